"""Secret scanning: fixed patterns, and formats inferred from what they find.

One pass over the whole texts writes, for each row, the base spans and every other candidate (a run of the characters
that labelled values have, as short as they may be, with letters and digits), and counts the pairs of characters of running text.
Values of base spans are the labelled credentials: of each kind a bounded sample (`sample` distinct values of at most
`longest` characters, those of smallest hash) becomes a prefix tree over symbols: leading characters that many values share stand for
themselves, the others for the smallest class of characters that holds their piece of the value.  Subtrees with fewer than `visits`
values are no format.  Statistically compatible states (likelihood-ratio tests on all their futures, red and blue states) are merged into
a probabilistic automaton.  All candidates are then scored: one is a span of kind `format` if an automaton finds it about as likely as the
labelled values, and each of its characters on average `margin` (in nats) likelier than running text does.

Time is linear in a text's length, however many spans it holds.  Null texts are empty texts, which hold no spans.
Repeated rows give repeated results; with no labelled credentials nothing is added; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
import statistics
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import bytelevel, frames

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so a shorter run that fails hides nothing
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{6,}")  # as labelled values, with a digit
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I)


@dataclass(frozen=True)
class Rules:
    sample: int = 600  # labelled values of a kind that are learned from
    longest: int = 512  # characters of a value that may be one of them
    visits: int = 10  # values that a state, and so a format, must be seen with
    alpha: float = 0.05
    margin: float = 0.5  # nats a character by which a format must be likelier than running text
    least: int = 6  # characters of a candidate
    digit: bool = True  # whether a candidate must have one
    letter: bool = True


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value), by start, then kind as listed."""
    out = []
    if WORD.search(text):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def candidates(text: str, spans: list, rules: Rules = Rules()) -> list[tuple[int, int, str]]:
    """Runs of credential characters with a letter and a digit, without dots at their ends, and the pieces between their
    dots; those inside a base span (spans are sorted by start) are left out, those around one are not."""
    out, k, reach = [], 0, 0
    for m in (CANDIDATE if rules.digit else RUN).finditer(text):
        whole = m[0].strip(".")
        at = m.start() + m[0].index(whole)
        found = [(at, whole)]
        if "." in whole:
            found += [(at + p.start(), p[0]) for p in re.finditer(r"[^.]+", whole)]
        for a, s in found:
            while k < len(spans) and spans[k][0] <= a:
                reach = max(reach, spans[k][1])
                k += 1
            if a + len(s) <= reach or len(s) < rules.least or (rules.digit and not DIGIT.search(s)) or (rules.letter and not LETTER.search(s)):
                continue
            out.append((a, a + len(s), s))
    return out


#: Classes of characters, smallest first.
CLASSES = {f"<{c}>": re.compile(f"[{c}]+") for c in ("0-9", "a-f0-9", "A-F0-9", "a-z", "A-Z", "a-z0-9", "A-Z0-9", "A-Za-z", "A-Za-z0-9")}
MIXED = "<A-Za-z0-9>"  # with it, separators are part of the class too: in such values they are as random as letters
SIZES = {x: sum(bool(p.fullmatch(chr(c))) for c in range(128)) for x, p in CLASSES.items()} | {MIXED: 67}
LEADING = 4  # characters among which digits, too, may stand for themselves
MARKS = 16  # characters that may


class Alphabet:
    """How values are written in symbols, learned from a sample: which beginnings are so common that they stand for themselves."""

    def __init__(self, values: list[str], share: float = 0.2, least: int = 5):
        self.common = {""}
        now = {"": values}
        for i in range(MARKS):
            after: dict[str, list[str]] = {}
            for start, of in now.items():
                longer: dict[str, list[str]] = {}
                for v in of:
                    if len(v) > i and (i < LEADING or not v[i].isdigit()):
                        longer.setdefault(v[: i + 1], []).append(v)
                after |= {x: vs for x, vs in longer.items() if len(vs) >= max(least, share * len(of))}
            now = after
            self.common |= set(now)

    def symbols(self, value: str) -> list[str]:
        """Characters that stand for themselves, classes, then the end."""
        n = 0
        while n < len(value) and value[: n + 1] in self.common:
            n += 1
        out = list(value[:n])
        for i, piece in enumerate(value[n:].split(".")):
            out += ["."] * (i > 0)
            inner = "".join(c for c in piece if c.isalnum())
            if inner:
                kind = next(x for x, p in CLASSES.items() if p.fullmatch(inner))
                out += [kind if c.isalnum() or kind == MIXED else c for c in piece]
            else:
                out += list(piece)
        return out + [""]


@dataclass
class Automaton:
    """States with counts of leaving symbols and their targets."""

    alphabet: Alphabet
    counts: list[dict[str, int]] = field(default_factory=lambda: [{}])
    to: list[dict[str, int]] = field(default_factory=lambda: [{}])
    least: float = -math.inf

    def add(self, value: str) -> None:
        s = 0
        for x in self.alphabet.symbols(value):
            self.counts[s][x] = self.counts[s].get(x, 0) + 1
            if x:
                if x not in self.to[s]:
                    self.to[s][x] = len(self.to)
                    self.counts.append({})
                    self.to.append({})
                s = self.to[s][x]

    def prune(self, visits: int) -> None:
        """Cuts what fewer than `visits` values lead to; its counts stay where they leave the rest."""
        for s in range(len(self.to)):
            self.to[s] = {x: t for x, t in self.to[s].items() if self.counts[s][x] >= visits}

    def likelihood(self, value: str) -> tuple[float, float]:
        """Mean log-likelihood of a symbol, and that of the characters a character; unseen symbols and their futures have the smoothed floor."""
        s, total, all_of = 0, 0.0, self.alphabet.symbols(value)
        for x in all_of:
            n = sum(self.counts[s].values()) if s is not None else 0
            c = self.counts[s].get(x, 0) if s is not None else 0
            total += math.log((c + 0.05) / (n + 5))
            s = self.to[s].get(x) if s is not None else None
        inside = sum(math.log(SIZES[x]) for x in all_of if x in SIZES)
        return total / len(all_of), (total - inside) / len(all_of)

    def score(self, value: str) -> float:
        return self.likelihood(value)[0]

    def accepts(self, value: str) -> bool:
        """Whether the automaton's states lead through the whole value."""
        s = 0
        for x in self.alphabet.symbols(value):
            if not self.counts[s].get(x):
                return False
            if x and (s := self.to[s].get(x)) is None:
                return False
        return True

    @property
    def states(self) -> int:
        seen, todo = {0}, [0]
        while todo:
            more = set(self.to[todo.pop()].values()) - seen
            seen |= more
            todo += more
        return len(seen)


def surprise(c: int, n: int, d: int, m: int) -> float:
    """Likelihood-ratio statistic of c out of n and d out of m being draws with one probability (about chi-square of one degree)."""
    p = (c + d) / (n + m)
    parts = ((c, n * p), (n - c, n * (1 - p)), (d, m * p), (m - d, m * (1 - p)))
    return 2 * sum(o * math.log(o / e) for o, e in parts if o)


def compatible(a: Automaton, p: int, q: int, alpha: float) -> bool:
    """Whether all futures of two states may be draws from one distribution; what lies below q is a tree, so this ends."""
    todo = [(p, q)]
    most = statistics.NormalDist().inv_cdf(1 - alpha / 2) ** 2
    while todo:
        p, q = todo.pop()
        cp, cq = a.counts[p], a.counts[q]
        n, m = sum(cp.values()), sum(cq.values())
        if not n or not m:
            continue
        if any(surprise(cp.get(x, 0), n, cq.get(x, 0), m) > most for x in cp.keys() | cq.keys()):
            return False
        todo += [(a.to[p][x], a.to[q][x]) for x in a.to[p].keys() & a.to[q].keys()]
    return True


def merge(a: Automaton, red: int, blue: int) -> None:
    """Folds the tree below `blue` into `red`."""
    todo = [(red, blue)]
    while todo:
        p, q = todo.pop()
        if p == q:
            continue
        for x, c in a.counts[q].items():
            a.counts[p][x] = a.counts[p].get(x, 0) + c
        for x, t in a.to[q].items():
            if x in a.to[p]:
                todo.append((a.to[p][x], t))
            else:
                a.to[p][x] = t


def infer(values: list[str], rules: Rules = Rules()) -> Automaton | None:
    """The automaton of labelled values: their prefix tree with compatible states merged; None if no format has values enough."""
    a = Automaton(Alphabet(values))
    for v in sorted(values):
        a.add(v)
    a.prune(rules.visits)
    if not a.to[0]:
        return None
    red, blue = [0], [(0, x) for x in sorted(a.to[0])]
    while blue:
        blue.sort(key=lambda e: (-sum(a.counts[a.to[e[0]][e[1]]].values()), e))
        s, x = blue.pop(0)
        t = a.to[s][x]
        if t in red:
            continue
        for r in red:
            if compatible(a, r, t, rules.alpha):
                a.to[s][x] = r
                merge(a, r, t)
                break
        else:
            red.append(t)
        known = set(red)
        blue = sorted({(r, y) for r in red for y, u in a.to[r].items() if u not in known})
    scores = sorted(a.score(v) for v in values if a.accepts(v))
    a.least = scores[len(scores) // 100] - 0.15 if scores else math.inf
    return a


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODES = np.zeros(256, np.uint8)  # number of each credential character, from 1 on; 0 for all others
CODES[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(1, len(LETTERS) + 1)
N = len(LETTERS) + 1


def char_pairs(b: np.ndarray) -> np.ndarray:
    """How often each credential character, or a border of a run, follows each (N x N, flat)."""
    c = CODES[b].astype(np.int64)
    out = np.bincount(c[:-1] * N + c[1:], minlength=N * N) if len(c) > 1 else np.zeros(N * N, np.int64)
    out[0] = 0
    return out


class Background:
    """What else a run may be: a word of running text, as pairs of characters counted in all texts, or a number of any
    sort (a date, a version), in which a character's successor is mostly of its own sort (digit, lower case, upper case, other).
    """

    def __init__(self, pairs: np.ndarray, prior: float = 50.0):
        sort = np.array([0, *(1 + (c.islower() + 2 * c.isupper() + 3 * c.isdigit()) for c in LETTERS)])
        own = sort[:, None] == sort[None, :]
        before = np.where(own, 0.8, 0.05) / np.array([(sort == x).sum() for x in sort])[None, :]
        n = np.maximum(pairs, 0).reshape(N, N) + prior * before
        self.logs = [np.log(x / x.sum(1, keepdims=True)) for x in (n, before)]

    def score(self, value: str) -> float:
        """Mean log-likelihood of a character, the end among them, as what it is likelier to be."""
        c = np.concatenate([[0], CODES[np.frombuffer(value.encode(), np.uint8)], [0]])
        return max(float(log[c[:-1], c[1:]].sum()) for log in self.logs) / (len(c) - 1)


FOUND = "doc_id long, base array<struct<start:int,end:int,kind:string,value:string>>, rest array<struct<start:int,end:int,value:string>>, pairs array<long>"


def find(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Base spans and candidates of each row; a row more a task has the pairs of characters of its running text, and neither."""

    def f(batches):
        base = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        rest = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        kind = {"doc_id": pa.int64(), "base": base, "rest": rest, "pairs": pa.list_(pa.int64())}
        pairs = np.zeros(N * N, np.int64)
        for whole in batches:
            for part in bytelevel.slices(whole, "text"):
                spans, others = [], []
                for t in part.column(1).to_pylist():
                    s = base_spans(t)
                    spans.append([dict(zip(("start", "end", "kind", "value"), x)) for x in s])
                    others.append([dict(zip(("start", "end", "value"), x)) for x in candidates(t, s, rules)])
                b, _ = bytelevel.batch_bytes(part.column(1))
                labelled = " ".join(x["value"] for s in spans for x in s)
                pairs += char_pairs(b) - char_pairs(np.frombuffer(f" {labelled} ".encode(), np.uint8))
                yield frames.batch(kind, doc_id=part.column(0), base=spans, rest=others, pairs=[None] * len(part))
        if pairs.any():
            yield frames.batch(kind, doc_id=[None], base=[None], rest=[None], pairs=[pairs])

    return frames.map_arrow(frames.texts_of(docs), f, FOUND)


def sampled(values: DataFrame, most: int) -> list[str]:
    """At most `most` distinct values, those of smallest hash."""
    return [r[0] for r in values.distinct().orderBy(F.xxhash64("value"), "value").limit(most).collect()]


def learn(found: DataFrame, rules: Rules = Rules()) -> tuple[dict[str, Automaton], Background]:
    """Automata of the kinds that have labelled values enough, and the background of all texts."""
    labelled = found.select(F.explode("base").alias("s")).select("s.kind", "s.value").filter(F.length("value") <= rules.longest)
    out = {}
    for kind in KINDS[:3]:
        got = sampled(labelled.filter(F.col("kind") == kind).select("value"), rules.sample)
        if got and (a := infer(got, rules)):
            out[kind] = a
    pairs = np.zeros(N * N)
    for r in found.select(F.posexplode("pairs")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # N * N rows at most
        pairs[r["pos"]] = r["n"]
    return out, Background(pairs)


def scan(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id and spans: array of (start, end, kind, value), by start, then kind."""
    found = frames.kept(find(docs, rules), "secrets")
    models, background = learn(found, rules)

    def f(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

        def secret(value: str) -> bool:
            for m in models.values():
                whole, chars = m.likelihood(value)
                if whole >= m.least and chars >= background.score(value) + rules.margin:
                    return True
            return False

        for part in batches:
            out = []
            for base, rest in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                more, end = [], 0  # a run comes before its pieces, which add nothing to one that is found
                for x in rest:
                    if x["end"] > end and secret(x["value"]):
                        more.append(x | {"kind": "format"})
                        end = x["end"]
                out.append(sorted([*base, *more], key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"])))
            yield frames.batch({"doc_id": pa.int64(), "spans": kind}, doc_id=part.column(0), spans=out)

    return frames.map_arrow(found.filter("base is not null").select("doc_id", "base", "rest"), f, "doc_id long, spans array<struct<start:int,end:int,kind:string,value:string>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans as text."""
    named = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), count("format"))


def redact(text: str, spans: list) -> str:
    """A text with its secrets masked; for callers that hold both."""
    out, at = [], 0
    for a, z in sorted((x["start"], x["end"]) for x in spans):
        if z > at:
            out += [text[at : max(a, at)], "*" * (z - max(a, at))]
            at = z
    return "".join([*out, text[at:]])


