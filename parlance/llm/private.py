"""Personal data: detected entities are replaced by keyed surrogates of the same type, script and format.

A surrogate is the image of the entity under a keyed permutation of all strings of its format: letters stay letters of their
script, case and sort (vowel or consonant), digits stay digits, separators, titles and country codes stay, check digits
hold again where they held.  The permutation is one cycle (x -> p^-1(p(x) + 1) under a Feistel permutation p), so no
entity keeps its value and two entities of one format never meet: distinctness and coreference hold over the whole corpus
without any shared state, on any machine.  Each batch checks that again while it replaces (a second surrogate is drawn if
two ever met), and `collisions` checks it over a whole table.

Names: given names of the list become others of their gender and length, all other names keep their last letter (it
often marks gender).  A name is found after a form of address or by a listed given name before a capitalised word; its
words are then replaced wherever the text has them, titled or not.  Dates of birth stay valid dates of their format and
century; addresses keep their kind of street.

The key is a required argument: who has it can undo the surrogates.

Time is linear in a text's length, however dense its entities are: every pattern has bounded parts.  An e-mail's local part
is the last 64 characters before its @ (longer ones aren't addresses), a domain has 253 at most, a word of a name 40.
Octets are taken as written, so 1.2.3.4 and 01.2.3.4 are two entities.

Null texts stay null in `replaced` and are empty in `scan`; empty texts and tables give empty results; repeated rows are
replaced alike; other columns pass through.  Lengths don't change.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import bytelevel, frames

TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Monsieur Madame Señor Señora Sr Sra Srta".split()
GIVEN = {
    "f": """Ana Ava Eva Ida Ina Lea Mia Zoe Anna Alba Cora Elsa Emma Erin Inés Inga Jane Lena Lisa Lucy Maja Mary Nina Nora Olga Ruth Sara Vera Alice Anita
        Berta Birte Carla Celia Chloé Clara Diana Elena Elisa Emily Erika Fanny Greta Heike Helen Irene Julia Laura Lucía María Marie Marta Paula Petra Sofia Susan Amélie
        Barbara Brigit Camila Carmen Claire Gisela Hannah Ingrid Jessie Louise Manuela Monika Sabine Sandra Teresa Ursula Yvonne""".split(),
    "m": """Ali Ben Jan Leo Max Tim Tom Adam Alan Axel Carl Eric Eliot Emil Fred Gary Hans Hugo Iván Jack Jens John José Juan Karl Kurt Luis Marc Neil Noah Otto Paul
        Pere Ralf René Sven Uwe Aaron Brian Bruno David Diego Ernst Felix Franz Henri Henry Jakob James Jorge Jules Kevin Klaus Lukas Marco Mario Oscar Pablo Peter Simon
        Alfred Andrés Daniel Dieter Dennis Edward Fabian George Gérard Johann Jürgen Martin Miguel Robert Stefan Thomas Vicente William""".split(),
}
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct rue avenue boulevard chemin impasse Calle Avenida Plaza Paseo Camino de du des del la le las los el den der".split()
WORD = r"[^\W\d_a-z][^\W\d_]{1,39}(?:[-'’][^\W\d_]{1,40}){0,3}(?!\w)"
INITIALS = r"(?:[^\W\d_a-z]\.? ){0,3}"
DATE = r"(?a:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}(?P<mark>[./-])\d{1,2}(?P=mark)\d{4})(?!\w)"
DOMAIN = re.compile(r"(?a:@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9]))")
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+-"
PATTERNS = {
    "ip": re.compile(r"(?a:(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"),
    "iban": re.compile(r"(?a:\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b)"),
    "card": re.compile(r"(?a:(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w))"),
    "ssn": re.compile(r"(?a:(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"),
    "phone": re.compile(r"(?a:(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5})(?!\w))"),
    "birth": re.compile(rf"\b(?i:born(?: on)?|date of birth|birth ?date|dob|né(?:e)? le|geboren am|nacid[oa] el)[: ]{{1,3}}(?P<value>{DATE})"),
    "address": re.compile(
        rf"(?<![\w.])(?:\d{{1,5}} (?:{WORD} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct)\b"
        rf"|\d{{1,4}},? (?:rue|avenue|boulevard|chemin|impasse) (?:(?:de|du|des|la|le) ){{0,2}}{WORD}"
        rf"|(?:Calle|Avenida|Plaza|Paseo|Camino) (?:(?:de|del|la|las|los|el) ){{0,2}}{WORD},? \d{{1,4}}\b"
        r"|[^\W\d_a-z][^\W\d_]{1,30}(?:straße|strasse|gasse|allee) \d{1,4}[a-z]?\b)"
    ),
    "name": re.compile(rf"\b(?:{'|'.join(TITLES)})\b\.? {INITIALS}(?P<first>{WORD})(?: (?P<more>{WORD}))?"),
}
PAIR = re.compile(rf"\b(?P<first>[^\W\d_a-z][^\W\d_]{{1,39}}) {INITIALS}(?P<more>{WORD})")
PART = re.compile(r"[^\W\d_]+")
HINT = r"[0-9@]|\b(?:" + "|".join([*TITLES, *GIVEN["f"], *GIVEN["m"]]) + r")\b"


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses: from each @ on to the domain's end, and back over the local part."""
    out, after = [], 0
    for m in DOMAIN.finditer(text):
        lo = max(after, m.start() - 65)
        a = lo + len(text[lo : m.start()].rstrip(LOCAL))
        a = max(a, m.start() - 64)
        if a < m.start() and text[m.start() - 1] not in ".+-" and m.end() - m.start() <= 254:
            out.append((a, m.end()))
            after = m.end()
    return out


def found_names(text: str) -> list[tuple[int, int]]:
    """Titled names, listed given names with the word that follows, and all other mentions of their words."""
    out, known = [], set()

    def take(a: int, m: re.Match) -> None:
        z = m.end("more") if m["more"] and m["more"][0].isupper() else m.end("first")
        out.append((a, z))
        known.update(w[0] for w in PART.finditer(text, m.start("first"), z) if len(w[0]) > 1)

    for m in PATTERNS["name"].finditer(text):
        if m["first"][0].isupper():
            take(m.start(), m)
    at = 0
    while m := PAIR.search(text, at):
        listed = SORTS.get(folded(m["first"])) in ("f", "m") and m["more"][0].isupper()
        if listed:
            take(m.start(), m)
        at = m.end() if listed else m.end("first")
    if known:
        out += [m.span() for m in re.finditer(r"(?<!\w)[^\W\d_]+(?!\w)", text) if m[0] in known]
    return out


def spans_of(kind: str, text: str) -> list[tuple[int, int]]:
    if kind == "email":
        return emails(text) if "@" in text else []
    if kind == "name":
        return found_names(text)
    hits = PATTERNS[kind].finditer(text)
    if kind == "ip":
        return [m.span() for m in hits if all(int(x) < 256 for x in m[0].split("."))]
    if kind == "birth":
        return [m.span("value") for m in hits if date_sort(m["value"])]
    if kind == "address":
        return [m.span() for m in hits if all(w[0][0].isupper() or SORTS.get(folded(w[0])) == "street" or len(w[0]) == 1 for w in PART.finditer(m[0]))]
    return [m.span() for m in hits]


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) without overlaps; kinds listed first win, e-mails before all, and what they cover others don't see."""
    out, rest = [], text
    for kind in ("email", *PATTERNS):
        hits, end = [], -1
        for a, z in sorted(spans_of(kind, rest), key=lambda x: (x[0], -x[1])):
            if a >= end:
                hits.append((a, z))
                end = z
        if hits:
            pieces, at = [], 0
            for a, z in hits:
                pieces += [rest[at:a], "\0" * (z - a)]
                at = z
            rest = "".join([*pieces, rest[at:]])
            out += [(a, z, kind) for a, z in hits]
    return sorted(out)


class Permutation:
    """A keyed permutation of 0 .. n-1 (Feistel network over the next even number of bits, walked until it falls inside)."""

    def __init__(self, key: bytes, tweak: str, n: int, rounds: int = 8):
        self.n, self.rounds = n, rounds
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.start = hashlib.blake2b(f"{tweak}/{n}".encode(), key=key[:64], digest_size=16).digest()

    def _round(self, k: int, x: int) -> int:
        need = (self.half + 7) // 8
        out = b""
        while len(out) < need:
            out += hashlib.blake2b(x.to_bytes(need, "little") + bytes([k, len(out) & 255]), key=self.start, digest_size=min(64, need)).digest()
        return int.from_bytes(out[:need], "little") & self.mask

    def forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for k in range(self.rounds):
                a, b = b, a ^ self._round(k, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def back(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for k in reversed(range(self.rounds)):
                a, b = b ^ self._round(k, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def next(self, x: int) -> int:
        """The successor of x on one cycle through all n."""
        return self.back((self.forward(x) + 1) % self.n)


@functools.lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """Characters that may stand for `c`: of its script, case and sort; those of which it is one.

    Only letters whose two cases are one character each have others: the rest (ß, İ, ǅ) stand for themselves.
    """
    if c.isdigit() and c.isascii():
        return "0123456789"
    low = c.lower()
    if not c.isalpha() or not cased(low) or c not in (low, low.upper()):
        return c
    if low.isascii():
        group = "aeiouy" if low in "aeiouy" else "bcdfghjklmnpqrstvwxz"
    else:
        script = unicodedata.name(low, "").split(" ")[0]
        lo = ord(low) & ~0x3F
        of = [x for x in map(chr, range(lo, lo + 64)) if cased(x) and x.lower() == x and unicodedata.name(x, "").split(" ")[0] == script]
        group = "".join(x for x in of if is_vowel(x) == is_vowel(low))
    if c != low:
        group = group.upper()
    return group if c in group else c


def is_vowel(low: str) -> bool:
    return unicodedata.normalize("NFD", low)[0] in "aeiouyаеиоуыэюяαειουωη"


def cased(low: str) -> bool:
    """Whether a lower-case character and its upper case are one character each and lead to each other."""
    up = low.upper()
    return len(low) == len(up) == 1 and up != low and up.lower() == low


def permuted(key: bytes, kind: str, value, choices: list):
    """`value` (a string, or a list of strings) under the keyed cycle of all that take their i-th part from choices[i]."""
    n, x = 1, 0
    for c, of in zip(value, choices):
        x = x * len(of) + of.index(c)
        n *= len(of)
    if n == 1:
        return value
    skeleton = "|".join("".join(of) if len(of) < 3 else of[0] + of[-1] + str(len(of)) for of in choices)
    y = Permutation(key, f"{kind}/{hashlib.sha256(skeleton.encode()).hexdigest()}", n).next(x)
    out = []
    for of in reversed(choices):
        y, k = divmod(y, len(of))
        out.append(of[k])
    return "".join(reversed(out)) if isinstance(value, str) else out[::-1]


def luhn(digits: str) -> str:
    """The check digit that makes `digits` and it valid."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def fill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def octet_set(p: str) -> list[str]:
    """Octets that are written as `p` is: as many zeros before as many digits."""
    core = str(int(p))
    return ["0" * (len(p) - len(core)) + str(x) for x in range(256) if len(str(x)) == len(core)]


def date_sort(value: str) -> tuple | None:
    """What a date of birth must share with its surrogate (order, separator, widths, century); None if it isn't a date."""
    parts = re.split("[./-]", value)
    iso = len(parts[0]) == 4
    year, (a, b) = (parts[0], parts[1:]) if iso else (parts[2], parts[:2])
    order = "ymd" if iso else "mdy" if int(b) > 12 else "dmy" if int(a) > 12 else "both"
    day, month = (a, b) if order in ("dmy", "both") else (b, a)
    try:
        datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None
    if not 1800 <= int(year) < 2100:
        return None
    return order, re.sub(r"\d", "", value)[0], len(a), len(b), year[:2]


def next_date(key: bytes, value: str) -> str:
    """The next date of the same sort on the keyed cycle through its century."""
    sort = date_sort(value)
    order, mark, a, b, century = sort
    start = datetime.date(int(century) * 100, 1, 1)
    days = (datetime.date(int(century) * 100 + 99, 12, 31) - start).days + 1
    steps = Permutation(key, f"birth/{sort}", days)
    parts = [int(x) for x in re.split("[./-]", value)]
    y, m, d = parts if order == "ymd" else (parts[2], *(parts[:2] if order == "mdy" else parts[1::-1]))
    at = (datetime.date(y, m, d) - start).days
    while True:
        at = steps.next(at)
        day = start + datetime.timedelta(at)
        m, d = str(day.month), str(day.day)
        first, second = (d, m) if order in ("dmy", "both") else (m, d)
        parts = [first.zfill(a), second.zfill(b)]
        text = mark.join([str(day.year), *parts] if order == "ymd" else [*parts, str(day.year)])
        if date_sort(text) == sort:
            return text


@functools.lru_cache(maxsize=100_000)
def surrogate(kind: str, value: str, key: bytes) -> str:
    digits = "".join(c for c in value if c.isdigit())
    if kind == "email":
        at = value.rindex(".")
        low = value[:at].lower()
        new = permuted(key, kind, low, [alphabet(c) for c in low]) + value[at:]
        return "".join(b.upper() if a.isupper() and b.isalpha() else b for a, b in zip(value, new))
    if kind == "ip":
        parts = value.split(".")
        return ".".join(permuted(key, kind, parts, [octet_set(p) for p in parts]))
    if kind == "iban":  # how far the check digits are from the right ones stays, so right ones stay right
        body = permuted(key, kind, value[4:], [alphabet(c) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in value[4:]])
        off = int(value[2:4]) - int(iban_check(value[:2], value[4:]))
        return f"{value[:2]}{(int(iban_check(value[:2], body)) + off) % 100:02d}{body}"
    if kind == "card":
        body = permuted(key, kind, digits[:-1], [digits[0], *["0123456789"] * (len(digits) - 2)])
        off = int(digits[-1]) - int(luhn(digits[:-1]))
        return fill(value, body + str((int(luhn(body)) + off) % 10))
    if kind == "phone":
        stay = len(m[1]) if (m := re.match(r"\+(1|\d{1,3}(?=[ .(-])|\d{2})", value)) else 0
        if not m and len(digits) == 11:
            stay = 1
        head = lambda d: "01" if d in "01" else "23456789"
        sets = [*digits[:stay], *(head(d) if i in (0, 3) else "0123456789" for i, d in enumerate(digits[stay:]))]
        return fill(value, permuted(key, kind, digits, sets))
    if kind == "birth":
        return next_date(key, value)
    if kind == "address":
        number = re.search(r"\d+", value)
        new = permuted(key, kind, number[0], ["123456789" if i == 0 and d != "0" else "0" if i == 0 else "0123456789" for i, d in enumerate(number[0])])
        word = lambda m: m[0] if len(m[0]) == 1 or SORTS.get(folded(m[0])) == "street" else street_part(m[0], key)
        return PART.sub(word, value[: number.start()]) + new + PART.sub(word, value[number.end() :])
    if kind == "name":
        title = m[0] if (m := re.match(rf"(?:{'|'.join(TITLES)})\b\.? ", value)) else ""
        return title + PART.sub(lambda m: name_part(m[0], key), value[len(title) :])
    return fill(value, permuted(key, kind, digits, ["0123456789"] * len(digits)))


def folded(name: str) -> str:
    """In lower case, but for letters whose cases aren't one character each."""
    return "".join(c.lower() if cased(c.lower()) and c.lower().upper() == c else c for c in name)


#: Words that are permuted among those of their sort and length, so that no other word becomes one of them.
SORTS = {folded(n): g for g, names in {**GIVEN, "street": STREETS, "title": TITLES}.items() for n in names}
LISTED = {(g, len(n)): sorted(x for x, h in SORTS.items() if h == g and len(x) == len(n)) for n, g in SORTS.items()}


def name_part(name: str, key: bytes) -> str:
    """Another name of the same length, script, case and (as a listed name tells it) gender; however its letters' cases are, the same one."""
    low = folded(name)
    if sort := SORTS.get(low):
        of = LISTED[sort, len(low)]
        new = of[Permutation(key, f"{sort}/{len(low)}", len(of)).next(of.index(low))]
    else:
        new, sets = low, [alphabet(c) for c in low[:-1]] + [low[-1]]
        while (new := permuted(key, "name", new, sets)) in SORTS:  # past listed words; the cycle has `low` itself at the latest
            pass
    return "".join(b.upper() if a != c else b for a, c, b in zip(name, low, new))


def street_part(word: str, key: bytes) -> str:
    """As name_part; the ending that tells the kind of street stays."""
    end = next((e for e in ("straße", "strasse", "gasse", "allee") if word.endswith(e)), "")
    return name_part(word[: len(word) - len(end)], key) + end


class Replacer:
    """Replaces in a stream of texts and holds the two sides of the map against each other."""

    def __init__(self, key: bytes, most: int = 200_000):
        self.key, self.most, self.back = key, most, {}

    def one(self, kind: str, value: str) -> str:
        """The surrogate; another one if two entities ever met in theirs."""
        key = self.key
        while True:
            new = surrogate(kind, value, key)
            if self.back.setdefault((kind, new), value) == value:
                return new
            key = hashlib.blake2b(key, digest_size=32).digest()

    def __call__(self, text: str) -> tuple[str, list]:
        """The new text, and its entities (start, end, kind, surrogate)."""
        out, found, at = [], [], 0
        for a, z, kind in entities(text):
            new = self.one(kind, text[a:z])
            found.append((a, z, kind, new))
            out += [text[at:a], new]
            at = z
        if len(self.back) > self.most:
            self.back.clear()
        return "".join([*out, text[at:]]), found


def rewrite(texts: pa.Array, replace: Replacer) -> tuple[list, list]:
    """New texts and their entities; texts without any hint aren't searched."""
    hint = pc.match_substring_regex(texts, HINT).to_pylist()
    new, found = [], []
    for t, h in zip(texts.to_pylist(), hint):
        t, e = replace(t) if h else (t, [])
        new.append(t)
        found.append(e)
    return new, found


def scan(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, and the entities: (start, end, kind, surrogate), in code points of the old text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))

    def f(batches):
        replace = Replacer(key)
        for whole in batches:
            for part in bytelevel.slices(whole, "text"):
                new, found = rewrite(part.column(1), replace)
                spans = [[dict(zip(("start", "end", "kind", "surrogate"), x)) for x in e] for e in found]
                yield frames.batch({"doc_id": pa.int64(), "text": pa.string(), "entities": kind}, doc_id=part.column(0), text=new, entities=spans)

    return frames.map_arrow(frames.texts_of(docs), f, "doc_id long, text string, entities array<struct<start:int,end:int,kind:string,surrogate:string>>")


def replaced(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """`docs` with surrogates in its text; all other columns as they are (lengths don't change)."""
    k = docs.columns.index(text)

    def f(batches):
        replace = Replacer(key)
        for whole in batches:
            name = whole.schema.names[k]
            filled = whole.set_column(k, name, pc.fill_null(whole.column(k), ""))
            for part, old in zip(bytelevel.slices(filled, name), parts_like(whole, filled, name)):
                new, _ = rewrite(part.column(k), replace)
                again = pa.array(new, whole.column(k).type, mask=old.column(k).is_null().to_numpy(zero_copy_only=False))
                yield part.set_column(k, whole.schema.field(k), again)

    return frames.map_rows(docs, f)


def parts_like(whole: pa.RecordBatch, filled: pa.RecordBatch, name: str):
    lo = 0
    for part in bytelevel.slices(filled, name):
        yield whole.slice(lo, len(part))
        lo += len(part)


def collisions(originals: DataFrame, key: bytes) -> DataFrame:
    """Surrogates of several distinct entities among rows (kind, value); none, if all is well."""

    def f(batches):
        for part in batches:
            k, v = part.column(0).to_pylist(), part.column(1).to_pylist()
            yield frames.batch({"kind": pa.string(), "value": pa.string(), "surrogate": pa.string()}, kind=k, value=v, surrogate=[surrogate(a, b, key) for a, b in zip(k, v)])

    made = frames.map_arrow(originals.select("kind", "value").distinct(), f, "kind string, value string, surrogate string")
    return made.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).filter("n > 1")
