"""Quality rules by repetition: a suffix array over the words of each text.

For every text, suffixes of its word sequence are ranked by prefix doubling (whole Arrow batches at once; words of
different texts never compare equal).  Neighbouring suffixes with their longest common prefixes give the LCP intervals; a
suffix's deepest interval is the larger of its two neighbouring prefixes, and the spans of those intervals together cover
just what the maximal repeated substrings cover.  A text is rejected if spans of `min_repeat` words or more cover more
than `max_covered` of its words, or if its longest repeat has more than `max_longest` words.

Nulls, empty texts and texts of blanks have no words.  Repeated rows are judged each for itself; an empty table gives an
empty result.  Other columns of the input are ignored by `judge` and kept by `accepted`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from parlance.llm import bytelevel, frames, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    window: int = 5  # words, for the share of repeated words
    max_repeat_percent: int = 20
    min_repeat: int = 8  # words, from which a repeated substring counts as covered
    max_covered: float = 0.2
    max_longest: int = 50


def longest_repeats(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that begins there and occurs elsewhere in the same text too.

    `code`: words as integers; `at`: where each text begins, and the last ends.  Occurrences may overlap.
    """
    n = len(code)
    if n < 2:
        return np.zeros(n, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = doc * (int(code.max()) + 1) + code
    order = np.argsort(key, kind="stable")
    rank = classes(key[order], order, n)
    levels, step = [rank], 1
    while True:
        # a rank is the place of its class's first member in the suffix order: a class of one is settled
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        after = np.append(rank, -1)[np.minimum(active + step, n)]
        pair = rank[active].astype(np.int64) * (n + 1) + after + 1
        order = np.argsort(pair, kind="stable")
        pair, who = pair[order], active[order]
        mine = rank[who]
        first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        new = np.append(True, pair[1:] != pair[:-1])
        place = np.maximum.accumulate(np.where(new, np.arange(len(who)), 0)) - (np.arange(len(who)) - place)
        rank = rank.copy()
        rank[who] = mine + place
        levels.append(rank)
        step *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    i, j = suffix[:-1], suffix[1:]
    same = levels[0][i] == levels[0][j]
    i, j = i[same], j[same]
    common = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, z = i + common, j + common
        inside = np.maximum(a, z) < n
        r = levels[k]
        common += np.where(inside & (r[np.minimum(a, n - 1)] == r[np.minimum(z, n - 1)]), 1 << k, 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, i, common)
    np.maximum.at(out, j, common)
    return out


def classes(key: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Rank of each position whose sorted keys are `key`: the place of the first equal one."""
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return rank


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + length, -1)
    return np.cumsum(d[:-1]) > 0


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


COLUMNS = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "n_covered": pa.int64(), "longest_repeat": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, base_failed boolean, kept boolean"


def measure(ids: pa.Array, texts: pa.Array, rules: Rules) -> pa.RecordBatch:
    b, doc_at = bytelevel.batch_bytes(texts)
    w = words.split(b, doc_at)
    n = np.diff(w.at)
    longest = longest_repeats(w.code, w.at)
    total = len(w.code)
    short = np.flatnonzero(longest >= rules.window)
    windows = covered(short, np.full(len(short), rules.window), total)
    long = np.flatnonzero(longest >= rules.min_repeat)
    spans = covered(long, longest[long], total)
    most = np.zeros(len(n), np.int64)
    if total:
        full = np.flatnonzero(n)
        most[full] = np.maximum.reduceat(longest, w.at[:-1][full])
    lead = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(lead[w.end] - lead[w.start])])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    lines = np.fromiter((repeated_lines(t) for t in texts.to_pylist()), np.int64, len(n))
    repeat_words, n_covered = per_text(windows, w.at), per_text(spans, w.at)
    failed = (n < rules.min_words) | (100 * repeat_words > rules.max_repeat_percent * n)
    good = ~failed & (n_covered <= rules.max_covered * n) & (most <= rules.max_longest)
    return frames.batch(COLUMNS, doc_id=ids, n_words=n, word_chars=np.diff(chars[w.at]), n_symbols=per_text(symbol[b], doc_at), n_dup_lines=lines, n_repeat_words=repeat_words, n_covered=n_covered, longest_repeat=most, base_failed=failed, kept=good)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts and verdict for each row of `docs` (doc_id, text)."""

    def f(batches):
        for whole in batches:
            for part in bytelevel.slices(whole, "text", 2 << 20):
                yield measure(part.column(0), part.column(1), rules)

    return frames.map_arrow(frames.texts_of(docs), f, SCHEMA)


def accepted(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs`, all their columns, that the rules keep."""
    k = docs.columns.index("text")

    def f(batches):
        for whole in batches:
            filled = whole.append_column("_text", pc.fill_null(whole.column(k), ""))
            for part in bytelevel.slices(filled, "_text", 2 << 20):
                keep = measure(pa.nulls(len(part), pa.int64()), part.column(part.num_columns - 1), rules).column("kept")
                yield part.filter(keep).select(list(range(part.num_columns - 1)))

    return frames.map_rows(docs, f)
