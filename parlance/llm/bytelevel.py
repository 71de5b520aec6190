"""Byte-level BPE pre-tokenisation on whole Arrow batches, and a word table on top of it.

The vocabulary files of this family split text by the published pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

`split_words` finds the same cuts with NumPy on the UTF-8 bytes of a batch: one class per byte, cuts where the
class changes, then the rules for blanks and contractions.  Words repeat, so an encoder only has to
see the distinct ones; `WordTable` keeps their ids in flat arrays and expands a batch by gathers.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, OTHER, BLANK = 1, 2, 3, 4

# Code points of the White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
WHITE_TEXT = tuple(chr(c) for c in WHITE_SPACE if c != 32)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = BLANK
    return out


def byte_classes(b: np.ndarray) -> np.ndarray:
    """Class of each byte: that of the character it belongs to."""
    table = classes()
    out = table[:256][b]
    lead = np.flatnonzero(b >= 0xC0)
    if not len(lead):
        return out
    v = b[lead].astype(np.int32)
    width = 2 + (v >= 0xE0) + (v >= 0xF0)
    cp = np.where(width == 2, v & 0x1F, np.where(width == 3, v & 0x0F, v & 0x07))
    for k in range(1, 4):
        more = width > k
        cp[more] = (cp[more] << 6) | (b[lead[more] + k] & 0x3F)
    kind = table[cp]
    out[lead] = kind
    for k in range(1, 4):
        more = width > k
        out[lead[more] + k] = kind[more]
    return out


def split_words(b: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Byte positions where words begin, in texts that lie end to end in `b` and begin at `doc_at`.

    Texts may be empty (then `doc_at` repeats); no word crosses from one text to the next.
    """
    n = len(b)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(b)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    first = np.zeros(n + 1, bool)
    first[doc_at] = True
    cut |= first
    # the last blank of a run goes with the next word if it is a plain space, else stands alone
    at = np.flatnonzero(cut[1:n] & ~first[1:n]) + 1
    at = at[(kind[at] != BLANK) & (kind[at - 1] == BLANK)]
    # width of that last blank: a plain space or another ASCII blank is one byte
    last = at - 1
    while len(wide := np.flatnonzero((b[last] & 0xC0) == 0x80)):
        last[wide] -= 1
    cut[last] = True
    cut[at[b[last] == 32]] = False
    q = np.flatnonzero(b == 39)
    q = q[cut[q]]
    q = q[q + 1 < n]
    q = q[~first[q + 1] & (kind[q + 1] == LETTER)]
    if len(q):
        one = np.isin(b[q + 1], np.frombuffer(b"stmd", np.uint8))
        ok2 = (q + 2 < n) & ~first[np.minimum(q + 2, n)]
        c1, c2 = b[q + 1], b[np.minimum(q + 2, n - 1)]
        two = ok2 & (((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108)))
        for hit, width in ((one, 2), (two, 3)):
            cut[q[hit] + 1] = False
            cut[q[hit] + width] = True
    return np.flatnonzero(cut[:n])


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, end to end, and where each text begins and the last ends."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return b, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch whose texts have about `most` bytes together (one longer text is a part of its own)."""
    k = batch.schema.get_field_index(column)
    size = np.zeros(len(batch), np.int64) + 8
    got = np.asarray(pc.fill_null(pc.binary_length(batch.column(k)), 0), np.int64)
    size += got
    total = np.cumsum(size)
    lo = 0
    while lo < len(batch):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class WordTable:
    """Ids of distinct words, filled by `encode(list of words) -> (ids end to end, how many of each)`; forgets all beyond `most` words.

    The words are one Arrow array, so a million of them take some ten megabytes.
    """

    def __init__(self, encode, most: int = 800_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self):
        self.known = pa.array([], pa.binary())
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.n = np.zeros(1 << 14, np.int32)
        self.used = 0

    def rows(self, words: pa.Array) -> np.ndarray:
        """Row of each distinct word."""
        if len(self.known) + len(words) > self.most and len(self.known) > self.most // 2:
            self.clear()
        out = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known), -1), np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = words.take(pa.array(missing))
            ids, n = self.encode(new.to_pylist())
            first, total = len(self.known), len(ids)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while first + len(new) > len(self.at):
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
                self.n = np.concatenate([self.n, np.zeros_like(self.n)])
            self.flat[self.used : self.used + total] = ids
            self.at[first : first + len(new)] = self.used + np.cumsum(n) - n
            self.n[first : first + len(new)] = n
            self.used += total
            self.known = pa.concat_arrays([self.known, new])
            out[missing] = np.arange(first, first + len(new))
        return out

    def encode_texts(self, b: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin and the last end."""
        at = split_words(b, doc_at[:-1])
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(len(doc_at), np.int64)
        ends = np.append(at, len(b)).astype(np.int32 if len(b) < 2**31 else np.int64)
        kind = pa.binary() if ends.dtype == np.int32 else pa.large_binary()
        words = pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(b))])
        coded = words.dictionary_encode()
        rows = self.rows(coded.dictionary.cast(pa.binary()))[coded.indices.to_numpy()]
        n = self.n[rows]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1])
        ids = self.flat[np.repeat(self.at[rows] - (ends - n), n) + np.arange(total)]
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(at, doc_at, "left")]


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    `words(list of bytes) -> list of id lists` encodes distinct words; without it the library itself does.
    Strings of added tokens in a text become their ids, as in the library.
    """

    def __init__(self, path: str, words=None, most: int = 800_000):
        self.special = special_tokens(path)
        self.table = WordTable(words or library_words(path), most)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) end to end, and where each text's ids begin and the last end."""
        has = np.zeros(len(texts), bool)
        for s in self.special:
            has |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not has.any():
            return self.table.encode_texts(*batch_bytes(texts))
        parts, cuts = [], []  # the texts between added tokens, and the id that follows each (-1: the text's end)
        for t, h in zip(texts.to_pylist(), has):
            for piece, k in cut_special(t, self.special) if h else [(t, -1)]:
                parts.append(piece)
                cuts.append(k)
        ids, at = self.table.encode_texts(*batch_bytes(pa.array(parts, pa.large_string())))
        cuts = np.array(cuts)
        ids = np.insert(ids, at[1:][cuts >= 0], cuts[cuts >= 0])
        ends = at[1:] + np.cumsum(cuts >= 0)
        return ids, np.concatenate([[0], ends[cuts < 0]])


def cut_special(text: str, special: dict[str, int]) -> list[tuple[str, int]]:
    """The pieces between added tokens, each with the id that follows it, or -1 at the end."""
    import re

    out, at = [], 0
    for m in re.finditer("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)), text):
        out.append((text[at : m.start()], special[m[0]]))
        at = m.end()
    return [*out, (text[at:], -1)]


def load_tokenizer(path: str):
    """The library's tokenizer, without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for y in ids for x in y), np.int32, int(n.sum())), n


def library_words(path: str, together: int = 500):
    """Words as the library encodes them: many in one text with line feeds between, which are words of their own there.

    Words of blanks would run into those, and go alone.
    """
    t = load_tokenizer(path)
    t.encode_special_tokens = True
    many = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    feed = many(["\n"])[0]

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        said = [w.decode() for w in words]
        alone = [i for i, w in enumerate(said) if w.isspace() or w[-1:].isspace() or w[:1] in WHITE_TEXT]
        if len(feed) != 1 or len(alone) > len(said) // 2:
            return flat(many(said))
        apart = dict(zip(alone, many([said[i] for i in alone])))
        rest = [w for i, w in enumerate(said) if i not in apart] if apart else said
        ids = [np.array(x, np.int32) for x in many(["\n".join(rest[i : i + together]) + "\n" for i in range(0, len(rest), together)])]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        ends = np.flatnonzero(ids == feed[0])
        if len(ends) != len(rest):
            return flat(many(said))
        n = np.diff(np.concatenate([[-1], ends])) - 1
        ids = np.delete(ids, ends)
        if not apart:
            return ids, n
        parts = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
        it = iter(parts)
        return flat([apart[i] if i in apart else next(it).tolist() for i in range(len(said))])

    return encode


@functools.lru_cache(maxsize=4)
def shared_encoder(path: str) -> Encoder:
    """One encoder a worker process, so that its word table lasts over tasks."""
    return Encoder(path)
