"""Words `[^\\x20\\x09-\\x0D]+` of whole Arrow batches, as codes into the batch's own dictionary."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True


@dataclass
class Words:
    start: np.ndarray  # byte position of each word
    end: np.ndarray
    code: np.ndarray  # into dictionary
    dictionary: pa.Array  # binary
    at: np.ndarray  # word number where each text begins, and the last ends

    @property
    def doc(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def split(b: np.ndarray, doc_at: np.ndarray) -> Words:
    """Words of texts that lie end to end in `b`; `doc_at` has where each begins, and the last ends."""
    n = len(b)
    ink = np.zeros(n + 2, bool)
    ink[1:-1] = ~BLANK[b]
    first = np.zeros(n + 2, bool)
    first[doc_at[:-1] + 1] = True
    first[n + 1] = True
    start = np.flatnonzero(ink[1:-1] & (~ink[:-2] | first[1:-1]))
    end = np.flatnonzero(ink[1:-1] & (~ink[2:] | first[2:])) + 1
    at = np.searchsorted(start, doc_at, "left")
    if not len(start):
        return Words(start, end, np.zeros(0, np.int64), pa.array([], pa.binary()), at)
    # words and the gaps between them, in turn, as one binary array
    marks = np.empty(2 * len(start), np.int32)
    marks[0::2], marks[1::2] = start, end
    both = pa.Array.from_buffers(pa.binary(), len(marks) - 1, [None, pa.py_buffer(marks), pa.py_buffer(np.ascontiguousarray(b))])
    coded = both.dictionary_encode()
    return Words(start, end, coded.indices.to_numpy()[0::2].astype(np.int64), coded.dictionary, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) on an array of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(dictionary: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word."""
    import xxhash

    f = xxhash.xxh3_64_intdigest
    return np.fromiter(map(f, dictionary.to_pylist()), np.uint64, len(dictionary))


def shingles(code_hash: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words within a text, and where each text's runs begin and the last end.

    A text of fewer words, but at least one, has the run of all its words.
    """
    n = np.diff(at)
    out_n = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(out_n)])
    total = int(out_at[-1])
    doc = np.repeat(np.arange(len(n)), out_n)
    i = np.arange(total) - np.repeat(out_at[:-1], out_n) + at[:-1][doc]
    last = at[1:][doc]
    h = np.full(total, 0x9E3779B97F4A7C15, np.uint64)
    padded = np.append(code_hash, np.uint64(0))
    for k in range(size):
        j = i + k
        h = mix(h * np.uint64(0x100000001B3) + np.where(j < last, padded[np.minimum(j, len(code_hash))], np.uint64(k)))
    return h, out_at
