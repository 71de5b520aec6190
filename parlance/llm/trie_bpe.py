"""BPE encoding by a walk over the trie of distinct words, and decoding.

For a vocabulary whose tokens encode to themselves, a prefix's encoding is fixed by its last token: it is the one
suffix token that may follow the last token of the prefix before it (a pair of tokens may stand together if encoding
their joint bytes gives that pair again).  Distinct words are put in sorted order, which is the depth-first order of
their trie; the walk keeps one last token a depth and resumes at the common prefix with the word before, so the
states of shared prefixes are computed once.  A word's ids are read back from its end, from state to state.

Null texts are empty texts and have no ids.  Repeated rows give repeated results; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm import bytelevel, frames


def byte_alphabet() -> dict[str, int]:
    """The published stand-ins of bytes: printable ones stand for themselves, the rest for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class TrieEncoder:
    """Encodes lists of distinct words (bytes)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_alphabet()
        self.token = {bytes(of[c] for c in s): i for s, i in model["vocab"].items() if all(c in of for c in s)}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for b, i in self.token.items():
            self.bytes[i] = b
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        ids = model["vocab"]
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[a], ids[b]] = (r, ids[a + b])
        self.longest = max(map(len, self.token))
        self.single = [self.token.get(bytes([b]), -1) for b in range(256)]
        # lengths of the tokens that end in given two bytes, longest first
        ends: dict[bytes, set[int]] = {}
        for b in self.token:
            ends.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {k: sorted(v | {1}, reverse=True) for k, v in ends.items()}
        self.pairs: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """By the definition: the merge of lowest rank, leftmost first, until none applies."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: (self.rank.get((ids[i], ids[i + 1]), (1 << 30,))[0], i))
            hit = self.rank.get((ids[best], ids[best + 1]))
            if hit is None:
                break
            a, b, out, i = ids[best], ids[best + 1], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(hit[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return got

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return bytelevel.flat(self.lists(words))

    def lists(self, words: list[bytes]) -> list[list[int]]:
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list = [None] * len(words)
        last: list[int] = [-1]  # last[d]: the last token of the first d bytes of the present path
        before = b""
        token, bytes_of, lengths, pairs, may_follow = self.token, self.bytes, self.lengths, self.pairs, self.may_follow
        for w in order:
            word = words[w]
            n, m = len(word), min(len(before), len(word))
            d = 0
            if before[:m] == word[:m]:
                d = m
            else:
                while before[d] == word[d]:
                    d += 1
            del last[d + 1 :]
            for e in range(d + 1, n + 1):
                for k in lengths.get(word[max(0, e - 2) : e], (1,)):
                    if k > e:
                        continue
                    t = token.get(word[e - k : e])
                    if t is None:
                        continue
                    p = last[e - k]
                    if p < 0:
                        if k == e:
                            break
                        continue
                    ok = pairs.get(p << 20 | t)
                    if may_follow(p, t) if ok is None else ok:
                        break
                else:
                    raise ValueError(f"no token ends {word[:e]!r}")
                last.append(t)
            ids, e = [], n
            while e:
                t = last[e]
                ids.append(t)
                e -= len(bytes_of[t])
            ids.reverse()
            out[w] = ids
            before = word
        return out


@functools.lru_cache(maxsize=2)
def shared_encoder(path: str) -> bytelevel.Encoder:
    return bytelevel.Encoder(path, TrieEncoder(path))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, and where each begins and the last ends; added tokens too."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    of = byte_alphabet()
    table = {i: bytes(of[c] for c in s) if all(c in of for c in s) else s.encode() for s, i in whole["model"]["vocab"].items()}
    table |= {x["id"]: x["content"].encode() for x in whole["added_tokens"]}
    parts = [table.get(i, b"") for i in range(max(table) + 1)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([*map(len, parts)])])


def decode(ids: np.ndarray, at: np.ndarray, path: str) -> tuple[bytes, np.ndarray]:
    """Bytes of id streams that lie end to end, and where each begins and the last ends."""
    flat, start = vocabulary(path)
    n = (start[1:] - start[:-1])[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    b = flat[np.repeat(start[ids] - (ends - n), n) + np.arange(total)]
    return b.tobytes(), np.concatenate([[0], ends])[at]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every whole text."""

    def f(batches):
        e = shared_encoder(path)
        for whole in batches:
            for part in bytelevel.slices(whole, "text"):
                ids, at = e(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return frames.map_arrow(frames.texts_of(docs), f, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); bytes that aren't UTF-8 become the replacement character."""

    def f(batches):
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                part = whole.slice(lo, 1000)
                ids = part.column(1).flatten().to_numpy()
                at = np.concatenate([[0], np.cumsum(part.column(1).value_lengths().to_numpy())])
                b, ends = decode(ids, at, path)
                yield frames.batch({"doc_id": pa.int64(), "text": pa.string()}, doc_id=part.column(0), text=[b[a:z].decode("utf-8", "replace") for a, z in zip(ends[:-1], ends[1:])])

    return frames.map_arrow(encoded.select("doc_id", "ids"), f, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens and digests of the ids and of the text decoded from them, of every whole text.

    The ids are those of `encode`, batch by batch, without leaving the worker; decoding starts from the ids alone.
    """

    def f(batches):
        e = shared_encoder(path)
        width = np.zeros(0, np.int64)
        kind = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for part in bytelevel.slices(whole, "text", 2 << 20):
                ids, at = e(part.column(1))
                top = int(ids.max(initial=0)) + 1
                if top > len(width):  # decimal forms of all ids seen so far
                    numbers = [b"%d," % i for i in range(max(top, 1 << 16))]
                    width = np.array([len(x) for x in numbers])
                    flat, begin = np.frombuffer(b"".join(numbers), np.uint8), np.cumsum(width) - width
                n = width[ids]
                ends = np.cumsum(n)
                said = flat[np.repeat(begin[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
                cut = np.concatenate([[0], ends])[at]
                text, back = decode(ids, at, path)
                yield frames.batch(
                    kind, doc_id=part.column(0), n_tokens=np.diff(at),
                    ids_sha256=[sha(said[a : max(a, z - 1)]) for a, z in zip(cut[:-1], cut[1:])],
                    decoded_sha256=[sha(valid(text[a:z])) for a, z in zip(back[:-1], back[1:])],
                )

    return frames.map_arrow(frames.texts_of(docs), f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def valid(b: bytes) -> bytes:
    return b.decode("utf-8", "replace").encode()
