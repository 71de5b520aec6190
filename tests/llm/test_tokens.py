"""Packing, encoding, store: against the tokenizers library, and exact round trips."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import bytelevel, packing, queries, store, trie_bpe
from tests.conftest import DATA


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def small(spark, tokenizer):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return dict(zip([r.doc_id for r in rows], ids_of(tokenizer, [r.text or "" for r in rows])))


ENCODERS = {"library": lambda p: bytelevel.Encoder(p), "trie": lambda p: bytelevel.Encoder(p, trie_bpe.TrieEncoder(p)), "forgetful": lambda p: bytelevel.Encoder(p, most=3)}


@pytest.mark.parametrize("kind", ENCODERS)
def test_every_code_point(path, tokenizer, kind):
    e = ENCODERS[kind](path)
    step = 1 if kind == "library" else 7
    points = [c for c in range(0, 0x110000, step) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 40_000):
        texts = [f"a{chr(c)}1{chr(c)} {chr(c)}b {chr(c)}{chr(c)}" for c in points[lo : lo + 40_000 : 1 if kind == "library" else 5]]
        ids, at = e(pa.array(texts, pa.large_string()))
        for t, a, z, want in zip(texts, at[:-1], at[1:], ids_of(tokenizer, texts)):
            assert ids[a:z].tolist() == want, (t, unicodedata.name(t[1], ""))
        if kind != "library" and lo > 80_000:
            break


PIECES = ["a", "'", "s", "ll", "re", " ", "  ", "\n", "\t", "1", "é", "!", " ", "日", "<|endoftext|>", "t", "'s", "　", "d", "ve", "x", "\x1c", "\x85", "🙂", "´", "́"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=8))
def test_any_text(texts):
    from parlance.llm.queries import tokenizer_path

    tokenizer = bytelevel.load_tokenizer(tokenizer_path())
    for e in (bytelevel.shared_encoder(tokenizer_path()), trie_bpe.shared_encoder(tokenizer_path())):
        ids, at = e(pa.array(texts, pa.large_string()))
        want = ids_of(tokenizer, texts)
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == want
        b, ends = trie_bpe.decode(ids, at, tokenizer_path())
        assert [b[a:z].decode("utf-8", "replace") for a, z in zip(ends[:-1], ends[1:])] == [tokenizer.decode(x, skip_special_tokens=False) for x in want]


def test_op5(spark, tokenizer, small):
    for r in queries.op5_bpe_encoding(spark, str(DATA)).collect():
        ids = small[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_frames(spark, odd, none, path):
    ids = trie_bpe.encode(odd, path)
    back = {(r.doc_id, r.text) for r in trie_bpe.decoded(ids, path).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert trie_bpe.encode(none, path).count() == trie_bpe.digest(none, path).count() == 0


def check_packing(rows, ids, capacity=2048):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(ids)
    for d, ps in by.items():
        whole, at = [*ids[d], 0], 0
        for k, p in enumerate(sorted(ps, key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, crc(whole[at : at + p.length]))
            at += p.length
            assert k == 0 or p.length == capacity
        assert at == len(whole) and (len(ps) == 1) == (len(whole) <= capacity)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_op1(spark, small):
    n = check_packing(queries.op1_best_fit_packing(spark, str(DATA)).collect(), small)
    assert n <= -(-sum(len(x) + 1 for x in small.values()) // 2048) + 1


def test_packing_odd_rows(spark, odd, none, path, tokenizer):
    rows = packing.pack(odd, path, capacity=64).collect()
    once = {i: t for i, t, *_ in odd.collect()}
    ids = dict(zip(once, ids_of(tokenizer, [t or "" for t in once.values()])))
    twice = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 5)
    assert twice == [(0, 0, 2), (0, 0, 2)]
    one = [r for r in rows if r.doc_id != 5]
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in ids.values()) + 2
    assert all(r.length <= 64 and r.offset + r.length <= 64 for r in rows) and len({(r.doc_id, r.piece) for r in one}) == len(one)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(none, path).count() == 0


def best_sum(lengths, stock, room):
    sums = {0}
    for x in lengths:
        for _ in range(stock[x]):
            sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fullest_combination():
    r = random.Random(5)
    for _ in range(200):
        stock = Counter(r.randint(1, 40) for _ in range(r.randint(1, 12)))
        room = r.randint(0, 100)
        lengths = sorted(stock, reverse=True)
        got = packing.fullest(lengths, stock, room)
        assert sum(got) == best_sum(lengths, stock, room)
        assert not Counter(got) - stock


def test_plan_uses_everything_once():
    r = random.Random(6)
    for _ in range(50):
        counts = Counter(r.randint(1, 50) for _ in range(r.randint(0, 300)))
        bins = packing.plan(counts, 50)
        used = Counter()
        for times, inside in bins:
            assert times > 0 and sum(x * k for x, k in inside) <= 50
            for x, k in inside:
                used[x] += times * k
        assert used == counts
        places = packing.places(bins)
        spots = [(s + i // k, o + i % k * x) for x, runs in places.items() for a, k, s, o, b in zip(*runs, [*runs[0][1:], counts[x]]) for i in range(b - a)]
        assert len(set(spots)) == len(spots) == sum(counts.values())


def test_op10(spark, small):
    got = {r.doc_id: r for r in queries.op10_token_store(spark, str(DATA)).collect()}
    at = 0
    for d in sorted(small):
        whole = [*small[d], 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(whole), crc(whole))
        at += len(whole)


def test_store_round_trip(spark, odd, none, path, tokenizer, tmp_path):
    at = store.write(odd, str(tmp_path / "store"), path, fmt=store.Format(bits=3, least=16, most=40))
    assert store.verify(spark, at)
    rows = store.read(spark, at).orderBy("start").collect()
    texts = sorted((i, t or "") for i, t, *_ in odd.collect())
    assert [r.doc_id for r in rows] == [i for i, _ in texts]
    ids = [[*x, 0] for x in ids_of(tokenizer, [t for _, t in texts])]
    assert sorted((r.doc_id, tuple(r.ids)) for r in rows) == sorted((i, tuple(x)) for (i, _), x in zip(texts, ids))
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([len(r.ids) for r in rows])])[:-1].tolist()
    chunks = spark.read.parquet(f"{at}/data/kind=chunk")
    assert chunks.count() == chunks.select("key").distinct().count() < store.links(spark, at).count()
    empty = store.write(none, str(tmp_path / "none"), path)
    assert store.verify(spark, empty) and store.summary(spark, empty).count() == 0


def test_store_tells_damage(spark, odd, path, tmp_path):
    at = store.write(odd, str(tmp_path / "a"), path)
    whole = spark.read.parquet(f"{at}/data").drop("kind").filter("ids is not null").collect()
    bad = [(bytes(r.key), r.n, bytes(r.ids[:-1]) + b"\x01") for r in whole]
    spark.createDataFrame(bad, "key binary, n long, ids binary").write.mode("overwrite").parquet(f"{at}/data/kind=chunk")
    with pytest.raises(Exception, match="damaged"):
        store.summary(spark, at).collect()
    rows = spark.read.parquet(f"{at}/recipes")
    changed = rows.selectExpr("part", "local_start", "doc_id + 1 AS doc_id", "n_tokens", "digests", "lengths", "root").collect()
    spark.createDataFrame(changed, rows.schema).write.mode("overwrite").parquet(f"{at}/recipes")
    assert not store.verify(spark, at)


def test_cuts_move_with_content():
    r = np.random.default_rng(1)
    fmt = store.Format(bits=4, least=20, most=200)
    x = r.integers(0, 50_000, 4000).astype(np.int32)
    y = np.concatenate([r.integers(0, 50_000, 37).astype(np.int32), x])

    def pieces(v):
        ends = store.cuts(v, np.array([0, len(v)]), fmt)[0]
        return {v[a:z].tobytes() for a, z in zip([0, *ends[:-1]], ends)}

    assert len(pieces(x) & pieces(y)) > 0.8 * len(pieces(x))
    ends = store.cuts(y, np.array([0, 10, 10, 700, len(y)]), fmt)
    assert [e[-1:] for e in ends] == [[10], [], [700], [len(y)]]
    assert all(20 <= z - a <= 200 for a, z in zip(ends[3], ends[3][1:-1]))


def test_crc_shares():
    r = random.Random(3)
    for _ in range(50):
        parts = [r.randbytes(r.randint(0, 60)) for _ in range(r.randint(1, 6))]
        after = [sum(map(len, parts[i + 1 :])) for i in range(len(parts))]
        got = np.bitwise_xor.reduce(store.shifted(np.array([zlib.crc32(p) for p in parts], np.int64), np.array(after)))
        assert got == zlib.crc32(b"".join(parts))
