"""Sequential operators against plain loops written from their semantics, on random input."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from parlance.functions import diff, numerals
from parlance.operators import clustering, folds, intervals, joins
from parlance.plans import transcript


def random_segments(seed, n=60, recs=4, span=8000):
    r = random.Random(seed)
    out = []
    for rec in range(recs):
        t = 0
        for i in range(n):
            t += r.randint(0, span)
            out.append((rec, i, t, t + r.randint(0, span), r.choice("ab"), r.random() < 0.15, "x" * r.randint(0, 9) + r.choice(["。", "", ","]), r.randint(0, 3)))
    return out


SCHEMA = "rec_id long, seq long, start_ms long, end_ms long, speaker string, overlap boolean, text string, spk long"


@pytest.fixture(scope="module")
def rows():
    return random_segments(1)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_merge_segments(frame, rows):
    """A segment begins a group where the gap before it is wide; groups have their first start and last end, short ones go."""
    want = []
    for rec, rs in groups(rows).items():
        start, end = np.array([r[2] for r in rs]), np.array([r[3] for r in rs])
        first = np.flatnonzero(np.append(True, start[1:] - end[:-1] > 1500))
        last = np.append(first[1:], len(rs)) - 1
        want += [(rec, int(s), int(e)) for s, e in zip(start[first], end[last]) if e - s >= 800]
    got = intervals.merge_segments(frame, 1500, 800)
    assert sorted((r.rec_id, r.start_ms, r.end_ms) for r in got.collect()) == sorted(want)


def test_chunks_cover_segments(frame, rows):
    """Chunks of a long segment begin every 1,500 ms and are 3,000 ms long, as far as the segment goes; a short one is its own."""
    begins = lambda s, e: range(s, e, 1500) if e - s > 3000 else (s,)
    want = [(rec, seq, t, min(t + 3000, e)) for rec, seq, s, e, *_ in rows for t in begins(s, e)]
    got = [(r.rec_id, r.seq, r.start_ms, r.end_ms) for r in intervals.chunk_windows(frame).collect()]
    assert sorted(got) == sorted(want)


def test_smoothing(frame, rows):
    want = []
    for rec, rs in groups(rows).items():
        labels = [r[4] for r in rs]
        new = [labels[i - 1] if 0 < i < len(labels) - 1 and labels[i - 1] == labels[i + 1] != labels[i] else labels[i] for i in range(len(labels))]
        runs = []
        for r, x in zip(rs, new):
            if runs and runs[-1][2] == x:
                runs[-1][1] = r[3]
            else:
                runs.append([r[2], r[3], x])
        want += [(rec, *x) for x in runs]
    got = [(r.rec_id, r.start_ms, r.end_ms, r.spk) for r in intervals.smooth_islands(frame.drop("spk"), "speaker").collect()]
    assert sorted(got) == sorted(want)


def paragraphs(rows, joins, keep):
    out = []
    for rec, rs in groups(rows).items():
        ps = []
        for _, _, s, e, spk, ov, text, _ in rs:
            if ps and joins(ps[-1], s, e, spk, ov, text):
                p = ps[-1]
                p[1], p[4] = e, p[4] + text
                if keep:
                    p[3] = p[3] or ov
            else:
                ps.append([s, e, spk, ov, text])
        out += [(rec, *p) for p in ps]
    return sorted(out)


def test_group_paragraphs(frame, rows):
    want = paragraphs(rows, lambda p, s, e, spk, ov, t: p[2] == spk and s - p[1] <= 4000 and e - p[0] <= 20000 and len(p[4]) < 12, True)
    got = folds.group_paragraphs(frame, 4000, 20_000, 12)
    assert sorted((r.rec_id, r.start_ms, r.end_ms, r.speaker, r.overlap, r.text) for r in got.collect()) == want


def test_merge_consecutive(frame, rows):
    want = paragraphs(rows, lambda p, s, e, spk, ov, t: p[2] == spk and not p[3] and not ov and s - p[1] <= 4000 and e - p[0] <= 20000 and len(p[4]) + len(t) <= 15, False)
    got = folds.merge_consecutive(frame, 4000, 20_000, 15)
    assert sorted((r.rec_id, r.start_ms, r.end_ms, r.speaker, r.overlap, r.text) for r in got.collect()) == want


def test_nearest_and_dominant_turn(frame, rows):
    turns = frame.filter("seq % 3 = 0")
    near = {(r.rec_id, r.seq): r.spk for r in joins.nearest_turn(frame.filter("seq % 3 <> 0").drop("spk"), turns).collect()}
    most = {(r.rec_id, r.seq): r.spk for r in joins.max_overlap(frame.filter("seq % 3 <> 0").drop("spk"), turns).collect()}
    for rec, rs in groups(rows).items():
        ts = [r for r in rs if r[1] % 3 == 0]
        for _, seq, s, e, *_ in (r for r in rs if r[1] % 3):
            mid, best, left = (s + e) / 2, None, None
            for t in ts:
                if t[2] <= mid <= t[3]:
                    best = t[7]
                    break
                d = min(abs(mid - t[2]), abs(mid - t[3]))
                if left is None or d < left:
                    best, left = t[7], d
            assert near[rec, seq] == best
            over = [(min(e, t[3]) - max(s, t[2]), -t[1], t[7]) for t in ts]
            top = max(over)
            assert most[rec, seq] == (top[2] if top[0] > 0 else None)


def test_time_align(frame, rows):
    """Each right one has the nearest left one that touches it and that no earlier one has, if that is near enough."""
    a, b = frame.filter("seq % 2 = 0"), frame.filter("seq % 2 = 1")
    got = {(r.rec_id, r.seq_b): r.seq_a for r in folds.time_align(a, b, 2000).collect()}
    far = lambda x, y: max(abs(y[2] - x[2]), abs(y[3] - x[3]))
    for rec, rs in groups(rows).items():
        taken = set()
        for y in rs[1::2]:
            free = [x for x in rs[::2] if x[1] not in taken and max(x[2], y[2]) <= min(x[3], y[3])]
            near = min(free, key=lambda x: far(x, y), default=None)
            want = near[1] if near and far(near, y) <= 2000 + y[3] - y[2] else None
            assert got[rec, y[1]] == want
            taken |= {want} - {None}


def test_matching_blocks_are_the_librarys():
    r = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 40))) for _ in range(2))
        assert diff.matching_blocks(a, b) == list(map(tuple, SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()))
    long = "".join(r.choice("abcdefgh ") for _ in range(6000))
    assert "".join(diff.carried_over([long[i : i + 60] for i in range(0, 6000, 60)], long)).replace(" ", "") == long.replace(" ", "")


def test_carried_over_borders():
    """A border lies where the last block that begins before it says; plain search over all blocks."""
    r = random.Random(4)
    for _ in range(500):
        pieces = ["".join(r.choice("abc，。 ") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 5))]
        whole = "".join(r.choice("abc，。 ") for _ in range(r.randint(1, 25)))
        text = "".join(pieces)
        if not text:
            continue
        blocks = SequenceMatcher(None, text, whole, autojunk=False).get_matching_blocks()
        place = lambda x: max(((b.a, b.b + min(x - b.a, b.size)) for b in blocks if b.a <= x), default=(0, 0))[1]  # noqa: B023, E731
        want, lo = [], 0
        for p in pieces:
            a, z = place(lo), place(lo + len(p))
            z += next((n for n, c in enumerate(whole[z:]) if c not in "，。！？、；：,.!?;:"), len(whole) - z)
            want.append(whole[a:z].strip() or p)
            lo += len(p)
        assert diff.carried_over(pieces, whole) == want


def test_fuse_keeps_the_text(frame):
    out = transcript.fuse(frame.filter("seq % 3 <> 0"), frame.filter("seq % 3 = 0"))
    texts = {}
    for r in sorted(out.collect(), key=lambda r: (r.rec_id, r.seq, r.part)):
        texts[r.rec_id, r.seq] = texts.get((r.rec_id, r.seq), "") + r.text
    for r in frame.filter("seq % 3 <> 0 and text <> ''").collect():
        assert texts[r.rec_id, r.seq] == r.text


def test_average_linkage():
    r = np.random.default_rng(0)
    for n, options in ((1, {}), (2, {"threshold": 0.5}), (30, {"threshold": 0.8}), (30, {"clusters": 4}), (25, {"clusters": 3, "whiten": True})):
        x = r.normal(size=(n, 5))
        y = x - x.mean(0) if options.get("whiten") else x
        y = y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-8)
        d, sets = 1 - y @ y.T, [[i] for i in range(n)]
        while len(sets) > options.get("clusters", 1):
            pairs = [(np.mean([d[a, b] for a in p for b in q]), i, j) for i, p in enumerate(sets) for j, q in enumerate(sets) if i < j]
            least, i, j = min(pairs)
            if "clusters" not in options and not least < options.get("threshold", 0.7):
                break
            sets[i] += sets.pop(j)
        label = clustering.average_linkage(x, **options)
        assert {frozenset(s) for s in sets} == {frozenset(np.flatnonzero(label == k)) for k in set(label)}
        assert list(dict.fromkeys(label)) == sorted(set(label))


def test_cuts_and_fusion():
    assert diff.cut_near("一二三。四五六", 5) == 4
    assert diff.cut_near("一二,三四五六", 5) == 3
    assert diff.cut_near("abcdef", 9) == 6
    assert diff.dealt("aa! bb! cc", [1, 1, 1]) == ["aa!", "bb!", "cc"]
    assert diff.fuse_pair("我用火山引擎", "我用活山引擎", frozenset(["火"])) == "我用火山引擎"
    assert diff.carried_over(["你好", "世界"], "你好，世 界") == ["你好，", "世 界"]
    assert diff.mine("这是火山引警的东西", "这是火山引擎的东西") == []
    assert diff.mine("这是活三的东西", "这是火山的东西")[0]["right"] == "火山"


@pytest.mark.parametrize("text, want", [("十块", "十块"), ("二千万", "20010000"), ("上百", "上百"), ("万", "万"), ("两千零五", "2000五"), ("三点多10000元", "三点多万元")])
def test_numerals(text, want):
    assert numerals.mended(numerals.to_digits(text)) == want


def test_average_linkage_is_bounded():
    """Memory is that of the vectors, not the square of a recording's rows; rounds, chains and copies give the same clusters as a full matrix."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 5000)] + 0.1 * rng.normal(size=(5000, 16))
    tracemalloc.start()
    label = clustering.average_linkage(x, threshold=0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5000 * 5000 * 8 / 2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.array([u[label == k].mean(0) for k in range(label.max() + 1)])
    near = s @ s.T
    np.fill_diagonal(near, -1)
    assert 10 < len(s) < 200 and near.max() <= 0.8  # no two clusters are left that had to merge
    back = clustering.average_linkage(x[::-1], threshold=0.2)[::-1]
    assert len({*zip(back.tolist(), label.tolist())}) == len(s)  # the same sets, whatever the order


def test_average_linkage_by_rounds_and_chains(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (2, 9, 40, 150):
        for x in (rng.normal(size=(n, 5)), rng.normal(size=(n // 2 + 1, 5))[rng.integers(0, n // 2 + 1, n)]):
            for options in ({"threshold": 0.3}, {"threshold": 0.9}, {"clusters": 1}, {"clusters": min(n, 3)}):
                rounds = clustering.average_linkage(x, **options)
                with monkeypatch.context() as m:
                    m.setattr(clustering.Tree, "grow", lambda self, mean, name, least: self.chains(mean.copy(), name, least))
                    assert (clustering.average_linkage(x, **options) == rounds).all()
                assert "clusters" not in options or rounds.max() + 1 == options["clusters"]


def test_average_linkage_of_odd_rows():
    x = np.array([[0.0, 1.0], [np.nan, 1.0], [0.0, 2.0], [0.0, 0.0], [1.0, 0.0], [0.0, 0.0], [0.0, 1.0]])
    assert clustering.average_linkage(x, threshold=0.5).tolist() == [0, 1, 0, 2, 3, 4, 0]
    assert clustering.average_linkage(x, clusters=1).tolist() == [0] * 7


def test_turns_from_vectors_of_long_recordings(spark):
    """Voices of long recordings, by the order of their first chunks; a chunk alone among another voice's takes that one."""
    import pandas as pd

    rng = np.random.default_rng(5)
    voices, frames, expected = rng.normal(size=(4, 24)), [], []
    for rec in range(2):
        said = np.repeat(rng.integers(0, 4, 900), rng.integers(1, 6, 900))
        names = list(dict.fromkeys(said.tolist()))
        label = [names.index(v) for v in said]
        x = (voices[said] + 0.05 * rng.normal(size=(len(said), 24))).astype(np.float32)
        frames.append(pd.DataFrame({"rec_id": rec, "seq": range(len(said)), "start_ms": np.arange(len(said)) * 100, "end_ms": np.arange(len(said)) * 100 + 90, "embedding": x.tolist()}))
        last = len(label) - 1
        smooth = [label[i - 1] if 0 < i < last and label[i - 1] == label[i + 1] else label[i] for i in range(len(label))]
        starts = [i for i in range(len(smooth)) if not i or smooth[i] != smooth[i - 1]]
        expected += [(rec, i * 100, j * 100 - 10, smooth[i]) for i, j in zip(starts, [*starts[1:], len(smooth)])]
    chunks = spark.createDataFrame(pd.concat(frames), "rec_id long, seq long, start_ms long, end_ms long, embedding array<float>").repartition(5, "seq")
    got = transcript.turns_from_vectors(chunks, chunks, threshold=0.5).select("rec_id", "start_ms", "end_ms", "spk").collect()
    assert sorted(map(tuple, got)) == expected


def test_turns_from_vectors_label_each_chunk_once(spark, monkeypatch):
    """Times go through the clustering with the vectors: rows of one seq aren't joined with each other, and each has its own label."""
    monkeypatch.setattr(transcript.intervals, "smooth_islands", lambda named: named)
    rows = [(rec, k // 20, 100 * k, 100 * k + 90, [[1.0, 0.0], [0.0, 1.0]][k % 2]) for rec in range(2) for k in range(200)]
    odd = [(None, 0, 0, 90, [1.0, 0.0]), (0, None, 0, 90, [0.0, 1.0])]  # without recording or place: no chunks
    chunks = spark.createDataFrame(rows + odd, "rec_id long, seq long, start_ms long, end_ms long, embedding array<float>").repartition(3)
    named = transcript.turns_from_vectors(chunks, chunks, threshold=0.5)
    got = named.select("rec_id", "seq", "start_ms", "end_ms", "label").collect()
    assert sorted(map(tuple, got)) == [(*r[:4], r[2] // 100 % 2) for r in rows]
    assert "Join" not in named._jdf.queryExecution().toString()


def test_cluster_of_a_group_is_bounded(spark, monkeypatch):
    """What a task does with a recording's rows: labels in order, in memory far below the square of the rows."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import GroupedData

    taken = []
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, schema: taken.append(f))
    clustering.cluster(spark.createDataFrame([(0, 0, [1.0])], "rec_id long, seq long, embedding array<float>"), threshold=0.9)
    rng = np.random.default_rng(6)
    seq = rng.permutation(5000)
    x = rng.normal(size=(5000, 16)).astype(np.float32)
    t = pa.table({"rec_id": np.zeros(5000, np.int64), "seq": seq, "embedding": pa.array(list(x[seq]), pa.list_(pa.float32()))})
    tracemalloc.start()
    out = taken[0](t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5000 * 5000 * 8 / 2
    assert out.column("seq").to_pylist() == list(range(5000))
    assert out.column("label").to_pylist() == clustering.average_linkage(x, threshold=0.9).tolist()
    with pytest.raises(ValueError, match="one length"):
        taken[0](pa.table({"rec_id": [0, 0], "seq": [0, 1], "embedding": [[1.0], None]}))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_audit_pairs_moves_no_vector_twice(spark, kind):
    """Pairs of blocks are read from one table of the blocks: nothing is shuffled by pairs, and all pairs are found."""
    from parlance.operators import vectors

    rng = np.random.default_rng(7)
    for n, block in ((700, 64), (512, 64), (130, 64), (40, 64), (3, 64), (0, 64)):
        x = rng.normal(size=(n, 6)).astype(np.float32).astype(float)
        x[5:9] = x[5:6]
        ids = rng.permutation(3 * n)[:n]
        ids[20:22] = ids[20:21]  # one id twice
        rows = [(int(i), v) for i, v in zip(ids, x.tolist())] + [(None, [1.0] * 6), (10**9, None)]
        got = vectors.audit_pairs(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), 0.8, block=block)
        plan = got._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        size = np.linalg.norm(x, axis=1)
        sim = x @ x.T / (np.outer(size, size) + 1e-8)
        expected = sorted((int(ids[a]), int(ids[b]), round(sim[a, b], 9)) for a, b in zip(*np.nonzero(sim > 0.8)) if ids[a] < ids[b])
        assert sorted((r.i, r.j, round(r.sim, 9)) for r in got.collect()) == expected
        assert n < 40 or expected
