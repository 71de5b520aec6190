"""Near-duplicate documents by ProbMinHash over word shingles.

A shingle is a run of five words; all shingles of a text have the same weight, however often they occur, as in the sets that
pairs are verified on.  Each shingle has a Poisson process of arrivals with its weight as rate, seeded by its hash; an arrival
falls into one of K registers, which keep the shingle that came first.  A shingle stops as soon as its next arrival is later
than every register of the text.  Two texts agree in a register with the probability of their plain Jaccard similarity.

Texts of the same words are one class from the start; only their representatives go on.  Registers are hashed in bands.
Within a bucket one byte of each register tells which texts may reach the threshold with one of another class; only
their texts are fetched, and pairs are verified on whole shingle sets (Jaccard 0.8 or more) where they meet: distances to
a hub settle most, and a link is needed only between classes, so a bucket gives fewer links than it has texts.
A first round over a few bands joins most of a large group; buckets beyond `split` texts are dealt to parts in it, whose
classes meet again by one text each.  The second round, over all bands, is exhaustive: there large buckets are compared block
by block, so that any two texts of different classes in a bucket meet.

Null texts and texts without words have no shingles: each is a class of its own.  Texts of fewer than five words have one
shingle, all their words.  Rows without doc_id have no class; repeated rows (same doc_id, same words) get one row in the
result, rows of one doc_id with different words one each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import bytelevel, frames, words
from parlance.llm.components import components


@dataclass(frozen=True)
class Setup:
    size: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 6
    slack: float = 0.13  # 4.5 standard errors of the estimate from 192 registers at 0.8
    first: int = 4  # bands of the first round
    split: int = 4_096
    broadcast_ids: int = 4_000_000  # ids of candidates, 8 bytes each, that may be sent to all executors

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def prob_min_hash(h: np.ndarray, at: np.ndarray, k: int, weighted: bool = True) -> np.ndarray:
    """Registers (texts x k, hashes of the winning shingles) of texts whose shingle hashes lie end to end; 0 where there is none.

    Weights are 1 + ln(times), or equal, where two texts agree in a register with the probability of their sets' Jaccard similarity.
    """
    d = len(at) - 1
    doc = np.repeat(np.arange(d), np.diff(at))
    key = words.mix(h ^ words.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, one, times = np.unique(key, return_index=True, return_counts=True)
    h, doc = h[one], doc[one].astype(np.int64)
    weight = 1.0 + np.log(times) if weighted else np.ones(len(h))
    first = np.full(d * k, np.inf)
    sig = np.zeros(d * k, np.uint64)
    limit = np.full(d, np.inf)
    t, s = np.zeros(len(h)), words.mix(h + np.uint64(0x9E3779B97F4A7C15))
    while len(h):
        s = words.mix(s + np.uint64(0x9E3779B97F4A7C15))
        t = t - np.log1p(-((s >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        live = t < limit[doc]
        h, doc, weight, t, s = h[live], doc[live], weight[live], t[live], s[live]
        cell = doc * k + (words.mix(s ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(k)).astype(np.int64)
        better = t < first[cell]
        cell, came, who = cell[better], t[better], h[better]
        np.minimum.at(first, cell, came)
        won = first[cell] == came
        sig[cell[won]] = who[won]
        limit = first.reshape(d, k).max(1)
    return sig.reshape(d, k)


def prints(hashed: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the words, in order, of texts that have some; `at` has where each begins, and the last ends."""
    place = (np.arange(len(hashed)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
    return [np.add.reduceat(words.mix(hashed ^ words.mix(place + np.uint64(c))), at[:-1]) for c in (1 << 40, 3 << 50)]


SIGNED = "doc_id long, f1 long, f2 long, sketch binary, bands array<long>"


def signatures(docs: DataFrame, setup: Setup) -> DataFrame:
    """For each document with a word: two hashes of its words in order, a byte of each register, a hash of each band."""

    def f(batches):
        for whole in batches:
            for part in bytelevel.slices(whole, "text", 2 << 20):
                b, doc_at = bytelevel.batch_bytes(part.column(1))
                w = words.split(b, doc_at)
                some = np.flatnonzero(np.diff(w.at))
                if not len(some):
                    continue
                hashed = words.hashes(w.dictionary)[w.code]
                h, at = words.shingles(hashed, w.at, setup.size)
                at = np.append(at[:-1][some], at[-1])
                named = prints(hashed, np.append(w.at[:-1][some], w.at[-1]))
                sig = prob_min_hash(h, at, setup.registers, weighted=False)
                key = np.zeros((len(some), setup.bands), np.uint64) + np.arange(1, setup.bands + 1, dtype=np.uint64)
                for r in range(setup.rows):
                    key = words.mix(key * np.uint64(0x100000001B3) ^ sig[:, r :: setup.rows])
                sketch = words.mix(sig).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(some)), *(pa.array(p.view(np.int64)) for p in named),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, setup.bands), pa.int32()), pa.array(key.reshape(-1).view(np.int64))),
                    ], ["doc_id", "f1", "f2", "sketch", "bands"],
                )

    return frames.map_arrow(docs, f, SIGNED)


def resembling(buckets: DataFrame, share: float) -> DataFrame:
    """Of rows (bucket, id, root, sketch, doc_id), sorted by bucket, those (bucket, id, doc_id) that resemble one of another class in their bucket."""

    def alike(ids, roots, sketches):
        x, roots = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(ids), -1), np.array(roots)
        hit = np.zeros(len(ids), bool)
        for i in range(len(ids) - 1):
            near = np.flatnonzero(((x[i + 1 :] == x[i]).mean(1) >= share) & (roots[i + 1 :] != roots[i])) + i + 1
            hit[near] = True
            hit[i] |= len(near) > 0
        return np.flatnonzero(hit)

    def f(batches):
        now, ids, roots, sketches, docs, out = None, [], [], [], [], []

        def close():
            if len(ids) > 1:
                out.extend((now, ids[i], docs[i]) for i in alike(ids, roots, sketches))

        def pack():
            return frames.batch({"bucket": pa.int64(), "id": pa.int64(), "doc_id": pa.int64()}, bucket=[r[0] for r in out], id=[r[1] for r in out], doc_id=[r[2] for r in out])

        for part in batches:
            for k, i, r, s, d in zip(*(part.column(c).to_pylist() for c in range(5))):
                if k != now:
                    close()
                    now, ids, roots, sketches, docs = k, [], [], [], []
                    if len(out) > 50_000:
                        yield pack()
                        out = []
                ids.append(i)
                roots.append(r)
                sketches.append(s)
                docs.append(d)
        close()
        yield pack()

    return frames.map_arrow(buckets.select("bucket", "id", "root", "sketch", "doc_id"), f, "bucket long, id long, doc_id long")


def sets_of(texts: pa.Array, size: int) -> tuple[list[np.ndarray], list[tuple | None]]:
    """Sorted distinct shingle hashes of each text, and the two hashes of its words."""
    b, doc_at = bytelevel.batch_bytes(texts)
    w = words.split(b, doc_at)
    hashed = words.hashes(w.dictionary)[w.code] if len(w.code) else np.zeros(0, np.uint64)
    h, at = words.shingles(hashed, w.at, size)
    names: list[tuple | None] = [None] * len(texts)
    some = np.flatnonzero(np.diff(w.at))
    if len(some):
        for i, *two in zip(some, *(p.view(np.int64).tolist() for p in prints(hashed, np.append(w.at[:-1][some], w.at[-1])))):
            names[i] = tuple(two)
    return [np.unique(h[x:z]) for x, z in zip(at[:-1], at[1:])], names


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def forest(roots: list, sketches: list[bytes], sets: list[np.ndarray], threshold: float, share: float) -> list[tuple[int, int]]:
    """Links (places) that join all texts of different classes whose similarity reaches the threshold, without those that
    earlier links make needless.

    Distances to a hub, the text most like the bucket's commonest registers, decide most pairs, since 1 - Jaccard is a
    metric: a pair whose two distances differ by more than the limit can't be within it, one whose sum is
    within it must be.
    """
    m, limit = len(roots), 1 - threshold + 1e-9
    top = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    parent = list(range(len(top)))
    place = [top[r] for r in roots]

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(m, -1)
    size = np.array([len(s) for s in sets])
    if m > 3:
        commonest = np.array([np.bincount(c).argmax() for c in x.T], np.uint8)
        hub = int((x == commonest).sum(1).argmax())
        far = np.array([1 - jaccard(sets[hub], s) for s in sets])
        order = [hub, *(int(i) for i in np.argsort(far, kind="stable") if i != hub)]
    else:
        far, order = np.zeros(m), list(range(m))
    out = []
    for n, i in enumerate(order):
        rest = np.array(order[n + 1 :], np.int64)
        if not len(rest):
            break
        rest = rest[(np.minimum(size[rest], size[i]) >= (threshold - 1e-9) * np.maximum(size[rest], size[i])) & (np.abs(far[rest] - far[i]) <= limit)]
        rest = rest[(x[rest] == x[i]).mean(1) >= share]
        for j in rest.tolist():
            a, b = find(place[i]), find(place[j])
            if a != b and ((m > 3 and far[i] + far[j] <= limit) or 1 - jaccard(sets[i], sets[j]) <= limit):
                parent[b] = a
                out.append((i, j))
    return out


def linked(buckets: DataFrame, setup: Setup) -> DataFrame:
    """Verified links (a, b) of rows (bucket, id, root, sketch, f1, f2, text), sorted by bucket; rows with a = b name one text
    of each class that a bucket has in the end.  A text whose hashes aren't f1 and f2 is another one of the same doc_id."""
    share = setup.threshold - setup.slack

    def f(batches):
        now, held, have, out = None, [], set(), []

        def close():
            ids = [h[0] for h in held]
            links = forest([h[1] for h in held], [h[2] for h in held], [h[3] for h in held], setup.threshold, share) if len(held) > 1 else []
            out.extend((now, ids[i], ids[j]) for i, j in links)
            joined = {j for _, j in links}
            out.extend((now, ids[i], ids[i]) for i in range(len(ids)) if i not in joined)

        def pack():
            return frames.batch({"bucket": pa.int64(), "a": pa.int64(), "b": pa.int64()}, bucket=[r[0] for r in out], a=[r[1] for r in out], b=[r[2] for r in out])

        for whole in batches:
            for part in bytelevel.slices(whole, "text"):
                rows = zip(*(part.column(c).to_pylist() for c in range(6)), *sets_of(part.column(6), setup.size))
                for k, i, r, s, f1, f2, shingles, named in rows:
                    if k != now:
                        if held:
                            close()
                        now, held, have = k, [], set()
                        if len(out) > 50_000:
                            yield pack()
                            out = []
                    if named == (f1, f2) and i not in have:
                        held.append((i, r, s, shingles))
                        have.add(i)
        if held:
            close()
        yield pack()

    return frames.map_arrow(buckets.select("bucket", "id", "root", "sketch", "f1", "f2", "text"), f, "bucket long, a long, b long")


def blocks(large: DataFrame, setup: Setup) -> DataFrame:
    """Rows (band, id, root, n) of large buckets, each in all blocks (bucket) of its part.

    A bucket is cut into parts of half of `split`; a class that fills one has parts of its own.  A block is two parts, and all
    pairs of parts are blocks but those of one class, so any two texts of different classes meet in one.
    """
    half = max(setup.split // 2, 1)
    sizes = large.groupBy("band", "root").agg(F.count("*").alias("c"))
    own = sizes.filter(F.col("c") > half).select("band", "root", F.ceil(F.col("c") / half).alias("own"))
    rest = sizes.filter(F.col("c") <= half).groupBy("band").agg(F.ceil(F.sum("c") / half).alias("rest"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias("k")
    part = lambda root, k: F.xxhash64(root, k)
    none = F.lit("").alias("of")
    parts = own.select("band", F.col("root").cast("string").alias("of"), numbers("own")).union(rest.select("band", none, numbers("rest"))).select("band", "of", part("of", "k").alias("part"))
    x, y = (parts.select("band", F.col("of").alias(f"of{c}"), F.col("part").alias(c)) for c in "xy")
    mixed = (F.col("ofx") == "") | (F.col("ofx") != F.col("ofy"))
    pairs = x.join(y, "band").filter((F.col("x") <= F.col("y")) & mixed).select("band", F.xxhash64("band", "x", "y").alias("bucket"), F.explode(F.array_distinct(F.array("x", "y"))).alias("part"))
    # of these tables one has a row for `half` texts at most, the other a row a bucket
    named = large.join(F.broadcast(own), ["band", "root"], "left").join(F.broadcast(rest), "band", "left")
    place = F.pmod(F.xxhash64("id", "band"), F.coalesce("own", "rest"))
    placed = named.withColumn("part", part(F.when(F.col("own").isNull(), F.lit("")).otherwise(F.col("root").cast("string")), place))
    return placed.join(pairs, ["band", "part"]).select("band", "id", "root", "n", "bucket")


def met(members: DataFrame, sketches: DataFrame, docs: DataFrame, setup: Setup, large: bool, exact: bool) -> DataFrame:
    """Verified links a < b between classes of members (band, id, root, n), n texts in the band's bucket.

    Where there are `large` buckets: `exact` compares them block by block, otherwise they are dealt to parts, which is cheap and
    joins most of a large class.
    """
    sort = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    small, beyond = F.col("n") <= setup.split, F.col("n") > setup.split
    if not large:
        dealt = members.withColumn("bucket", F.col("band"))
    elif exact:
        dealt = members.filter(small).select("band", "id", "root", "n", F.col("band").alias("bucket")).union(blocks(members.filter(beyond), setup))
    else:
        parts = F.ceil(F.col("n") / setup.split)
        dealt = members.withColumn("bucket", F.when(small, F.col("band")).otherwise(F.xxhash64("band", F.pmod(F.xxhash64("id", "band"), parts))))
    rows = dealt.join(sketches, "id")
    near = frames.kept(resembling(sort(rows), setup.threshold - setup.slack), "near")
    ids = frames.kept(near.select("doc_id").distinct(), "wanted")
    needed = docs.join(few(ids, setup), "doc_id", "left_semi").select("doc_id", "text")
    held = rows.join(near, ["bucket", "id"], "left_semi").join(needed, "doc_id")
    pair = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found, used = linked(sort(held), setup), [near, ids]
    if large and not exact:  # classes that the parts of a large bucket have meet in the bucket, one text each, where they are few
        found = frames.kept(found, "parts")
        used.append(found)
        heads = found.filter("a = b").select("bucket", F.col("a").alias("id"))
        again = held.filter(beyond).join(heads, ["bucket", "id"], "left_semi").withColumn("bucket", F.col("band"))
        fit = again.groupBy("band").agg(F.count("*").alias("heads")).filter(F.col("heads") <= setup.split).select("band")
        found = found.union(linked(sort(again.join(fit, "band", "left_semi")), setup))
    out = frames.kept(pair(found), "links")
    frames.drop_kept(*used)
    return out


def few(table: DataFrame, setup: Setup) -> DataFrame:
    """`table`, to be broadcast if its rows are as few as may be."""
    return F.broadcast(table) if table.count() <= setup.broadcast_ids else table


#: Rows of exact copies that one task of a join by their text need hold.
COPIES = 256


def named(docs: DataFrame, setup: Setup) -> DataFrame:
    """doc_id, f1, f2, class_id, copy_of, root for each distinct row with words.

    Distinct texts have ids of their own, so rows of one doc_id may have several texts; `root` tells classes apart even then.
    """
    signed = frames.kept(signatures(docs, setup), "signatures")
    counted = signed.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # written, so that ids stay, and the joins have exchanges of their own, whose large partitions Spark splits
    same = frames.kept(counted.withColumn("id", F.monotonically_increasing_id()), "same")
    copies = frames.kept(signed.select("doc_id", "f1", "f2").join(same.select("f1", "f2", "id", "n"), ["f1", "f2"]), "copies")
    heads = same.select("f1", "f2", F.col("first").alias("doc_id"), "id")
    own = frames.kept(signed.join(heads, ["f1", "f2", "doc_id"]).dropDuplicates(["id"]), "own")
    frames.drop_kept(signed)
    sketches = own.select("id", "sketch", "doc_id", "f1", "f2")
    bands = own.select(F.posexplode("bands").alias("no", "band"), "id")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = frames.kept(bands.join(shared, "band"), "members")
    large = bool(members.filter(F.col("n") > setup.split).take(1))
    roots, links, used = None, None, [members, own]
    for turn in range(2):
        if turn == 0:  # a few bands find most of a large group, which is one class in the others from then on
            known = members.filter(F.col("no") < setup.first).withColumn("root", F.col("id"))
        else:
            known = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = known.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
        new = met(known.join(open_, "band", "left_semi"), sketches, docs, setup, large, exact=turn > 0)
        some = bool(new.take(1))
        before, used = roots, [*used, new]
        links = new if links is None else links.union(new)
        if some or roots is None:
            roots = components(links)
            if before is not None:
                frames.drop_kept(before)
    least = frames.kept(roots.join(same.select("id", "first"), "id").groupBy("root").agg(F.min("first").alias("class_id")), "least")
    groups = roots.join(few(least, setup), "root").select("id", "class_id", "root")
    salts = F.floor((F.col("n") - 1) / COPIES)
    texts = same.join(groups, "id", "left").select("id", F.coalesce("class_id", "first").alias("class_id"), F.col("first").alias("copy_of"), F.coalesce("root", "id").alias("root"), F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("salt"))
    placed = copies.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts + 1))
    out = frames.kept(placed.join(texts, ["id", "salt"]).select("doc_id", "f1", "f2", "class_id", "copy_of", "root").distinct(), "classes")
    frames.drop_kept(*used, same, copies, roots, least)
    return out


def classes(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and copy_of (the smallest doc_id with the same words)."""
    texts = frames.texts_of(docs).filter("doc_id is not null")
    known = named(texts, setup).select("doc_id", "class_id", "copy_of")
    plain = texts.select("doc_id").distinct().join(known, "doc_id", "left")
    return plain.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def printed(docs: DataFrame) -> DataFrame:
    """doc_id, text, f1, f2 of each row; nulls where there is no word."""

    def f(batches):
        for whole in batches:
            for part in bytelevel.slices(whole, "text"):
                _, names = sets_of(part.column(1), 5)
                two = [pa.array([n and n[i] for n in names], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *two], ["doc_id", "text", "f1", "f2"])

    return frames.map_arrow(docs, f, "doc_id long, text string, f1 long, f2 long")


def deduplicated(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """Rows of `docs`, all their columns, one of each class: that of smallest doc_id; rows without doc_id stay.

    Where rows share a doc_id, those of the same words (without any: of the same text) count once, and each other is judged by its own text.
    """
    texts = frames.texts_of(docs).filter("doc_id is not null")
    known = named(texts, setup)
    names = docs.columns
    key = F.col("`doc_id`").cast("long")
    repeated = frames.kept(texts.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_key")), "repeated")
    gone = known.filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    stays = docs.join(gone, key == F.col("_gone"), "left_anti")
    if not repeated.take(1):
        return stays.select(*[F.col(f"`{c}`") for c in names])
    once = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, t = (f"c{names.index(x)}" for x in ("doc_id", "text"))
    some = F.broadcast(repeated) if repeated.count() <= setup.broadcast_ids else repeated
    alone = once.join(some, F.col(i).cast("long") == F.col("_key"), "left_anti").join(gone, F.col(i).cast("long") == F.col("_gone"), "left_anti")
    again = once.join(some, F.col(i).cast("long") == F.col("_key"), "left_semi")
    # each class keeps one text of its smallest doc_id: the one of smallest hashes
    kept_texts = known.filter("doc_id = class_id").groupBy("root", "doc_id").agg(F.min(F.struct("f1", "f2")).alias("x")).select("x.f1", "x.f2", "doc_id")
    seen = printed(frames.texts_of(again, i, t)).distinct()
    wordless = seen.filter("f1 is null").select("doc_id", "text")
    right = seen.join(kept_texts, ["doc_id", "f1", "f2"], "left_semi").groupBy("doc_id", "f1", "f2").agg(F.min("text").alias("text")).select("doc_id", "text")
    wanted = wordless.union(right).select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"))
    good = again.join(wanted, (F.col(i).cast("long") == F.col("_key")) & (F.coalesce(F.col(t).cast("string"), F.lit("")) == F.col("_text"))).dropDuplicates(["_key", "_text"])
    return alone.unionByName(good.select(*once.columns)).toDF(*names)
