"""Token ids in a content-addressed store.

Layout under one folder (Parquet files as containers, readable from any store that Spark reads):

  data/kind=chunk    digest, n, ids     unique chunks, ids little-endian and unsigned, `width` bytes each
  recipes/           part, local_start, doc_id, n_tokens, digests, lengths    ascending by doc_id within and over parts;
                     digests of 16 bytes and lengths of 4, end to end
  manifest/          part, base, n_docs, n_tokens, root, width     one row a part, and the root over all parts

Streams are cut where a rolling hash over the last 16 ids has `bits` low zeros, so equal passages give equal chunks wherever
they stand.  A chunk is named by the digest of its ids and stored once: tasks drop their own repeats, one shuffle
by digest meets the rest, and in a sorted partition a chunk is compared with the one before.  Recipes are spread by row, so
thousands of copies or empty texts don't meet.  A recipe lists a document's chunks; leaves over recipes form a Merkle tree for each part, and the
parts' roots one above.  Where a document starts in the whole stream is its place in its part plus the part's base.

Reading back checks each chunk against its digest.  The crc32 of a document comes from its chunks' crc32s: crc32 of a
concatenation is linear, so a chunk's share depends only on its own crc32 and the number of bytes after it, and
shares are joined by exclusive or; no document's ids have to meet in one place.

Null texts are empty texts (only the end id).  Repeated rows are documents of their own, ties in doc_id follow their
content; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bytelevel, frames
from parlance.llm.words import mix

WINDOW = 16


@dataclass(frozen=True)
class Format:
    width: int = 2  # bytes an id; 4 for vocabularies beyond 65,536
    bits: int = 8  # a cut each 2**bits ids on average, after the least length
    least: int = 64
    most: int = 2048

    @property
    def dtype(self) -> str:
        return f"<u{self.width}"


def cuts(ids: np.ndarray, at: np.ndarray, fmt: Format) -> list[list[int]]:
    """Ends of the chunks of each stream; streams lie end to end and begin at `at`."""
    c = np.uint64(0x9E3779B97F4A7C15)
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < WINDOW:  # h[i] covers ids i-step+1 .. i
        longer = h.copy()
        longer[step:] += h[:-step] * c
        h, c, step = longer, np.uint64(int(c) * int(c) & (1 << 64) - 1), step * 2
    marks = (np.flatnonzero(h >> np.uint64(64 - fmt.bits) == 0) + 1).tolist()
    out, k = [], 0
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        ends, begin = [], a
        while begin < z:
            lo, hi = begin + fmt.least, begin + fmt.most
            while k < len(marks) and marks[k] < lo:
                k += 1
            end = marks[k] if k < len(marks) and marks[k] <= min(hi, z) else min(hi, z)
            ends.append(end)
            begin = end
        out.append(ends)
    return out


def name(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=DIGEST).digest()


def leaf(doc_id, n_tokens: int, digests: bytes) -> bytes:
    return hashlib.sha256(b"\0" + f"{doc_id}:{n_tokens}:".encode() + digests).digest()


class Tree:
    """A Merkle tree over a stream of leaves, in memory of its height."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, x: bytes) -> None:
        level = 0
        while self.peaks and self.peaks[-1][0] == level:
            x = hashlib.sha256(b"\1" + self.peaks.pop()[1] + x).digest()
            level += 1
        self.peaks.append((level, x))

    @property
    def root(self) -> bytes:
        out = b""
        for _, x in reversed(self.peaks):
            out = hashlib.sha256(b"\1" + x + out).digest() if out else x
        return out


DIGEST = 16
DATA = {"kind": pa.string(), "key": pa.binary(), "n": pa.int64(), "ids": pa.binary(), "doc_id": pa.int64(), "digests": pa.binary(), "lengths": pa.binary()}


def chunked(docs: DataFrame, path: str, end_id: int, fmt: Format) -> DataFrame:
    """Recipes and chunks of all documents; no chunk twice from one task."""

    def f(batches):
        e, seen, row = bytelevel.shared_encoder(path), set(), 0
        for whole in batches:
            for part in bytelevel.slices(whole, "text"):
                ids, at = e(part.column(1))
                ids = np.insert(ids, at[1:], end_id)
                if int(ids.max(initial=0)) >> 8 * fmt.width:
                    raise ValueError(f"an id of the vocabulary doesn't fit into {fmt.width} bytes")
                at = at + np.arange(len(at))
                raw = ids.astype(fmt.dtype).tobytes()
                rows: dict[str, list] = {k: [] for k in DATA}

                def add(*values):
                    for k, v in zip(DATA, values):
                        rows[k].append(v)

                for d, begin, ends in zip(part.column(0).to_pylist(), at[:-1].tolist(), cuts(ids, at, fmt)):
                    digests, lengths, a = [], [], begin
                    for z in ends:
                        b = raw[a * fmt.width : z * fmt.width]
                        digest = name(b)
                        digests.append(digest)
                        lengths.append(z - a)
                        if digest not in seen:
                            seen.add(digest)
                            add("chunk", digest, z - a, b, None, None, None)
                        a = z
                    whole_of = b"".join(digests)
                    add("recipe", name(f"{d}/{row}".encode()), a - begin, None, d, whole_of, np.array(lengths, "<u4").tobytes())
                    row += 1
                if len(seen) > 500_000:
                    seen.clear()
                yield frames.batch(DATA, **rows)

    return frames.map_arrow(frames.texts_of(docs), f, "kind string, key binary, n long, ids binary, doc_id long, digests binary, lengths binary")


def once(df: DataFrame) -> DataFrame:
    """Chunks of the same digest, which follow each other in their partition, once; recipes as they are."""

    def f(batches):
        last = None
        for part in batches:
            keep = []
            for kind, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                keep.append(kind == "recipe" or key != last)
                if kind == "chunk":
                    last = key
            yield part.filter(pa.array(keep, pa.bool_()))

    return frames.map_arrow(df.sortWithinPartitions("kind", "key"), f, df.schema)


ORDERED = {"part": pa.int32(), "local_start": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "digests": pa.binary(), "lengths": pa.binary(), "root": pa.binary()}


def ordered(recipes: DataFrame) -> DataFrame:
    """Recipes in ascending order with their places, and after each part a row with its sum and root."""

    def f(batches):
        from pyspark import TaskContext

        part_no, at, n, tree = TaskContext.get().partitionId(), 0, 0, Tree()
        for whole in batches:
            ids, counts, digests = whole.column(0).to_pylist(), whole.column(1).to_numpy(), whole.column(2).to_pylist()
            for d, c, x in zip(ids, counts.tolist(), digests):
                tree.add(leaf(d, c, x))
            start = at + np.cumsum(counts) - counts
            at, n = at + int(counts.sum()), n + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([part_no] * len(ids), pa.int32()), pa.array(start), *whole.columns[:4], pa.nulls(len(ids), pa.binary())], names=list(ORDERED))
        if n:
            yield frames.batch(ORDERED, part=[part_no], local_start=[n], doc_id=[None], n_tokens=[at], digests=[None], lengths=[None], root=[tree.root])

    placed = recipes.withColumn("tie", F.xxhash64("digests")).repartitionByRange("doc_id", "tie", "key").sortWithinPartitions("doc_id", "tie", "key")
    return frames.map_arrow(placed.select("doc_id", F.col("n").alias("n_tokens"), "digests", "lengths"), f, "part int, local_start long, doc_id long, n_tokens long, digests binary, lengths binary, root binary")


def write(docs: DataFrame, at: str, path: str, end_id: int = 0, fmt: Format = Format()) -> str:
    """Encodes and stores `docs` (doc_id, text) in the new folder `at`, and returns that."""
    spark = docs.sparkSession
    data = once(chunked(docs, path, end_id, fmt).repartition("key"))
    data.write.partitionBy("kind").option("compression", "zstd").parquet(f"{at}/data")
    recipes = spark.read.schema("key binary, n long, doc_id long, digests binary, lengths binary").parquet(f"{at}/data/kind=recipe") if any_of(spark, f"{at}/data/kind=recipe") else None
    if recipes is None:
        recipes = spark.createDataFrame([], "key binary, n long, doc_id long, digests binary, lengths binary")
    ordered(recipes).write.option("compression", "zstd").parquet(f"{at}/recipes")
    sums = spark.read.schema(SORTED).parquet(f"{at}/recipes").filter("root is not null").select("part", "local_start", "n_tokens", "root").orderBy("part").collect()  # one row a partition
    rows, base, tree = [], 0, Tree()
    for r in sums:
        rows.append((r["part"], base, r["local_start"], r["n_tokens"], bytes(r["root"]), fmt.width))
        base += r["n_tokens"]
        tree.add(bytes(r["root"]))
    rows.append((-1, base, sum(r[2] for r in rows), base, tree.root, fmt.width))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{at}/manifest")
    return at


SORTED = "part int, local_start long, doc_id long, n_tokens long, digests binary, lengths binary, root binary"
MANIFEST = "part int, base long, n_docs long, n_tokens long, root binary, width int"


def any_of(spark: SparkSession, at: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def recipes_of(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, digests, lengths from the files."""
    recipes = spark.read.schema(SORTED).parquet(f"{at}/recipes").filter("root is null")
    bases = spark.read.schema(MANIFEST).parquet(f"{at}/manifest").filter("part >= 0").select("part", "base")
    return recipes.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "digests", "lengths", "part", "local_start")


def chunks_of(spark: SparkSession, at: str, with_ids: bool) -> DataFrame:
    """digest, n, crc (of the ids as unsigned 32-bit integers), and the ids, each checked against its name."""
    if not any_of(spark, f"{at}/data/kind=chunk"):
        return spark.createDataFrame([], "digest binary, n long, crc long" + ", ids array<int>" * with_ids)
    width = spark.read.schema(MANIFEST).parquet(f"{at}/manifest").filter("part < 0").first()["width"]
    kind = {"digest": pa.binary(), "n": pa.int64(), "crc": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def f(batches):
        for part in batches:
            out = {k: [] for k in kind}
            for digest, n, b in zip(*(part.column(i).to_pylist() for i in range(3))):
                if name(b) != digest or len(b) != n * width:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(b, f"<u{width}").astype("<u4")
                for k, v in zip(kind, (digest, n, zlib.crc32(ids), ids)):
                    out[k].append(v)
            yield frames.batch(kind, **out)

    data = spark.read.schema("key binary, n long, ids binary").parquet(f"{at}/data/kind=chunk")
    return frames.map_arrow(data, f, "digest binary, n long, crc long" + ", ids array<int>" * with_ids)


@functools.lru_cache(maxsize=1)
def shifts() -> np.ndarray:
    """[k, j, v]: what byte j with value v of a crc32 becomes when 2**k zero bytes follow."""
    poly, table = 0xEDB88320, []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (poly if v & 1 else 0)
        table.append(v)
    table = np.array(table, np.uint32)
    out = np.empty((48, 4, 256), np.uint32)
    x = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out[0] = table[x & 255] ^ (x >> 8)
    for k in range(1, 48):
        out[k] = _apply(out[k - 1], out[k - 1])
    return out


def _apply(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    return m[0][x & 255] ^ m[1][x >> 8 & 255] ^ m[2][x >> 16 & 255] ^ m[3][x >> 24 & 255]


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The share of parts with crc32 `crc` in the crc32 of a whole in which `after` bytes follow them."""
    out = crc.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        hit = after >> k & 1 == 1
        out[hit] = _apply(shifts()[k], out[hit])
    return out


def links(spark: SparkSession, at: str) -> DataFrame:
    """One row for each chunk of each document: doc_id, start, n_tokens, pos, digest, after (bytes that follow, 4 an id)."""

    def f(batches):
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "pos": pa.int32(), "digest": pa.binary(), "after": pa.int64()}
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                part = whole.slice(lo, 2000)
                if not len(part):
                    continue
                names, lengths = b"".join(part.column(3).to_pylist()), np.frombuffer(b"".join(part.column(4).to_pylist()), "<u4").astype(np.int64)
                n = np.asarray(pc.binary_length(part.column(4)), np.int64) // 4
                doc = np.repeat(np.arange(len(part)), n)
                first = np.cumsum(n) - n
                upto = np.cumsum(lengths)
                inside = upto - (upto - lengths)[first][doc]
                offsets = pa.py_buffer(np.arange(0, DIGEST * len(doc) + 1, DIGEST, dtype=np.int32))
                digests = pa.Array.from_buffers(pa.binary(), len(doc), [None, offsets, pa.py_buffer(names)])
                own = pa.array(doc)
                total = part.column(2).to_numpy()[doc]
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(total), pa.array(np.arange(len(doc)) - first[doc], pa.int32()), digests, pa.array(4 * (total - inside))], names=list(kinds))

    r = recipes_of(spark, at).select("doc_id", "start", "n_tokens", "digests", "lengths")
    return frames.map_arrow(r, f, "doc_id long, start long, n_tokens long, pos int, digest binary, after long")


def summary(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def f(batches):
        for part in batches:
            share = shifted(part.column(4).to_numpy(), part.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(share.astype(np.int64)), part.column(5)], ["doc_id", "start", "n_tokens", "share", "n"])

    met = links(spark, at).join(chunks_of(spark, at, False), "digest").select("doc_id", "start", "n_tokens", "after", "crc", "n")
    shares = frames.map_arrow(met, f, "doc_id long, start long, n_tokens long, share long, n long")
    whole = shares.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("n").alias("n"))
    return whole.select("doc_id", "start", F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error("a document misses ids")).cast("long").alias("n_tokens"), "ids_crc32")


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, ids of every document, rebuilt from its chunks."""
    met = links(spark, at).join(chunks_of(spark, at, True), "digest")
    return met.groupBy("doc_id", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))


def verify(spark: SparkSession, at: str) -> bool:
    """Whether recipes as read give the roots of the manifest; chunks are checked whenever they are read."""

    def f(batches):
        now, tree = None, None
        for whole in batches:
            for p, d, n, x in zip(*(whole.column(i).to_pylist() for i in range(4))):
                if p != now:
                    if now is not None:
                        yield frames.batch({"part": pa.int32(), "got": pa.binary()}, part=[now], got=[tree.root])
                    now, tree = p, Tree()
                tree.add(leaf(d, n, x))
        if now is not None:
            yield frames.batch({"part": pa.int32(), "got": pa.binary()}, part=[now], got=[tree.root])

    r = recipes_of(spark, at).repartition("part").sortWithinPartitions("part", "local_start")
    got = frames.map_arrow(r.select("part", "doc_id", "n_tokens", "digests"), f, "part int, got binary")
    manifest = spark.read.schema(MANIFEST).parquet(f"{at}/manifest")
    tree = Tree()
    for x in manifest.filter("part >= 0").orderBy("part").collect():
        tree.add(bytes(x["root"]))
    wrong = manifest.filter("part >= 0").join(got, "part", "left").filter("got is null or got <> root").count()
    return wrong == 0 and bytes(manifest.filter("part < 0").first()["root"]) == tree.root


def new_store(spark: SparkSession) -> str:
    return f"{frames.shared_dir(spark)}/parlance/store-{uuid.uuid4().hex}"
