"""Vectors: cosine, centroids, registry matches, audits.

Arithmetic is in double precision in JVM expressions.  The registry side of a match (`names`) is a table of enrolled
voices; matches join through blocks of it, and a side is only broadcast by Spark's own size threshold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parlance.session import shared_dir, ship

EPS = 1e-8


def doubles(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def unit(a: Column, eps: float = EPS) -> Column:
    n = norm(a) + eps
    return F.transform(a, lambda x: x / n)


def mean_vectors(df: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group: one partial sum a task and place, then the array again."""
    parts = df.select(*keys, F.posexplode(doubles(vector)).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))


def centroids(df: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    return mean_vectors(df, *keys, vector=vector).select(*keys, unit(F.col("mean")).alias("centroid"))


def ranked_matches(queries: DataFrame, names: DataFrame, k: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar names (name, voice) of each query, best first, ties by name; grade of the best one only."""
    q = queries.select(key, doubles(vector).alias("_q")).withColumn("_nq", norm(F.col("_q")))
    n = names.select("name", doubles("voice").alias("_v")).withColumn("_nv", norm(F.col("_v")))
    met = q.crossJoin(n).select(key, "name", (dot(F.col("_q"), F.col("_v")) / (F.col("_nq") * F.col("_nv") + EPS)).alias("sim"))
    order = Window.partitionBy(key).orderBy(F.desc("sim"), "name")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("grade", F.when(F.col("rank") == 1, grade(F.col("sim"))))


def grade(sim: Column) -> Column:
    return F.when(sim >= 0.55, "high").when(sim >= 0.40, "weak").otherwise("none")


def match(queries: DataFrame, names: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", missing: str | None = None) -> DataFrame:
    """Name of the most similar voice if it reaches the threshold, and the similarity (0 without names)."""
    best = ranked_matches(queries, names, 1, key, vector).select(key, "name", "sim")
    out = queries.select(key).join(best, key, "left")
    name = F.when(F.col("sim") >= threshold, F.col("name"))
    return out.select(key, (F.coalesce(name, F.lit(missing)) if missing else name).alias("name"), F.coalesce("sim", F.lit(0.0)).alias("sim"))


def verify(queries: DataFrame, names: DataFrame, least: float = 0.40, key: str = "vec_id", own: str = "own_name", vector: str = "embedding") -> DataFrame:
    """Similarity to the own voice, the best other, the margin, and whether the own one is good enough and best."""
    q = queries.select(key, own, doubles(vector).alias("_q")).withColumn("_nq", norm(F.col("_q")))
    n = names.select("name", doubles("voice").alias("_v")).withColumn("_nv", norm(F.col("_v")))
    met = q.crossJoin(n).withColumn("sim", dot(F.col("_q"), F.col("_v")) / (F.col("_nq") * F.col("_nv") + EPS))
    mine = F.col("name") == F.col(own)
    out = met.groupBy(key).agg(F.max(F.when(mine, F.col("sim"))).alias("own_sim"), F.max(F.when(~mine, F.col("sim"))).alias("best_other"))
    return out.withColumn("margin", F.col("own_sim") - F.col("best_other")).withColumn("passed", (F.col("own_sim") >= least) & (F.col("own_sim") > F.coalesce("best_other", F.lit(-1.0))))


def audit_pairs(names: DataFrame, threshold: float = 0.70, key: str = "vec_id", vector: str = "embedding", block: int = 8192) -> DataFrame:
    """Pairs i < j of the registry more similar than the threshold.

    All pairs have to be looked at: rows are dealt to blocks, written once to the shared folder, and each pair of blocks
    is a row of their product, read from there and never shuffled.  A task holds two blocks and a tile of similarities; only pairs beyond
    the threshold leave it.
    """
    ship(names.sparkSession)
    n, blocks = in_blocks(names, key, vector, block)
    apart = F.pmod(F.col("second") - F.col("no"), F.lit(n))  # each block meets half of the others
    meets = (2 * apart < n) | ((2 * apart == n) & (F.col("no") < F.col("second")))
    others = blocks.select(F.col("no").alias("second"), F.col("ids").alias("ids2"), F.col("width").alias("width2"), F.col("v").alias("v2"))
    both = blocks.join(others.hint("shuffle_replicate_nl"), meets)
    kind = dict(names.dtypes)[key]
    out = pa.schema([("i", to_arrow_type(both.schema["ids"].dataType.elementType)), ("j", to_arrow_type(both.schema["ids"].dataType.elementType)), ("sim", pa.float64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for t in batches:
            for k in range(len(t)):
                one, two = (unpacked(t, k, *c) for c in (("ids", "width", "v"), ("ids2", "width2", "v2")))
                same = t.column("no")[k] == t.column("second")[k]
                for i, j, sim in similar(*one, *two, threshold):
                    keep = (i < j) if same else (i != j)
                    found.append((np.minimum(i, j)[keep], np.maximum(i, j)[keep], sim[keep]))
                    size += len(found[-1][0])
                    if size > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), x.type) for c, x in zip(zip(*found), out)], schema=out)
                        found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), x.type) for c, x in zip(zip(*found), out)], schema=out)

    return both.mapInArrow(f, f"i {kind}, j {kind}, sim double")


def in_blocks(names: DataFrame, key: str, vector: str, block: int) -> tuple[int, DataFrame]:
    """Rows in blocks of about `block`, a row each (no from 0, ids, width, v: the vectors' bytes), in a table of the shared folder; and how many numbers there are."""
    spark, kinds = names.sparkSession, dict(names.dtypes)
    wide = "float" if kinds[vector] == "array<float>" else "double"
    rows = names.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{wide}>").alias("v")).filter("id is not null and v is not null")
    n = max(1, -(-rows.count() // block))
    schema = f"no int, ids array<{kinds[key]}>, width int, v binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = list(batches)
        if not any(len(b) for b in t):
            return
        t = pa.Table.from_batches(t).combine_chunks()
        ids, v = t.column("id").combine_chunks(), t.column("v").combine_chunks()
        width = pc.list_value_length(v).unique().to_pylist()
        if len(width) > 1:
            raise ValueError(f"vectors have to have one length, not {width[:5]}")
        flat = v.flatten().to_numpy(zero_copy_only=False)
        yield pa.record_batch({
            "no": pa.array([TaskContext.get().partitionId()], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "width": pa.array(width, pa.int32()), "v": pa.array([flat.astype(np.float32 if wide == "float" else np.float64).tobytes()], pa.binary()),
        })

    at = f"{shared_dir(spark)}/parlance/blocks-{uuid.uuid4().hex}"
    rows.repartition(n).mapInArrow(pack, schema).write.parquet(at)
    return n, spark.read.schema(schema).parquet(at)


def unpacked(t: pa.RecordBatch, k: int, ids: str, width: str, v: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (in double precision) of the block in row k."""
    i = t.column(ids)[k].values
    raw = t.column(v)[k].as_buffer()
    x = np.frombuffer(raw, np.float32 if raw.size == 4 * len(i) * t.column(width)[k].as_py() else np.float64)
    return i.to_numpy(zero_copy_only=False), x.astype(np.float64).reshape(len(i), -1)


def similar(ids: np.ndarray, x: np.ndarray, ids2: np.ndarray, y: np.ndarray, threshold: float, rows: int = 256, columns: int = 2048):
    """Tile by tile: ids of the rows of x and y that are more similar than the threshold, and the similarity."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    for at in range(0, len(x), rows):
        p = slice(at, at + rows)
        for left in range(0, len(y), columns):
            q = slice(left, left + columns)
            both = np.multiply.outer(nx[p], ny[q])
            both += EPS
            sim = x[p] @ y[q].T
            sim /= both
            a, b = np.nonzero(sim > threshold)
            yield ids[p][a], ids2[q][b], sim[a, b]


def upsert(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """The registry with `rows` (name, voice) added or put in place of those of the same name."""
    return remove(registry, rows.select("name")).unionByName(rows)


def remove(registry: DataFrame, names: DataFrame) -> DataFrame:
    return registry.join(names.select("name").distinct(), "name", "left_anti").select(*registry.columns)


def adjacent_distance(rows: DataFrame, vector: str = "embedding", key: str = "rec_id", order: str = "seq") -> DataFrame:
    """1 - cosine of each row and the one before it (both with unit length), without the first rows."""
    w = Window.partitionBy(key).orderBy(order)
    v = unit(doubles(vector))
    out = rows.withColumn("_u", v).withColumn("_before", F.lag("_u").over(w)).filter(F.col("_before").isNotNull())
    return out.withColumn("distance", 1 - dot(F.col("_u"), F.col("_before"))).drop("_u", "_before")


def window_means(windows: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """Mean of the unit vectors of each group, with unit length again."""
    return centroids(windows.withColumn("_u", unit(doubles(vector))), *keys, vector="_u")


def duplicate_warnings(new: DataFrame, registry: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Pairs of a new voice (name, voice) and a registered one of another name that are suspiciously similar."""
    a = new.select(F.col("name").alias("new_name"), doubles("voice").alias("_a"))
    b = registry.select("name", doubles("voice").alias("_b"))
    return a.join(b, F.col("new_name") != F.col("name")).select("new_name", "name", cosine(F.col("_a"), F.col("_b")).alias("sim")).filter(F.col("sim") > threshold)


def enrolled(samples: DataFrame) -> DataFrame:
    """name, voice: the mean of each name's sample vectors (name, embedding), not normalised."""
    return mean_vectors(samples, "name").select("name", F.col("mean").cast("array<float>").alias("voice"))
