"""Small helpers that the operators share: Arrow mapping and tables in the shared folder."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import shared_dir, ship


def kept(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Written to a table in the shared folder and read again: the lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/parlance/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._kept_at = at
    return out


def drop_kept(*tables: DataFrame) -> None:
    """Removes tables of kept frames that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["_kept_at"])
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(f):
    """`f`, which gives the memory that it freed back to the system when a task ends: idle workers count against an executor too."""

    def run(batches):
        yield from f(batches)
        release()

    return run


def release() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """`f(iterator of record batches)` on each partition; names and types of the result are `schema`."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(f), schema)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB instead of the default 64: texts can be long, and a batch stands in the JVM and in the worker.

    A session with a value of its own keeps it.
    """
    with contextlib.suppress(Exception):  # older versions don't know the setting
        if spark.conf.get(BATCH) in ("67108864b", "67108864", "64m", "64MB"):
            spark.conf.set(BATCH, "8m")


def map_rows(df: DataFrame, f) -> DataFrame:
    """As map_arrow, with the schema of `df` for the result, whatever its columns are called: `f` sees them as c0, c1, ..."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(tidy(f), plain.schema).toDF(*df.columns)


def batch(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and whole text only (other columns aren't read); a null text is an empty one."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
