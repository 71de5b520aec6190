"""Registration, and the inputs that the queries derive from the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.session import table

BUCKET_MS = 20_000_000  # the segments below last some hours

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name; results get wide types: long, double, and doubles of 6 places."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widened(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def widened(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("float", "double"):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(name))
    return df.select(*out)


#: Milliseconds since 1970 of the wall-clock column ts, whatever the session's time zone.
EVENT_MS = "unix_date(to_date(ts)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + cast(floor(extract(SECOND FROM ts) * 1000) as bigint)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments: a user's events are a recording, the value is the duration in hundreds of seconds."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "rec_id")  # named first, so that its partitioning serves what follows
    ms = F.expr(EVENT_MS)
    order = Window.partitionBy("rec_id").orderBy("ts", "event_id")
    return e.select(
        "rec_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), ms.alias("start_ms"),
        (ms + F.round(F.col("value") * 1000).cast("long") * 100).alias("end_ms"), F.col("event_type").alias("speaker"), "value", "event_id",
    )


SEG = """seg AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch_us(ts) // 1000 AS start_ms,
  epoch_us(ts) // 1000 + CAST(round(value * 1000) AS BIGINT) * 100 AS end_ms, event_type AS speaker, value, event_id FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third segment, as a turn of one of four speakers."""
    return segments(spark, sf_dir).filter("seq % 3 = 0").withColumn("spk", F.col("event_id") % 4)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other segments, as sentences."""
    return segments(spark, sf_dir).filter("seq % 3 <> 0").withColumn("text", F.concat("speaker", F.lit(" "), F.col("event_id").cast("string"), F.lit(". ")))


PARTS = SEG + """, turns AS (SELECT *, event_id % 4 AS spk FROM seg WHERE seq % 3 = 0),
sents AS (SELECT *, speaker || ' ' || event_id || '. ' AS text FROM seg WHERE seq % 3 <> 0)"""


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sentences: pairs of turns have one speaker, lengths give the times, every seventh turn overlaps."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "rec_id").withColumnRenamed("turn", "seq")
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    w = Window.partitionBy("rec_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n).over(w), F.lit(0)) * 60 + F.col("seq") * 900
    return c.select("rec_id", "seq", start.alias("start_ms"), (start + n * 60).alias("end_ms"), F.concat(F.lit("spk_"), F.floor(F.col("seq") / 3).cast("string")).alias("speaker"), (F.col("seq") % 7 == 5).alias("overlap"), text.alias("text"))


SPOKEN = """spoken AS (SELECT conv_id AS rec_id, turn AS seq, st AS start_ms, st + n * 60 AS end_ms, 'spk_' || (turn // 3) AS speaker, turn % 7 = 5 AS overlap, text FROM
  (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(text, '') AS text,
    CAST(coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 60 + turn * 900 AS st FROM conversations))"""
