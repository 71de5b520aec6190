"""Writers of the interchange files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text


def paragraphs_json(rows: DataFrame, path: str) -> None:
    """start, end (seconds, 2 places), speaker, overlap, text, one JSON object a line, sorted within recordings."""
    rows.select("rec_id", "seq", F.round(F.col("start_ms") / 1000, 2).alias("start"), F.round(F.col("end_ms") / 1000, 2).alias("end"), F.coalesce("speaker", F.lit("spk_unknown")).alias("speaker"), F.coalesce("overlap", F.lit(False)).alias("overlap"), "text").repartitionByRange("rec_id", "seq").sortWithinPartitions("rec_id", "seq").write.json(path)


def readable(rows: DataFrame) -> DataFrame:
    """rec_id and the readable transcript: a header line and the text of each paragraph, blank lines between."""
    block = F.concat(text.header(F.coalesce("speaker", F.lit("spk_unknown")), F.col("start_ms") / 1000, F.col("end_ms") / 1000, F.col("overlap")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return text.joined(rows.withColumn("block", block), "rec_id").withColumnRenamed("prompt", "transcript")


def readable_text(rows: DataFrame, path: str) -> None:
    readable(rows).select("transcript").write.option("lineSep", "\n\n\n").text(path)


def document(rows: DataFrame, route: str) -> DataFrame:
    """One nested row a recording: source, route, duration_sec, speakers, segments."""
    segment = F.struct(F.col("seq"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "speaker", "text")
    out = rows.groupBy("rec_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"), F.array_sort(F.collect_set("speaker")).alias("names"), (F.coalesce(F.max("end_ms"), F.lit(0)) / 1000).alias("duration_sec"))
    return out.select(F.col("rec_id").alias("source"), F.lit(route).alias("route"), "duration_sec", F.transform("names", lambda n: F.struct(n.alias("id"), n.alias("name"))).alias("speakers"), "segments")


def next_path(spark: SparkSession, path: str) -> str:
    """The path, or the first of path_1, path_2, ... that doesn't exist."""
    jvm = spark._jvm.org.apache.hadoop.fs
    there = lambda p: jvm.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(p))
    stem, dot, ext = path.rpartition(".") if "." in path.rsplit("/", 1)[-1] else (path, "", "")
    at, k = path, 0
    while there(at):
        k += 1
        at = f"{stem}_{k}{dot}{ext}"
    return at


def appended_rules(rules: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules with new (wrong, right) ones added, and one row of counts (added, skipped)."""
    fresh = new.select("wrong", "right").distinct().join(rules.select("wrong", "right"), ["wrong", "right"], "left_anti")
    counts = new.agg(F.count("*").alias("n")).crossJoin(fresh.agg(F.count("*").alias("added"))).select("added", (F.col("n") - F.col("added")).alias("skipped"))
    return rules.select("wrong", "right").unionByName(fresh), counts


def stage_dump(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Writes a stage as JSON if a folder is given, and gives it back."""
    if folder:
        df.write.mode("overwrite").json(f"{folder}/{name}")
    return df


def cut_samples(recordings: DataFrame, plan: DataFrame) -> DataFrame:
    """Samples of each plan row (rec_id, name, start_s, end_s) from recordings (rec_id, sr, samples), clamped; an end not beyond its start is an error."""
    from parlance.functions import audio

    met = plan.join(recordings, "rec_id")
    ok = F.when(F.col("end_s") > F.col("start_s"), F.col("end_s")).otherwise(F.raise_error(F.lit("a cut must end after it starts")).cast("double"))
    lo = F.greatest(F.lit(0), F.least((F.col("start_s") * F.col("sr")).cast("int"), F.size("samples")))
    hi = F.greatest(lo, F.least((ok * F.col("sr")).cast("int"), F.size("samples")))
    out = met.select("rec_id", F.concat(text.file_safe("name"), F.lit(".wav")).alias("file"), "sr", F.slice("samples", lo + 1, hi - lo).alias("samples"))
    return out.withColumn("dbfs", audio.rms_dbfs("samples")).withColumn("grade", F.when(F.col("dbfs") > -30, "good").when(F.col("dbfs") > -40, "fair").otherwise("weak"))
