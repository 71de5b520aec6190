"""Readers of the interchange files.  All take paths that Spark can open, with explicit schemas."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text

PARAGRAPH = "start double, end double, speaker string, overlap boolean, text string"


def paragraphs(spark: SparkSession, path: str, unit: str = "either") -> DataFrame:
    """Rows of paragraph files (a JSON list each), in seconds or (unit "ms") milliseconds, by one of three rules of guessing the unit.

    "either": both times by 1000 if either is beyond 100000; "start": if the start is; "ms": both times 1000 if the start is less.
    Rows without a start or end go; a missing speaker is spk_unknown (empty with "ms"); texts are trimmed (not with "ms").
    """
    rows = spark.read.schema(PARAGRAPH).json(path, multiLine=True).filter("start is not null and end is not null").withColumn("rec_id", F.input_file_name())
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("rec_id").orderBy(F.monotonically_increasing_id())) - 1)
    rule = {"either": text.seconds_either, "start": text.seconds_by_start, "ms": text.milliseconds_by_start}[unit]
    start, end = rule(F.col("start"), F.col("end"))
    said = F.coalesce("text", F.lit(""))
    speaker = F.coalesce("speaker", F.lit("")) if unit == "ms" else F.coalesce(F.when(F.col("speaker") != "", F.col("speaker")), F.lit("spk_unknown"))
    return rows.select("rec_id", "seq", start.alias("start"), end.alias("end"), speaker.alias("speaker"), (said if unit == "ms" else F.trim(said)).alias("text"), F.coalesce("overlap", F.lit(False)).alias("overlap"))


CORRECTIONS = "rules array<struct<wrong:string,right:string>>, hotwords array<string>"


def rules(spark: SparkSession, path: str) -> DataFrame:
    """pos, wrong, right of correction files of either form: {"rules": [...]} or a flat map, whose keys that begin with _ are left out."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", CORRECTIONS)
    flat = F.filter(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: ~e["key"].startswith("_"))
    entries = F.when(F.get_json_object("value", "$.rules").isNotNull(), listed["rules"]).otherwise(F.transform(flat, lambda e: F.struct(e["key"].alias("wrong"), e["value"].alias("right"))))
    return raw.select(F.posexplode(entries).alias("pos", "r")).select("pos", "r.wrong", "r.right")


def hotwords(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", CORRECTIONS).alias("c"))
    return raw.select(F.posexplode("c.hotwords").alias("pos", "word"))


def domain_words(hot: DataFrame, corrections: DataFrame) -> DataFrame:
    """Distinct hotwords and right sides."""
    return hot.select("word").union(corrections.select(F.col("right").alias("word"))).filter("word <> ''").distinct()


# Fixed value: how a recogniser's prompt begins.
PROMPT = "本段会议涉及以下专有名词与术语: "


def initial_prompt(hot: DataFrame, corrections: DataFrame, extra: str = "", most: int = 60) -> DataFrame:
    """One row: the first `most` distinct words in order of hotwords, right sides and extra ones, joined after a fixed beginning; empty without words."""
    spark = hot.sparkSession
    more = spark.createDataFrame([(2, i, w) for i, w in enumerate(extra.split())], "src int, pos int, word string")
    every = hot.select(F.lit(0).alias("src"), "pos", "word").union(corrections.select(F.lit(1), "pos", "right")).union(more).filter("word <> ''")
    first = every.groupBy("word").agg(F.min(F.struct("src", "pos")).alias("at")).orderBy("at").limit(most)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), "、").alias("words")).select(F.when(F.col("words") != "", F.concat(F.lit(PROMPT), F.col("words"))).otherwise("").alias("prompt"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of text files, or of JSON lists or {"paragraphs": []} of rows with a text, joined by newlines."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    rows = F.from_json("value", "array<struct<text:string>>")
    inner = F.from_json("value", "paragraphs array<struct<text:string>>")["paragraphs"]
    listed = F.when(F.ltrim("value").startswith("["), F.filter(rows, lambda r: F.coalesce(r["text"], F.lit("")) != "")).otherwise(inner)
    joined = F.array_join(F.transform(listed, lambda r: F.coalesce(r["text"], F.lit(""))), "\n")
    return raw.select("path", F.when(F.col("path").endswith(".json"), F.coalesce(joined, F.lit(""))).otherwise(F.col("value")).alias("text"))


STAMP = "^\\[(\\d+):(\\d+)(?:-(\\d+):(\\d+))?\\]\\s*(?:(.+?)\\s*:\\s*)?$"


def transcript_lines(lines: DataFrame) -> DataFrame:
    """Paragraphs of transcript lines (rec_id, seq, value): blank lines and time-stamp lines end one; a stamp's times and
    speaker hold until the next blank line ends a paragraph or another stamp comes."""
    order = Window.partitionBy("rec_id").orderBy("seq")
    v = F.regexp_replace("value", "\\s+$", "")
    rows = lines.withColumn("v", v).withColumn("blank", F.col("v") == "").withColumn("stamp", F.col("v").rlike(STAMP))
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.sum((F.col("blank") | F.col("stamp")).cast("int")).over(before))
    g = lambda i: F.regexp_extract("v", STAMP, i)
    sec = lambda m, s: F.when(g(m) != "", g(m).cast("int") * 60 + g(s).cast("int"))
    meta = F.struct(sec(1, 2).alias("start"), sec(3, 4).alias("end"), F.nullif(F.trim(g(5)), F.lit("")).alias("speaker"))
    kind = "struct<start:int,end:int,speaker:string>"
    said = Window.partitionBy("rec_id", "part")
    has_text = F.max((~F.col("blank") & ~F.col("stamp")).cast("int")).over(said) == 1
    rows = rows.withColumn("has_text", has_text)
    # a blank line forgets the stamp only if it ended a paragraph
    prev_text = F.lag(F.when(F.col("blank") | F.col("stamp"), 0).otherwise(1)).over(order)
    mark = F.when(F.col("stamp"), F.struct(F.lit(True).alias("on"), meta.alias("m"))).when(F.col("blank") & (prev_text == 1), F.struct(F.lit(False).alias("on"), F.lit(None).cast(kind).alias("m")))
    rows = rows.withColumn("state", F.last(mark, True).over(before))
    text_rows = rows.filter(~F.col("blank") & ~F.col("stamp"))
    out = text_rows.groupBy("rec_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"]), " ").alias("text"), F.min_by("state", "seq").alias("s"))
    return out.filter(F.trim("text") != "").select("rec_id", F.col("part").alias("seq"), F.col("s.m.start").alias("start"), F.col("s.m.end").alias("end"), F.col("s.m.speaker").alias("speaker"), "text")


CLOUD = "text string, audio_duration double, utterances array<struct<text:string,start_time:double,end_time:double,speaker:string,speaker_id:string,additions:string>>"


def cloud_results(raw: DataFrame, value: str = "value", key: str = "rec_id") -> DataFrame:
    """Rows of a cloud recogniser's answers (JSON): the speaker of `speaker`, else of `additions` if that is an object, else `speaker_id`;
    without utterances the whole text as one row."""
    inner = F.get_json_object(value, "$.result")
    root = F.when(inner.isNotNull(), inner).otherwise(F.col(value))
    lists = F.coalesce(F.get_json_object(root, "$.utterances"), F.get_json_object(root, "$.Utterances"))
    parsed = F.from_json(lists, "array<struct<text:string,start_time:double,end_time:double,speaker:string,speaker_id:string,additions:string>>")
    rows = raw.select(key, root.alias("_root"), parsed.alias("_u"))
    some = rows.filter(F.size("_u") > 0).select(key, F.posexplode("_u").alias("seq", "u"))
    extra = F.col("u.additions")
    spk = F.coalesce(F.col("u.speaker"), F.when(extra.startswith("{"), F.get_json_object(extra, "$.speaker")).otherwise(F.col("u.speaker_id")))
    sec = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) / 1000, 2)
    named = F.coalesce(F.concat(F.lit("spk_"), spk), F.lit("spk_unknown"))
    out = some.select(key, "seq", sec("u.start_time").alias("start"), sec("u.end_time").alias("end"), named.alias("speaker"), F.lit(False).alias("overlap"), F.trim(F.coalesce("u.text", F.lit(""))).alias("text"))
    whole = rows.filter(F.col("_u").isNull() | (F.size("_u") == 0))
    duration = F.round(F.coalesce(F.get_json_object("_root", "$.audio_duration").cast("double"), F.lit(0.0)) / 1000, 2)
    return out.union(whole.select(key, F.lit(0), F.lit(0.0), duration, F.lit("spk_unknown"), F.lit(False), F.coalesce(F.get_json_object("_root", "$.text"), F.lit(""))))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, voice array<float>").parquet(path)


def enrol_plan(plan: DataFrame, default_dur: float = 10.0) -> DataFrame:
    """(name, start, end, time, dur) with start and end in seconds: given, or from time and duration."""
    t = text.parsed_time("time")
    start = F.coalesce(text.parsed_time("start"), t)
    end = F.coalesce(text.parsed_time("end"), t + F.coalesce(F.col("dur").cast("double"), F.lit(default_dur)))
    return plan.select("name", start.alias("start_s"), end.alias("end_s"))


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sr, samples of 16-bit PCM wave files (mono: channels are averaged)."""
    @F.pandas_udf("struct<sr:int,samples:array<float>>")
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = []
        for b in content:
            with wave.open(io.BytesIO(b)) as w:
                x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
                rows.append((w.getframerate(), x.astype(np.float32)))
        return pd.DataFrame(rows, columns=["sr", "samples"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode("content").alias("a")).select("path", "a.sr", "a.samples")
