"""Whole plans: from model outputs (segments, vectors, sentences) to paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import diff, numerals, text
from parlance.operators import clustering, folds, intervals, joins, vectors


def turns_from_vectors(segments: DataFrame, chunks: DataFrame, clusters: int | None = None, threshold: float = 0.7, fine: bool = True) -> DataFrame:
    """Segments and their chunks with vectors (rec_id, seq, start_ms, end_ms, embedding) to speaker turns."""
    named = clustering.cluster(chunks, keep=("start_ms", "end_ms"), clusters=clusters, threshold=threshold).dropna(subset=["rec_id", "seq"])
    return intervals.smooth_islands(named) if fine else intervals.segment_votes(segments, named)


def transcript(sentences: DataFrame, turns: DataFrame, rules: list[tuple[str, str]] = (), names: DataFrame | None = None, ranges: DataFrame | None = None, separated: DataFrame | None = None, bucket_ms: int = joins.BUCKET_MS) -> DataFrame:
    """Sentences and turns to paragraphs: numerals, corrections, speakers, overlaps, names, paragraphs, merged neighbours."""
    said = text.corrected(numerals.normalised(text.clean("text")), list(rules))
    rows = joins.nearest_turn(sentences.withColumn("text", said), turns, bucket_ms).withColumn("speaker", F.col("spk"))
    if ranges is not None:
        rows = joins.replace_overlaps(rows, ranges, separated, bucket_ms).withColumn("spk", F.col("speaker"))
    else:
        rows = rows.withColumn("overlap", F.lit(False))
    if names is not None:
        rows = joins.named_speakers(rows, names)
    else:
        rows = rows.withColumn("speaker", F.coalesce(F.concat(F.lit("spk_"), F.col("spk").cast("string")), F.lit("spk_unknown")))
    return folds.merge_consecutive(folds.group_paragraphs(rows.select("rec_id", "seq", "start_ms", "end_ms", "speaker", "overlap", "text")))


def fuse(asr: DataFrame, diar: DataFrame, bucket_ms: int = joins.BUCKET_MS) -> DataFrame:
    """Texts of one source with the speakers of another: each text is cut at marks in proportion to the time of the
    speakers that overlap it, in order."""
    rows = asr.filter(F.coalesce("text", F.lit("")) != "").withColumn("overlap", F.coalesce("overlap", F.lit(False)))
    groups = joins.overlap_groups(rows, diar, bucket_ms)
    listed = groups.groupBy("rec_id", "seq").agg(F.array_sort(F.collect_list(F.struct("group_no", "start_ms", "end_ms", "speaker", "overlap"))).alias("g"))
    met = rows.join(listed, ["rec_id", "seq"], "left")
    plain = F.struct(F.lit(0).cast("long").alias("group_no"), "start_ms", "end_ms", F.coalesce(F.when(F.col("speaker") != "", F.col("speaker")), F.lit("spk_unknown")).alias("speaker"), "overlap")
    one = F.struct(F.lit(0).cast("long").alias("group_no"), "start_ms", "end_ms", F.col("g")[0]["speaker"].alias("speaker"), (F.col("g")[0]["overlap"] | F.col("overlap")).alias("overlap"))
    few = met.filter(F.col("g").isNull() | (F.size("g") == 1)).select("rec_id", "seq", F.lit(0).alias("part"), F.when(F.col("g").isNull(), plain).otherwise(one).alias("x"), "text")
    many = met.filter(F.size("g") > 1).withColumn("t", diff.dealt_text(F.col("text"), F.transform("g", lambda x: x["end_ms"] - x["start_ms"])))
    cut = many.select("rec_id", "seq", F.posexplode(F.arrays_zip(F.col("g"), F.col("t"))).alias("part", "z")).select("rec_id", "seq", "part", F.col("z.g").alias("x"), F.col("z.t").alias("text")).filter("text <> ''")
    out = few.unionByName(cut)
    return out.select("rec_id", "seq", "part", "x.start_ms", "x.end_ms", "x.speaker", "x.overlap", "text")


def redistribute(blocks: DataFrame, turns: DataFrame, bucket_ms: int = joins.BUCKET_MS) -> DataFrame:
    """Texts of ASR blocks (rec_id, seq, subs, text) to the speakers that dominate their sub-segments, neighbours of one
    speaker as one, cut in proportion to time."""
    subs = blocks.filter(F.trim("text") != "").select("rec_id", F.col("seq").alias("block"), F.posexplode("subs").alias("pos", "s")).select("rec_id", "block", "pos", F.struct("block", "pos").alias("seq"), F.col("s.start_ms").alias("start_ms"), F.col("s.end_ms").alias("end_ms"))
    named = joins.max_overlap(subs, turns, bucket_ms=bucket_ms)
    w = Window.partitionBy("rec_id", "block").orderBy("pos")
    new = F.when(F.lag("pos").over(w).isNotNull() & F.col("spk").eqNullSafe(F.lag("spk").over(w)), 0).otherwise(1)
    runs = named.withColumn("_n", new).withColumn("g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    groups = runs.groupBy("rec_id", "block", "g", "spk").agg(F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"))
    listed = groups.groupBy("rec_id", F.col("block").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("g", "start_ms", "end_ms", "spk"))).alias("g"))
    met = blocks.join(listed, ["rec_id", "seq"]).withColumn("t", diff.dealt_text(F.col("text"), F.transform("g", lambda x: x["end_ms"] - x["start_ms"])))
    out = met.select("rec_id", "seq", F.posexplode(F.arrays_zip(F.col("g"), F.col("t"))).alias("part", "z"))
    return out.select("rec_id", "seq", "part", F.col("z.g.start_ms").alias("start_ms"), F.col("z.g.end_ms").alias("end_ms"), F.col("z.g.spk").alias("speaker"), F.col("z.t").alias("text")).filter("text <> ''")


def change_points(rows: DataFrame, threshold: float = 0.5, least: int = 8) -> DataFrame:
    """Speaker changes along vectors (rec_id, seq, at_ms, embedding): smoothed distances of neighbours, their peaks beyond the
    threshold, at least `least` places apart; the place of a cut is the later vector of its pair."""
    w = Window.partitionBy("rec_id").orderBy("seq")
    d = vectors.adjacent_distance(rows).withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    top = intervals.peaks(intervals.smoothed(d), threshold).select("rec_id", "seq", "place", F.col("at_ms"))
    return folds.spaced(top, least)
