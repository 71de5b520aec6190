"""Joins on time: sentences, words and turns of one recording.

Every join has the recording as its key.  Range conditions go through time buckets (`touching`): both sides are dealt to
the buckets they touch and meet there, so a recording of many hours is many small joins instead of a product.  Where a
nearest partner is wanted, both sides are merged into one ordered stream and read off by windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.intervals import BUCKET_MS, END, REC, SEQ, START, islands, touching

def turns_as(turns: DataFrame, *more: str) -> DataFrame:
    return turns.select(REC, F.col(SEQ).alias("turn_no"), F.col(START).alias("ts"), F.col(END).alias("te"), F.col("spk"), *more)


def nearest_turn(sentences: DataFrame, turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Speaker of each sentence: that of the first turn (by seq) that contains its midpoint, else of the turn whose
    boundary is nearest (the first among equals); null without turns.

    Containing turns come from a bucketed join; for the rest only four turns can be nearest, those of the last end and
    start before and the next ones after, which windows over the merged stream of boundaries find.
    """
    mid = (F.col(START) + F.col(END)) / 2
    s = sentences.withColumn("mid", mid)
    t = turns_as(turns)
    inside = touching(s.select(REC, SEQ, "mid"), t, "mid", "mid", "ts", "te", bucket_ms).groupBy(REC, SEQ).agg(F.min_by("spk", "turn_no").alias("_in"), F.count("*").alias("_n"))
    # one stream of boundaries (kind 0) and midpoints (kind 1)
    marks = t.select(REC, F.col("ts").cast("double").alias("at"), "turn_no", "spk").union(t.select(REC, F.col("te").cast("double").alias("at"), "turn_no", "spk"))
    marks = marks.groupBy(REC, "at").agg(F.min(F.struct("turn_no", "spk")).alias("who"))
    none = F.lit(None).cast(marks.schema["who"].dataType)
    stream = marks.select(REC, "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias(SEQ), "who", F.col("at").alias("mark")).union(s.select(REC, "mid", F.lit(1), F.col(SEQ).cast("long"), none, F.lit(None).cast("double")))
    w = Window.partitionBy(REC).orderBy("at", "kind")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    near = stream.select(REC, SEQ, "kind", "at", *[F.last(c, True).over(back).alias(f"b_{c}") for c in ("who", "mark")], *[F.first(c, True).over(ahead).alias(f"a_{c}") for c in ("who", "mark")]).filter("kind = 1")
    db, da = F.col("at") - F.col("b_mark"), F.col("a_mark") - F.col("at")
    before = F.struct(db.alias("d"), F.col("b_who.turn_no").alias("n"), F.col("b_who.spk").alias("spk"))
    after = F.struct(da.alias("d"), F.col("a_who.turn_no").alias("n"), F.col("a_who.spk").alias("spk"))
    best = F.when(db.isNull(), F.when(da.isNotNull(), after)).when(da.isNull(), before).otherwise(F.least(before, after))
    out = near.select(REC, SEQ, best["spk"].alias("_near"))
    return sentences.join(inside, [REC, SEQ], "left").join(out, [REC, SEQ], "left").withColumn("spk", F.when(F.col("_n") > 0, F.col("_in")).otherwise(F.col("_near"))).drop("_in", "_n", "_near")


def max_overlap(rows: DataFrame, turns: DataFrame, missing: str | None = None, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Speaker of the one turn with the largest common part (the first among equals; not summed over turns); `missing` where none has any."""
    t = turns_as(turns)
    common = (F.least(END, "te") - F.greatest(START, "ts")).alias("ov")
    met = touching(rows.select(REC, SEQ, START, END), t, START, END, "ts", "te", bucket_ms).select(REC, SEQ, "spk", "turn_no", common).filter("ov > 0")
    best = met.groupBy(REC, SEQ).agg(F.max_by("spk", F.struct("ov", -F.col("turn_no"))).alias("spk"), F.max("ov").alias("overlap_ms"))
    out = rows.join(best, [REC, SEQ], "left")
    return out.withColumn("spk", F.coalesce("spk", F.lit(missing))) if missing is not None else out


def asof_turn(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Speaker at each word's midpoint: that of the last turn that began by then, if it still lasts; else of the nearer of
    that turn's end and the next turn's start (the smaller speaker among equals).  Turns are in order of start."""
    s = words.withColumn("mid", (F.col(START) + F.col(END)) / 2)
    t = turns_as(turns)
    who = F.struct("ts", "te", "spk")
    kind = t.select(who.alias("x")).schema["x"].dataType
    stream = t.select(REC, F.col("ts").cast("double").alias("at"), F.lit(0).alias("kind"), F.col("turn_no").cast("long").alias("no"), who.alias("who"), F.lit(None).cast("long").alias(SEQ)).union(
        s.select(REC, "mid", F.lit(1), F.lit(None).cast("long"), F.lit(None).cast(kind), F.col(SEQ).cast("long")))
    w = Window.partitionBy(REC).orderBy("at", "kind", "no")
    near = stream.select(REC, SEQ, "kind", "at", F.last("who", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.first("who", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("n")).filter("kind = 1")
    back = F.struct(F.abs(F.col("at") - F.col("p.te")).alias("d"), F.col("p.spk").alias("spk"))
    ahead = F.struct(F.abs(F.col("n.ts") - F.col("at")).alias("d"), F.col("n.spk").alias("spk"))
    spk = F.when(F.col("p").isNotNull() & (F.col("at") <= F.col("p.te")), F.col("p.spk")).when(F.col("p").isNull(), F.col("n.spk")).when(F.col("n").isNull(), F.col("p.spk")).otherwise(F.least(back, ahead)["spk"])
    return words.join(near.select(REC, SEQ, spk.alias("spk")), [REC, SEQ], "left")


def words_to_sentences(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Words (rec_id, segment, seq, start_ms, end_ms, word) as sentences: cut where the segment or the speaker changes; a word
    without speaker keeps the one before in its segment (0 at its start); blank sentences go."""
    named = asof_turn(words, turns)
    inside = Window.partitionBy(REC, "segment").orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    named = named.withColumn("spk", F.coalesce(F.last("spk", True).over(inside), F.lit(0)))
    order = Window.partitionBy(REC).orderBy(SEQ)
    runs = islands(named, (F.col("spk") != F.lag("spk").over(order)) | (F.col("segment") != F.lag("segment").over(order)))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(SEQ, "word"))), lambda x: x["word"]), ""))
    out = runs.groupBy(REC, "island", "segment", "spk").agg(F.min_by(START, SEQ).alias(START), F.max_by(END, SEQ).alias(END), text.alias("text"))
    return out.filter(F.length("text") > 0).select(REC, F.col("island").alias(SEQ), START, END, F.col("spk").alias("speaker"), "text")


def overlap_groups(asr: DataFrame, diar: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Common parts of each ASR row with the turns it overlaps, in order of start, neighbours of one speaker as one (the
    end is the last part's, overlap holds if it holds for any)."""
    t = diar.select(REC, F.col(SEQ).alias("turn_no"), F.col(START).alias("ts"), F.col(END).alias("te"), F.col("speaker").alias("spk"), F.coalesce("overlap", F.lit(False)).alias("ov"))
    met = touching(asr.select(REC, SEQ, START, END), t, START, END, "ts", "te", bucket_ms)
    parts = met.select(REC, SEQ, "turn_no", F.greatest(START, "ts").alias("ps"), F.least(END, "te").alias("pe"), "spk", "ov").filter("pe > ps")
    order = Window.partitionBy(REC, SEQ).orderBy("ps", "turn_no")
    new = F.when(F.col("spk").eqNullSafe(F.lag("spk").over(order)) & F.lag("ps").over(order).isNotNull(), 0).otherwise(1)
    runs = parts.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct("ps", "turn_no")
    return runs.groupBy(REC, SEQ, "group_no", F.col("spk").alias("speaker")).agg(F.min("ps").alias(START), F.max_by("pe", key).alias(END), F.max("ov").alias("overlap"))


def overlapping_text(anchors: DataFrame, others: DataFrame, least_ms: int = 500, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Texts of the other side that overlap each anchor by at least `least_ms`, in order of start."""
    o = others.select(REC, F.col(SEQ).alias("other_no"), F.col(START).alias("os"), F.col(END).alias("oe"), F.col("text").alias("other_text"))
    met = touching(anchors.select(REC, SEQ, START, END), o, START, END, "os", "oe", bucket_ms).filter(F.least(END, "oe") - F.greatest(START, "os") >= least_ms)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("os", "other_no", "other_text"))), lambda x: x["other_text"]), "")
    return anchors.join(met.groupBy(REC, SEQ).agg(joined.alias("alt_text"), F.count("*").alias("n_alt")), [REC, SEQ], "left").withColumn("alt_text", F.coalesce("alt_text", F.lit(""))).withColumn("n_alt", F.coalesce("n_alt", F.lit(0)))


def replace_overlaps(sentences: DataFrame, ranges: DataFrame, separated: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Sentences whose midpoint lies in a range of two distinct known speakers give way to the separated ones; sorted
    rows get a new seq by start, then speaker (null first)."""
    real = ranges.filter(F.col("spk_a").isNotNull() & F.col("spk_b").isNotNull() & (F.col("spk_a") != F.col("spk_b")))
    s = sentences.withColumn("mid", (F.col(START) + F.col(END)) / 2)
    r = real.select(REC, F.col(START).alias("rs"), F.col(END).alias("re"))
    gone = touching(s.select(REC, SEQ, "mid"), r, "mid", "mid", "rs", "re", bucket_ms).select(REC, SEQ).distinct()
    stays = sentences.join(gone, [REC, SEQ], "left_anti")
    cols = [REC, START, END, "speaker", "text"]
    all_rows = stays.select(*cols, F.lit(False).alias("overlap"), F.col(SEQ).alias("_seq")).unionByName(separated.select(*cols, F.lit(True).alias("overlap"), F.col(SEQ).alias("_seq")))
    order = Window.partitionBy(REC).orderBy(START, F.col("speaker").asc_nulls_first(), "overlap", "_seq")
    return all_rows.withColumn(SEQ, F.row_number().over(order).cast("long")).drop("_seq")


def named_speakers(rows: DataFrame, names: DataFrame, prefix: str = "spk_") -> DataFrame:
    """Registered name of each speaker id, else the id with a prefix, else spk_unknown."""
    return rows.join(names.select(REC, "spk", "name"), [REC, "spk"], "left").withColumn("speaker", F.coalesce("name", F.concat(F.lit(prefix), F.col("spk").cast("string")), F.lit("spk_unknown"))).drop("name")


def new_names(candidates: DataFrame, registry: DataFrame, overwrite: bool = False) -> DataFrame:
    """Candidates whose name the registry doesn't have, or all when overwriting."""
    return candidates if overwrite else candidates.join(registry.select("name").distinct(), "name", "left_anti")
