"""Totals, checks, top-k and naming over turns and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.intervals import END, REC, SEQ, START


def speaker_time(turns: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Total time (never less than 0 a turn), turns and share of each speaker."""
    out = turns.groupBy(REC, speaker).agg(F.sum(F.greatest(F.lit(0), F.col(END) - F.col(START))).alias("total_ms"), F.count("*").alias("n"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(REC).orderBy(F.desc("total_ms"), speaker)))


def document_summary(rows: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Sorted distinct speakers and the last end (0 without rows) of each recording."""
    return rows.groupBy(REC).agg(F.array_sort(F.collect_set(speaker)).alias("speakers"), F.coalesce(F.max(END), F.lit(0)).alias("duration_ms"), F.count("*").alias("n_segments"))


def duration_mismatch(a: DataFrame, b: DataFrame, most_ms: int = 30_000) -> DataFrame:
    """Last ends of two sources of each recording, and whether they differ by more than `most_ms`."""
    ends = lambda df, name: df.groupBy(REC).agg(F.max(END).alias(name))
    both = ends(a, "end_a").join(ends(b, "end_b"), REC, "full_outer")
    both = both.withColumn("end_a", F.coalesce("end_a", F.lit(0))).withColumn("end_b", F.coalesce("end_b", F.lit(0)))
    return both.withColumn("differs", F.abs(F.col("end_a") - F.col("end_b")) > most_ms)


def candidate_frequency(pairs: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """How often each (wrong, right) was mined, with the first context as example; most frequent first, the `most` first ones if that is given."""
    out = pairs.groupBy("wrong", "right").agg(F.count("*").alias("freq"), F.min_by("context_asr", "pos").alias("context_asr"))
    out = out.filter(F.col("freq") >= least).orderBy(F.desc("freq"), "wrong", "right")
    return out if most is None else out.limit(most)


def noise_clusters(rows: DataFrame, least: int, label: str = "label") -> DataFrame:
    n = F.count("*").over(Window.partitionBy(REC, label))
    return rows.withColumn("spk", F.when(n < least, F.lit("noise")).otherwise(F.col(label).cast("string")))


def enroll_candidates(paragraphs: DataFrame, least_s: float = 5.0, most_s: float = 15.0, top: int = 3, least_chars: int = 20) -> DataFrame:
    """The best passages of each speaker to enrol: not overlapped, of fitting length and enough letters, by a score of
    both (compared after rounding to 3 places), earlier ones first among equals."""
    text = F.trim(F.coalesce("text", F.lit("")))
    plain = F.length(F.regexp_replace(text, "(?U)[^一-鿿\\w]", ""))
    dur = (F.col(END) - F.col(START)) / 1000
    score = F.round(F.least(dur / 10, F.lit(1.0)) * 1.5 + F.least(plain / 80, F.lit(1.0)), 3)
    rows = paragraphs.filter(~F.coalesce("overlap", F.lit(False))).withColumn("speaker", F.coalesce(F.when(F.col("speaker") != "", F.col("speaker")), F.lit("Unknown")))
    rows = rows.withColumn("chars", plain).withColumn("dur_s", dur).withColumn("score", score)
    rows = rows.filter(F.col("dur_s").between(least_s, most_s) & (F.col("chars") >= least_chars))
    order = Window.partitionBy(REC, "speaker").orderBy(F.desc("score"), SEQ)
    snippet = F.concat(F.substring(text, 1, 80), F.when(F.length(text) > 80, "...").otherwise(""))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(REC, "speaker", "rank", SEQ, START, END, "score", "chars", snippet.alias("text"))


def best_reference(votes: DataFrame, least_s: float = 3.0, most_s: float = 10.0) -> DataFrame:
    """The cleanest segment of each speaker from rows (rec_id, seq, start_ms, end_ms, spk, purity, rms): twice the purity,
    fitness of the length and loudness; ties by the later, the longer, the purer, the louder one.  A longer one is cut to
    the middle."""
    dur = (F.col(END) - F.col(START)) / 1000
    fit = F.when(dur.between(least_s, most_s), 1.0).when(dur > most_s, 0.5).otherwise(dur / least_s)
    rows = votes.withColumn("dur_s", dur).withColumn("score", F.col("purity") * 2 + fit + (F.col("rms") + 50) / 50)
    order = Window.partitionBy(REC, "spk").orderBy(*[F.desc(c) for c in ("score", START, END, "dur_s", "purity", "rms")])
    best = rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    centre, half = F.floor((F.col(START) + F.col(END)) / 2), int(most_s * 1000 / 2)
    long = F.col("dur_s") > most_s
    return best.select(REC, "spk", SEQ, F.when(long, F.greatest(START, centre - half)).otherwise(F.col(START)).alias(START), F.when(long, F.least(END, centre + half)).otherwise(F.col(END)).alias(END), "score")


def longest_turns(turns: DataFrame, enough_ms: int = 30_000, least_ms: int = 1000, speaker: str = "spk") -> DataFrame:
    """Longest turns of each speaker until they make up `enough_ms`; speakers whose turns make less than `least_ms` go."""
    dur = F.col(END) - F.col(START)
    order = Window.partitionBy(REC, speaker).orderBy(F.desc("dur_ms"), SEQ)
    rows = turns.withColumn("dur_ms", dur).withColumn("before_ms", F.coalesce(F.sum("dur_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    picked = rows.filter(F.col("before_ms") < enough_ms)
    return picked.withColumn("picked_ms", F.sum("dur_ms").over(Window.partitionBy(REC, speaker))).filter(F.col("picked_ms") >= least_ms)


def first_appearance_names(rows: DataFrame, label: str = "label", prefix: str = "Speaker_") -> DataFrame:
    """Speaker_A, Speaker_B, ... by the earliest start of each label."""
    first = rows.groupBy(REC, label).agg(F.min(START).alias("_first"))
    no = F.row_number().over(Window.partitionBy(REC).orderBy("_first", label))
    return rows.join(first.withColumn("name", F.concat(F.lit(prefix), F.char(64 + no))).select(REC, label, "name"), [REC, label])


def filled_speakers(rows: DataFrame, speaker: str = "speaker", missing: str = "Speaker_X") -> DataFrame:
    """A missing speaker is that of the next row that has one, else of the one before, else `missing`."""
    order = Window.partitionBy(REC).orderBy(SEQ)
    known = F.when(F.col(speaker) != "", F.col(speaker))
    ahead = F.first(known, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    back = F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(speaker, F.coalesce(known, ahead, back, F.lit(missing)))


def upper_median(value: Column) -> Column:
    """The middle of sorted values, the upper one of two."""
    s = F.sort_array(F.collect_list(value))
    return F.element_at(s, (F.size(s) / 2).cast("int") + 1)


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many texts of each recording differ between two stages."""
    a, b = before.select(REC, SEQ, F.col("text").alias("_a")), after.select(REC, SEQ, F.col("text").alias("_b"))
    return a.join(b, [REC, SEQ]).groupBy(REC).agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), F.count("*").alias("n"))


def fusable(anchors: DataFrame, least_chars: int = 10) -> DataFrame:
    """Anchors worth fusing: not overlapped and of enough characters."""
    return anchors.filter(~F.coalesce("overlap", F.lit(False)) & (F.length("text") >= least_chars))


def long_enough(replies: DataFrame, least_chars: int = 2, text: str = "text") -> DataFrame:
    """Texts from overlapped speech that are worth keeping: of enough characters without blanks around them."""
    return replies.filter(F.length(F.regexp_replace(text, "^\\s+|\\s+$", "")) >= max(least_chars, 1))


def in_band(turns: DataFrame, least_ms: int = 5000, most_ms: int = 20_000) -> DataFrame:
    """Turns whose duration is within the band in which overlaps are looked for."""
    return turns.filter((F.col(END) - F.col(START)).between(least_ms, most_ms))
