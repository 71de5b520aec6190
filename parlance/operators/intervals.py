"""Interval operators.

Rows are (rec_id, seq, start_ms, end_ms, ...): `seq` is a total order within a recording.  Everything is a window over
one recording or an explode; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REC, SEQ, START, END = "rec_id", "seq", "start_ms", "end_ms"
BUCKET_MS = 60_000  # some turns of a talk; for other data a few times the usual length


def by_rec(*order: str) -> Window:
    return Window.partitionBy(REC).orderBy(*(order or (SEQ,)))


def islands(df: DataFrame, opens: Column, name: str = "island", order: tuple[str, ...] = (SEQ,)) -> DataFrame:
    """Numbers runs of rows: a new run where `opens` holds (a null opens one)."""
    return df.withColumn("_opens", F.when(opens, 1).when(opens.isNull(), 1).otherwise(0)).withColumn(name, F.sum("_opens").over(by_rec(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def bucketed(df: DataFrame, start: Column, end: Column, bucket_ms: int) -> DataFrame:
    lo, hi = F.floor(start / bucket_ms), F.floor(F.greatest(end, start) / bucket_ms)
    return df.withColumn("_bucket", F.explode(F.sequence(lo, hi)))


def touching(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of one recording whose intervals [ls, le] and [rs, re] touch, each pair once.

    A pair shares all buckets of its common part; it is kept in the first of them.
    """
    a = bucketed(left, F.col(ls), F.col(le), bucket_ms)
    b = bucketed(right, F.col(rs), F.col(re), bucket_ms)
    first = F.col("_bucket") == F.floor(F.greatest(ls, rs) / bucket_ms)
    return a.join(b, [REC, "_bucket"]).filter((F.col(rs) <= F.col(le)) & (F.col(re) >= F.col(ls)) & first).drop("_bucket")


def merge_segments(segments: DataFrame, gap_ms: int = 300, min_ms: int = 800) -> DataFrame:
    """Joins a segment to the one before it if the silence between them is at most `gap_ms`; the end is that of the last
    joined segment, even if an earlier one ended later.  Shorter results than `min_ms` go."""
    before = F.lag(END).over(by_rec())
    runs = islands(segments, F.col(START) - before > gap_ms)
    out = runs.groupBy(REC, "island").agg(F.min_by(START, SEQ).alias(START), F.max_by(END, SEQ).alias(END))
    return out.filter(F.col(END) - F.col(START) >= min_ms).select(REC, F.col("island").alias(SEQ), START, END)


def chunk_windows(segments: DataFrame, max_ms: int = 3000, hop_ms: int = 1500) -> DataFrame:
    """Segments longer than `max_ms` become windows that begin every `hop_ms`; the last ones may be short."""
    long = F.col(END) - F.col(START) > max_ms
    starts = F.when(long, F.sequence(F.col(START), F.col(END) - 1, F.lit(hop_ms).cast("long"))).otherwise(F.array(START))
    out = segments.select(REC, SEQ, START, END, F.posexplode(starts).alias("chunk_no", "at"))
    stop = F.when(F.col(END) - F.col(START) > max_ms, F.least(F.col("at") + max_ms, F.col(END))).otherwise(F.col(END))
    return out.select(REC, SEQ, "chunk_no", F.col("at").alias(START), stop.alias(END))


def cut_windows(segments: DataFrame, max_ms: int = 30_000, min_ms: int = 300) -> DataFrame:
    """Hard cuts every `max_ms` without overlap; pieces shorter than `min_ms` go."""
    starts = F.sequence(F.col(START), F.greatest(F.col(START), F.col(END) - 1), F.lit(max_ms).cast("long"))
    out = segments.filter(F.col(END) > F.col(START)).select(REC, SEQ, END, F.posexplode(starts).alias("piece_no", "at"))
    out = out.select(REC, SEQ, "piece_no", F.col("at").alias(START), F.least(F.col("at") + max_ms, F.col(END)).alias(END))
    return out.filter(F.col(END) - F.col(START) >= min_ms)


def hysteresis(frames: DataFrame, onset: float = 0.5, offset: float = 0.35, min_on_ms: int = 250, min_off_ms: int = 200, pad_on_ms: int = 50, pad_off_ms: int = 50) -> DataFrame:
    """Speech intervals from frame scores (rec_id, seq, t_ms, prob, duration_ms).

    On from the first score >= onset until one < offset (onset >= offset).  An interval still open ends with the recording.
    Intervals are padded and clamped to the recording, joined over silences of at most `min_off_ms` (with the largest
    end), and dropped if shorter than `min_on_ms`.
    """
    if onset < offset:
        raise ValueError("onset must not be less than offset")
    order = by_rec("seq")
    mark = F.when(F.col("prob") >= onset, 1).when(F.col("prob") < offset, 0)
    state = F.coalesce(F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    marked = frames.withColumn("on", state).withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0)))
    edges = marked.filter(F.col("on") != F.col("was")).withColumn("next_t", F.lead("t_ms").over(order))
    raw = edges.filter("on = 1").select(REC, SEQ, F.greatest(F.col("t_ms") - pad_on_ms, F.lit(0)).alias(START), F.least(F.coalesce("next_t", "duration_ms") + pad_off_ms, F.col("duration_ms")).alias(END))
    return join_near(raw, min_off_ms).filter(F.col(END) - F.col(START) >= min_on_ms)


def join_near(segments: DataFrame, gap_ms: int, same: tuple[str, ...] = ()) -> DataFrame:
    """Joins neighbours (by start) whose gap to the furthest end so far is at most `gap_ms`, and that agree in the columns `same`; the end is the largest."""
    order = by_rec(START, SEQ)
    if not same:
        reach = F.max(END).over(order.rowsBetween(Window.unboundedPreceding, -1))
        runs = islands(segments, F.col(START) - reach > gap_ms, order=(START, SEQ))
    else:
        other = F.lit(False)
        for c in same:
            other = other | ~F.col(c).eqNullSafe(F.lag(c).over(order))
        runs = islands(segments, F.coalesce(other, F.lit(True)), "_run", (START, SEQ))
        inner = Window.partitionBy(REC, "_run").orderBy(START, SEQ)
        reach = F.max(END).over(inner.rowsBetween(Window.unboundedPreceding, -1))
        runs = islands(runs, F.col(START) - reach > gap_ms, order=(START, SEQ))
    out = runs.groupBy(REC, "island", *same).agg(F.min(START).alias(START), F.max(END).alias(END))
    return out.select(REC, F.col("island").alias(SEQ), START, END, *same)


def label_turns(turns: DataFrame, min_ms: int = 250, gap_ms: int = 250) -> DataFrame:
    """Turns (rec_id, seq, start_ms, end_ms, label) with labels numbered by first appearance (before anything is
    dropped), without turns shorter than `min_ms`, sorted, and neighbours of one speaker joined over short gaps."""
    first = Window.partitionBy(REC)
    order = F.min(SEQ).over(Window.partitionBy(REC, "label"))
    numbered = turns.withColumn("_first", order).withColumn("spk", (F.dense_rank().over(first.orderBy("_first")) - 1).cast("long"))
    kept = numbered.filter(F.col(END) - F.col(START) >= min_ms)
    return join_near(kept, gap_ms, ("spk",))


def smooth_islands(chunks: DataFrame, label: str = "label", smooth: bool = True) -> DataFrame:
    """A label between two equal other ones takes theirs (all judged on the original labels); then equal neighbours are joined, whatever the gap."""
    order = by_rec()
    a, b = F.lag(label).over(order), F.lead(label).over(order)
    new = F.when((a == b) & (a != F.col(label)), a).otherwise(F.col(label)) if smooth else F.col(label)
    named = chunks.withColumn("spk", new)
    runs = islands(named, F.col("spk") != F.lag("spk").over(order))
    return runs.groupBy(REC, "island", "spk").agg(F.min_by(START, SEQ).alias(START), F.max_by(END, SEQ).alias(END)).select(REC, F.col("island").alias(SEQ), START, END, "spk")


def segment_votes(segments: DataFrame, chunks: DataFrame, slack_ms: int = 1, gap_ms: int = 500, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Each segment gets the commonest label of its chunks (a chunk belongs to the first segment that contains it; ties
    go to the label seen first); then neighbours of one speaker are joined over gaps of at most `gap_ms`."""
    s = segments.select(REC, F.col(SEQ).alias("seg"), F.col(START).alias("ss"), F.col(END).alias("se"))
    c = chunks.select(REC, F.col(SEQ).alias("chunk"), F.col(START).alias("cs"), F.col(END).alias("ce"), "label")
    inside = touching(c, s, "cs", "ce", "ss", "se", bucket_ms).filter((F.col("cs") >= F.col("ss")) & (F.col("ce") <= F.col("se") + slack_ms))
    owner = inside.groupBy(REC, "chunk").agg(F.min("seg").alias("seg"), F.first("label").alias("label"))
    votes = owner.groupBy(REC, "seg", "label").agg(F.count("*").alias("n"), F.min("chunk").alias("first"))
    won = votes.groupBy(REC, "seg").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("spk"))
    turns = s.join(won, [REC, "seg"]).select(REC, F.col("seg").alias(SEQ), F.col("ss").alias(START), F.col("se").alias(END), "spk")
    order = by_rec()
    runs = islands(turns, ~F.col("spk").eqNullSafe(F.lag("spk").over(order)) | (F.col(START) - F.lag(END).over(order) > gap_ms))
    return runs.groupBy(REC, "island", "spk").agg(F.min_by(START, SEQ).alias(START), F.max_by(END, SEQ).alias(END)).select(REC, F.col("island").alias(SEQ), START, END, "spk")


def diarized_turns(chunks: DataFrame, min_chunks: int = 5, gap_ms: int = 500) -> DataFrame:
    """Labels of few chunks become `noise`; then equal neighbours are joined over gaps of at most `gap_ms`."""
    n = F.count("*").over(Window.partitionBy(REC, "label"))
    named = chunks.withColumn("spk", F.when(n < min_chunks, F.lit("noise")).otherwise(F.col("label").cast("string")))
    order = by_rec()
    runs = islands(named, ~F.col("spk").eqNullSafe(F.lag("spk").over(order)) | (F.col(START) - F.lag(END).over(order) > gap_ms))
    return runs.groupBy(REC, "island", "spk").agg(F.min_by(START, SEQ).alias(START), F.max_by(END, SEQ).alias(END)).select(REC, F.col("island").alias(SEQ), START, END, "spk")


def run_lengths(rows: DataFrame, speaker: str = "speaker", text: str | None = None) -> DataFrame:
    """Consecutive rows of one speaker as one, whatever gap and length; texts are joined in order."""
    runs = islands(rows, ~F.col(speaker).eqNullSafe(F.lag(speaker).over(by_rec())))
    more = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(SEQ, text))), lambda x: x[text]), "").alias(text)] if text else []
    return runs.groupBy(REC, F.col("island"), speaker).agg(F.min_by(START, SEQ).alias(START), F.max_by(END, SEQ).alias(END), F.count("*").alias("n"), *more).withColumnRenamed("island", SEQ)


def sliding_windows(segments: DataFrame, window_ms: int = 750, hop_ms: int = 100) -> DataFrame:
    """Full windows inside each segment and their centres."""
    last = F.col(END) - window_ms
    out = segments.filter(last >= F.col(START)).select(REC, SEQ, F.posexplode(F.sequence(F.col(START), last, F.lit(hop_ms).cast("long"))).alias("window_no", START))
    return out.select(REC, SEQ, "window_no", START, (F.col(START) + window_ms).alias(END), (F.col(START) + window_ms / 2).cast("long").alias("centre_ms"))


def smoothed(series: DataFrame, value: str = "distance") -> DataFrame:
    """Mean of three neighbours, places beyond the edges counting as zero; series of fewer than three stay as they are."""
    around = F.sum(value).over(by_rec().rowsBetween(-1, 1)) / 3
    return series.withColumn("smooth", F.when(F.count("*").over(Window.partitionBy(REC)) < 3, F.col(value)).otherwise(around))


def peaks(series: DataFrame, threshold: float, value: str = "smooth") -> DataFrame:
    """Places that are above the threshold and no less than both neighbours; the first and last have only one and are none."""
    order = by_rec()
    v, a, b = F.col(value), F.lag(value).over(order), F.lead(value).over(order)
    return series.withColumn("_peak", (v > threshold) & (v >= a) & (v >= b)).filter("_peak").drop("_peak")


def split_at(segments: DataFrame, cuts: DataFrame, min_segment_ms: int = 5000, min_piece_ms: int = 200, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Segments of at least `min_segment_ms` split at the cuts (rec_id, at_ms) that lie inside; of split ones, shorter pieces than `min_piece_ms` go."""
    long = segments.filter(F.col(END) - F.col(START) >= min_segment_ms).select(REC, SEQ, START, END)
    inside = touching(long, cuts.select(REC, "at_ms"), START, END, "at_ms", "at_ms", bucket_ms).filter((F.col("at_ms") > F.col(START)) & (F.col("at_ms") < F.col(END)))
    at = inside.groupBy(REC, SEQ).agg(F.array_sort(F.collect_set("at_ms")).alias("at"))
    edges = segments.join(at, [REC, SEQ], "left").withColumn("at", F.coalesce("at", F.array().cast("array<long>")))
    edges = edges.withColumn("lo", F.concat(F.array(START), "at")).withColumn("hi", F.concat("at", F.array(END)))
    out = edges.select(REC, SEQ, F.size("at").alias("_cuts"), F.posexplode(F.arrays_zip("lo", "hi")).alias("piece_no", "p"))
    out = out.select(REC, SEQ, "_cuts", "piece_no", F.col("p.lo").alias(START), F.col("p.hi").alias(END))
    return out.filter((F.col(END) - F.col(START) >= min_piece_ms) | (F.col("_cuts") == 0)).drop("_cuts")


def split_summary(segments: DataFrame, pieces: DataFrame, min_segment_ms: int = 5000) -> DataFrame:
    """Of each recording: segments before and after splitting, those long enough to be split, and cuts made."""
    before = segments.groupBy(REC).agg(F.count("*").alias("n_in"), F.count_if(F.col(END) - F.col(START) >= min_segment_ms).alias("n_long"))
    after = pieces.groupBy(REC).agg(F.count("*").alias("n_out"), F.sum((F.col("piece_no") > 0).cast("int")).alias("n_cuts"))
    return before.join(after, REC, "left").na.fill(0)


def frame_scores(frames: DataFrame, scores: str = "scores") -> DataFrame:
    """Speech score of a frame: the largest of its local speakers' scores."""
    return frames.withColumn("prob", F.array_max(scores))


def loud_chunks(chunks: DataFrame, min_ms: int = 500, min_dbfs: float = -50.0) -> DataFrame:
    """Chunks long and loud enough to embed, from rows with a level `dbfs`; a cheap filter before any model."""
    return chunks.filter((F.col(END) - F.col(START) >= min_ms) & (F.col("dbfs") >= min_dbfs))
