"""The canonical plan of a meeting, from detected speech, chunk vectors and sentences to paragraphs, with its settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import intervals
from parlance.operators.intervals import BUCKET_MS
from parlance.plans import transcript as plans


@dataclass(frozen=True)
class Settings:
    gap_ms: int = 300  # silence over which speech segments are joined
    min_ms: int = 800  # shorter ones go
    chunk_ms: int = 3000
    hop_ms: int = 1500
    least_chunk_ms: int = 500
    least_dbfs: float = -50.0
    clusters: int | None = None
    threshold: float = 0.7
    fine: bool = True  # turns from chunks, else one speaker a segment
    rules: tuple[tuple[str, str], ...] = ()
    bucket_ms: int = BUCKET_MS


def chunks(speech: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Joined speech segments, and the chunks (rec_id, seq, chunk_no, start_ms, end_ms) that a model has to embed."""
    merged = intervals.merge_segments(speech, settings.gap_ms, settings.min_ms)
    return merged, intervals.chunk_windows(merged, settings.chunk_ms, settings.hop_ms)


def meeting(speech: DataFrame, vectors: DataFrame, sentences: DataFrame, settings: Settings = Settings(), names: DataFrame | None = None, ranges: DataFrame | None = None, separated: DataFrame | None = None) -> DataFrame:
    """Paragraphs from speech segments, the vectors of their chunks (rec_id, seq, chunk_no, dbfs, embedding) and sentences."""
    merged, all_chunks = chunks(speech, settings)
    loud = intervals.loud_chunks(all_chunks.join(vectors, ["rec_id", "seq", "chunk_no"]), settings.least_chunk_ms, settings.least_dbfs)
    order = Window.partitionBy("rec_id").orderBy("seq", "chunk_no")
    numbered = loud.withColumn("no", (F.row_number().over(order) - 1).cast("long")).select("rec_id", F.col("no").alias("seq"), "start_ms", "end_ms", "embedding")
    turns = plans.turns_from_vectors(merged, numbered, settings.clusters, settings.threshold, settings.fine)
    return plans.transcript(sentences, turns, list(settings.rules), names, ranges, separated, settings.bucket_ms)
