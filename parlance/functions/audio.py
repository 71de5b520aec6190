"""Numbers from arrays of samples, as JVM expressions; spectra by a pandas UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _d(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def rms(x: str | Column) -> Column:
    return F.sqrt(F.aggregate(_d(x), F.lit(0.0), lambda s, v: s + v * v) / F.size(_d(x)))


def rms_dbfs(x: str | Column) -> Column:
    return 20 * F.log10(rms(x) + 1e-10)


def peak(x: str | Column) -> Column:
    return F.array_max(F.transform(_d(x), lambda v: F.abs(v)))


def crest_db(x: str | Column) -> Column:
    return 20 * F.log10((peak(x) + 1e-10) / (rms(x) + 1e-10))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# For each measure its weight, the value that scores nothing, and how far the one that scores all is from it.
LOUDNESS, CENTROID, FLATNESS, CREST = (0.20, -50, 25), (0.30, 800, 1500), (0.30, 0.05, 0.35), (0.20, 3, 9)


def quality_score(dbfs: Column, centroid: Column, flatness: Column, crest: Column, seconds: Column) -> Column:
    """0 .. 1 from loudness, spectral centroid and flatness, and crest factor; 0.5 for less than 0.3 s."""
    share = lambda x, of: (x - of[1]) / of[2]
    s = LOUDNESS[0] * clip01(share(dbfs, LOUDNESS)) + CENTROID[0] * clip01(share(centroid, CENTROID)) + FLATNESS[0] * clip01(1 - share(flatness, FLATNESS)) + CREST[0] * clip01(share(crest, CREST))
    return F.when(seconds < 0.3, F.lit(0.5)).otherwise(s)


def blended(score: Column, mos: Column) -> Column:
    """With a predicted opinion score (1 .. 5), half of it."""
    return F.when(mos.isNull(), score).otherwise(0.5 * score + 0.5 * clip01((mos - 1.5) / 3.0))


def classify(score: Column) -> Column:
    return F.when(score >= 0.6, "near").when(score >= 0.4, "medium").otherwise("far")


def normalised(x: str | Column) -> Column:
    p = peak(x)
    return F.when(p > 0, F.transform(_d(x), lambda v: v / p)).otherwise(_d(x))


def gained(x: str | Column, gain: Column | float) -> Column:
    g = gain if isinstance(gain, Column) else F.lit(float(gain))
    return F.transform(_d(x), lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * g)))


def to_unit_range(x: str | Column, is_int16: Column) -> Column:
    """Integer samples, and floats beyond 2, divided by 32768."""
    return F.when(is_int16 | (peak(x) > 2), F.transform(_d(x), lambda v: v / 32768)).otherwise(_d(x))


def sliced(x: str | Column, sr: int, start_s: Column, end_s: Column) -> Column:
    """Samples of a time window, clamped to the recording."""
    n = F.size(_d(x))
    lo = F.greatest(F.lit(0), F.least((start_s * sr).cast("int"), n))
    hi = F.greatest(lo, F.least((end_s * sr).cast("int"), n))
    return F.slice(_d(x), lo + 1, hi - lo)


def measured(samples: DataFrame, frame: int, key: str = "rec_id", vector: str = "samples") -> DataFrame:
    """Level, 10th and 95th percentile of the levels of frames of `frame` samples, and their range; for fewer than four frames only the level."""
    n = F.floor(F.size(_d(vector)) / frame)
    parts = samples.select(key, rms_dbfs(vector).alias("level"), n.alias("frames"), F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: rms_dbfs(F.slice(_d(vector), i * frame + 1, frame)))).alias("db"))
    each = parts.withColumn("x", F.explode_outer("db")).groupBy(key, "level", "frames").agg(F.percentile("x", F.lit(0.10)).alias("p10"), F.percentile("x", F.lit(0.95)).alias("p95"))
    few = F.col("frames") < 4
    none = F.lit(None).cast("double")
    return each.select(key, "level", F.when(few, none).otherwise(F.col("p10")).alias("p10"), F.when(few, none).otherwise(F.col("p95")).alias("p95"), F.when(few, none).otherwise(F.col("p95") - F.col("p10")).alias("range"))


def window_scan(frames: DataFrame, per_window: int, value: str = "value") -> DataFrame:
    """Means over tumbling windows of `per_window` rows."""
    no = F.floor((F.row_number().over(Window.partitionBy("rec_id").orderBy("seq")) - 1) / per_window)
    return frames.withColumn("window_no", no).groupBy("rec_id", "window_no").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def separation_verdict(rms_a: Column, rms_b: Column, speech_a: Column, speech_b: Column, sim: Column, energy_db: float = 12.0, alike: float = 0.80, least: float = 0.05, gap: float = 0.10) -> Column:
    """What two separated tracks are: struct(mode, keep): all_noise, noise_one, single, or overlap."""
    high, low = F.greatest(speech_a, speech_b), F.least(speech_a, speech_b)
    speaking = F.when(speech_a >= speech_b, 0).otherwise(1)
    strong = F.when(rms_a >= rms_b, 0).otherwise(1)
    out = lambda mode, *keep: F.struct(F.lit(mode).alias("mode"), F.array(*[k.cast("int") for k in keep]).cast("array<int>").alias("keep"))
    return (
        F.when(high < least, out("all_noise"))
        .when(high - low >= gap, out("noise_one", speaking))
        .when(F.abs(rms_a - rms_b) >= energy_db, out("single", strong))
        .when(sim >= alike, out("single", strong))
        .otherwise(out("overlap", F.lit(0), F.lit(1)))
    )


def speech_ratio(speech: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of each recording (rec_id, total_ms) that its speech intervals make up."""
    s = speech.groupBy("rec_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    return totals.join(s, "rec_id", "left").withColumn("ratio", F.when(F.col("total_ms") > 0, F.coalesce("speech_ms", F.lit(0)) / F.col("total_ms")).otherwise(F.lit(0.0)))


def spectral(vector: str = "samples", sr: int = 16_000, n_fft: int = 512, hop: int = 160):
    """Mean spectral centroid, flatness and 85 % roll-off of sample arrays (short-time Fourier transform, Hann window, centred)."""
    @F.pandas_udf("centroid double, flatness double, rolloff double")
    def f(x: pd.Series) -> pd.DataFrame:
        window = np.hanning(n_fft + 1)[:-1]
        freq = np.fft.rfftfreq(n_fft, 1 / sr)
        rows = []
        for v in x:
            v = np.pad(np.asarray(v, np.float64), n_fft // 2)
            frames = np.lib.stride_tricks.sliding_window_view(v, n_fft)[::hop]
            s = np.abs(np.fft.rfft(frames * window, axis=1))
            total = s.sum(1)
            centroid = np.divide(s @ freq, total, out=np.zeros(len(s)), where=total > 0).mean()
            p = np.maximum(s * s, 1e-10)
            flatness = (np.exp(np.log(p).mean(1)) / p.mean(1)).mean()
            cum = np.cumsum(s, axis=1)
            rolloff = freq[(cum >= 0.85 * cum[:, -1:]).argmax(1)].mean()
            rows.append((centroid, flatness, rolloff))
        return pd.DataFrame(rows, columns=["centroid", "flatness", "rolloff"])

    return f(F.col(vector))


def estimated_quality(samples: DataFrame, sr: int = 16_000, key: str = "rec_id", vector: str = "samples", n_fft: int = 512, hop: int = 160) -> DataFrame:
    """key, score and class of each recording from its own samples."""
    seconds = F.size(vector) / sr
    rows = samples.select(key, rms_dbfs(vector).alias("dbfs"), crest_db(vector).alias("crest_db"), seconds.alias("seconds"), spectral(vector, sr, n_fft, hop).alias("s"))
    rows = rows.withColumn("score", quality_score(F.col("dbfs"), F.col("s.centroid"), F.col("s.flatness"), F.col("crest_db"), F.col("seconds")))
    return rows.select(key, "score", classify(F.col("score")).alias("class"))
