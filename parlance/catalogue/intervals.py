"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.catalogue.base import BUCKET_MS, SEG, query, segments
from parlance.operators import intervals as op


@query(f"""WITH {SEG}, m AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS o FROM seg WINDOW w AS (PARTITION BY rec_id ORDER BY seq)),
i AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY seq) AS g FROM m)
SELECT rec_id, CAST(g AS BIGINT) AS seq, speaker, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, count(*) AS n FROM i GROUP BY rec_id, g, speaker""")
def speaker_turns(spark, sf_dir):
    """Runs of one speaker."""
    return op.run_lengths(segments(spark, sf_dir)).select("rec_id", "seq", "speaker", "start_ms", "end_ms", "n")


@query(f"""WITH {SEG}, m AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= 10000000 THEN 0 ELSE 1 END AS o FROM seg WINDOW w AS (PARTITION BY rec_id ORDER BY seq)),
i AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY seq) AS g FROM m),
r AS (SELECT rec_id, CAST(g AS BIGINT) AS seq, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms FROM i GROUP BY rec_id, g)
SELECT * FROM r WHERE end_ms - start_ms >= 8000000""")
def merge_segments(spark, sf_dir):
    return op.merge_segments(segments(spark, sf_dir), 10_000_000, 8_000_000)


CHUNKS = SEG + """, chunks AS (SELECT rec_id, seq, CAST(chunk_no AS BIGINT) AS chunk_no, start_ms + chunk_no * 5000000 AS start_ms,
  CASE WHEN long THEN least(start_ms + chunk_no * 5000000 + 10000000, end_ms) ELSE end_ms END AS end_ms
  FROM (SELECT *, end_ms - start_ms > 10000000 AS long, unnest(generate_series(0, CASE WHEN end_ms - start_ms > 10000000 THEN (end_ms - start_ms - 1) // 5000000 ELSE 0 END)) AS chunk_no FROM seg))"""


def chunks(spark, sf_dir):
    return op.chunk_windows(segments(spark, sf_dir), 10_000_000, 5_000_000)


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def chunk_windows(spark, sf_dir):
    return chunks(spark, sf_dir)


@query(f"""WITH {SEG}, p AS (SELECT rec_id, seq, end_ms AS e, unnest(generate_series(0, (end_ms - start_ms - 1) // 7000000)) AS piece_no, start_ms AS s FROM seg WHERE end_ms > start_ms),
c AS (SELECT rec_id, seq, CAST(piece_no AS BIGINT) AS piece_no, s + piece_no * 7000000 AS start_ms, least(s + piece_no * 7000000 + 7000000, e) AS end_ms FROM p)
SELECT * FROM c WHERE end_ms - start_ms >= 500000""")
def cut_windows(spark, sf_dir):
    return op.cut_windows(segments(spark, sf_dir), 7_000_000, 500_000)


def scored_frames(spark, sf_dir):
    s = segments(spark, sf_dir)
    total = F.count("*").over(Window.partitionBy("rec_id")) * 1000
    return s.select("rec_id", "seq", (F.col("seq") * 1000).alias("t_ms"), F.col("value").alias("prob"), total.alias("duration_ms"))


@query(f"""WITH {SEG}, f AS (SELECT rec_id, seq, seq * 1000 AS t, count(*) OVER (PARTITION BY rec_id) * 1000 AS d, CASE WHEN value >= 150 THEN 1 WHEN value < 60 THEN 0 END AS m FROM seg),
s AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS st FROM f),
e AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY rec_id ORDER BY seq), 0) AS was FROM s),
x AS (SELECT *, lead(t) OVER (PARTITION BY rec_id ORDER BY seq) AS nt FROM e WHERE st <> was),
r AS (SELECT rec_id, seq, greatest(t - 100, 0) AS a, least(coalesce(nt, d) + 100, d) AS z FROM x WHERE st = 1),
o AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY rec_id ORDER BY a, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1800 THEN 0 ELSE 1 END AS o FROM r),
g AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY a, seq) AS g FROM o)
SELECT rec_id, CAST(g AS BIGINT) AS seq, min(a) AS start_ms, max(z) AS end_ms FROM g GROUP BY rec_id, g HAVING max(z) - min(a) >= 2000""")
def vad_hysteresis(spark, sf_dir):
    return op.hysteresis(scored_frames(spark, sf_dir), 150, 60, 2000, 1800, 100, 100)


@query(f"""WITH {SEG}, f AS (SELECT *, min(seq) OVER (PARTITION BY rec_id, speaker) AS f FROM seg),
n AS (SELECT *, dense_rank() OVER (PARTITION BY rec_id ORDER BY f) - 1 AS spk FROM f),
k AS (SELECT * FROM n WHERE end_ms - start_ms >= 3000000),
r AS (SELECT *, CASE WHEN spk = lag(spk) OVER (PARTITION BY rec_id ORDER BY start_ms, seq) THEN 0 ELSE 1 END AS o FROM k),
q AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY start_ms, seq) AS run FROM r),
p AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY rec_id, run ORDER BY start_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 30000000 THEN 0 ELSE 1 END AS o2 FROM q),
g AS (SELECT *, sum(o2) OVER (PARTITION BY rec_id ORDER BY start_ms, seq) AS g FROM p)
SELECT rec_id, CAST(g AS BIGINT) AS seq, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(spk AS BIGINT) AS spk FROM g GROUP BY rec_id, g, spk""")
def turn_merge_runmax(spark, sf_dir):
    return op.label_turns(segments(spark, sf_dir).withColumnRenamed("speaker", "label"), 3_000_000, 30_000_000)


@query(f"""WITH {SEG}, n AS (SELECT *, lag(speaker) OVER w AS a, lead(speaker) OVER w AS b FROM seg WINDOW w AS (PARTITION BY rec_id ORDER BY seq)),
s AS (SELECT *, CASE WHEN a = b AND a <> speaker THEN a ELSE speaker END AS spk FROM n),
o AS (SELECT *, CASE WHEN spk = lag(spk) OVER (PARTITION BY rec_id ORDER BY seq) THEN 0 ELSE 1 END AS o FROM s),
g AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY seq) AS g FROM o)
SELECT rec_id, CAST(g AS BIGINT) AS seq, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, spk FROM g GROUP BY rec_id, g, spk""")
def smooth_islands(spark, sf_dir):
    return op.smooth_islands(segments(spark, sf_dir), "speaker")


@query(f"""WITH {CHUNKS}, c AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, seq, chunk_no) - 1 AS chunk, start_ms AS cs, end_ms AS ce, (seq * 7 + chunk_no) % 3 AS label FROM chunks),
own AS (SELECT c.rec_id, chunk, label, min(seq) AS seg FROM c JOIN seg s ON c.rec_id = s.rec_id AND cs >= start_ms AND ce <= end_ms + 1 GROUP BY ALL),
v AS (SELECT rec_id, seg, label, count(*) AS n, min(chunk) AS f FROM own GROUP BY ALL),
w AS (SELECT rec_id, seg, label FROM v QUALIFY row_number() OVER (PARTITION BY rec_id, seg ORDER BY n DESC, f) = 1),
t AS (SELECT s.rec_id, s.seq, s.start_ms, s.end_ms, label AS spk FROM seg s JOIN w ON s.rec_id = w.rec_id AND s.seq = w.seg),
o AS (SELECT *, CASE WHEN spk = lag(spk) OVER x AND start_ms - lag(end_ms) OVER x <= 500 THEN 0 ELSE 1 END AS o FROM t WINDOW x AS (PARTITION BY rec_id ORDER BY seq)),
g AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY seq) AS g FROM o)
SELECT rec_id, CAST(g AS BIGINT) AS seq, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, CAST(spk AS BIGINT) AS spk FROM g GROUP BY rec_id, g, spk""")
def segment_vote(spark, sf_dir):
    c = chunks(spark, sf_dir)
    order = Window.partitionBy("rec_id").orderBy("start_ms", "seq", "chunk_no")
    named = c.withColumn("label", (F.col("seq") * 7 + F.col("chunk_no")) % 3).withColumn("no", (F.row_number().over(order) - 1).cast("long")).drop("seq").withColumnRenamed("no", "seq")
    return op.segment_votes(segments(spark, sf_dir), named, bucket_ms=BUCKET_MS)


@query(f"""WITH {SEG}, n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY rec_id, speaker) < 12 THEN 'noise' ELSE speaker END AS spk FROM seg),
o AS (SELECT *, CASE WHEN spk = lag(spk) OVER x AND start_ms - lag(end_ms) OVER x <= 9000000 THEN 0 ELSE 1 END AS o FROM n WINDOW x AS (PARTITION BY rec_id ORDER BY seq)),
g AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY seq) AS g FROM o)
SELECT rec_id, CAST(g AS BIGINT) AS seq, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, spk FROM g GROUP BY rec_id, g, spk""")
def diarized_turns(spark, sf_dir):
    return op.diarized_turns(segments(spark, sf_dir).withColumnRenamed("speaker", "label"), 12, 9_000_000)


@query(f"""WITH {SEG} SELECT rec_id, seq, CAST(k AS BIGINT) AS window_no, start_ms + k * 4000000 AS start_ms, start_ms + k * 4000000 + 6000000 AS end_ms, start_ms + k * 4000000 + 3000000 AS centre_ms
FROM (SELECT *, unnest(generate_series(0, (end_ms - 6000000 - start_ms) // 4000000)) AS k FROM seg WHERE end_ms - 6000000 >= start_ms)""")
def sliding_windows(spark, sf_dir):
    return op.sliding_windows(segments(spark, sf_dir), 6_000_000, 4_000_000)


@query(f"""WITH {SEG}, c AS (SELECT rec_id, (start_ms + end_ms) // 2 AS at_ms FROM seg WHERE seq % 2 = 0),
l AS (SELECT s.rec_id, s.seq, s.start_ms, s.end_ms, list_sort(list_distinct(list(at_ms) FILTER (at_ms > s.start_ms AND at_ms < s.end_ms AND s.end_ms - s.start_ms >= 9000000))) AS a FROM seg s JOIN c USING (rec_id) GROUP BY ALL),
f AS (SELECT rec_id, seq, start_ms, end_ms, coalesce(a, []) AS a FROM l),
p AS (SELECT rec_id, seq, list_concat([start_ms], a) AS lo, list_concat(a, [end_ms]) AS hi, a, unnest(generate_series(0, len(a))) AS piece_no FROM f)
SELECT rec_id, seq, CAST(piece_no AS BIGINT) AS piece_no, lo[piece_no + 1] AS start_ms, hi[piece_no + 1] AS end_ms FROM p WHERE hi[piece_no + 1] - lo[piece_no + 1] >= 100000 OR len(a) = 0""")
def split_at_changes(spark, sf_dir):
    s = segments(spark, sf_dir)
    cuts = s.filter("seq % 2 = 0").select("rec_id", F.expr("(start_ms + end_ms) div 2").alias("at_ms"))
    return op.split_at(s, cuts, 9_000_000, 100_000, BUCKET_MS)


@query(f"""WITH {SEG}, c AS (SELECT rec_id, count(*) AS n_in, count(*) FILTER (end_ms - start_ms >= 9000000) AS n_long FROM seg GROUP BY 1), x AS (SELECT s.rec_id, s.seq, c.m FROM seg s JOIN (SELECT rec_id, (start_ms + end_ms) // 2 AS m FROM seg WHERE seq % 2 = 0) c ON s.rec_id = c.rec_id AND m > s.start_ms AND m < s.end_ms AND s.end_ms - s.start_ms >= 9000000),
n AS (SELECT rec_id, count(DISTINCT (seq, m)) AS k FROM x GROUP BY 1)
SELECT rec_id, n_in, n_long, n_in + coalesce(k, 0) AS n_out, coalesce(k, 0) AS n_cuts FROM c LEFT JOIN n USING (rec_id)""")
def split_summary(spark, sf_dir):
    s = segments(spark, sf_dir)
    cuts = s.filter("seq % 2 = 0").select("rec_id", F.expr("(start_ms + end_ms) div 2").alias("at_ms"))
    return op.split_summary(s, op.split_at(s, cuts, 9_000_000, 0, BUCKET_MS), 9_000_000)


@query(f"""WITH {CHUNKS}, p AS (SELECT rec_id, seq, chunk_no, start_ms, end_ms, -((end_ms // 1000) % 80) AS dbfs FROM chunks) SELECT rec_id, seq, chunk_no FROM p WHERE end_ms - start_ms >= 6000000 AND dbfs >= -50""")
def loud_chunks(spark, sf_dir):
    rows = chunks(spark, sf_dir).withColumn("dbfs", -(F.floor(F.col("end_ms") / 1000) % 80))
    return op.loud_chunks(rows, 6_000_000, -50.0).select("rec_id", "seq", "chunk_no")


@query(f"""WITH {SEG} SELECT rec_id, seq, greatest(value, 490 - value, 300) AS prob FROM seg""")
def frame_scores(spark, sf_dir):
    v = F.col("value")
    return op.frame_scores(segments(spark, sf_dir).withColumn("scores", F.array(v, 490 - v, F.lit(300.0)))).select("rec_id", "seq", "prob")
