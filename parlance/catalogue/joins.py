"""Queries of the joins, totals and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalogue.base import BUCKET_MS, PARTS, SEG, SPOKEN, query, segments, sentences, spoken, turns
from parlance.operators import folds, joins, summaries
from parlance.session import table


@query(f"""WITH {PARTS}, d AS (SELECT s.rec_id, s.seq, t.seq AS no, t.spk, CASE WHEN t.start_ms <= (s.start_ms + s.end_ms) / 2 AND (s.start_ms + s.end_ms) / 2 <= t.end_ms THEN 0
  ELSE least(abs((s.start_ms + s.end_ms) / 2 - t.start_ms), abs((s.start_ms + s.end_ms) / 2 - t.end_ms)) END AS d,
  CASE WHEN t.start_ms <= (s.start_ms + s.end_ms) / 2 AND (s.start_ms + s.end_ms) / 2 <= t.end_ms THEN 0 ELSE 1 END AS o FROM sents s JOIN turns t USING (rec_id))
SELECT s.rec_id, s.seq, x.spk FROM sents s LEFT JOIN (SELECT rec_id, seq, spk FROM d QUALIFY row_number() OVER (PARTITION BY rec_id, seq ORDER BY o, d, no) = 1) x USING (rec_id, seq)""")
def nearest_turn(spark, sf_dir):
    return joins.nearest_turn(sentences(spark, sf_dir), turns(spark, sf_dir), BUCKET_MS).select("rec_id", "seq", "spk")


@query(f"""WITH {PARTS}, o AS (SELECT s.rec_id, s.seq, t.seq AS no, t.spk, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS ov FROM sents s JOIN turns t USING (rec_id)),
b AS (SELECT rec_id, seq, spk, ov FROM o WHERE ov > 0 QUALIFY row_number() OVER (PARTITION BY rec_id, seq ORDER BY ov DESC, no) = 1)
SELECT s.rec_id, s.seq, b.spk, b.ov AS overlap_ms FROM sents s LEFT JOIN b USING (rec_id, seq)""")
def dominant_turn(spark, sf_dir):
    return joins.max_overlap(sentences(spark, sf_dir), turns(spark, sf_dir), bucket_ms=BUCKET_MS).select("rec_id", "seq", "spk", "overlap_ms")


ASOF = PARTS + """, w AS (SELECT *, (start_ms + end_ms) / 2 AS mid FROM {rows}),
p AS (SELECT w.rec_id, w.seq, t.end_ms AS pe, t.spk AS ps, t.start_ms AS pt FROM w ASOF LEFT JOIN turns t ON w.rec_id = t.rec_id AND w.mid >= t.start_ms),
n AS (SELECT w.rec_id, w.seq, t.start_ms AS ns, t.spk AS nspk FROM w ASOF LEFT JOIN turns t ON w.rec_id = t.rec_id AND w.mid < t.start_ms),
a AS (SELECT w.rec_id, w.seq, CASE WHEN ps IS NOT NULL AND mid <= pe THEN ps WHEN ps IS NULL THEN nspk WHEN nspk IS NULL THEN ps
  WHEN abs(mid - pe) < abs(ns - mid) THEN ps WHEN abs(mid - pe) > abs(ns - mid) THEN nspk ELSE least(ps, nspk) END AS spk FROM w JOIN p USING (rec_id, seq) JOIN n USING (rec_id, seq))"""


@query(f"WITH {ASOF.format(rows='sents')} SELECT rec_id, seq, spk FROM a")
def asof_turn(spark, sf_dir):
    return joins.asof_turn(sentences(spark, sf_dir), turns(spark, sf_dir)).select("rec_id", "seq", "spk")


@query(f"""WITH {ASOF.format(rows='sents')}, x AS (SELECT s.*, s.seq // 12 AS segment, coalesce(last_value(a.spk IGNORE NULLS) OVER (PARTITION BY s.rec_id, s.seq // 12 ORDER BY s.seq ROWS UNBOUNDED PRECEDING), 0) AS spk FROM sents s JOIN a USING (rec_id, seq)),
o AS (SELECT *, CASE WHEN spk = lag(spk) OVER v AND segment = lag(segment) OVER v THEN 0 ELSE 1 END AS o FROM x WINDOW v AS (PARTITION BY rec_id ORDER BY seq)),
g AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY seq) AS g FROM o)
SELECT rec_id, CAST(g AS BIGINT) AS seq, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, spk AS speaker, trim(string_agg(text, '' ORDER BY seq)) AS text FROM g GROUP BY rec_id, g, segment, spk""")
def words_to_sentences(spark, sf_dir):
    words = sentences(spark, sf_dir).withColumn("segment", F.floor(F.col("seq") / 12)).withColumnRenamed("text", "word")
    return joins.words_to_sentences(words, turns(spark, sf_dir))


@query(f"""WITH {PARTS}, p AS (SELECT s.rec_id, s.seq, t.seq AS no, greatest(s.start_ms, t.start_ms) AS ps, least(s.end_ms, t.end_ms) AS pe, t.speaker AS spk, t.spk = 3 AS ov FROM sents s JOIN turns t USING (rec_id)
  WHERE least(s.end_ms, t.end_ms) > greatest(s.start_ms, t.start_ms)),
o AS (SELECT *, CASE WHEN spk = lag(spk) OVER (PARTITION BY rec_id, seq ORDER BY ps, no) THEN 0 ELSE 1 END AS o FROM p),
g AS (SELECT *, sum(o) OVER (PARTITION BY rec_id, seq ORDER BY ps, no) AS g FROM o)
SELECT rec_id, seq, CAST(g AS BIGINT) AS group_no, spk AS speaker, min(ps) AS start_ms, last(pe ORDER BY ps, no) AS end_ms, bool_or(ov) AS overlap FROM g GROUP BY rec_id, seq, g, spk""")
def overlap_groups(spark, sf_dir):
    return joins.overlap_groups(sentences(spark, sf_dir), turns(spark, sf_dir).withColumn("overlap", F.col("spk") == 3), BUCKET_MS)


@query(f"""WITH {PARTS}, m AS (SELECT s.rec_id, s.seq, string_agg(t.speaker || t.seq, '' ORDER BY t.start_ms, t.seq) AS alt_text, count(*) AS n_alt FROM sents s JOIN turns t USING (rec_id)
  WHERE least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) >= 1000000 GROUP BY ALL)
SELECT s.rec_id, s.seq, coalesce(alt_text, '') AS alt_text, coalesce(n_alt, 0) AS n_alt FROM sents s LEFT JOIN m USING (rec_id, seq)""")
def overlap_concat(spark, sf_dir):
    others = turns(spark, sf_dir).withColumn("text", F.concat("speaker", F.col("seq").cast("string")))
    return joins.overlapping_text(sentences(spark, sf_dir), others, 1_000_000, BUCKET_MS).select("rec_id", "seq", "alt_text", "n_alt")


@query(f"""WITH {PARTS}, r AS (SELECT rec_id, start_ms AS rs, end_ms AS re FROM turns WHERE event_id % 5 <> event_id % 3),
k AS (SELECT rec_id, start_ms, end_ms, speaker, text, false AS overlap, seq AS o FROM sents s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rec_id = s.rec_id AND rs <= (s.start_ms + s.end_ms) / 2 AND (s.start_ms + s.end_ms) / 2 <= re)),
u AS (SELECT * FROM k UNION ALL SELECT rec_id, start_ms, end_ms, speaker, 'separated' AS text, true, seq FROM turns)
SELECT rec_id, start_ms, end_ms, speaker, text, overlap, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, speaker NULLS FIRST, overlap, o) AS seq FROM u""")
def overlap_replace(spark, sf_dir):
    t = turns(spark, sf_dir)
    ranges = t.withColumn("spk_a", F.col("event_id") % 5).withColumn("spk_b", F.col("event_id") % 3)
    return joins.replace_overlaps(sentences(spark, sf_dir), ranges, t.withColumn("text", F.lit("separated")), BUCKET_MS)


@query(f"""WITH {PARTS}, n AS (SELECT DISTINCT rec_id, spk, 'name ' || rec_id || spk AS name FROM turns WHERE spk < 2)
SELECT rec_id, t.seq, coalesce(name, 'spk_' || t.spk, 'spk_unknown') AS speaker FROM (SELECT rec_id, seq, CASE WHEN seq % 5 = 0 THEN NULL ELSE spk END AS spk FROM turns) t LEFT JOIN n USING (rec_id, spk)""")
def named_speakers(spark, sf_dir):
    t = turns(spark, sf_dir)
    names = t.filter("spk < 2").select("rec_id", "spk", F.concat(F.lit("name "), F.col("rec_id").cast("string"), F.col("spk").cast("string")).alias("name")).distinct()
    rows = t.select("rec_id", "seq", F.when(F.col("seq") % 5 != 0, F.col("spk")).alias("spk"))
    return joins.named_speakers(rows, names).select("rec_id", "seq", "speaker")


@query(f"""WITH RECURSIVE {PARTS}, b AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, seq) AS k FROM sents),
c AS (SELECT rec_id, k, greatest(abs(b.start_ms - a.start_ms), abs(b.end_ms - a.end_ms)) AS d, a.start_ms AS s, a.seq AS q FROM b JOIN turns a USING (rec_id) WHERE a.start_ms <= b.end_ms AND a.end_ms >= b.start_ms),
l AS (SELECT rec_id, k, list({{'d': d, 'q': q}} ORDER BY d, s, q) AS near FROM c GROUP BY ALL),
n AS (SELECT rec_id, b.seq, k, 5000000 + b.end_ms - b.start_ms AS most, coalesce(near, []) AS near FROM b LEFT JOIN l USING (rec_id, k)),
f AS (SELECT DISTINCT rec_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq_b, CAST(NULL AS BIGINT) AS seq_a, CAST([] AS BIGINT[]) AS taken FROM n
  UNION ALL SELECT rec_id, k, seq, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END FROM
    (SELECT rec_id, k, seq, taken, CASE WHEN x.d <= most THEN x.q END AS pick FROM
      (SELECT n.rec_id, n.k, n.seq, n.most, f.taken, list_filter(n.near, lambda y: NOT list_contains(f.taken, y.q))[1] AS x FROM f JOIN n ON f.rec_id = n.rec_id AND n.k = f.k + 1)))
SELECT rec_id, seq_b, seq_a FROM f WHERE k > 0""")
def greedy_align(spark, sf_dir):
    """One-to-one matching in order, which is stateful: in SQL, recursion with a list of what is taken."""
    return folds.time_align(turns(spark, sf_dir), sentences(spark, sf_dir), 5_000_000)


@query(f"""WITH {SEG}, t AS (SELECT rec_id, speaker, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS total_ms, count(*) AS n FROM seg GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY total_ms DESC, speaker) AS rank FROM t""")
def speaker_duration(spark, sf_dir):
    return summaries.speaker_time(segments(spark, sf_dir))


@query(f"WITH {SEG} SELECT rec_id, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers, max(end_ms) AS duration_ms, count(*) AS n_segments FROM seg GROUP BY rec_id")
def document_summary(spark, sf_dir):
    return summaries.document_summary(segments(spark, sf_dir)).withColumn("speakers", F.array_join("speakers", ","))


@query(f"""WITH {PARTS}, a AS (SELECT rec_id, max(end_ms) AS end_a FROM turns GROUP BY 1), b AS (SELECT rec_id, max(end_ms) AS end_b FROM sents GROUP BY 1)
SELECT rec_id, coalesce(end_a, 0) AS end_a, coalesce(end_b, 0) AS end_b, abs(coalesce(end_a, 0) - coalesce(end_b, 0)) > 30000000 AS differs FROM a FULL JOIN b USING (rec_id)""")
def source_consistency(spark, sf_dir):
    return summaries.duration_mismatch(turns(spark, sf_dir), sentences(spark, sf_dir), 30_000_000)


@query(f"""WITH {SEG}, p AS (SELECT speaker AS wrong, 'v' || (event_id % 3) AS "right", 'context ' || event_id AS c, event_id AS pos FROM seg)
SELECT wrong, "right", count(*) AS freq, arg_min(c, pos) AS context_asr FROM p GROUP BY 1, 2 HAVING count(*) >= 2""")
def candidate_frequency(spark, sf_dir):
    pairs = segments(spark, sf_dir).select(F.col("speaker").alias("wrong"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("right"), F.concat(F.lit("context "), F.col("event_id").cast("string")).alias("context_asr"), F.col("event_id").alias("pos"))
    return summaries.candidate_frequency(pairs, 2)


@query(f"""WITH {SEG}, p AS (SELECT speaker || '-' || rec_id AS wrong, 'v' || (event_id % 3) AS "right", 'context ' || event_id AS c, event_id AS pos FROM seg)
SELECT wrong, "right", count(*) AS freq, arg_min(c, pos) AS context_asr FROM p GROUP BY 1, 2 ORDER BY freq DESC, wrong, "right" LIMIT 200""")
def top_candidates(spark, sf_dir):
    """The 200 most frequent corrections that were mined."""
    s = segments(spark, sf_dir)
    text = lambda x: F.col(x).cast("string")
    pairs = s.select(F.concat("speaker", F.lit("-"), text("rec_id")).alias("wrong"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("right"), F.concat(F.lit("context "), text("event_id")).alias("context_asr"), F.col("event_id").alias("pos"))
    return summaries.candidate_frequency(pairs, 1, 200)


@query("SELECT conv_id AS rec_id, turn AS seq, substr(text, 1, turn % 4) AS text FROM conversations WHERE length(trim(substr(text, 1, turn % 4))) >= 2")
def overlap_replies(spark, sf_dir):
    """Texts from overlapped speech that are long enough to keep."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seq"), F.substring("text", 1, (F.col("turn") % 4).cast("int")).alias("text"))
    return summaries.long_enough(c, 2)


@query(f"WITH {SEG} SELECT rec_id, seq, CASE WHEN count(*) OVER (PARTITION BY rec_id, speaker) < 13 THEN 'noise' ELSE speaker END AS spk FROM seg")
def noise_clusters(spark, sf_dir):
    return summaries.noise_clusters(segments(spark, sf_dir), 13, "speaker").select("rec_id", "seq", "spk")


@query(f"""WITH {SPOKEN}, r AS (SELECT *, length(regexp_replace(trim(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', '', 'g')) AS chars, (end_ms - start_ms) / 1000 AS dur FROM spoken WHERE NOT overlap),
s AS (SELECT *, round(least(dur / 10, 1.0) * 1.5 + least(chars / 80, 1.0), 3) AS score FROM r WHERE dur BETWEEN 5 AND 60 AND chars >= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY rec_id, speaker ORDER BY score DESC, seq) AS rank FROM s)
SELECT rec_id, speaker, rank, seq, start_ms, end_ms, score, chars, trim(text)[1:80] || CASE WHEN length(trim(text)) > 80 THEN '...' ELSE '' END AS text FROM k WHERE rank <= 2""")
def enroll_candidates(spark, sf_dir):
    return summaries.enroll_candidates(spoken(spark, sf_dir), 5, 60, 2)


@query(f"""WITH {PARTS}, v AS (SELECT *, (value % 50) / 50 AS purity, -(value % 45) AS rms, (end_ms - start_ms) / 1000 AS dur FROM turns),
s AS (SELECT *, purity * 2 + CASE WHEN dur BETWEEN 3000 AND 10000 THEN 1.0 WHEN dur > 10000 THEN 0.5 ELSE dur / 3000 END + (rms + 50) / 50 AS score FROM v),
b AS (SELECT *, (start_ms + end_ms) // 2 AS c FROM s QUALIFY row_number() OVER (PARTITION BY rec_id, spk ORDER BY score DESC, start_ms DESC, end_ms DESC) = 1)
SELECT rec_id, spk, seq, CASE WHEN dur > 10000 THEN greatest(start_ms, c - 5000000) ELSE start_ms END AS start_ms, CASE WHEN dur > 10000 THEN least(end_ms, c + 5000000) ELSE end_ms END AS end_ms, round(score, 6) AS score FROM b""")
def best_reference(spark, sf_dir):
    votes = turns(spark, sf_dir).withColumn("purity", (F.col("value") % 50) / 50).withColumn("rms", -(F.col("value") % 45))
    return summaries.best_reference(votes, 3000.0, 10_000.0)


@query(f"""WITH {PARTS}, d AS (SELECT *, end_ms - start_ms AS dur FROM turns),
c AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY rec_id, spk ORDER BY dur DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
p AS (SELECT *, sum(dur) OVER (PARTITION BY rec_id, spk) AS picked FROM c WHERE before < 30000000)
SELECT rec_id, spk, seq, dur AS dur_ms, CAST(before AS BIGINT) AS before_ms, CAST(picked AS BIGINT) AS picked_ms FROM p WHERE picked >= 10000000""")
def longest_turns(spark, sf_dir):
    return summaries.longest_turns(turns(spark, sf_dir), 30_000_000, 10_000_000).select("rec_id", "spk", "seq", "dur_ms", "before_ms", "picked_ms")


@query(f"""WITH {PARTS}, f AS (SELECT rec_id, spk, min(start_ms) AS f FROM turns GROUP BY 1, 2),
n AS (SELECT rec_id, spk, 'Speaker_' || chr(CAST(64 + row_number() OVER (PARTITION BY rec_id ORDER BY f, spk) AS INTEGER)) AS name FROM f) SELECT rec_id, seq, name FROM turns JOIN n USING (rec_id, spk)""")
def first_appearance_names(spark, sf_dir):
    return summaries.first_appearance_names(turns(spark, sf_dir), "spk").select("rec_id", "seq", "name")


@query(f"""WITH {SEG}, k AS (SELECT rec_id, seq, CASE WHEN value > 60 THEN speaker END AS s FROM seg)
SELECT rec_id, seq, coalesce(s, first_value(s IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  last_value(s IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Speaker_X') AS speaker FROM k""")
def filled_speakers(spark, sf_dir):
    return summaries.filled_speakers(segments(spark, sf_dir).withColumn("speaker", F.when(F.col("value") > 60, F.col("speaker")))).select("rec_id", "seq", "speaker")


@query(f"""WITH {SEG} SELECT rec_id, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, round(avg(value), 6) AS mean FROM seg GROUP BY rec_id""")
def upper_median(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("rec_id").agg(summaries.upper_median(F.col("value")).alias("upper_median"), F.avg("value").alias("mean"))


@query("SELECT conv_id AS rec_id, count(*) FILTER (WHERE replace(text, 'the', 'THE') <> text) AS changed, count(*) AS n FROM conversations GROUP BY 1")
def changed_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seq"), "text")
    return summaries.changed_rows(c, c.withColumn("text", F.replace("text", F.lit("the"), F.lit("THE"))))


@query(f"WITH {SPOKEN} SELECT rec_id, seq FROM spoken WHERE NOT overlap AND length(text) >= 200 AND end_ms - start_ms BETWEEN 5000 AND 60000")
def fusable_in_band(spark, sf_dir):
    return summaries.in_band(summaries.fusable(spoken(spark, sf_dir), 200), 5000, 60_000).select("rec_id", "seq")


@query("SELECT * FROM (VALUES ('c_0', 1::BIGINT), ('c_9', 1)) t(name, n)")
def enrol_duplicates(spark, sf_dir):
    """Candidates that a registry doesn't have yet."""
    have = spark.createDataFrame([("c_1",), ("c_2",)], "name string")
    new = spark.createDataFrame([("c_0", 1), ("c_1", 2), ("c_9", 1)], "name string, n int")
    return joins.new_names(new, have)
