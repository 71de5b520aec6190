"""Queries of parts that no other query runs: prompt pieces, literal rules, files written and read again, small clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parlance.catalogue.audio_text import MMSS, REPEATED
from parlance.catalogue.base import SEG, SPOKEN, query, segments, spoken
from parlance.functions import audio, text
from parlance.operators import clustering, folds, vectors
from parlance.session import shared_dir, table
from parlance.sources import readers, sinks

UNITS = "u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)) AS u FROM embeddings)"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"


@query(f"""WITH {UNITS}, p AS (SELECT vec_id // 8 AS segment, pos, avg(u[pos]) AS x FROM (SELECT vec_id, u, unnest(generate_series(1, len(u))) AS pos FROM u) GROUP BY 1, 2),
n AS (SELECT segment, sqrt(sum(x * x)) AS n FROM p GROUP BY 1) SELECT segment, CAST(pos - 1 AS BIGINT) AS pos, round(x / (n + 1e-8), 6) AS x FROM p JOIN n USING (segment)""")
def window_means(spark, sf_dir):
    """Vectors of eight windows as one of their segment."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("segment"), "embedding")
    return vectors.window_means(e, "segment").select("segment", F.posexplode("centroid").alias("pos", "x"))


@query(f"""WITH {UNITS}, g AS (SELECT vec_id // 3 AS rec_id, vec_id % 3 AS seq, u FROM u),
t AS (SELECT rec_id, any_value(u) FILTER (seq = 0) AS a, any_value(u) FILTER (seq = 1) AS b, any_value(u) FILTER (seq = 2) AS c FROM g GROUP BY 1 HAVING count(*) = 3),
d AS (SELECT rec_id, 1 - list_dot_product(a, b) AS ab, 1 - list_dot_product(a, c) AS ac, 1 - list_dot_product(b, c) AS bc FROM t),
m AS (SELECT *, least(ab, ac, bc) AS m FROM d),
j AS (SELECT *, CASE WHEN m >= 0.95 THEN 'none' WHEN (ab + ac + bc - m) / 2 < 0.95 THEN 'all' WHEN m = ab THEN 'ab' WHEN m = ac THEN 'ac' ELSE 'bc' END AS j FROM m),
l AS (SELECT rec_id, CASE j WHEN 'none' THEN [0, 1, 2] WHEN 'all' THEN [0, 0, 0] WHEN 'ab' THEN [0, 0, 1] WHEN 'ac' THEN [0, 1, 0] ELSE [0, 1, 1] END AS l FROM j)
SELECT CAST(rec_id AS BIGINT) AS rec_id, CAST(s AS BIGINT) AS seq, CAST(l[s + 1] AS BIGINT) AS label FROM l, (SELECT unnest([0, 1, 2]) AS s)""")
def clusters_of_three(spark, sf_dir):
    """Average linkage with a threshold on similarity, of recordings of three vectors each, where SQL can say it."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("rec_id"), (F.col("vec_id") % 3).alias("seq"), "embedding")
    whole = rows.groupBy("rec_id").count().filter("count = 3").select("rec_id")
    return clustering.cluster_similar(rows.join(whole, "rec_id"), 0.05)


@query("""WITH x AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding::DOUBLE[], lambda v: v * 9000) ELSE embedding::DOUBLE[] END AS x, vec_id % 2 = 0 AS i FROM embeddings),
y AS (SELECT vec_id, CASE WHEN i OR list_max(list_transform(x, lambda v: abs(v))) > 2 THEN list_transform(x, lambda v: v / 32768) ELSE x END AS y FROM x)
SELECT vec_id, round(list_max(y), 6) AS highest, round(list_min(y), 6) AS lowest, len(y) AS n FROM y""")
def unit_range(spark, sf_dir):
    """Samples of integers, and of floats that are none of the unit range, by 32768."""
    d = F.col("embedding").cast("array<double>")
    x = F.when(F.col("vec_id") % 3 == 0, F.transform(d, lambda v: v * 9000)).otherwise(d)
    y = table(spark, sf_dir, "embeddings").select("vec_id", audio.to_unit_range(x, F.col("vec_id") % 2 == 0).alias("y"))
    return y.select("vec_id", F.array_max("y").alias("highest"), F.array_min("y").alias("lowest"), F.size("y").alias("n"))


@query(f"""WITH {SPOKEN} SELECT rec_id, seq, '§' || (seq + 1) || ' [' || {MMSS.format(s='(start_ms / 1000)')} || '-' || {MMSS.format(s='(end_ms / 1000)')} || '] ' || speaker || ':' || chr(10) || '  [A] ' || text || chr(10) || '  [B] '
  || CASE WHEN seq % 4 = 0 THEN '<空>' ELSE speaker || ' ' || text END AS block FROM spoken""")
def pair_blocks(spark, sf_dir):
    """Blocks of two transcriptions of a paragraph."""
    other = F.when(F.col("seq") % 4 != 0, F.concat("speaker", F.lit(" "), "text"))
    return spoken(spark, sf_dir).select("rec_id", "seq", text.pair_block(F.col("seq") + 1, F.col("start_ms") / 1000, F.col("end_ms") / 1000, F.col("speaker"), F.col("text"), other).alias("block"))


@query(f"""WITH {SPOKEN} SELECT rec_id, seq, '[' || CASE WHEN seq % 5 = 0 THEN '' ELSE {MMSS.format(s='(CASE WHEN start_ms > 10000 THEN start_ms / 1000 ELSE start_ms END)')} END || '] ' || substr(text, 1, 80) AS snippet FROM spoken""")
def chapter_snippets(spark, sf_dir):
    return spoken(spark, sf_dir).select("rec_id", "seq", text.chapter_snippet(F.when(F.col("seq") % 5 != 0, F.col("start_ms")), F.col("text")).alias("snippet"))


@query(f"WITH {SEG} SELECT rec_id, seq, (start_ms % 86400000 // 60000) || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock FROM seg")
def clock_of_day(spark, sf_dir):
    return segments(spark, sf_dir).select("rec_id", "seq", text.clock_ms(F.col("start_ms") % 86_400_000).alias("clock"))


@query("SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), 'the', 'THE'), 'of THE', 'o/t'), 'THE', 'Z'), 'Z', 'the') AS text FROM documents")
def literal_corrections(spark, sf_dir):
    """Rules as they come, repeated wrong texts included."""
    rules = [("the", "THE"), ("of THE", "o/t"), ("THE", "Z"), ("", "x"), ("Z", "the")]
    return table(spark, sf_dir, "documents").select("doc_id", text.corrected(F.coalesce("text", F.lit("")), rules, literal=True).alias("text"))


@query("WITH d AS (SELECT item_id, text || '. ' || CASE WHEN item_id % 2 = 0 THEN 'ab cab cd' ELSE '' END AS t FROM benchmark) SELECT item_id, " + " OR ".join("(" + REPEATED.format(n=n, n3=n, n4=2 * n) + ")" for n in range(3, 11)) + " AS repeated FROM d")
def repetition_of_two(spark, sf_dir):
    """The stricter rule: a pattern that follows itself once."""
    t = F.concat("text", F.lit(". "), F.when(F.col("item_id") % 2 == 0, "ab cab cd").otherwise(""))
    return table(spark, sf_dir, "benchmark").select("item_id", text.repetition(t, least=2).isNotNull().alias("repeated"))


@query(f"""WITH RECURSIVE {SPOKEN}, n AS (SELECT rec_id, seq, length(text) + length(speaker || text) AS l, row_number() OVER (PARTITION BY rec_id ORDER BY seq) AS k FROM spoken),
f AS (SELECT rec_id, seq, k, CAST(0 AS BIGINT) AS b, l AS c FROM n WHERE k = 1
  UNION ALL SELECT n.rec_id, n.seq, n.k, CASE WHEN f.c + n.l > 2500 THEN f.b + 1 ELSE f.b END, CASE WHEN f.c + n.l > 2500 THEN n.l ELSE f.c + n.l END FROM f JOIN n ON f.rec_id = n.rec_id AND n.k = f.k + 1)
SELECT rec_id, seq, b AS batch_no, CAST(c AS BIGINT) AS chars FROM f""")
def pair_batches(spark, sf_dir):
    """Batches by the characters of two transcriptions together."""
    return folds.char_batches(spoken(spark, sf_dir).withColumn("other", F.concat("speaker", "text")), 2500, ("text", "other"))


def rule_file(spark: SparkSession, sf_dir: str) -> str:
    """A file of corrections and hotwords: names of nations, and of regions."""
    struct = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    n = table(spark, sf_dir, "nation").agg(struct("n_nationkey", F.col("n_name").alias("wrong"), F.lower("n_name").alias("right")).alias("rules"))
    r = table(spark, sf_dir, "region").agg(struct("r_regionkey", "r_name").alias("hot"))
    at = fresh(spark, "rules")
    rows = n.crossJoin(r).select(F.to_json(F.struct(F.transform("rules", lambda x: F.struct(x["wrong"].alias("wrong"), x["right"].alias("right"))).alias("rules"), F.transform("hot", lambda x: x["r_name"]).alias("hotwords"))).alias("value"))
    rows.coalesce(1).write.text(at)
    return at


@query('SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name AS wrong, lower(n_name) AS "right" FROM nation')
def rules_read(spark, sf_dir):
    return readers.rules(spark, rule_file(spark, sf_dir))


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, r_name AS word FROM region")
def hotwords_read(spark, sf_dir):
    return readers.hotwords(spark, rule_file(spark, sf_dir))


@query("WITH r AS (SELECT 'p' || label AS name, arg_min(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY label) SELECT name, CAST(pos - 1 AS BIGINT) AS pos, round(v[pos], 6) AS x FROM (SELECT name, v, unnest(generate_series(1, len(v))) AS pos FROM r)")
def registry_read(spark, sf_dir):
    """A registry that was written, read again."""
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").cast("array<float>").alias("voice"))
    at = fresh(spark, "registry")
    e.select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"), "voice").write.parquet(at)
    return readers.registry(spark, at).select("name", F.posexplode("voice").alias("pos", "x"))


@query(f"WITH {SPOKEN} SELECT rec_id, seq, start_ms, end_ms, speaker, text FROM spoken")
def stage_dump(spark, sf_dir):
    """A stage's rows as its dump has them."""
    folder = fresh(spark, "stages")
    rows = spoken(spark, sf_dir).select("rec_id", "seq", "start_ms", "end_ms", "speaker", "text")
    kept = sinks.stage_dump(rows, folder, "sentences")
    return spark.read.schema(kept.schema).json(f"{folder}/sentences")
