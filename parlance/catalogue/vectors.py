"""Queries of the vector operators.  The registry is the first vector of each label."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalogue.base import query
from parlance.operators import clustering, intervals, vectors
from parlance.session import table

EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"
REG = EMB + ", r AS (SELECT 'p' || label AS name, arg_min(e, vec_id) AS v, arg_min(n, vec_id) AS vn FROM e GROUP BY label)"
SIM = REG + ", s AS (SELECT vec_id, label, name, list_dot_product(e, v) / (n * vn + 1e-8) AS sim FROM e, r)"


def rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def names(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("voice")).select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"), "voice")


@query(f"""WITH {EMB}, m AS (SELECT label, pos, avg(e[pos]) AS x FROM (SELECT label, e, unnest(generate_series(1, len(e))) AS pos FROM e) GROUP BY 1, 2),
c AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT CAST(label AS BIGINT) AS label, CAST(pos - 1 AS BIGINT) AS pos, round(x / (n + 1e-8), 6) AS x FROM m JOIN c USING (label)""")
def centroids(spark, sf_dir):
    return vectors.centroids(rows(spark, sf_dir), "label").select("label", F.posexplode("centroid").alias("pos", "x"))


@query(f"WITH {SIM} SELECT vec_id, name, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) = 1")
def centroid_match(spark, sf_dir):
    return vectors.match(rows(spark, sf_dir), names(spark, sf_dir), -2.0)


@query(f"WITH {SIM} SELECT vec_id, CASE WHEN sim >= 0.3 THEN name ELSE 'unknown' END AS name, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) = 1")
def registry_match(spark, sf_dir):
    return vectors.match(rows(spark, sf_dir), names(spark, sf_dir), 0.3, missing="unknown")


@query(f"""WITH {SIM}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) AS rank FROM s)
SELECT vec_id, name, round(sim, 6) AS sim, rank, CASE WHEN rank > 1 THEN NULL WHEN sim >= 0.55 THEN 'high' WHEN sim >= 0.40 THEN 'weak' ELSE 'none' END AS grade FROM k WHERE rank <= 3""")
def topk_match(spark, sf_dir):
    return vectors.ranked_matches(rows(spark, sf_dir), names(spark, sf_dir), 3)


@query(f"""WITH {SIM}, v AS (SELECT vec_id, max(sim) FILTER (name = 'p' || label) AS o, max(sim) FILTER (name <> 'p' || label) AS b FROM s GROUP BY 1)
SELECT vec_id, round(o, 6) AS own_sim, round(b, 6) AS best_other, round(o - b, 6) AS margin, o >= 0.4 AND o > coalesce(b, -1) AS passed FROM v""")
def verify_margin(spark, sf_dir):
    q = rows(spark, sf_dir).withColumn("own_name", F.concat(F.lit("p"), F.col("label").cast("string")))
    return vectors.verify(q, names(spark, sf_dir))


@query(f"WITH {EMB} SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e) / (a.n * b.n + 1e-8), 6) AS sim FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n + 1e-8) > 0.3")
def audit_pairs(spark, sf_dir):
    return vectors.audit_pairs(rows(spark, sf_dir), 0.3)


@query(f"""WITH {REG}, u AS (SELECT name, v FROM r WHERE name NOT IN ('p1', 'p2', 'p3') UNION ALL SELECT 'p1', v FROM r WHERE name = 'p0' UNION ALL SELECT 'new', v FROM r WHERE name = 'p2')
SELECT name, round(v[1], 6) AS x FROM u""")
def registry_upsert(spark, sf_dir):
    """Adds or replaces p1 and new, and removes p2 and p3."""
    r = names(spark, sf_dir)
    renamed = lambda old, new: r.filter(F.col("name") == old).withColumn("name", F.lit(new))
    out = vectors.upsert(r, renamed("p0", "p1").unionByName(renamed("p2", "new")))
    gone = spark.createDataFrame([("p2",), ("p3",)], "name string")
    return vectors.remove(out, gone).select("name", F.col("voice")[0].alias("x"))


@query(f"""WITH {EMB}, u AS (SELECT vec_id % 3 AS rec_id, vec_id AS seq, list_transform(e, lambda x: x / (n + 1e-8)) AS u FROM e),
d AS (SELECT rec_id, seq, 1 - list_dot_product(u, lag(u) OVER (PARTITION BY rec_id ORDER BY seq)) AS d FROM u),
s AS (SELECT rec_id, seq, d, sum(d) OVER (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS smooth FROM d WHERE d IS NOT NULL)
SELECT rec_id, seq, round(d, 6) AS distance, round(smooth, 6) AS smooth FROM s""")
def smoothed_distance(spark, sf_dir):
    v = rows(spark, sf_dir).select((F.col("vec_id") % 3).alias("rec_id"), F.col("vec_id").alias("seq"), "embedding")
    return intervals.smoothed(vectors.adjacent_distance(v)).drop("embedding")


@query()
def ahc_labels(spark, sf_dir):
    v = rows(spark, sf_dir).select((F.col("vec_id") % 2).alias("rec_id"), F.col("vec_id").alias("seq"), "embedding")
    return clustering.cluster(v, threshold=0.9)


@query(f"""WITH {REG}, a AS (SELECT 'p' || label AS new_name, e, n FROM e)
SELECT new_name, name, round(list_dot_product(e, v) / (n * vn + 1e-8), 6) AS sim FROM a JOIN r ON new_name <> name WHERE list_dot_product(e, v) / (n * vn + 1e-8) > 0.2""")
def duplicate_warnings(spark, sf_dir):
    new = rows(spark, sf_dir).select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"), F.col("embedding").alias("voice"))
    return vectors.duplicate_warnings(new, names(spark, sf_dir), 0.2)


@query("""SELECT 'p' || label AS name, CAST(pos - 1 AS BIGINT) AS pos, round(CAST(avg(x) AS FLOAT)::DOUBLE, 4) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings) GROUP BY label, pos""")
def enrolled_voices(spark, sf_dir):
    s = rows(spark, sf_dir).select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"), "embedding")
    return vectors.enrolled(s).select("name", F.posexplode("voice").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))
