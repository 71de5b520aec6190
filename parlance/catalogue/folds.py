"""Queries of the ordered folds and whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalogue.base import BUCKET_MS, EVENT_MS, PARTS, SEG, SPOKEN, query, segments, sentences, spoken, turns
from parlance.operators import folds
from parlance.plans import meeting
from parlance.plans import transcript as plans
from parlance.session import table
from parlance.streaming import run, totals, vad

#: A fold in SQL: rows one by one, the open paragraph carried along; its last state is the paragraph.
MERGE = """, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seq) AS k FROM {rows}),
f AS (SELECT rec_id, k, CAST(0 AS BIGINT) AS p, start_ms, end_ms, speaker, overlap, text FROM n WHERE k = 1
  UNION ALL SELECT n.rec_id, n.k, CASE WHEN {joins} THEN f.p ELSE f.p + 1 END, CASE WHEN {joins} THEN f.start_ms ELSE n.start_ms END, n.end_ms, n.speaker,
    CASE WHEN {joins} THEN {overlap} ELSE n.overlap END, CASE WHEN {joins} THEN f.text || n.text ELSE n.text END FROM f JOIN n ON f.rec_id = n.rec_id AND n.k = f.k + 1)
SELECT rec_id, p AS seq, arg_max(start_ms, k) AS start_ms, arg_max(end_ms, k) AS end_ms, arg_max(speaker, k) AS speaker, arg_max(overlap, k) AS overlap, arg_max(text, k) AS text FROM f GROUP BY rec_id, p"""


def merge_sql(source: str, rows: str, joins: str, overlap: str) -> str:
    return f"WITH RECURSIVE {source}" + MERGE.format(rows=rows, joins=joins, overlap=overlap)


@query(merge_sql(SPOKEN, "spoken", "(f.speaker = n.speaker AND n.start_ms - f.end_ms <= 1000 AND n.end_ms - f.start_ms <= 150000 AND length(f.text) < 1200)", "f.overlap OR n.overlap"))
def paragraph_group(spark, sf_dir):
    return folds.group_paragraphs(spoken(spark, sf_dir), 1000, 150_000, 1200)


@query(merge_sql(SPOKEN, "spoken", "(f.speaker = n.speaker AND NOT f.overlap AND NOT n.overlap AND n.start_ms - f.end_ms <= 5000 AND n.end_ms - f.start_ms <= 180000 AND length(f.text) + length(n.text) <= 1500)", "f.overlap"))
def paragraph_merge(spark, sf_dir):
    return folds.merge_consecutive(spoken(spark, sf_dir))


@query(merge_sql(PARTS + ", rows AS (SELECT rec_id, seq, start_ms, end_ms, speaker, event_id % 9 = 4 AS overlap, text FROM sents)", "rows", "(f.speaker = n.speaker AND n.start_ms - f.end_ms <= 60000000 AND n.end_ms - f.start_ms <= 180000000 AND length(f.text) + length(n.text) <= 60)", "f.overlap"))
def utterance_merge(spark, sf_dir):
    """The same without regard to overlaps, on long recordings."""
    return folds.merge_consecutive(sentences(spark, sf_dir).withColumn("overlap", F.col("event_id") % 9 == 4), 60_000_000, 180_000_000, 60, overlap_apart=False)


@query(f"SELECT rec_id, seq, start_ms, end_ms, text FROM ({merge_sql(SPOKEN, 'spoken', '(n.start_ms - f.end_ms <= 2000 AND length(f.text) < 1500)', 'f.overlap')})")
def paragraphs_by_gap(spark, sf_dir):
    return folds.group_by_gap(spoken(spark, sf_dir))


@query(f"""WITH RECURSIVE {SEG}, n AS (SELECT *, seq + 1 AS k, end_ms - start_ms > 30000000 AS big FROM seg),
f AS (SELECT rec_id, k, CAST(0 AS BIGINT) AS b, start_ms AS s, end_ms AS e, big OR end_ms - start_ms > 30000000 AS closed FROM n WHERE k = 1
  UNION ALL SELECT n.rec_id, n.k, CASE WHEN f.closed OR n.big OR n.end_ms - f.s > 30000000 THEN f.b + 1 ELSE f.b END,
    CASE WHEN f.closed OR n.big OR n.end_ms - f.s > 30000000 THEN n.start_ms ELSE f.s END, n.end_ms,
    CASE WHEN n.big THEN true WHEN f.closed OR n.end_ms - f.s > 30000000 THEN false ELSE n.end_ms - f.s >= 25000000 END FROM f JOIN n ON f.rec_id = n.rec_id AND n.k = f.k + 1)
SELECT rec_id, b AS seq, min(s) AS start_ms, arg_max(e, k) AS end_ms, count(*) AS n_subs FROM f GROUP BY rec_id, b""")
def asr_blocks(spark, sf_dir):
    return folds.asr_blocks(segments(spark, sf_dir), 25_000_000, 30_000_000).select("rec_id", "seq", "start_ms", "end_ms", F.size("subs").alias("n_subs"))


@query(f"""WITH RECURSIVE {SPOKEN}, n AS (SELECT rec_id, seq, length(text) AS l, row_number() OVER (PARTITION BY rec_id ORDER BY seq) AS k FROM spoken),
f AS (SELECT rec_id, seq, k, CAST(0 AS BIGINT) AS b, l AS c FROM n WHERE k = 1
  UNION ALL SELECT n.rec_id, n.seq, n.k, CASE WHEN f.c + n.l > 1200 THEN f.b + 1 ELSE f.b END, CASE WHEN f.c + n.l > 1200 THEN n.l ELSE f.c + n.l END FROM f JOIN n ON f.rec_id = n.rec_id AND n.k = f.k + 1)
SELECT rec_id, seq, b AS batch_no, CAST(c AS BIGINT) AS chars FROM f""")
def char_batches(spark, sf_dir):
    return folds.char_batches(spoken(spark, sf_dir), 1200)


@query()
def fuse_sources(spark, sf_dir):
    """Texts with speakers of another source; cutting near marks is a cursor."""
    return plans.fuse(sentences(spark, sf_dir).withColumn("overlap", F.lit(False)), turns(spark, sf_dir).withColumn("overlap", F.col("spk") == 3), BUCKET_MS)


@query()
def redistribute_text(spark, sf_dir):
    blocks = folds.asr_blocks(segments(spark, sf_dir), 25_000_000, 30_000_000)
    said = blocks.withColumn("text", F.concat(F.lit("block "), F.col("seq").cast("string"), F.lit(". it has two sentences, or more. so they say")))
    return plans.redistribute(said, turns(spark, sf_dir), BUCKET_MS)


@query()
def transcript_plan(spark, sf_dir):
    """The canonical plan from sentences and turns to paragraphs."""
    return plans.transcript(sentences(spark, sf_dir), turns(spark, sf_dir), [("click", "tap"), ("view", "look")], bucket_ms=BUCKET_MS)


def chunk_vectors(chunks, v):
    """Chunks with a vector each, dealt over the whole table of vectors, whose ids count from 0; a chunk without one is an error."""
    dealt = chunks.withColumn("vec_id", F.pmod(F.col("rec_id") * 31 + F.col("seq") * 7 + F.col("chunk_no"), F.lit(v.count())))
    return dealt.join(v, "vec_id", "left").withColumn("embedding", F.coalesce("embedding", F.raise_error(F.lit("a chunk has no vector"))))


@query()
def meeting_plan(spark, sf_dir):
    """Speech, chunk vectors and sentences to paragraphs; the vectors stand for a model's, one for each chunk."""
    settings = meeting.Settings(10_000_000, 8_000_000, 10_000_000, 5_000_000, 1_000_000, -50.0, threshold=0.9, bucket_ms=BUCKET_MS)
    speech = segments(spark, sf_dir)
    _, chunks = meeting.chunks(speech, settings)
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors = chunk_vectors(chunks, v).select("rec_id", "seq", "chunk_no", (-(F.col("vec_id") % 60)).cast("double").alias("dbfs"), "embedding")
    return meeting.meeting(speech, vectors, sentences(spark, sf_dir), settings)


def vector_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("rec_id"), F.col("vec_id").alias("seq"), (F.col("vec_id") * 100).alias("at_ms"), (F.col("vec_id") * 100).alias("start_ms"), (F.col("vec_id") * 100 + 100).alias("end_ms"), "embedding", "label")


@query()
def turns_from_vectors(spark, sf_dir):
    v = vector_rows(spark, sf_dir)
    return plans.turns_from_vectors(v, v.select("rec_id", "seq", "start_ms", "end_ms", "embedding"), threshold=0.9)


@query(f"""WITH RECURSIVE v AS (SELECT vec_id % 3 AS rec_id, vec_id AS seq, vec_id * 100 AS at_ms, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT *, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8)) AS u FROM v),
d AS (SELECT rec_id, seq, at_ms, 1 - list_dot_product(u, lag(u) OVER w) AS d FROM u WINDOW w AS (PARTITION BY rec_id ORDER BY seq)),
p AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seq) - 1 AS place, sum(d) OVER (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM d WHERE d IS NOT NULL),
k AS (SELECT * FROM (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM p WINDOW w AS (PARTITION BY rec_id ORDER BY seq)) WHERE s > 1.05 AND s >= a AND s >= b),
n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY place) AS k FROM k),
f AS (SELECT rec_id, seq, place, at_ms, k, place AS last, true AS taken FROM n WHERE k = 1
  UNION ALL SELECT n.rec_id, n.seq, n.place, n.at_ms, n.k, CASE WHEN n.place - f.last >= 8 THEN n.place ELSE f.last END, n.place - f.last >= 8 FROM f JOIN n ON f.rec_id = n.rec_id AND n.k = f.k + 1)
SELECT rec_id, seq, place, at_ms FROM f WHERE taken""")
def change_points(spark, sf_dir):
    return plans.change_points(vector_rows(spark, sf_dir), 1.05, 8)


@query(f"""WITH {SEG}, m AS (SELECT rec_id, seq, seq * 1000 AS at_ms, CASE WHEN value >= 150 THEN 1 WHEN value < 60 THEN 0 END AS m FROM seg),
s AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS st FROM m),
e AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY rec_id ORDER BY seq), 0) AS was FROM s)
SELECT rec_id, seq, at_ms, CASE WHEN st = 1 THEN 'start' ELSE 'end' END AS event FROM e WHERE st <> was""")
def stream_vad(spark, sf_dir):
    """Events of the streaming detector over the frames, run to the end of the input."""
    files = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(files.schema).parquet(f"{sf_dir}/events.parquet*")
    # places of frames are those of the stored table; the stream carries them by event
    place = segments(spark, sf_dir).select("rec_id", "seq", "event_id")
    frames = stream.join(place, "event_id").select("rec_id", "seq", (F.col("seq") * 1000).alias("at_ms"), F.col("value").alias("prob"))
    return run.to_end(vad.events(frames, 150, 60))


@query(f"""WITH {SEG} SELECT rec_id, speaker, start_ms // 86400000 * 86400000 AS window_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, count(*) AS n FROM seg GROUP BY ALL""")
def stream_speaking_time(spark, sf_dir):
    """Totals by day of the stream, run to the end of the input."""
    files = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(files.schema).parquet(f"{sf_dir}/events.parquet*")
    ms = F.expr(EVENT_MS)
    rows = stream.select(F.col("user_id").alias("rec_id"), ms.alias("start_ms"), (ms + F.round(F.col("value") * 1000).cast("long") * 100).alias("end_ms"), F.col("event_type").alias("speaker"))
    return run.to_end(totals.speaking_time(rows), "complete")
