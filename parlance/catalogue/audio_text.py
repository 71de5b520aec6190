"""Queries of the numeric functions, text functions and readers.

The tables have no Chinese text, so functions on it run over a small literal table, the same for both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalogue.base import PARTS, SEG, SPOKEN, query, segments, sentences, spoken, turns
from parlance.functions import audio, diff, numerals, text
from parlance.sources import readers, sinks
from parlance.session import table

X = "x AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"
RMS = "sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))"
PEAK = "list_max(list_transform(x, lambda v: abs(v)))"


def samples(spark, sf_dir):
    """Vectors as short recordings of 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("rec_id"), F.col("embedding").cast("array<double>").alias("samples"))


@query(f"""WITH {X} SELECT vec_id, round(20 * log10({RMS} + 1e-10), 6) AS dbfs, round(20 * log10(({PEAK} + 1e-10) / ({RMS} + 1e-10)), 6) AS crest_db, round(list_sum(list_transform(x, lambda v: v / {PEAK})), 6) AS peak_sum,
round(list_sum(list_transform(x, lambda v: greatest(-1.0, least(1.0, v * 8)))), 6) AS gain_sum, round(list_sum(x[9:24]), 6) AS slice_sum FROM x""")
def audio_levels(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return samples(spark, sf_dir).select(
        "vec_id", audio.rms_dbfs("samples").alias("dbfs"), audio.crest_db("samples").alias("crest_db"), total(audio.normalised("samples")).alias("peak_sum"),
        total(audio.gained("samples", 8.0)).alias("gain_sum"), total(audio.sliced("samples", 16, F.lit(0.5), F.lit(1.5))).alias("slice_sum"))


@query(f"""WITH {X}, f AS (SELECT vec_id, 20 * log10(sqrt(list_sum(list_transform(x[i * 8 + 1 : i * 8 + 8], lambda v: v * v)) / 8) + 1e-10) AS db FROM (SELECT vec_id, x, unnest(generate_series(0, len(x) // 8 - 1)) AS i FROM x)),
p AS (SELECT vec_id, quantile_cont(db, 0.10) AS a, quantile_cont(db, 0.95) AS z FROM f GROUP BY 1)
SELECT vec_id, round(20 * log10({RMS} + 1e-10), 6) AS level, round(a, 6) AS p10, round(z, 6) AS p95, round(z - a, 6) AS "range" FROM x JOIN p USING (vec_id)""")
def noise_floor(spark, sf_dir):
    return audio.measured(samples(spark, sf_dir).drop("rec_id"), 8, "vec_id")


@query(f"WITH {SEG} SELECT rec_id, seq // 10 AS window_no, round(avg(value), 6) AS mean, count(*) AS n FROM seg GROUP BY ALL")
def window_scan(spark, sf_dir):
    return audio.window_scan(segments(spark, sf_dir), 10)


@query(f"""WITH {SEG}, m AS (SELECT rec_id, seq, -(value % 40) AS ra, -(value % 23) AS rb, (value % 7) / 10 AS sa, (value % 6) / 10 AS sb, CASE WHEN seq % 11 = 0 THEN NULL ELSE (value % 10) / 10 END AS sim FROM seg)
SELECT rec_id, seq, CASE WHEN greatest(sa, sb) < 0.05 THEN 'all_noise' WHEN abs(sa - sb) >= 0.1 THEN 'noise_one' WHEN abs(ra - rb) >= 12 THEN 'single' WHEN sim >= 0.8 THEN 'single' ELSE 'overlap' END AS mode,
CASE WHEN greatest(sa, sb) < 0.05 THEN '' WHEN abs(sa - sb) >= 0.1 THEN CASE WHEN sa >= sb THEN '0' ELSE '1' END WHEN abs(ra - rb) >= 12 OR sim >= 0.8 THEN CASE WHEN ra >= rb THEN '0' ELSE '1' END ELSE '0,1' END AS keep FROM m""")
def bss_decision(spark, sf_dir):
    v = F.col("value")
    verdict = audio.separation_verdict(-(v % 40), -(v % 23), (v % 7) / 10, (v % 6) / 10, F.when(F.col("seq") % 11 != 0, (v % 10) / 10))
    return segments(spark, sf_dir).select("rec_id", "seq", verdict.alias("x")).select("rec_id", "seq", "x.mode", F.array_join(F.transform("x.keep", lambda k: k.cast("string")), ",").alias("keep"))


@query(f"""WITH {SEG}, m AS (SELECT rec_id, seq, -(value % 60) AS db, 500 + value * 4 AS c, (value % 10) / 20 AS f, value % 15 AS k, value / 100 AS sec, CASE WHEN seq % 4 = 0 THEN 1 + (value % 4) END AS mos FROM seg),
s AS (SELECT *, CASE WHEN sec < 0.3 THEN 0.5 ELSE 0.2 * greatest(0, least(1, (db + 50) / 25)) + 0.3 * greatest(0, least(1, (c - 800) / 1500)) + 0.3 * greatest(0, least(1, 1 - (f - 0.05) / 0.35)) + 0.2 * greatest(0, least(1, (k - 3) / 9)) END AS s FROM m),
b AS (SELECT rec_id, seq, CASE WHEN mos IS NULL THEN s ELSE 0.5 * s + 0.5 * greatest(0, least(1, (mos - 1.5) / 3)) END AS score FROM s)
SELECT rec_id, seq, round(score, 6) AS score, CASE WHEN score >= 0.6 THEN 'near' WHEN score >= 0.4 THEN 'medium' ELSE 'far' END AS class FROM b""")
def quality_class(spark, sf_dir):
    v = F.col("value")
    score = audio.blended(audio.quality_score(-(v % 60), 500 + v * 4, (v % 10) / 20, v % 15, v / 100), F.when(F.col("seq") % 4 == 0, 1 + (v % 4)))
    return segments(spark, sf_dir).select("rec_id", "seq", score.alias("score"), audio.classify(score).alias("class"))


@query(f"WITH {PARTS}, s AS (SELECT rec_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms FROM sents GROUP BY 1) SELECT rec_id, 1000000000::BIGINT AS total_ms, speech_ms, round(speech_ms / 1000000000, 6) AS ratio FROM (SELECT DISTINCT rec_id FROM seg) JOIN s USING (rec_id)")
def speech_ratio(spark, sf_dir):
    totals = segments(spark, sf_dir).select("rec_id").distinct().withColumn("total_ms", F.lit(1_000_000_000))
    return audio.speech_ratio(sentences(spark, sf_dir), totals)


@query()
def spectral_features(spark, sf_dir):
    """Short-time spectra, by NumPy."""
    return samples(spark, sf_dir).select("vec_id", audio.spectral("samples", n_fft=16, hop=8).alias("s")).select("vec_id", "s.*")


# --- text ---

#: texts, and what the functions make of them
CHINESE = [
    ("我 们 开会 <|zh|><|HAPPY|>", "我们开会 <|zh|><|HAPPY|>", "我 们 开会"),
    ("hello world 你 好", "hello world 你好", "hello world 你 好"),
    ("<|en|>plain", "<|en|>plain", "plain"),
    (" 一 二 ", "一二", "一 二"),
]
NUMERALS = [
    ("四十三", "43"), ("一百五十块", "150块"), ("三千八百七十六", "3876"), ("三八七三", "3873"), ("幺二零三九", "1.2万"),
    ("几十万人", "几十万人"), ("上百", "上百"), ("好几千", "好几千"), ("五百万人", "5010000人"), ("十块", "十块"),
    ("一百零五", "100五"), ("编号 230000000 。", "编号 2.3亿 。"), ("共 12345 。", "共 1.2万 。"), ("值 1234", "值 1234"), ("一千多万", "1000多万"), ("一万元", "万元"),
]


def literal(rows, *names):
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") t({', '.join(names)})"


@query("SELECT text, cleaned, untagged FROM " + literal(CHINESE, "text", "cleaned", "untagged"))
def clean_text(spark, sf_dir):
    return spark.createDataFrame([(r[0],) for r in CHINESE], "text string").select("text", text.clean("text").alias("cleaned"), text.untagged("text").alias("untagged"))


@query("SELECT text, digits FROM " + literal(NUMERALS, "text", "digits"))
def itn(spark, sf_dir):
    return spark.createDataFrame([(r[0],) for r in NUMERALS], "text string").select("text", numerals.normalised("text").alias("digits"))


RULES = [("the", "THE"), ("and", "&"), ("", "x"), ("same", "same"), ("THE", "Z"), ("and", "+"), ("of the", "o/t")]


@query("SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), 'of the', 'o/t'), 'the', 'THE'), 'and', '+'), 'THE', 'Z') AS text FROM documents")
def corrections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.corrected(F.coalesce("text", F.lit("")), RULES).alias("text"))


@query("SELECT doc_id, CASE WHEN contains(text, 'B站') THEN 'B站' WHEN contains(text, 'damn') THEN 'damn' WHEN contains(text, 'stupid') THEN 'stupid' END AS term FROM documents")
def blacklist(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.blacklisted("text", ("stupid", "damn")).alias("term"))


REPEATED = """EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(1, greatest(length(t) - {n4} + 1, 0))) AS i) WHERE i IS NOT NULL AND substr(t, i, {n3}) = substr(t, i + {n}, {n3}) AND length(substr(t, i, {n4})) = {n4}
 AND NOT contains(substr(t, i, {n}), chr(10)) AND length(replace(substr(t, i, {n}), substr(t, i, 1), '')) > 0)"""


@query("WITH d AS (SELECT item_id, text || '. so so so so so ' || substr(text, 1, item_id % 3) AS t FROM benchmark) SELECT item_id, " + " OR ".join("(" + REPEATED.format(n=n, n3=3 * n, n4=4 * n) + ")" for n in range(3, 11)) + " AS repeated FROM d")
def repetition(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    t = F.concat("text", F.lit(". so so so so so "), F.expr("substr(text, 1, cast(item_id % 3 as int))"))
    return b.select("item_id", text.repetition(t).isNotNull().alias("repeated"))


@query()
def repetition_in_documents(spark, sf_dir):
    """Over whole texts, where the SQL form takes the square of their lengths; small ones are held against it in `repetition`."""
    return table(spark, sf_dir, "documents").select("doc_id", text.repetition_of_long("text").alias("pattern"))


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'better' ELSE text || CASE WHEN item_id % 3 = 0 THEN ' 抖音' ELSE '' END END AS text FROM benchmark WHERE item_id % 2 = 1 OR item_id % 3 = 0
UNION ALL SELECT item_id, text AS text FROM benchmark WHERE item_id % 2 = 0 AND item_id % 3 <> 0""")
def retranscribe(spark, sf_dir):
    """A blacklisted first text gives way to a clean second one."""
    b = table(spark, sf_dir, "benchmark")
    first = F.concat("text", F.when(F.col("item_id") % 3 == 0, " 抖音").otherwise(""))
    second = F.when(F.col("item_id") % 2 == 0, F.lit("better")).otherwise(F.concat(first, F.lit(" 微博")))
    return b.select("item_id", text.retranscribed(first, second).alias("text"))


ASCII = "regexp_replace(regexp_replace({c}, '[^\\x20-\\x7E]', '', 'g'), '[^A-Za-z0-9_]', '', 'g')"


@query(f"""WITH p AS (SELECT item_id, {ASCII.format(c='text')} AS r, {ASCII.format(c="replace(text, 'th', 'd')")} AS h FROM benchmark)
SELECT item_id, round(levenshtein(h, r) / length(r), 6) AS cer, round(greatest(0, 1 - levenshtein(h, r) / length(r)), 6) AS accuracy FROM p""")
def cer_pairs(spark, sf_dir):
    plain = F.regexp_replace("text", "[^\\x20-\\x7E]", "")
    rows = table(spark, sf_dir, "benchmark").select("item_id", plain.alias("ref"), F.regexp_replace(F.replace("text", F.lit("th"), F.lit("d")), "[^\\x20-\\x7E]", "").alias("hyp"))
    return rows.select("item_id", text.error_rate("hyp", "ref").alias("cer"), text.accuracy("hyp", "ref").alias("accuracy"))


TIMES = [("12.5", 12.5), ("1:02", 62.0), ("2:03:04.5", 7384.5), (" 7 ", 7.0), ("", None), ("x:y", None), ("0:0:1", 1.0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {'NULL' if v is None else f'{v}::DOUBLE'})" for t, v in TIMES) + ") t(t, seconds)")
def parse_time(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in TIMES], "t string").select("t", text.parsed_time("t").alias("seconds"))


MMSS = "lpad(CAST(floor({s} / 60)::BIGINT AS VARCHAR), CAST(greatest(2, length(CAST(floor({s} / 60)::BIGINT AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(floor({s})::BIGINT % 60 AS VARCHAR), 2, '0')"


@query(f"""WITH {SEG}, v AS (SELECT rec_id, seq, value * 20 AS s FROM seg)
SELECT rec_id, seq, {MMSS.format(s='s')} AS mmss, CAST(floor(s / 60)::BIGINT AS VARCHAR) || ':' || lpad(CAST(floor(s)::BIGINT % 60 AS VARCHAR), 2, '0') AS clock,
{MMSS.format(s='(CASE WHEN s * 4 > 10000 THEN s * 4 / 1000 ELSE s * 4 END)')} AS guess, replace(replace('a/b ' || seq, '/', '_'), ' ', '_') AS file FROM v""")
def time_formats(spark, sf_dir):
    s = F.col("value") * 20
    return segments(spark, sf_dir).select("rec_id", "seq", text.minutes(s).alias("mmss"), text.clock(s).alias("clock"), text.minutes_guess(s * 4).alias("guess"), text.file_safe(F.concat(F.lit("a/b "), F.col("seq").cast("string"))).alias("file"))


@query(f"""WITH {SEG}, v AS (SELECT rec_id, seq, value * 1000 AS s, value * 1000 + CASE WHEN seq % 2 = 0 THEN 90000 ELSE 10 END AS e FROM seg)
SELECT rec_id, seq, round(CASE WHEN s > 100000 OR e > 100000 THEN s / 1000 ELSE s END, 6) AS either, round(CASE WHEN s > 100000 THEN e / 1000 ELSE e END, 6) AS by_start, CAST(trunc(CASE WHEN s < 100000 THEN e * 1000 ELSE e END) AS BIGINT) AS ms FROM v""")
def unit_rules(spark, sf_dir):
    s = F.col("value") * 1000
    e = s + F.when(F.col("seq") % 2 == 0, 90_000).otherwise(10)
    return segments(spark, sf_dir).select("rec_id", "seq", text.seconds_either(s, e)[0].alias("either"), text.seconds_by_start(s, e)[1].alias("by_start"), text.milliseconds_by_start(s, e)[1].alias("ms"))


BLOCKS = SPOKEN + f""", b AS (SELECT rec_id, seq, '§' || (seq + 1) || ' [' || {MMSS.format(s='(CASE WHEN start_ms > 10000 THEN start_ms / 1000 ELSE start_ms END)')} || '-' || {MMSS.format(s='(CASE WHEN end_ms > 10000 THEN end_ms / 1000 ELSE end_ms END)')} || '] ' || speaker || ': ' || text AS block FROM spoken)"""


def blocks(spark, sf_dir):
    return spoken(spark, sf_dir).withColumn("block", text.prompt_block(F.col("seq") + 1, F.col("start_ms"), F.col("end_ms"), F.col("speaker"), F.col("text")))


@query(f"WITH {BLOCKS} SELECT rec_id, string_agg(block, chr(10) || chr(10) ORDER BY seq) AS prompt FROM b GROUP BY 1")
def prompt_blocks(spark, sf_dir):
    return text.joined(blocks(spark, sf_dir), "rec_id")


@query(f"WITH {SPOKEN} SELECT rec_id, seq + 1 AS no, CASE WHEN contains(text, '§') THEN NULL ELSE trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END AS body FROM spoken")
def prompt_roundtrip(spark, sf_dir):
    """Numbered blocks as a model would give them back, parsed again."""
    prompts = text.joined(blocks(spark, sf_dir), "rec_id").withColumnRenamed("prompt", "output")
    anchors = spoken(spark, sf_dir).withColumn("no", (F.col("seq") + 1).cast("int"))
    return text.restored(anchors, text.sections(prompts, "rec_id"), "rec_id").select("rec_id", "no", "body")


@query(f"""WITH {SPOKEN} SELECT rec_id, string_agg(speaker || ' - ' || (start_ms // 60000) || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || '-' || (end_ms // 60000) || ':' || lpad(CAST(end_ms // 1000 % 60 AS VARCHAR), 2, '0') ||
CASE WHEN overlap THEN ' [可能重叠]' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY seq) AS transcript FROM spoken GROUP BY 1""")
def readable_transcript(spark, sf_dir):
    return sinks.readable(spoken(spark, sf_dir))


@query(f"WITH {SPOKEN} SELECT rec_id AS source, 'batch' AS route, round(max(end_ms) / 1000, 6) AS duration_sec, count(DISTINCT speaker) AS n_speakers, count(*) AS n_segments FROM spoken GROUP BY 1")
def transcript_document(spark, sf_dir):
    return sinks.document(spoken(spark, sf_dir), "batch").select("source", "route", "duration_sec", F.size("speakers").alias("n_speakers"), F.size("segments").alias("n_segments"))


@query()
def fused_pairs(spark, sf_dir):
    """Character fusion of two versions of each item, by difflib."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", diff.fused(F.col("text"), F.replace("text", F.lit("th"), F.lit("d")), ["there", "den"]).alias("text"))


@query()
def mined_corrections(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    rows = b.select("item_id", text.bare(F.replace("text", F.lit("tion"), F.lit("shun"))).alias("asr"), text.bare("text").alias("ref"))
    return diff.mined(rows, "item_id", shortest=20)


@query()
def realigned_segments(spark, sf_dir):
    """Segments of one transcript with the words of another."""
    s = spoken(spark, sf_dir)
    whole = text.joined(s.withColumn("block", F.replace("text", F.lit("e"), F.lit("E"))), "rec_id", sep="").withColumnRenamed("prompt", "whole")
    return diff.realigned(s, whole)


CLOUD = [
    (1, '{"result": {"utterances": [{"text": " a ", "start_time": 0, "end_time": 2345, "additions": {"speaker": "0"}}, {"text": "b", "start_time": 3000, "end_time": 4000, "speaker": "7", "additions": {"speaker": "1"}}]}}'),
    (2, '{"Utterances": [{"text": "c", "start_time": 1, "end_time": 10, "speaker_id": 3}, {"text": "d", "start_time": 10, "end_time": 20}]}'),
    (3, '{"result": {"text": "whole", "audio_duration": 12340}}'),
]


@query("""SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 0.0::DOUBLE, 2.35::DOUBLE, 'spk_0', false, 'a'), (1, 1, 3.0, 4.0, 'spk_7', false, 'b'), (2, 0, 0.0, 0.01, 'spk_3', false, 'c'), (2, 1, 0.01, 0.02, 'spk_unknown', false, 'd'), (3, 0, 0.0, 12.34, 'spk_unknown', false, 'whole'))
t(rec_id, seq, start, "end", speaker, overlap, text)""")
def cloud_results(spark, sf_dir):
    return readers.cloud_results(spark.createDataFrame(CLOUD, "rec_id int, value string"))


LINES = ["[00:01-00:05] spk_1:", "hello", "world", "", "[01:00]", "later", "", "", "plain", "[02:00] A B :", "x"]


@query("""SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 5::BIGINT, 'spk_1', 'hello world'), (1, 60, NULL, NULL, 'later'), (1, NULL, NULL, NULL, 'plain'), (1, 120, NULL, 'A B', 'x')) t(rec_id, start, "end", speaker, text)""")
def transcript_lines(spark, sf_dir):
    lines = spark.createDataFrame([(1, i, v) for i, v in enumerate(LINES)], "rec_id int, seq int, value string")
    return readers.transcript_lines(lines).drop("seq")


HOT = [(0, "甲"), (1, "乙")]
FIX = [(0, "x", "乙"), (1, "y", "丙"), (2, "z", "")]


@query("SELECT '本段会议涉及以下专有名词与术语: 甲、乙、丙、丁' AS prompt")
def initial_prompt(spark, sf_dir):
    return readers.initial_prompt(spark.createDataFrame(HOT, "pos int, word string"), spark.createDataFrame(FIX, "pos int, wrong string, right string"), "丁 甲")


@query("SELECT * FROM (VALUES ('甲'), ('乙'), ('丙')) t(word)")
def domain_words(spark, sf_dir):
    return readers.domain_words(spark.createDataFrame(HOT, "pos int, word string"), spark.createDataFrame(FIX, "pos int, wrong string, right string"))


@query("""SELECT * FROM (VALUES ('x', '乙'), ('y', '丙'), ('z', ''), ('w', 'v')) t(wrong, "right")""")
def appended_rules(spark, sf_dir):
    new = spark.createDataFrame([("w", "v"), ("x", "乙"), ("w", "v")], "wrong string, right string")
    return sinks.appended_rules(spark.createDataFrame(FIX, "pos int, wrong string, right string"), new)[0]


@query("SELECT * FROM (VALUES ('a', 5.0::DOUBLE, 9.0::DOUBLE), ('b', 62.0, 72.0), ('c', 3.5, 6.5)) t(name, start_s, end_s)")
def enrol_plan(spark, sf_dir):
    rows = [("a", "5", "9", None, None), ("b", None, None, "1:02", None), ("c", None, None, "3.5", 3.0)]
    return readers.enrol_plan(spark.createDataFrame(rows, "name string, start string, end string, time string, dur double"))


@query(f"WITH {PARTS}, x AS (SELECT t.rec_id, t.seq, e.x[greatest(0, least(64, CAST(trunc(t.value % 3 * 16) AS INTEGER))) + 1 : greatest(0, least(64, CAST(trunc((t.value % 3 + 1) * 16) AS INTEGER)))] AS x FROM turns t JOIN (SELECT vec_id AS rec_id, embedding::DOUBLE[] AS x FROM embeddings) e USING (rec_id)) SELECT rec_id, 'n_' || seq || '.wav' AS file, len(x) AS n, round(list_sum(x), 6) AS total FROM x")
def cut_samples(spark, sf_dir):
    plan = turns(spark, sf_dir).select("rec_id", F.concat(F.lit("n "), F.col("seq").cast("string")).alias("name"), (F.col("value") % 3).alias("start_s"), (F.col("value") % 3 + 1).alias("end_s"))
    out = sinks.cut_samples(samples(spark, sf_dir).withColumn("sr", F.lit(16)), plan)
    return out.select("rec_id", "file", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda s, v: s + v).alias("total"))


STAMPED = [("我们开会。你好 ok吗？好", [[0, 10], [10, 20], [20, 30], [30, 40], [50, 60], [60, 70], [70, 80], [90, 95]]), ("ok. 好", [[5, 9]]), ("...", [])]


@query("""SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 0::BIGINT, 40::BIGINT, '我们开会。'), (0, 1, 50, 80, '你好 ok吗？'), (0, 2, 90, 95, '好'), (1, 0, 0, 0, 'ok.'), (1, 1, 5, 9, '好'), (2, 0, 0, 0, '.'), (2, 1, 0, 0, '.'), (2, 2, 0, 0, '.')) t(rec_id, seq, start_ms, end_ms, text)""")
def timed_sentences(spark, sf_dir):
    """Sentences of a text with one time stamp a character."""
    rows = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(STAMPED)], "rec_id int, text string, stamps array<array<int>>")
    return text.timed_sentences(rows)


@query("""SELECT * FROM (VALUES (1::BIGINT, 'a b'), (2::BIGINT, 'later')) t(no, body)""")
def fused_answer(spark, sf_dir):
    out = spark.createDataFrame([("§1 [00:00-00:05] spk_1:\n[00:00-00:05] spk_1:\na\n b\n\n§2\nfirst\n§ 2 x\nlater",)], "output string")
    return text.fused_sections(out).select("no", "body")


@query()
def estimated_quality(spark, sf_dir):
    """Quality of short recordings from their own samples and spectra."""
    return audio.estimated_quality(samples(spark, sf_dir).drop("rec_id"), 64, "vec_id", n_fft=16, hop=8)
