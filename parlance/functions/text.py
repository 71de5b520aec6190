"""Text of transcripts: cleaning, corrections, anomalies, time formats, prompt blocks; all JVM expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CJK = "一-鿿"
WORD = f"(?U)[^{CJK}\\w]"

# Terms that are taken for invented text in meetings.
BLACKLIST = [
    "宝宝", "老婆", "老公", "媳妇", "亲爱的", "想你了", "爱你", "好可爱", "哈哈哈哈", "嘻嘻", "么么哒",
    "火鸡面", "王者荣耀", "和平精英", "原神", "抖音", "小红书", "微博", "B站", "网易云",
    "睡觉", "睡饱", "想睡觉", "起床", "刷牙", "吃饭了吗", "今天吃啥", "好吃", "好饿",
    "字幕由社区提供", "感谢观看", "请订阅",
]
# Marks that end a sentence, and those after which a text may be cut too.
SENTENCE_MARKS, SOFT_MARKS = "。！？!?", "，,；;、"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: str | Column) -> Column:
    """Without blanks between CJK characters and at the ends."""
    return F.trim(F.regexp_replace(_c(x), f"(?<=[{CJK}])\\s+(?=[{CJK}])", ""))


def untagged(x: str | Column) -> Column:
    """Without recogniser tags such as <|zh|>."""
    return F.trim(F.regexp_replace(_c(x), "(?s)<\\|.*?\\|>", ""))


def letters(x: str | Column) -> Column:
    """Letters, digits, underscores and CJK characters only."""
    return F.regexp_replace(_c(x), WORD, "")


# What stands in a transcript's lines besides speech.
TIME_STAMP = "\\[\\d+:\\d+(?:-\\d+:\\d+)?\\]"
SPEAKER_TAGS = ("说话人\\s*\\d+", "发言人\\s*\\d+", "spk[_\\d]+", "(?U:Speaker_\\w+)")
HEADINGS = ("^#+\\s", "^---+\\s*$")
META = "|".join((TIME_STAMP, *SPEAKER_TAGS, *HEADINGS))


def bare(x: str | Column) -> Column:
    """For comparisons: without time stamps, speaker tags, headings, blanks and punctuation."""
    without = F.regexp_replace(_c(x), META, " ")
    return letters(F.regexp_replace(without, f"(?<=[{CJK}])\\s+(?=[{CJK}])", ""))


def corrected(x: str | Column, rules: list[tuple[str, str]], literal: bool = False) -> Column:
    """Rules one after another, longest wrong text first (earlier ones among equals); what one makes the next may change.

    Of rules with the same wrong text the last counts; empty ones and those that change nothing are skipped, unless
    `literal`, where rules apply as they come.
    """
    out = _c(x)
    if literal:
        ordered = rules
    else:
        last = dict(rules)
        ordered = sorted(((w, r) for w, r in last.items() if w and w != r), key=lambda p: -len(p[0]))
    for w, r in ordered:
        if w:
            out = F.replace(out, F.lit(w), F.lit(r))
    return out


def blacklisted(x: str | Column, extra: tuple[str, ...] = ()) -> Column:
    """The first blacklisted term, in order of the list's code points, that the text has; null without one."""
    return F.coalesce(*[F.when(F.contains(_c(x), F.lit(w)), F.lit(w)) for w in sorted({*BLACKLIST, *extra})])


def repetition(x: str | Column, least: int = 4, shortest: int = 3, longest: int = 10) -> Column:
    """The first pattern of the shortest length that follows itself `least` times or more, single-character ones aside; null without one.

    The look-ahead skips patterns of one character, which speech has by nature.
    """
    found = [F.nullif(F.regexp_extract(_c(x), f"(?d)(?!(.)\\1{{{n - 1}}})(.{{{n}}})\\2{{{least - 1},}}", 2), F.lit("")) for n in range(shortest, longest + 1)]
    return F.coalesce(*found)


def may_repeat(x: str | Column, least: int = 4, shortest: int = 3, longest: int = 10) -> Column:
    """Whether some stretch equals itself n characters on for long enough, for any n: true wherever `repetition` finds a
    pattern.  An Arrow UDF of a few comparisons a character, to spare long texts the patterns."""

    @F.pandas_udf("boolean")
    def f(s: pd.Series) -> pd.Series:
        out = np.zeros(len(s), bool)
        for i, t in enumerate(s):
            if t is None or len(t) < least * shortest:
                continue
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            for n in range(shortest, longest + 1):
                need = (least - 1) * n
                ends = np.flatnonzero(c[n:] != c[:-n])
                if len(c) - n >= need and np.diff(np.concatenate([[-1], ends, [len(c) - n]])).max() > need:
                    out[i] = True
                    break
        return pd.Series(out)

    return f(_c(x))


def repetition_of_long(x: str | Column, least: int = 4, shortest: int = 3, longest: int = 10) -> Column:
    """As repetition, trying the patterns only on texts that may have one."""
    return F.when(may_repeat(x, least, shortest, longest), repetition(x, least, shortest, longest))


def anomaly(x: str | Column, least: int = 4) -> Column:
    return F.coalesce(blacklisted(x), repetition(x, least))


def retranscribed(first: str | Column, second: str | Column, least: int = 4) -> Column:
    """The second transcription where the first is anomalous and the second is neither that nor empty."""
    a, b = _c(first), _c(second)
    return F.when(anomaly(a, least).isNotNull() & (F.coalesce(b, F.lit("")) != "") & anomaly(b, least).isNull(), b).otherwise(a)


def error_rate(hypothesis: str | Column, reference: str | Column) -> Column:
    """Character error rate over letters only: edit distance by the reference's length (1 for an empty reference and a text, 0 for both empty)."""
    h, r = letters(hypothesis), letters(reference)
    return F.when(F.length(r) > 0, F.levenshtein(h, r) / F.length(r)).otherwise(F.when(F.length(h) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def accuracy(hypothesis: str | Column, reference: str | Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - error_rate(hypothesis, reference))


def two(x: Column) -> Column:
    return F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))


def minutes(seconds: Column) -> Column:
    """MM:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.concat(two(F.floor(s / 60).cast("long")), F.lit(":"), two(s % 60))


def clock(seconds: Column) -> Column:
    """m:ss."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), two(s % 60))


def clock_ms(ms: Column) -> Column:
    return clock(ms / 1000)


def minutes_guess(t: Column) -> Column:
    """MM:SS of seconds, or of milliseconds if beyond 10000."""
    return F.when(t.isNull(), F.lit("")).otherwise(minutes(F.when(t > 10_000, t / 1000).otherwise(t)))


def span(start: Column, end: Column) -> Column:
    """MM:SS-MM:SS, without an end only the start, without a start nothing."""
    return F.when(start.isNull(), F.lit("")).when(end.isNull(), minutes_guess(start)).otherwise(F.concat(minutes_guess(start), F.lit("-"), minutes_guess(end)))


def header(speaker: Column, start_s: Column, end_s: Column, overlap: Column) -> Column:
    return F.concat(speaker, F.lit(" - "), clock(start_s), F.lit("-"), clock(end_s), F.when(F.coalesce(overlap, F.lit(False)), " [可能重叠]").otherwise(""))


def parsed_time(t: str | Column) -> Column:
    """Seconds of a number, M:S or H:M:S in text; null for blank or other text."""
    s = F.trim(_c(t))
    p = F.split(s, ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    n = F.size(p)
    return F.when(s == "", None).when(s.rlike("^[0-9]+(\\.[0-9]+)?$"), s.try_cast("double")).when(n == 2, part(1) * 60 + part(2)).when(n == 3, part(1) * 3600 + part(2) * 60 + part(3))


def seconds_either(start: Column, end: Column) -> tuple[Column, Column]:
    """Both by 1000 if either is beyond 100000."""
    ms = (start > 100_000) | (end > 100_000)
    return F.when(ms, start / 1000).otherwise(start), F.when(ms, end / 1000).otherwise(end)


def seconds_by_start(start: Column, end: Column) -> tuple[Column, Column]:
    """Both by 1000 if the start is beyond 100000."""
    ms = start > 100_000
    return F.when(ms, start / 1000).otherwise(start), F.when(ms, end / 1000).otherwise(end)


def milliseconds_by_start(start: Column, end: Column) -> tuple[Column, Column]:
    """Both times 1000 if the start is less than 100000, whatever it was."""
    s = start < 100_000
    return F.when(s, start * 1000).otherwise(start).cast("long"), F.when(s, end * 1000).otherwise(end).cast("long")


def file_safe(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), "[/\\\\\\s]", "_")


def prompt_block(no: Column, start: Column, end: Column, speaker: Column, text: Column) -> Column:
    """§N [MM:SS-MM:SS] speaker: text"""
    ts = F.when(start.isNull(), F.lit("")).otherwise(F.concat(F.lit("["), span(start, end), F.lit("] ")))
    who = F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(speaker, F.lit(": "))).otherwise("")
    return F.concat(F.lit("§"), no.cast("string"), F.lit(" "), ts, who, F.coalesce(text, F.lit("")))


def pair_block(no: Column, start_s: Column, end_s: Column, speaker: Column, a: Column, b: Column) -> Column:
    """§N [MM:SS-MM:SS] speaker: with the two texts below."""
    return F.concat(F.lit("§"), no.cast("string"), F.lit(" ["), minutes(start_s), F.lit("-"), minutes(end_s), F.lit("] "), speaker, F.lit(":\n  [A] "), a, F.lit("\n  [B] "), F.when(F.coalesce(b, F.lit("")) != "", b).otherwise("<空>"))


def joined(df: DataFrame, *keys: str, block: str = "block", order: str = "seq", sep: str = "\n\n") -> DataFrame:
    """Blocks of each group in order, with a separator."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, block))), lambda x: x[block]), sep).alias("prompt"))


def sections(output: DataFrame, *keys: str, text: str = "output") -> DataFrame:
    """(no, body) of each §N of a model's answer, without time stamps and speakers at the front; of a repeated number the last counts."""
    s = F.col(text)
    numbers = F.expr(f"regexp_extract_all(`{text}`, '§\\\\s*(\\\\d+)\\\\s*', 1)")
    bodies = F.split(s, "§\\s*\\d+\\s*")
    out = output.select(*keys, F.posexplode(F.arrays_zip(numbers.alias("no"), F.slice(bodies, F.lit(2), F.size(bodies)).alias("body"))).alias("_pos", "x"))
    body = F.regexp_replace(F.trim(F.regexp_replace(F.col("x.body"), "^\\s+|\\s+$", "")), "^\\s*\\[\\d+:\\d+(?:-\\d+:\\d+)?\\]\\s*", "")
    named = F.when(F.contains(F.substring(body, 1, 30), F.lit(":")), F.regexp_replace(body, "^[^\\[]+?:\\s*", "")).otherwise(body)
    rows = out.select(*keys, F.col("x.no").cast("int").alias("no"), F.trim(named).alias("body"), "_pos")
    return rows.groupBy(*keys, "no").agg(F.max_by("body", "_pos").alias("body"))


def restored(anchors: DataFrame, parsed: DataFrame, *keys: str, default: Column | None = None) -> DataFrame:
    """Text of each numbered anchor from the answer; where it lacks one, `default` or nothing."""
    out = anchors.join(parsed, [*keys, "no"], "left")
    return out.withColumn("body", F.coalesce(F.when(F.col("body") != "", F.col("body")), default if default is not None else F.lit("")))


def chapter_snippet(start: Column, text: Column, n: int = 80) -> Column:
    return F.concat(F.lit("["), minutes_guess(start), F.lit("] "), F.substring(text, 1, n))


def fused_sections(output: DataFrame, *keys: str, text: str = "output") -> DataFrame:
    """(no, body) of a fused answer: a section begins in the line after its §N; header lines repeated inside go, the
    others are joined by blanks."""
    src = F.concat(F.lit("\n"), F.col(text))
    numbers = F.regexp_extract_all(src, F.lit("§\\s*(\\d+)[^\\n]*\\n"), F.lit(1))
    bodies = F.split(src, "§\\s*\\d+[^\\n]*\\n")
    rows = output.select(*keys, F.posexplode(F.arrays_zip(numbers.alias("no"), F.slice(bodies, F.lit(2), F.size(bodies)).alias("body"))).alias("_pos", "x"))
    lines = F.transform(F.split(F.regexp_replace(F.col("x.body"), "^\\s+|\\s+$", ""), "\n"), lambda v: F.trim(v))
    plain = F.filter(lines, lambda v: ~v.rlike("^\\[\\d{2}:\\d{2}-\\d{2}:\\d{2}\\]\\s*(?U:spk_\\w+):?"))
    rows = rows.select(*keys, F.col("x.no").cast("int").alias("no"), F.trim(F.array_join(plain, " ")).alias("body"), "_pos")
    return rows.groupBy(*keys, "no").agg(F.max_by("body", "_pos").alias("body"))


def timed_sentences(rows: DataFrame, key: str = "rec_id") -> DataFrame:
    """Sentences of texts (key, text, stamps: array of [start, end] for each CJK character in order): cut after 。！？.!?；;,
    from the first CJK character's start to the last one's end so far."""
    chars = rows.select(key, "stamps", F.posexplode(F.split(clean("text"), "")).alias("pos", "ch")).filter("ch <> ''")
    w = Window.partitionBy(key).orderBy("pos")
    here, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    cjk = F.col("ch").rlike(f"[{CJK}]")
    marked = chars.withColumn("cjk", cjk).withColumn("upto", F.sum(cjk.cast("int")).over(here)).withColumn("no", F.coalesce(F.sum(F.col("ch").isin(*"。！？.!?；;").cast("int")).over(before), F.lit(0)))
    n = F.size("stamps")
    begin = F.when(F.col("cjk") & (F.col("upto") <= n), F.try_element_at("stamps", F.col("upto").cast("int"))[0])
    out = marked.withColumn("begin", begin).groupBy(key, "no").agg(
        F.min_by("begin", F.when(F.col("begin").isNotNull(), F.col("pos"))).alias("begin"), F.max("upto").alias("upto"), F.max_by("stamps", "pos").alias("stamps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("text"))
    start = F.coalesce("begin", F.lit(0))
    end = F.when((F.col("upto") > 0) & (F.size("stamps") > 0), F.element_at("stamps", F.least(F.col("upto"), F.size("stamps")).cast("int"))[1]).otherwise(start)
    return out.select(key, F.col("no").alias("seq"), start.alias("start_ms"), end.alias("end_ms"), F.trim("text").alias("text"))


#: How much a model may change; an unknown level counts as medium.
LEVELS = {
    "light": "Correct only clear recognition errors. Keep every word order and filler.",
    "medium": "Correct recognition errors and punctuation. Leave out fillers and repeated words.",
    "heavy": "Correct recognition errors and rewrite spoken sentences so that they read well. Add nothing.",
}


def correction_prompt(level: str = "medium") -> str:
    """Instructions for correcting numbered paragraphs, which the answer must keep with their numbers."""
    return LEVELS.get(level, LEVELS["medium"]) + " Answer with the same numbered sections, each beginning with § and its number."
