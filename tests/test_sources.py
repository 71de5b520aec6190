"""Readers and writers on real files."""

import json
import math
import struct
import wave

from parlance.functions import audio, text
from parlance.operators import vectors
from parlance.sources import readers, sinks
from pyspark.sql import functions as F


def test_paragraph_rules(spark, tmp_path):
    rows = [{"start": 1.5, "end": 200_000, "speaker": "a", "text": " x "}, {"start": 150_000, "end": 160_000, "text": "y"}, {"start": 3}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    at = str(tmp_path / "p.json")
    get = lambda unit: [(r.start, r.end, r.speaker, r.text) for r in readers.paragraphs(spark, at, unit).orderBy("seq").collect()]
    assert get("either") == [(0.0015, 200.0, "a", "x"), (150.0, 160.0, "spk_unknown", "y")]
    assert get("start") == [(1.5, 200_000.0, "a", "x"), (150.0, 160.0, "spk_unknown", "y")]
    assert get("ms") == [(1500, 200_000_000, "a", " x "), (150_000, 160_000, "", "y")]


def test_corrections_of_both_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rules": [{"wrong": "x", "right": "y"}], "hotwords": ["h"]}))
    (tmp_path / "b.json").write_text(json.dumps({"p": "q", "_note": "n"}))
    assert [(r.wrong, r.right) for r in readers.rules(spark, str(tmp_path / "a.json")).collect()] == [("x", "y")]
    assert [(r.wrong, r.right) for r in readers.rules(spark, str(tmp_path / "b.json")).collect()] == [("p", "q")]
    assert [r.word for r in readers.hotwords(spark, str(tmp_path / "a.json")).collect()] == ["h"]


def test_whole_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("l1\nl2")
    (tmp_path / "b.json").write_text(json.dumps([{"text": "x"}, {"text": ""}, {"text": "y"}]))
    (tmp_path / "c.json").write_text(json.dumps({"paragraphs": [{"text": "z"}]}))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.whole_text(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "l1\nl2", "b.json": "x\ny", "c.json": "z"}


def test_audio_and_sinks(spark, tmp_path):
    n = 1600
    x = [int(16384 * math.sin(2 * math.pi * 440 * i / 16000)) for i in range(n)]
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(struct.pack(f"<{n}h", *x))
    a = readers.audio_files(spark, str(tmp_path / "s.wav"))
    row = a.select("sr", F.size("samples").alias("n"), audio.rms_dbfs("samples").alias("db"), audio.spectral("samples").alias("s")).first()
    assert (row.sr, row.n) == (16000, n) and abs(row.db + 9.03) < 0.05 and 300 < row.s.centroid < 700
    rows = spark.createDataFrame([(1, 0, 0, 1500, "a", False, "hello"), (1, 1, 1500, 61_000, None, True, "you")], "rec_id long, seq long, start_ms long, end_ms long, speaker string, overlap boolean, text string")
    sinks.paragraphs_json(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.orderBy("seq").select("start", "end", "speaker").collect() == [(0.0, 1.5, "a"), (1.5, 61.0, "spk_unknown")]
    assert sinks.readable(rows).first().transcript == "a - 0:00-0:01\nhello\n\nspk_unknown - 0:01-1:01 [可能重叠]\nyou"
    sinks.readable_text(rows, str(tmp_path / "txt"))
    assert sinks.next_path(spark, str(tmp_path / "out")) == str(tmp_path / "out_1")
    assert sinks.next_path(spark, str(tmp_path / "new.json")) == str(tmp_path / "new.json")


def test_registry_round_trip(spark, tmp_path):
    r = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "name string, voice array<float>")
    r.write.parquet(str(tmp_path / "db"))
    back = readers.registry(spark, str(tmp_path / "db"))
    out = vectors.upsert(back, spark.createDataFrame([("b", [1.0, 1.0]), ("c", [2.0, 0.0])], "name string, voice array<float>"))
    assert {x.name: list(x.voice) for x in out.collect()} == {"a": [1.0, 0.0], "b": [1.0, 1.0], "c": [2.0, 0.0]}
    q = spark.createDataFrame([(1, [3.0, 0.1])], "vec_id long, embedding array<float>")
    empty = back.limit(0)
    assert vectors.match(q, empty, 0.5).collect() == [(1, None, 0.0)]
    assert vectors.match(q, back, 0.5).first().name == "a"


def test_prompts(spark):
    out = spark.createDataFrame([("§1 [00:01-00:05] a: hello: you\n\n§2 x\n§2 later",)], "output string")
    got = {r.no: r.body for r in text.sections(out).collect()}
    assert got == {1: "hello: you", 2: "later"}


def test_repetition_rules(spark):
    rows = [("abcabcabcabc",), ("abcabcabc",), ("aaaaaaaaaaaaaaaa",), ("x\nab\nab\nab\nab\n",), ("再见了再见了再见了再见了",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.repetition("t")).collect()]
    assert got == ["abc", None, None, None, "再见了"]


def test_registered_functions(spark):
    from parlance.functions.register import register

    assert register(spark) == ["normalise_numerals", "fuse_texts", "cut_near"]
    assert spark.sql("SELECT normalise_numerals('四十三'), fuse_texts('abc', 'axc'), cut_near('ab。cd', 4)").first()[:] == ("43", "axc", 3)


def test_correction_prompt():
    assert text.correction_prompt("none of these") == text.correction_prompt("medium") != text.correction_prompt("heavy")


def test_retries_and_polling(spark):
    import pytest

    from parlance.sources import remote

    tries, pauses = [], []

    def flaky(t):
        tries.append(t)
        if len(tries) < 3:
            raise OSError("busy")
        return f" {t}! "

    assert remote.with_retries(flaky, sleep=pauses.append)("x") == "x!" and pauses == [1.0, 3.0]
    assert remote.with_retries(lambda t: 1 / 0, sleep=pauses.append)("x") is None
    left = [None, None, "done"]
    assert remote.poll(lambda: left.pop(0), sleep=lambda s: None) == "done"
    ticks = iter(range(0, 10_000, 1000))
    with pytest.raises(TimeoutError):
        remote.poll(lambda: None, sleep=lambda s: None, clock=lambda: next(ticks))
    assert remote.headers("a", "b", "c", "d")["X-Api-Request-Id"] == "d"

    def shout(t):
        if t == "bad":
            raise ValueError
        return t.upper()

    rows = spark.createDataFrame([("hi",), ("bad",), (None,)], "prompt string")
    assert [r.output for r in remote.answers(rows, shout, pauses=(0.0,)).collect()] == ["HI", None, None]
