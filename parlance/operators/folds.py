"""Ordered folds: operators whose next state depends on all rows before, which windows can't express.

`ordered_fold` streams the rows of each recording in order through a small state machine: one shuffle by recording, a
sort within partitions, then one pass in Arrow batches.  A recording is never held as a whole; its state is one open
row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parlance.session import ship


def ordered_fold(df: DataFrame, order: list[str], reads: list[str], make: Callable[[], Fold], schema: str, key: str = "rec_id") -> DataFrame:
    """Rows that `make()` gives for each recording's rows (dicts) in order; the recording's key is added as first column.

    Only the columns that the fold reads are shuffled, as far as there are any of these names.
    """
    ship(df.sparkSession)
    out_type = StructType.fromDDL(f"{key} {dict(df.dtypes)[key]}, {schema}")
    df = df.select(*[c for c in dict.fromkeys([key, *order, *reads]) if c in df.columns])
    arrow = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, out = None, None, []

        def pack():
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if fold is None or row[key] != now:
                    if fold is not None:
                        out += [{key: now} | r for r in fold.close()]
                    now, fold = row[key], make()
                out += [{key: now} | r for r in fold.add(row)]
            if len(out) > 5000:
                yield pack()
                out = []
        if fold is not None:
            out += [{key: now} | r for r in fold.close()]
        yield pack()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out_type)


class Fold:
    """Takes rows in order and gives finished ones."""

    def add(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def close(self) -> list[dict]:
        return []


class Merge(Fold):
    """One open row; `joins(open, row)` says whether the next row goes into it."""

    def __init__(self, joins: Callable[[dict, dict], bool], keep_overlap: bool):
        self.joins, self.keep_overlap, self.open, self.n = joins, keep_overlap, None, 0

    def add(self, row):
        o = self.open
        if o is not None and self.joins(o, row):
            o["end_ms"] = row["end_ms"]
            o["_parts"].append(row["text"] or "")
            o["_chars"] += len(row["text"] or "")
            if self.keep_overlap:
                o["overlap"] = o["overlap"] or bool(row.get("overlap"))
            return []
        done = self.close()
        self.open = {"seq": self.n, "start_ms": row["start_ms"], "end_ms": row["end_ms"], "speaker": row.get("speaker"), "overlap": bool(row.get("overlap")), "_parts": [row["text"] or ""], "_chars": len(row["text"] or "")}
        self.n += 1
        return done

    def close(self):
        o, self.open = self.open, None
        return [] if o is None else [{k: v for k, v in o.items() if k[0] != "_"} | {"text": "".join(o["_parts"])}]


SAID = ["start_ms", "end_ms", "speaker", "overlap", "text"]
SENTENCE = "seq long, start_ms long, end_ms long, speaker string, overlap boolean, text string"


def group_paragraphs(sentences: DataFrame, gap_ms: int = 800, dur_ms: int = 60_000, chars: int = 600) -> DataFrame:
    """Sentences of one speaker as a paragraph while gaps are short, the whole is short enough, and the paragraph so far has
    fewer than `chars` characters; a paragraph overlaps if any of its sentences does."""

    def joins(o, r):
        return o["speaker"] == r["speaker"] and r["start_ms"] - o["end_ms"] <= gap_ms and r["end_ms"] - o["start_ms"] <= dur_ms and o["_chars"] < chars

    return ordered_fold(sentences, ["seq"], SAID, lambda: Merge(joins, True), SENTENCE)


def merge_consecutive(paragraphs: DataFrame, gap_ms: int = 5000, dur_ms: int = 180_000, chars: int = 1500, overlap_apart: bool = True) -> DataFrame:
    """Neighbours of one speaker as one while gap, duration and characters of the result stay within the limits; with
    `overlap_apart` overlapping paragraphs stay alone."""

    def joins(o, r):
        apart = overlap_apart and (o["overlap"] or bool(r.get("overlap")))
        return not apart and o["speaker"] == r["speaker"] and r["start_ms"] - o["end_ms"] <= gap_ms and r["end_ms"] - o["start_ms"] <= dur_ms and o["_chars"] + len(r["text"] or "") <= chars

    return ordered_fold(paragraphs, ["seq"], SAID, lambda: Merge(joins, False), SENTENCE)


def group_by_gap(sentences: DataFrame, gap_ms: int = 2000, chars: int = 1500) -> DataFrame:
    """Paragraphs by silence alone: a new one after a gap beyond `gap_ms`, or when the one before has `chars` characters."""

    def joins(o, r):
        return r["start_ms"] - o["end_ms"] <= gap_ms and o["_chars"] < chars

    return ordered_fold(sentences, ["seq"], SAID, lambda: Merge(joins, False), SENTENCE).drop("speaker", "overlap")


class Blocks(Fold):
    def __init__(self, target: int, most: int):
        self.target, self.most, self.open, self.n = target, most, None, 0

    def _out(self, start, end, subs):
        self.n += 1
        return {"seq": self.n - 1, "start_ms": start, "end_ms": end, "subs": subs}

    def close(self):
        o, self.open = self.open, None
        return [self._out(*o)] if o else []

    def add(self, row):
        s, e = row["start_ms"], row["end_ms"]
        sub = {"start_ms": s, "end_ms": e}
        if e - s > self.most:
            return [*self.close(), self._out(s, e, [sub])]
        if self.open and e - self.open[0] > self.most:
            done = self.close()
            self.open = (s, e, [sub])
            return done
        if not self.open:
            self.open = (s, e, [sub])
            return []
        self.open = (self.open[0], e, [*self.open[2], sub])
        return self.close() if e - self.open[0] >= self.target else []


def asr_blocks(segments: DataFrame, target_ms: int = 25_000, most_ms: int = 30_000) -> DataFrame:
    """Segments packed in order into blocks of at most `most_ms`; a block closes at `target_ms`, a longer segment is a
    block of its own; blocks keep their segments."""
    return ordered_fold(segments, ["seq"], ["start_ms", "end_ms"], lambda: Blocks(target_ms, most_ms), "seq long, start_ms long, end_ms long, subs array<struct<start_ms:long,end_ms:long>>")


class Batches(Fold):
    def __init__(self, most: int, sizes: tuple[str, ...]):
        self.most, self.sizes, self.no, self.size, self.any = most, sizes, 0, 0, False

    def add(self, row):
        n = sum(len(row[c] or "") for c in self.sizes)
        if self.any and self.size + n > self.most:
            self.no, self.size = self.no + 1, 0
        self.any, self.size = True, self.size + n
        return [{"seq": row["seq"], "batch_no": self.no, "chars": self.size}]


def char_batches(rows: DataFrame, most: int = 2500, texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """Batch number of each row and the characters of its batch so far: a batch that isn't empty closes before it would pass `most` characters (of all `texts` together)."""
    return ordered_fold(rows, ["seq"], list(texts), lambda: Batches(most, texts), "seq long, batch_no int, chars long")


class Spaced(Fold):
    def __init__(self, least: int):
        self.least, self.last = least, None

    def add(self, row):
        if self.last is not None and row["place"] - self.last < self.least:
            return []
        self.last = row["place"]
        return [{"seq": row["seq"], "place": row["place"], "at_ms": row["at_ms"]}]


def spaced(peaks: DataFrame, least: int) -> DataFrame:
    """Peaks (seq, place, at_ms) at least `least` places after the last one taken."""
    return ordered_fold(peaks, ["place"], ["seq", "at_ms"], lambda: Spaced(least), "seq long, place long, at_ms long")


class Align(Fold):
    """Holds the rows of the first side that the second may still touch, by start."""

    def __init__(self, gap: int):
        self.gap, self.a, self.free, self.low = gap, [], [], 0
        self.reach: list[int] = []

    def add(self, row):
        if row["side"] == 0:
            self.a.append(row)
            self.free.append(True)
            self.reach.append(max(row["end_ms"], self.reach[-1]) if self.reach else row["end_ms"])
            return []
        a, start, end = self.a, row["start_ms"], row["end_ms"]
        while self.low < len(a) and (not self.free[self.low] or self.reach[self.low] < start):
            self.low += 1  # taken, or over before this and all later rows of b begin
        best, least = None, None
        for i in range(self.low, len(a)):
            if a[i]["start_ms"] > end:
                break
            if not self.free[i] or a[i]["end_ms"] < start:
                continue
            d = max(abs(start - a[i]["start_ms"]), abs(end - a[i]["end_ms"]))
            if least is None or d < least:
                best, least = i, d
        if best is None or least > self.gap + end - start:
            return [{"seq_b": row["seq"], "seq_a": None}]
        self.free[best] = False
        return [{"seq_b": row["seq"], "seq_a": a[best]["seq"]}]


def time_align(a: DataFrame, b: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """One-to-one: each row of b, in order, takes the free row of a that touches it and whose larger difference of starts and ends
    is least (the first such), if that is at most `gap_ms` plus b's duration; seq_a is null where none is left.

    Both sides must be in order of start.
    """
    from pyspark.sql import functions as F

    cols = ["rec_id", "seq", "start_ms", "end_ms"]
    both = a.select(*cols).withColumn("side", F.lit(0)).union(b.select(*cols).withColumn("side", F.lit(1)))
    return ordered_fold(both, ["side", "start_ms", "seq"], ["end_ms"], lambda: Align(gap_ms), "seq_b long, seq_a long")
