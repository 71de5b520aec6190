"""Best-fit packing of documents into sequences by minimum bin slack.

A document's ids (with the end id) stay together unless they are longer than a sequence; then they are cut into
whole sequences, and the rest, the first piece, is packed like a short document.  What has to be known to pack is how many
pieces there are of each length, a table of at most `capacity` rows whatever the corpus.  On it the bins are planned:
the longest piece left opens a bin, a subset-sum over bitsets of the lengths left (with their numbers) finds the fullest
bin around it, and this combination is taken out as often as the stock allows.  Each pick uses up at least half of
some length's stock, so the plan is short too; it says, for each length, which ranks go to which bins.

Ranks are dealt without a global sort: a task counts pieces of each length within itself, and offsets of (task, length) are
summed up.  The pieces are written once before they are ranked, so a lost executor can't change a rank.

Null texts are empty texts (one piece, the end id).  Repeated rows are packed each for itself; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import bytelevel, frames

PIECES = "task string, local_rank long, doc_id long, piece int, start long, length int, ids_crc32 long"


def fullest(lengths: list[int], stock: dict[int, int], room: int) -> list[int]:
    """Lengths, no more of each than there are, whose sum is the largest that doesn't exceed `room`; long ones first."""
    full, reach, layers = (1 << (room + 1)) - 1, 1, []
    for x in lengths:
        if x > room:
            continue
        layers.append((x, reach))
        left, step = min(stock[x], room // x), 1
        while left:
            k = min(step, left)
            reach |= (reach << (x * k)) & full
            left -= k
            step *= 2
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, []
    for x, before in reversed(layers):
        while not before >> best & 1:
            out.append(x)
            best -= x
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many, [(length, how many in each)]), longest first, from the numbers of pieces of each length."""
    stock = {x: c for x, c in counts.items() if c > 0}
    lengths, bins = sorted(stock, reverse=True), []
    while lengths:
        top = lengths[0]
        stock[top] -= 1
        inside = [top, *fullest([x for x in lengths if stock[x]], stock, capacity - top)]
        stock[top] += 1
        each: dict[int, int] = {}
        for x in inside:
            each[x] = each.get(x, 0) + 1
        times = min(stock[x] // k for x, k in each.items())
        for x, k in each.items():
            stock[x] -= times * k
        bins.append((times, sorted(each.items(), reverse=True)))
        lengths = [x for x in lengths if stock[x]]
    return bins


def places(bins: list) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, pieces a bin, first sequence and first offset of every run of like bins."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, inside in bins:
        offset = 0
        for x, k in inside:
            out.setdefault(x, []).append((used.get(x, 0), k, sequence, offset))
            used[x] = used.get(x, 0) + times * k
            offset += x * k
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*runs)) for x, runs in out.items()}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """All pieces with a rank among those of their task and length."""

    def f(batches):
        e, task, seen = bytelevel.shared_encoder(path), uuid.uuid4().hex, np.zeros(capacity + 1, np.int64)
        kind = {"task": pa.string(), "local_rank": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64()}
        for whole in batches:
            for part in bytelevel.slices(whole, "text"):
                ids, at = e(part.column(1))
                rows = {k: [] for k in kind if k != "task"}
                for d, a, z in zip(part.column(0).to_pylist(), at[:-1], at[1:]):
                    own = np.append(ids[a:z], end_id).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(own), capacity)):
                        for name, v in zip(rows, (seen[n], d, k, s, n, zlib.crc32(own[s : s + n]))):
                            rows[name].append(v)
                        seen[n] += 1
                yield frames.batch(kind, task=[task] * len(rows["doc_id"]), **rows)

    return frames.map_arrow(frames.texts_of(docs), f, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    all_pieces = frames.kept(pieces(docs, path, capacity, end_id), "pieces")
    by_task = all_pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in all_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(places(plan(counts, capacity)))

    def f(batches):
        for part in batches:
            length, rank = part.column("length").to_numpy(), part.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                x = int(length[at[0]])
                first, each, seq, off = where.value[x]
                run = np.searchsorted(first, rank[at], "right") - 1
                k = rank[at] - first[run]
                sequence[at] = seq[run] + k // each[run]
                offset[at] = off[run] + k % each[run] * x
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = all_pieces.join(base, ["task", "length"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return frames.map_arrow(ranked, f, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
