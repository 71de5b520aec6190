"""Approximate nearest neighbours: one hierarchical navigable small-world graph a shard.

Vectors of one direction (equal unit vectors in single precision: copies and multiples) are one node with its smallest ids, so
thousands of copies neither crowd a neighbourhood nor a shard.  Nodes are dealt to shards by a hash; a shard's levels are
drawn geometrically, and each level is a flat neighbour array (nodes x degree, -1 for none).  Nodes are inserted in an order drawn
from the shard's size, a batch at a time: each descends through the graph so far, and on every level of its own it chooses links
among the nodes it meets there and those of its batch, by the usual rule that drops a neighbour which is nearer to one already
kept.  Links are mutual; a node with more than `degree` of them chooses anew by that rule.  All
queries of a block descend together: a beam of `upper` on the upper levels, whose nodes all enter the level below, a beam of
`beam` on the lowest.  Every shard answers every query.  All nodes of the beam are scored anew in double precision, and
of those that are within single precision's error of the best k all ids are: near ties are settled on the original vectors.

Vectors that are null, zero or hold null or non-finite components take no part; of repeated rows (same id and vector) one
counts; ties go to the smaller id; of one direction the `same` smallest ids are candidates.  An empty table, or one
with a single vector, gives no rows for lack of candidates.  Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import frames


@dataclass(frozen=True)
class Graph:
    degree: int = 24
    near: int = 48  # nodes from which a new node's links are chosen
    build: int = 64  # beam of an insertion on the lowest level
    batch: int = 512  # nodes that are inserted together, as many as there are already at most
    beam: int = 256
    upper: int = 16
    same: int = 1024  # ids of one direction that are kept; multiples of a vector differ by rounding only, so no more can matter
    shard: int = 8_192  # vectors, on average


def levels(n: int, degree: int) -> np.ndarray:
    """A node's highest level, geometrically distributed."""
    u = np.random.default_rng(n).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(degree)).astype(np.int64)


def chosen(x: np.ndarray, near: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of candidates `near` (node numbers, -1 for none) in descending order of `sim`, a mask of `most` a row: those that are nearer to
    the row's node than to any taken before, then the nearest of the others."""
    v = x[np.maximum(near, 0)]
    among = v @ v.transpose(0, 2, 1)
    some = near >= 0
    take = np.zeros(near.shape, bool)
    count = np.zeros(len(near), np.int64)
    for j in range(near.shape[1]):
        closer = (take & (among[:, j, :] > sim[:, j : j + 1])).any(1)
        take[:, j] = some[:, j] & ~closer & (count < most)
        count += take[:, j]
    for j in range(near.shape[1]):
        more = some[:, j] & ~take[:, j] & (count < most)
        take[more, j] = True
        count += more
    return take


def similarities(x: np.ndarray, who: np.ndarray, near: np.ndarray) -> np.ndarray:
    return np.where(near >= 0, np.einsum("ad,akd->ak", x[who], x[np.maximum(near, 0)]), -np.inf).astype(np.float32)


def descending(near: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sim, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)


class Index:
    """Unit vectors x (float32) and the flat arrays of their levels."""

    def __init__(self, x: np.ndarray, g: Graph = Graph()):
        self.x, self.g = x, g
        top = levels(len(x), g.degree)
        self.levels = []
        for level in range(int(top.max(initial=0)) + 1):
            nodes = np.flatnonzero(top >= level)
            row = np.full(len(x), -1, np.int32)
            row[nodes] = np.arange(len(nodes))
            self.levels.append((row, np.full((len(nodes), g.degree), -1, np.int32)))
        self.entry = int(np.argmax(top)) if len(x) else -1
        order = np.random.default_rng(len(x)).permutation(len(x))
        order = order[order != self.entry]
        done = 0
        while done < len(order):
            new = order[done : done + min(max(done, 64), g.batch)]
            self.insert(new, top)
            done += len(new)

    def insert(self, new: np.ndarray, top: np.ndarray) -> None:
        """Nodes descend through the graph so far and are linked to nodes found there and among themselves, level by level."""
        x, g = self.x, self.g
        at = np.full((len(new), 1), self.entry, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            at, score = self.walk(x[new], at, level, g.upper if level else g.build)
            here = top[new] >= level
            who = new[here]
            if not len(who):
                continue
            mates = x[who] @ x[who].T
            np.fill_diagonal(mates, -np.inf)
            near = np.concatenate([at[here], np.broadcast_to(who, mates.shape)], 1)
            near, sim = descending(near, np.concatenate([score[here], mates], 1), g.near)
            near = np.where(sim > -np.inf, near, -1)
            self.link(level, who, near, chosen(x, near, sim, g.degree // 2))

    def link(self, level: int, who: np.ndarray, near: np.ndarray, take: np.ndarray) -> None:
        """Links of new nodes and the way back; a node with too many chooses anew among all it has."""
        x, m = self.x, self.g.degree
        row, links = self.levels[level]
        r, c = np.nonzero(take)
        links[row[who[r]], np.cumsum(take, 1)[r, c] - 1] = near[r, c]
        src, dst = who[r], near[r, c]
        back = ~(links[row[dst]] == src[:, None]).any(1)
        src, dst = src[back], dst[back]
        order = np.lexsort((-np.einsum("ad,ad->a", x[src], x[dst]), dst))
        src, dst = src[order], dst[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst, "left")
        ok = place < m  # of more the nearest
        popular, at = np.unique(dst[ok], return_inverse=True)
        came = np.full((len(popular), m), -1, np.int64)
        came[at, place[ok]] = src[ok]
        for lo in range(0, len(popular), 1024):
            own = popular[lo : lo + 1024]
            every = np.concatenate([links[row[own]], came[lo : lo + 1024]], 1)
            every, sim = descending(every, similarities(x, own, every), 2 * m)
            crowded = (every[:, m:] >= 0).any(1)
            keep = np.arange(2 * m) < np.where(crowded, 0, m)[:, None]
            keep[crowded] = chosen(x, every[crowded], sim[crowded], m)
            first = np.argsort(~keep, axis=1, kind="stable")[:, :m]
            links[row[own]] = np.take_along_axis(every, first, 1)

    def search(self, q: np.ndarray, k: int) -> np.ndarray:
        """Numbers of about the k nearest nodes for each of the unit vectors q, nearest first, -1 for none."""
        at = np.full((len(q), 1), self.entry, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            at, _ = self.walk(q, at, level, self.g.upper)
        at, score = self.walk(q, at, 0, max(self.g.beam, k))
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(at, order, 1)

    def walk(self, q: np.ndarray, entries: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beams (node numbers, -1 for none, and similarities) in which walks over a level end that start from `entries`."""
        n, (row, links) = len(q), self.levels[level]
        found = np.full((n, beam), -1, np.int64)
        score = np.full((n, beam), -np.inf, np.float32)
        seen = np.zeros((n, len(links)), bool)
        a, b = np.nonzero(entries >= 0)
        found[a, b] = entries[a, b]
        score[a, b] = np.einsum("ad,ad->a", q[a], self.x[entries[a, b]])
        seen[a, row[entries[a, b]]] = True
        open_ = found >= 0
        live = np.arange(n)
        while len(live):
            s = np.where(open_[live], score[live], -np.inf)
            j = s.argmax(1)
            going = s[np.arange(len(j)), j] > -np.inf
            live, j = live[going], j[going]
            if not len(live):
                break
            node = found[live, j]
            open_[live, j] = False
            near = links[row[node]]
            place = row[np.maximum(near, 0)]
            fresh = (near >= 0) & ~seen[live[:, None], place]
            a, b = np.nonzero(fresh)
            seen[live[a], place[a, b]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[a, b] = np.einsum("ad,ad->a", q[live[a]], self.x[near[a, b]])
            every = np.concatenate([score[live], s], 1)
            who = np.concatenate([found[live], near], 1)
            op = np.concatenate([open_[live], fresh], 1)
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            score[live] = np.take_along_axis(every, best, 1)
            found[live] = np.take_along_axis(who, best, 1)
            open_[live] = np.take_along_axis(op, best, 1)
        return np.where(score > -np.inf, found, -1), score


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v: array<double>) whose vector can take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine).filter(F.size("v") > 0)


def directions(rows: DataFrame, most: int) -> DataFrame:
    """The `most` smallest ids of each direction with their vectors: own, array of (id, v).

    Tasks keep so many rows of a direction before the shuffle (a window group limit), so one of very many ids costs a few rows a task.
    """
    fine = rows.withColumn("big", F.array_max(F.transform("v", F.abs)))
    fine = fine.withColumn("u", F.transform("v", lambda x: x / F.col("big")))
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    fine = fine.withColumn("length", length).withColumn("u", F.transform("u", lambda x: (x / F.col("length") + F.lit(0.0)).cast("float")))
    order = Window.partitionBy("u").orderBy("id", "v")
    few = fine.dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return few.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("own")).select("own")


def search(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", g: Graph = Graph()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `df` found for each row of `queries` (both key, vector), itself left out."""
    nodes = frames.kept(directions(usable(df, key, vector), max(g.same, k + 1)), "vectors")
    shards = max(1, round(nodes.count() / g.shard))
    asked = usable(queries, key, vector).dropDuplicates(["id", "v"])
    own = "array<struct<id:bigint,v:array<double>>>"
    dealt = nodes.select(F.pmod(F.xxhash64("own", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("side"), F.col("own").cast(own))
    each = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), F.array(F.struct("id", "v")).cast(own).alias("own"))
    # by range, so that no two shards share a task
    both = dealt.unionByName(each).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "side", "own")

    def f(batches):
        shard, held, index = None, [], {}
        kind = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

        def build():
            by_dim: dict[int, list] = {}
            for members in held:
                by_dim.setdefault(len(members[0][1]), []).append(members)
            out = {}
            for dim, nodes in by_dim.items():
                x = np.array([v for members in nodes for _, v in members])
                size = norms(x)
                at = np.concatenate([[0], np.cumsum([len(members) for members in nodes])])
                first = x[at[:-1]] / size[at[:-1], None]
                out[dim] = (x, size, np.array([i for members in nodes for i, _ in members]), at, first, Index(first.astype(np.float32), g))
            return out

        def answer(ids: list[int], q: list[np.ndarray]):
            rows: dict[str, list] = {c: [] for c in kind}
            for dim in {len(v) for v in q}:
                who = [i for i, v in enumerate(q) if len(v) == dim]
                if dim not in index:
                    continue
                x, length, names, at, first, graph = index[dim]
                y = np.array([q[i] for i in who])
                size = norms(y)
                unit = y / size[:, None]
                got = graph.search(unit.astype(np.float32), max(g.beam, k + 1))
                score = np.where(got >= 0, np.einsum("ad,akd->ak", unit, first[np.maximum(got, 0)]), -np.inf)
                for r, i in enumerate(who):
                    least = np.sort(score[r])[-(k + 1) :][0]
                    near = got[r][(got[r] >= 0) & (score[r] >= least - 1e-6)]
                    hits = [
                        (float(np.dot(y[r], x[m]) / (size[r] * length[m])), int(names[m]))
                        for node in near for m in range(at[node], at[node + 1]) if names[m] != ids[i]
                    ]
                    for s, other in sorted(hits, key=lambda h: (-h[0], h[1]))[:k]:
                        for c, value in zip(kind, (ids[i], other, s)):
                            rows[c].append(value)
            return frames.batch(kind, **rows)

        def members(column, i):
            one = column[i].values
            v = one.field(1)
            return [(d, np.asarray(v[j].values, np.float64)) for j, d in enumerate(one.field(0).to_pylist())]

        for part in batches:
            for lo in range(0, len(part), 256):
                block = part.slice(lo, 256)
                at, sides = block.column(0).to_numpy(), block.column(1).to_numpy()
                pending_ids, pending = [], []
                for i in range(len(block)):
                    if at[i] != shard:
                        if pending:
                            yield answer(pending_ids, pending)
                            pending_ids, pending = [], []
                        shard, held, index = at[i], [], None
                    of = members(block.column(2), i)
                    if sides[i] == 0:
                        held.append(of)
                    else:
                        if index is None:
                            index = build()
                            held = []
                        pending_ids.append(of[0][0])
                        pending.append(of[0][1])
                if pending:
                    yield answer(pending_ids, pending)

    hits = frames.map_arrow(both.select("shard", "side", "own"), f, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows; large and small components neither overflow nor vanish."""
    big = np.abs(x).max(1, initial=0)
    big[big == 0] = 1
    return np.sqrt(((x / big[:, None]) ** 2).sum(1)) * big
