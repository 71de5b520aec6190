"""Agglomerative clustering of a recording's vectors: average linkage on cosine distance.

Groups are recordings; each group is clustered by NumPy in one task.  The mean distance between two clusters is one minus
the product of their mean vectors, so memory is the vectors and a few tiles, never the square of a recording's rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from parlance.session import ship

ROWS, COLUMNS = 512, 8192  # of a tile of similarities
SAME = 1e-6  # equal vectors at less than this distance are one node from the start


def average_linkage(x: np.ndarray, clusters: int | None = None, threshold: float | None = 0.7, whiten: bool = False, eps: float = 1e-8) -> np.ndarray:
    """Labels of the rows of x: merges the nearest two clusters (mean distance of their members) until `clusters` are left,
    or the nearest are at `threshold` or beyond.  Rows that aren't finite stay alone, unless `clusters` asks for fewer.

    A merged cluster is never nearer to a third one than the nearer of its parts.  So clusters that are each other's
    nearest may merge at once, in any order, and one whose nearest is beyond the threshold is finished.
    """
    n = len(x)
    if n < 2:
        return np.zeros(n, np.int64)
    x = x.astype(np.float64)
    if whiten:
        x = x - x.mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + eps
    own = np.einsum("ij,ij->i", x, x)
    tree = Tree(n)
    rows = tree.copies(x, 1.0 - own, SAME if clusters is not None else min(SAME, threshold))
    tree.grow(x if len(rows) == n else x[rows], rows, -np.inf if clusters is not None else 1.0 - threshold)
    if clusters is None:
        return tree.labels()
    tree.join_rest(np.flatnonzero(~np.isfinite(own)))
    return tree.labels(clusters or 1)


class Tree:
    """Merges of clusters, each known by its first row, and the distances at which they happened."""

    def __init__(self, n: int):
        self.n, self.size, self.high = n, np.ones(n), np.full(n, -np.inf)
        self.into, self.gone, self.at = [], [], []

    def add(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        """Clusters b go into a (a < b, none twice); a distance counts as that of its parts at least, whatever rounding does."""
        self.high[a] = np.maximum(np.maximum(self.high[a], self.high[b]), distance)
        self.size[a] += self.size[b]
        self.into.append(a)
        self.gone.append(b)
        self.at.append(self.high[a])

    def copies(self, x: np.ndarray, apart: np.ndarray, least: float) -> np.ndarray:
        """The finite rows, without those equal to an earlier one, which merge with it first; `apart` is the distance of a row's
        copies, which has to be below `least`."""
        finite = np.isfinite(apart)
        bits = (x + 0.0).view(np.uint64)
        digest = bits @ (np.random.default_rng(0).integers(0, 2**63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        del bits
        _, lead, which = np.unique(digest, return_index=True, return_inverse=True)
        lead = lead[which]
        again = np.flatnonzero((apart < least) & (lead != np.arange(self.n)))
        again = np.concatenate([b[(x[b] == x[lead[b]]).all(1)] for b in np.split(again, range(COLUMNS, len(again), COLUMNS))])
        again = again[np.argsort(lead[again], kind="stable")]
        self.into.append(lead[again])
        self.gone.append(again)
        self.at.append(apart[lead[again]])
        self.size += np.bincount(lead[again], minlength=self.n)
        left = finite.copy()
        left[again] = False
        return np.flatnonzero(left)

    def grow(self, mean: np.ndarray, name: np.ndarray, least: float) -> None:
        """Merges while any similarity is beyond `least`.  Rounds of mutual nearest clusters, then chains of nearest ones if too few
        of those looked at merge: the work grows with the square of the rows and never faster."""
        m = len(name)
        near, best = np.zeros(m, np.int64), np.zeros(m)
        stale, looks = np.arange(m), 4 * m
        while len(name) > 1:
            near[stale], best[stale] = nearest(mean, stale)
            going = best > least
            a = np.flatnonzero(going & (near[near] == np.arange(len(name))) & (near > np.arange(len(name))))
            looks += 16 * len(a) - max(len(stale), 64)
            if looks < 0 or (going.any() and not len(a)):
                return self.chains(mean[going], name[going], least)
            b = near[a]
            mean[a] = self.joined(name[a], name[b], mean[a], mean[b], best[a])
            moved = np.zeros(len(name), bool)
            moved[a] = moved[b] = True
            keep = going.copy()
            keep[b] = False
            stale = moved | moved[near]
            place = np.cumsum(keep) - 1
            mean, name, best, stale = mean[keep], name[keep], best[keep], np.flatnonzero(stale[keep])
            near = place[near[keep]]

    def joined(self, a, b, x, y, similarity):
        """The mean vectors of clusters a and b, merged."""
        p, q = self.size[a][..., None], self.size[b][..., None]
        out = (x * p + y * q) / (p + q)
        self.add(a, b, 1.0 - similarity)
        return out

    def chains(self, mean: np.ndarray, name: np.ndarray, least: float) -> None:
        """Each chain goes from a cluster to its nearest, and so on, until two are each other's nearest; they merge, and it goes on
        from before them.  At most three looks at all clusters for each one."""
        alive, left = np.ones(len(name), bool), len(name)
        chain, up = [], []  # up: similarity of each link and the one before it
        while left > 1:
            if not chain:
                if 2 * left < len(name):
                    mean, name = mean[alive], name[alive]
                    alive = np.ones(left, bool)
                chain, up = [int(alive.argmax())], [-np.inf]
            top = chain[-1]
            s = mean @ mean[top]
            s[~alive] = -np.inf
            s[top] = -np.inf
            j = int(s.argmax())
            if max(s[j], up[-1]) <= least:  # finished
                alive[top] = False
                left -= 1
                chain, up = [], []
            elif s[j] > up[-1] and j not in chain:  # one that is there already is as near as the one before, but for rounding
                chain.append(j)
                up.append(float(s[j]))
            else:
                a, b = sorted((chain[-2], top))
                mean[a] = self.joined(name[[a]], name[[b]], mean[[a]], mean[[b]], np.array([up[-1]]))[0]
                alive[b] = False
                left -= 1
                del chain[-2:], up[-2:]

    def join_rest(self, rows: np.ndarray) -> None:
        """Rows without a distance merge last, in order, with the first row."""
        for b in rows[rows > 0]:
            self.add(np.array([0]), np.array([b]), np.array([np.inf]))

    def labels(self, clusters: int | None = None) -> np.ndarray:
        """Numbers of the clusters by first appearance: after all merges, or the nearest ones until so many are left."""
        root = np.arange(self.n)
        into, gone, at = (np.concatenate(c) for c in (self.into, self.gone, self.at))
        done = np.arange(len(at)) if clusters is None else np.argsort(at, kind="stable")[: max(self.n - clusters, 0)]
        root[gone[done]] = into[done]
        while (root[root] != root).any():
            root = root[root]
        return np.unique(root, return_inverse=True)[1]


def nearest(mean: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most similar other cluster of each of `rows` (the first of equal ones), and the similarity."""
    near, best = np.zeros(len(rows), np.int64), np.full(len(rows), -np.inf)
    tile = np.empty((ROWS, COLUMNS))
    for at in range(0, len(rows), ROWS):
        r = rows[at : at + ROWS]
        q, k = mean[r], np.arange(len(r))
        for left in range(0, len(mean), COLUMNS):
            c = mean[left : left + COLUMNS]
            s = tile.reshape(-1)[: len(r) * len(c)].reshape(len(r), len(c))
            np.matmul(q, c.T, out=s)
            own = (r >= left) & (r < left + len(c))
            s[k[own], r[own] - left] = -np.inf
            j = s.argmax(1)
            v = s[k, j]
            more = np.flatnonzero(v > best[at : at + len(r)])
            near[at + more], best[at + more] = left + j[more], v[more]
    return near, best


def cluster(rows: DataFrame, key: str = "rec_id", order: str = "seq", vector: str = "embedding", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """rec_id, seq, label of every row, and the columns `keep`, which break ties of seq."""
    ship(rows.sparkSession)

    def f(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in (order, *keep)])).combine_chunks()
        label = average_linkage(matrix(t.column(vector)), **options)
        return t.select([key, order, *keep]).append_column("label", pa.array(label, pa.int64()))

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, order, *keep))
    return rows.select(key, order, *keep, vector).groupBy(key).applyInArrow(f, f"{schema}, label long")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as the rows of a matrix in double precision; they have to have one length."""
    size = pc.list_value_length(column).unique()
    if len(size) > 1 or size.null_count:
        raise ValueError(f"vectors have to have one length, not {size.to_pylist()[:5]}")
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (flat[0] if len(flat) == 1 else np.concatenate(flat)).reshape(len(column), -1)


def cluster_similar(rows: DataFrame, similarity: float = 0.55, **options) -> DataFrame:
    """As cluster, with a threshold on similarity instead of distance."""
    return cluster(rows, threshold=1 - similarity, **options)
