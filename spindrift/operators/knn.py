"""Exact and approximate nearest-neighbour joins.

The expression kernel declares the join and lets Spark prune each partition to the k best before it
shuffles (WindowGroupLimit). The block kernel multiplies matrices in Arrow batches and keeps the k best of
each partition, then merges. Of the two sides the one that is stated to be small is broadcast, in blocks of
at most BROADCAST_COMPONENTS numbers by a count, so no row of the other is shuffled by the size of its vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from spindrift.functions import vectors as V

#: Queries beyond so many components together are not sent to every task at once.
BROADCAST_COMPONENTS = 8_000_000
#: Distances that a task holds at once; pairs whose distance it adds up at once.
TILE, PAIRS = 4_000_000, 1_000_000


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance", "key")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks(side: DataFrame, key: str, vector: str, most: int) -> list[DataFrame]:
    """``side`` in blocks by hash of about ``most`` components at most."""
    size = side.select(F.sum(F.size(vector)).alias("n")).first()["n"] or 0
    n = max(1, -(-size // most))
    return [side] if n == 1 else [side.where(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]


def knn(queries: DataFrame, rows: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False, small: str = "queries", most: int = BROADCAST_COMPONENTS) -> DataFrame:
    """qid, key, distance, rank from queries (qid, vector) and rows (key, vector), ordered by (distance, key).

    ``small``: the side that is broadcast, block by block, queries or rows. Null vectors and pairs without a distance (other sizes, zero vectors under cosine) give no hit."""
    q = queries.select("qid", F.col("vector").alias("qv")).where("qv is not null")
    d = rows.select("key", F.col("vector").alias("dv")).where("dv is not null")
    if metric == "cosine":  # lengths once a row, not once a pair
        q = q.withColumn("qn", V.norm("qv"))
        d = d.withColumn("dn", V.norm("dv"))
        dist = F.lit(1.0) - F.try_divide(V.dot("qv", "dv"), F.col("qn") * F.col("dn"))
    else:
        dist = V.distance("qv", "dv", metric)
    near = (F.size("qv") == F.size("dv")) & (F.col("qid") != F.col("key")) if exclude_self else F.size("qv") == F.size("dv")
    out = None
    for block in blocks(q, "qid", "qv", most) if small == "queries" else blocks(d, "key", "dv", most):
        pairs = d.join(F.broadcast(block), near) if small == "queries" else q.join(F.broadcast(block), near)
        hits = pairs.select("qid", "key", dist.alias("distance")).where("distance is not null")
        out = hits if out is None else out.unionByName(hits)
    return ranked(out, k)


def knn_block(queries: DataFrame, rows: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False, most: int = BROADCAST_COMPONENTS) -> DataFrame:
    """The same hits by matrix products, for many queries: distances of the candidates are then added up as knn() does, so ties are the same.

    The stated query set goes to the tasks in blocks of at most ``most`` components."""
    out = None
    for part in blocks(queries, "qid", "vector", most):
        held = part.where("vector is not null").select("qid", "vector").toArrow()  # at most about ``most`` components
        hits = _block(held, queries.schema["qid"].dataType, rows, k, metric, exclude_self)
        out = hits if out is None else out.unionByName(hits)
    return ranked(out, k)


def values(column: pa.Array) -> np.ndarray:
    """Keys as numpy has them: whole numbers, or objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def sized(keys: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, matrix of the vectors) for each size of vectors; null ones, and ones with a null component, have no distance."""
    size = np.nan_to_num(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(int)
    for n in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == n)
        own = vectors.take(pa.array(at)).flatten()
        if own.null_count:
            whole = ~np.asarray(own.is_null()).reshape(len(at), n).any(1)
            at = at[whole]
            own = vectors.take(pa.array(at)).flatten()
        yield values(keys.take(pa.array(at))), np.asarray(own.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), n)


def _places(keys: np.ndarray) -> np.ndarray:
    """Numbers in the order of the keys; null is first."""
    if keys.dtype != object:
        return keys
    place = {x: i for i, x in enumerate(sorted({x for x in keys if x is not None}))}
    return np.array([place.get(x, -1) for x in keys], np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Lengths by sums in the order of the components, as a loop has them."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total += x[:, c] * x[:, c]
    return np.sqrt(total)


class Nearest:
    """The ``k`` nearest rows of each of some queries, by (distance, key), from rows that come in tiles.

    Products in single precision say which rows may be among them, by an edge that gives way for what these lose; of those the distance is
    added up in double precision, component by component, as the expression kernel and SQL do it. So equal vectors are at equal
    distances wherever they stand. NaN is farther than all numbers; what has no distance is no hit."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, metric: str, exclude_self: bool, edge: np.ndarray | None = None):
        """``edge``: what a row's distance may be at most, where that is known."""
        if metric not in ("cosine", "l2", "inner_product"):
            raise ValueError(metric)
        self.qids, self.q, self.k, self.metric, self.exclude_self = qids, q, k, metric, exclude_self
        with np.errstate(all="ignore"):
            self.length = _lengths(q)
        self.count, self.distance = np.zeros(len(q), int), np.zeros((len(q), k))
        self.keys = np.zeros((len(q), k), np.int64)
        self.edge = np.full(len(q), np.inf) if edge is None else np.where(np.isnan(edge), np.inf, edge)
        self.odd = ~np.isfinite(self.length)
        self.slack = 8 * (q.shape[1] + 8) * np.finfo(np.float32).eps
        unit = q / np.where(self.odd | (self.length == 0), 1, self.length)[:, None]
        self.unit = np.where(self.odd[:, None], 0, unit).astype(np.float32)
        self.columns = np.ascontiguousarray(q.T)

    def add(self, keys: np.ndarray, d: np.ndarray, which: np.ndarray | None = None) -> None:
        """Rows of the queries' size that meet the queries at the places ``which`` (all)."""
        which = np.arange(len(self.q)) if which is None else which
        with np.errstate(all="ignore"):
            length = _lengths(d)
            if not len(which) or not len(keys):
                return
            some = self._few_copies(keys, d)
            keys, d, length = keys[some], d[some], length[some]
            odd = ~np.isfinite(length)
            scale = np.max(length[~odd], initial=0.0) or 1.0
            by = np.where(odd | (length == 0), 1, length)[:, None] if self.metric == "cosine" else scale
            unit, columns = np.where(odd[:, None], 0, d / by).astype(np.float32), np.ascontiguousarray(d.T)
            own: dict = {}
            if self.exclude_self:
                for j, key in enumerate(keys.tolist()):
                    own.setdefault(key, []).append(j)
            step = max(1, TILE // len(keys))
            for s in range(0, len(which), step):
                w = which[s : s + step]
                i, j = self._candidates(w, unit, length, odd, scale, own)
                for n in range(0, len(i), PAIRS):
                    self._kept(w, i[n : n + PAIRS], j[n : n + PAIRS], keys, columns, length)

    def _few_copies(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Places of rows; of equal vectors no more than can be among the nearest, by key."""
        n = self.k
        if self.exclude_self and len(keys):
            n += int(np.unique(_places(keys), return_counts=True)[1].max())
        if len(keys) <= n or not d.shape[1]:
            return np.arange(len(keys))
        same = np.unique(np.ascontiguousarray(d).view(np.dtype((np.void, d.dtype.itemsize * d.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        if same.max() + 1 == len(keys):
            return np.arange(len(keys))
        order = np.lexsort((_places(keys), same))
        nth = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        return np.sort(order[nth < n])

    def _candidates(self, w: np.ndarray, unit: np.ndarray, lengths: np.ndarray, odd: np.ndarray, scale: float, own: dict) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``w`` and of rows that may be among the nearest."""
        length, edge = self.length[w], self.edge[w]
        s = self.unit[w] @ unit.T
        np.negative(s, out=s)
        if self.metric == "cosine":
            bound, slack = edge - 1, np.full(len(w), self.slack)
        elif self.metric == "inner_product":
            bound, slack = edge / (length * scale), np.full(len(w), self.slack)
        else:  # squared distance less the query's own square, over 2 |q| |longest row|
            ratio = np.where(length > 0, scale / np.where(length > 0, length, 1), 1.0)
            square = (unit.astype(np.float64) ** 2).sum(1)
            if (length > 0).all() and np.isfinite(ratio).all() and ratio.max() < 1e6:
                s += (ratio[:, None] / 2).astype(np.float32) * square.astype(np.float32)
                bound, slack = (edge**2 - length**2) / (2 * length * scale), self.slack * (1 + ratio + length / scale)
            else:  # lengths of no common scale: by double precision
                s = square - 2 * (np.where(self.odd[w][:, None], 0, self.q[w] / scale) @ unit.astype(np.float64).T)
                bound, slack = (edge / scale) ** 2 - (length / scale) ** 2, self.slack * (1 + (length / scale) ** 2)
        apart = odd | (lengths == 0) if self.metric == "cosine" else odd
        if apart.any():
            s[:, apart] = np.inf
        for i, qid in enumerate(self.qids[w].tolist()) if own else ():
            if qid in own:
                s[i, own[qid]] = np.inf
        bound = np.where(np.isnan(bound) | self.odd[w], np.inf, bound + slack)
        may = s <= bound[:, None].astype(s.dtype) if s.dtype == np.float64 else s <= np.nextafter(bound.astype(np.float32), np.float32(np.inf))[:, None]
        many = np.flatnonzero(np.count_nonzero(may, axis=1) > 4 * self.k)
        if len(many) and s.shape[1] > self.k:
            kth = np.partition(s[many], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64) + slack[many]
            may[many] = s[many] <= np.where(np.isnan(kth), np.inf, np.minimum(kth, bound[many]))[:, None]
        if self.metric == "cosine":  # a zero vector has a distance from vectors that aren't finite only
            may[length == 0] = False
            may[:, apart] = False
        may[self.odd[w]] = True
        if odd.any():
            may[:, odd] = True
        for i, qid in enumerate(self.qids[w].tolist()) if own else ():
            if qid in own:
                may[i, own[qid]] = False
        return np.nonzero(may)

    def _kept(self, w: np.ndarray, i: np.ndarray, j: np.ndarray, keys: np.ndarray, columns: np.ndarray, length: np.ndarray) -> None:
        a, total = w[i], np.zeros(len(i))
        for x, y in zip(self.columns, columns):
            if self.metric == "l2":
                gap = x[a] - y[j]
                total += gap * gap
            else:
                total += x[a] * y[j]
        if self.metric == "cosine":
            both = self.length[a] * length[j]
            distance = 1 - total / both
            ok = both != 0
            i, j, distance = i[ok], j[ok], distance[ok]
        else:
            distance = np.sqrt(total) if self.metric == "l2" else -total
        touched = np.unique(i)
        rows = w[touched]
        if keys.dtype != self.keys.dtype:
            self.keys, keys = self.keys.astype(object), keys.astype(object)
        held = np.arange(self.k) < self.count[rows][:, None]
        r = np.concatenate([np.nonzero(held)[0], np.searchsorted(touched, i)])
        d = np.concatenate([self.distance[rows][held], distance])
        key = np.concatenate([self.keys[rows][held], keys[j]])
        o = np.lexsort((_places(key), d, r))
        r = r[o]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        o, r, nth = o[nth < self.k], r[nth < self.k], nth[nth < self.k]
        self.distance[rows[r], nth], self.keys[rows[r], nth] = d[o], key[o]
        self.count[rows] = np.bincount(r, minlength=len(rows))
        full = rows[self.count[rows] == self.k]
        last = self.distance[full, self.k - 1]
        self.edge[full] = np.fmin(self.edge[full], np.where(np.isnan(last), np.inf, last))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        """qid, key, distance."""
        r, nth = np.nonzero(np.arange(self.k) < self.count[:, None])
        columns = self.qids[r].tolist(), self.keys[r, nth].tolist(), self.distance[r, nth]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def far(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of ``q`` to all of ``d``; not finite where there is none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "cosine":
            return 1 - (q @ d.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1))
        if metric == "inner_product":
            return -(q @ d.T)
        if metric == "l2":
            return np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (d**2).sum(1) - 2 * (q @ d.T)))
    raise ValueError(metric)


def _block(held: pa.Table, qid_type: DataType, rows: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = rows.schema["key"].dataType.simpleString()
    schema = pa.schema([("qid", to_arrow_type(qid_type)), ("key", to_arrow_type(rows.schema["key"].dataType)), ("distance", pa.float64())])
    own = {q.shape[1]: (qids, q) for qids, q in sized(held["qid"].combine_chunks(), held["vector"].combine_chunks())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: Nearest(qids, q, k, metric, exclude_self) for n, (qids, q) in own.items()}
        for b in batches:
            for keys, d in sized(b["key"], b["vector"]):
                if d.shape[1] in found:
                    found[d.shape[1]].add(keys, d)
        for each in found.values():
            yield each.batch(schema)

    return rows.select("key", "vector").mapInArrow(run, f"qid {qid_type.simpleString()}, key {key_type}, distance double")


def sweep(current: int, others: list[int], start: int = 0) -> list[int]:
    """Search settings to try, the current one among them, beginning elsewhere each time, so that none is always the first to find a cold cache."""
    every = sorted({current, *others})
    at = start % len(every)
    return every[at:] + every[:at]
