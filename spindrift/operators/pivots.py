"""Exact neighbours where both tables are large: cells around pivots, and bounds that say which cells a query can leave out.

Rows go to the cell of their nearest pivot. A query first meets its home cell, which bounds the distance of
its k-th neighbour; then it visits only cells that the triangle inequality doesn't rule out: by the ring that
a cell's rows lie in, and by the plane between its pivot and the query's nearest one. Cells lie in groups of about BLOCK rows or
more; a query goes once to a group, with the cells that it visits there. Groups are compared in tiles of about
BLOCK queries and BLOCK rows, so a cell with a third of all rows is many tasks, and no task holds a cell. Neither
table is broadcast; only pivots, and a few numbers for each, go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spindrift.functions import vectors as V
from spindrift.operators import ivf
from spindrift.operators.knn import Nearest, ranked, sized
from spindrift.sources import scratch

#: Queries, and rows, of a tile; pivots.
BLOCK, PIVOTS = 16_384, 256
#: Share of squared lengths by which bounds give way, for what floats lose.
SLACK = 1e-10


@dataclass
class Joined:
    """``hits``: qid, key, distance, rank. ``work``: one row with pairs (all of queries and rows) and compared (those in tiles)."""

    hits: DataFrame
    work: DataFrame


@dataclass(frozen=True)
class _Space:
    """Where order by the metric is order by L2: vectors of length one under cosine; one component more under inner product.

    ``longest``: the length of the longest row."""

    metric: str
    longest: float

    def points(self, vectors: pa.Array, rows: bool) -> np.ndarray:
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)
        if self.metric == "cosine":
            return x / np.linalg.norm(x, axis=1, keepdims=True)
        return self.lifted(x, rows) if self.metric == "inner_product" else x

    def lifted(self, x: np.ndarray, rows: bool) -> np.ndarray:
        more = np.sqrt(np.maximum(0, self.longest**2 - (x**2).sum(1))) if rows else np.zeros(len(x))
        return np.hstack([x, more[:, None]])

    def reach(self, q: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """How far from each point a row can be whose distance is ``edge`` at most."""
        own = (q**2).sum(1)
        most = 1.0 if self.metric == "cosine" else self.longest**2
        squared = {"cosine": 2 * edge, "l2": edge**2, "inner_product": own + most + 2 * edge}[self.metric]
        return np.sqrt(np.maximum(0, squared) + SLACK * (own + most))


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T)))


def _usable(df: DataFrame, name: str, dims: int, metric: str) -> DataFrame:
    """name, vector: rows that can have a distance."""
    own = df.select(name, "vector").where(F.col("vector").isNotNull() & (F.size("vector") == dims))
    length = V.norm("vector")
    return own.where(F.coalesce(~F.isnan(length) & (length < float("inf")), F.lit(False)) & ((length > 0) if metric == "cosine" else F.lit(True)))


def _placed(rows: DataFrame, pivots: np.ndarray, space: _Space) -> DataFrame:
    """key, vector, cell, away (from the cell's pivot)."""
    kind, vector = to_arrow_type(rows.schema["key"].dataType), rows.schema["vector"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _apart(space.points(b["vector"], True), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b["key"].cast(kind), b["vector"], pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["key", "vector", "cell", "away"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, vector {vector.simpleString()}, cell int, away double")


def _visits(queries: DataFrame, pivots: np.ndarray, space: _Space, cells: dict[int, tuple], k: int, first: bool) -> DataFrame:
    """qid, vector, edge, cells: the home cell alone (``first``), or the others that may hold one of the k nearest, from queries with ``edge`` (null: not bounded yet)."""
    qid, vector = queries.schema["qid"].dataType.simpleString(), queries.schema["vector"].dataType.simpleString()
    some = np.array(sorted(cells))
    n, low, high = (np.array([cells[c][i] for c in some], np.float64) for i in range(3))
    full = n > k  # with the query itself left out, k remain
    between = _apart(pivots[some], pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = space.points(b["vector"], False)
            every = _apart(x, pivots)
            d = every[:, some]
            home = np.where(full, d, np.inf).argmin(1) if full.any() else d.argmin(1)
            edges = pa.nulls(b.num_rows, pa.float64()) if first else b["edge"]
            if first:
                found = [[int(some[h])] for h in home]
            else:
                nearest = every.argmin(1)
                own = every[np.arange(len(x)), nearest]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.nan_to_num((d**2 - own[:, None] ** 2) / (2 * between[:, nearest].T), nan=0.0, posinf=0.0, neginf=0.0)
                least = np.maximum(np.maximum(d - high, low - d), plane)
                edge = np.asarray(b["edge"].to_numpy(zero_copy_only=False), np.float64)
                reach = np.where(np.isnan(edge), np.inf, space.reach(x, np.nan_to_num(edge)))
                may = least <= (reach + 1e-5 * np.sqrt(SLACK) * (1 + reach))[:, None]
                may[np.arange(len(x)), home] = False
                found = [some[np.flatnonzero(m)].tolist() for m in may]
            yield pa.RecordBatch.from_arrays([b["qid"], b["vector"], edges, pa.array(found, pa.list_(pa.int32()))], ["qid", "vector", "edge", "cells"])

    return queries.mapInArrow(run, f"qid {qid}, vector {vector}, edge double, cells array<int>")


def _groups(cells: dict[int, tuple]) -> list[int]:
    """The group of each cell: cells in their order, a group with BLOCK rows is full."""
    out, group, n = [0] * (max(cells, default=0) + 1), 0, 0
    for c in sorted(cells):
        if n >= BLOCK:
            group, n = group + 1, 0
        out[c] = group
        n += cells[c][0]
    return out


def _tiles(asked: DataFrame, placed: DataFrame, cells: dict[int, tuple], k: int, metric: str, exclude_self: bool) -> DataFrame:
    """qid, key, distance: of each tile the k nearest of every query."""
    qid, key = asked.schema["qid"].dataType, placed.schema["key"].dataType
    schema = pa.schema([("qid", to_arrow_type(qid)), ("key", to_arrow_type(key)), ("distance", pa.float64())])
    parts = lambda n: F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n)
    numbers = F.array(*map(F.lit, _groups(cells)))
    group = lambda c: F.get(numbers, c)
    visits = asked.select("qid", "vector", "edge", "cells", F.explode(F.array_distinct(F.transform("cells", group))).alias("group"))
    rows = placed.withColumn("group", group(F.col("cell")))
    sizes = F.broadcast(visits.groupBy("group").agg(parts("na")).join(rows.groupBy("group").agg(parts("nb")), "group"))  # a row for each pivot at most
    tiles = sizes.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 1
    spread = min(2 * tiles, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # stated, as small inputs of much work would be put together
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = F.filter("cells", lambda c: group(c) == F.col("group"))
    left = visits.join(sizes, "group").select("group", dealt("qid", "na").alias("a"), each("nb").alias("b"), "qid", "vector", "edge", here.alias("cells"))
    right = rows.join(sizes, "group").select("group", each("na").alias("a"), dealt("key", "nb").alias("b"), "key", "vector", "cell")

    def tile(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return schema.empty_table()
        ((qids, x),), ((keys, y),) = (sized(t[c].combine_chunks(), t["vector"].combine_chunks()) for t, c in ((q, "qid"), (d, "key")))
        found = Nearest(qids, x, k, metric, exclude_self, np.asarray(q["edge"].to_numpy(), np.float64))
        visited = q["cells"].combine_chunks()
        at, to = np.asarray(pa.compute.list_parent_indices(visited)), np.asarray(visited.flatten())
        order, cell = np.argsort(to, kind="stable"), d["cell"].to_numpy()
        at, to = at[order], to[order]
        for c in np.unique(cell).tolist():
            some = cell == c
            found.add(keys[some], y[some], at[np.searchsorted(to, c) : np.searchsorted(to, c, "right")])
        return pa.Table.from_batches([found.batch(schema)])

    by = ["group", "a", "b"]
    left, right = left.repartition(spread, *by), right.repartition(spread, *by)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, f"qid {qid.simpleString()}, key {key.simpleString()}, distance double")


def knn_pivots(queries: DataFrame, rows: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False, pivots: int = PIVOTS) -> Joined:
    """knn() of two large tables, queries (qid, vector) and rows (key, vector): the same hits, exact at every number of pivots.

    Null vectors, ones that aren't finite, other sizes, and zero vectors under cosine give no hit. Equal distances go to the smaller key. A repeated
    qid is one query with the vectors of all its rows. Without bounds that help (vectors spread evenly in many dimensions) every pair is compared."""
    if metric not in ("cosine", "l2", "inner_product"):
        raise ValueError(metric)
    spark, hits, work = queries.sparkSession, [], []
    for dims in sorted(r[0] for r in queries.select(F.size("vector")).where("vector is not null").distinct().collect()):  # a number for each size of vectors
        own, asked = _usable(rows, "key", dims, metric), _usable(queries, "qid", dims, metric)
        space = _Space(metric, own.agg(F.max(V.norm("vector"))).first()[0] or 0.0)
        centres = ivf.train(own, pivots, "cosine" if metric == "cosine" else "l2")
        if not len(centres) or not dims:
            continue
        centres = space.lifted(centres, True) if metric == "inner_product" else centres
        placed = scratch.kept(_placed(own, centres, space), "cells")
        cells = {r.cell: (r.n, r.low, r.high) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}  # a row for each pivot at most
        home = scratch.kept(_visits(asked, centres, space, cells, k, True), "home")
        near = scratch.kept(ranked(_tiles(home, placed, cells, k, metric, exclude_self), k).drop("rank"), "near")
        edge = near.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("distance")).alias("edge"))
        others = scratch.kept(_visits(home.select("qid", "vector").join(edge, "qid", "left"), centres, space, cells, k, False), "visits")
        hits += [near, _tiles(others, placed, cells, k, metric, exclude_self)]
        counts = placed.groupBy("cell").agg(F.count("*").alias("n"))
        met = home.unionByName(others).select(F.explode("cells").alias("cell")).join(F.broadcast(counts), "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
        work.append(home.agg((F.count("*") * F.lit(sum(c[0] for c in cells.values()))).alias("pairs")).crossJoin(met))  # one row each
    if not hits:
        q, d = queries.schema["qid"].dataType.simpleString(), rows.schema["key"].dataType.simpleString()
        return Joined(ranked(spark.createDataFrame([], f"qid {q}, key {d}, distance double"), k), spark.createDataFrame([(0, 0)], "pairs long, compared long"))
    out, done = hits[0], work[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    for w in work[1:]:
        done = done.unionByName(w)
    return Joined(ranked(out, k), done.agg(F.sum("pairs").alias("pairs"), F.sum("compared").alias("compared")))
