"""An approximate neighbour graph by NN-descent, and a beam search on it.

A graph starts from cells: rows of one cell, a bounded number, are compared with each other. Several draws of pivots make cells, and a
row lies in the cells of its two nearest pivots of each; a draw costs a tenth of what a round moves, and leaves few edges to be found.
Then neighbours of neighbours are tried, round by round: each row's neighbours, and the rows it is a neighbour of (the
nearest ``degree`` of these), meet and are compared among themselves, where one of the two is new since the last round; a pair
goes on only if it is nearer than what one of its ends has. It ends when few edges change. Vectors go only to where a row is new. A search
keeps the ``ef`` nearest rows found for each query, and looks at the neighbours of those whose neighbours
it hasn't seen, all queries at once in a round, until there are none.

Queries, the stated small side, go to the tasks in blocks, so a search moves numbers and no vectors of pairs.
Work a round is the rows times the square of the degree; nothing compares all pairs, and no hub's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spindrift.operators.knn import BROADCAST_COMPONENTS, _places, blocks, far, knn_block, sized, values
from spindrift.sources import scratch

#: Rows of a cell on average, of which twice as many are compared with each other at most; draws of pivots; pivots of a draw at most; cells of a row in a draw.
CELL, DRAWS, PIVOTS, NEAREST_CELLS = 4096, 8, 4096, 2
#: Rounds at most; share of edges that may change in the last round.
ROUNDS, SETTLED = 12, 0.002
#: Distances that a task holds at once.
TILE = 1_000_000
#: Rows that searches start from; rounds of a search at most.
ENTRIES, SEARCH_ROUNDS = 64, 40


def _numbers(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)


def _segments(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of ``column``, which arrives sorted; a value's rows are bounded in number."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        values = b[column]
        edges = np.flatnonzero(np.asarray(pa.compute.not_equal(values.slice(1), values.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False), bool)) + 1
        starts = [0, *edges.tolist(), b.num_rows]
        if held and held[-1][column][0] != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(starts, starts[1:]):
            held.append(b.slice(i, j - i))
            if j < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """Of each row a number that k of its numbers don't exceed, the k-th or little more."""
    part = d.shape[1] // 16
    if part >= 4 * k:  # the least of each sixteen
        d = d[:, : 16 * part].reshape(len(d), 16, part).min(1)
    return np.partition(d, k - 1, axis=1)[:, k - 1]


def _edges(keys: np.ndarray, x: np.ndarray, degree: int, metric: str, worst: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, distance) as places: of each row the ``degree`` nearest others that are not farther than its worst, where one of the two is new; ties go to the smaller key."""
    n, k = len(keys), min(degree, len(keys) - 1)
    none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    if k < 1:
        return none
    place = _places(keys)
    order = np.argsort(place, kind="stable")
    place, x, worst, new = place[order], x[order], worst[order], new[order]
    out, step, once = [none], max(1, TILE // n), n == len(np.unique(place))
    for s in range(0, n, step):
        own = slice(s, s + step)
        d = far(x[own], x, metric)
        if not np.isfinite(d).all():
            d[~np.isfinite(d)] = np.inf
        if once:
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        else:
            d[place[own, None] == place] = np.inf
        if not new.all():
            d[~(new[own, None] | new)] = np.inf
        r, c = np.nonzero(d <= np.minimum(_kth(d, k), worst[own])[:, None])  # ties may go to a smaller key
        found = d[r, c]
        r, c, found = r[np.isfinite(found)], c[np.isfinite(found)], found[np.isfinite(found)]
        nearest = np.lexsort((c, found, r))
        r, c, found = r[nearest], c[nearest], found[nearest]
        few = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((order[r[few] + s], order[c[few]], found[few]))
    return tuple(np.concatenate(column) for column in zip(*out))


def _nearest(edges: DataFrame, degree: int, few: bool = False) -> DataFrame:
    """Of each key the ``degree`` nearest, each other key once. Each task drops what can't be among them before the shuffle.

    ``few``: no key has many edges, so all of a key's go to one task, and only once."""
    edges = edges.repartition("key") if few else edges
    once = edges.groupBy("key", "other").agg(F.min("distance").alias("distance"), F.bool_and("new").alias("new"))
    w = Window.partitionBy("key").orderBy("distance", "other")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= degree).drop("rank")


@dataclass
class Graph:
    """``rows``: key, vector. ``edges``: key, other, distance, the ``degree`` nearest that were found of each row."""

    rows: DataFrame
    edges: DataFrame
    metric: str
    rounds: int

    @classmethod
    def build(cls, rows: DataFrame, degree: int = 16, metric: str = "cosine", rounds: int = ROUNDS) -> Graph:
        """Rows without a vector, and of another size than most, are left out; two rows without a distance (zero vectors under cosine) aren't neighbours."""
        own = rows.where("vector is not null").select("key", "vector")
        size = own.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        own = scratch.kept(own.where(F.size("vector") == (size["n"] if size else -1)), "nodes")
        edges = scratch.kept(_nearest(_start(own, degree, metric), degree, few=True), "edges")
        total, done = edges.count(), 0
        for _ in range(rounds if total else 0):
            done += 1
            found = scratch.kept(_nearest(edges.withColumn("new", F.lit(False)).unionByName(_joined(own, edges, degree, metric)), degree), "edges")
            changed = found.where("new").count()
            scratch.drop(edges)
            edges = found
            if changed <= SETTLED * total:
                break
        return cls(own, edges.select("key", "other", "distance"), metric, done)

    def search(self, queries: DataFrame, k: int = 10, ef: int = 64, exclude_self: bool = False, most: int = BROADCAST_COMPONENTS) -> DataFrame:
        """qid, key, distance, rank of the ``k`` nearest found, among the ``ef`` nearest of a beam. queries: qid, vector; null vectors find nothing.

        The stated query set goes to the tasks in blocks of at most ``most`` components."""
        kind = to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(self.rows.schema["key"].dataType)
        q = scratch.kept(queries.where("vector is not null").select("qid", F.col("vector").alias("qv")), "queries")
        entries = self.rows.orderBy(F.md5(F.col("key").cast("string")), "key").limit(ENTRIES)
        first = knn_block(q.select("qid", F.col("qv").alias("vector")), entries, min(ef, ENTRIES), self.metric)
        beam = scratch.kept(first.select("qid", "key", "distance", F.lit(False).alias("done")), "beam")
        seen = beam.select("qid", "key")
        parts = [p.toArrow() for p in blocks(q, "qid", "qv", most)]  # at most about ``most`` components each
        metric, schema = self.metric, f"qid {queries.schema['qid'].dataType.simpleString()}, key {self.rows.schema['key'].dataType.simpleString()}, distance double, done boolean"

        def measured(held: pa.Table):
            own = {x.shape[1]: (qids, x) for qids, x in sized(held["qid"].combine_chunks(), held["qv"].combine_chunks())}

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                place = {n: {qid: i for i, qid in enumerate(qids.tolist())} for n, (qids, _) in own.items()}
                for b in batches:
                    y = _numbers(b["vector"]) if b.num_rows else np.zeros((0, 0))
                    at = np.array([place.get(y.shape[1], {}).get(qid, -1) for qid in values(b["qid"]).tolist()], int)
                    b, y, at = b.filter(pa.array(at >= 0)), y[at >= 0], at[at >= 0]
                    if not len(at):
                        continue
                    x = own[y.shape[1]][1][at]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        dot = (x * y).sum(1)
                        d = -dot if metric == "inner_product" else np.sqrt(((x - y) ** 2).sum(1)) if metric == "l2" else 1 - dot / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                    ok = pa.array(np.isfinite(d))
                    yield pa.RecordBatch.from_arrays([b["qid"].filter(ok).cast(kind[0]), b["key"].filter(ok).cast(kind[1]), pa.array(d).filter(ok), pa.array(np.zeros(int(np.isfinite(d).sum()), bool))], ["qid", "key", "distance", "done"])

            return run

        def near(tried: DataFrame) -> DataFrame:
            out = None
            for b, held in enumerate(parts):
                own = tried if len(parts) == 1 else tried.where(F.pmod(F.xxhash64("qid"), F.lit(len(parts))) == b)
                hits = own.join(self.rows, "key").mapInArrow(measured(held), schema)
                out = hits if out is None else out.unionByName(hits)
            return out

        w = Window.partitionBy("qid").orderBy("distance", "key")
        for _ in range(SEARCH_ROUNDS):
            tried = beam.where("not done").join(self.edges.select("key", "other"), "key").select("qid", F.col("other").alias("key")).distinct().join(seen, ["qid", "key"], "left_anti")
            tried = scratch.kept(tried, "tried")
            if tried.isEmpty():
                break
            both = beam.withColumn("done", F.lit(True)).unionByName(near(tried))
            beam = scratch.kept(both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ef).drop("rank"), "beam")
            seen = seen.unionByName(tried)
        hits = beam.where("qid <> key") if exclude_self else beam
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "key", "distance", "rank")


_EDGE = "key {0}, other {0}, distance double, new boolean"


def _pivots(rows: DataFrame, n: int, draw: int) -> np.ndarray:
    """Vectors of n rows drawn by hash, each once; without odd ones."""
    drawn = rows.orderBy(F.md5(F.concat_ws("|", F.lit(draw), F.col("key").cast("string"))), "key").limit(n).select("vector").toArrow()
    x = _numbers(drawn["vector"].combine_chunks()) if drawn.num_rows else np.zeros((0, 1))
    return np.unique(x[np.isfinite(x).all(1)], axis=0)


def _cells(x: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """The places of each row's nearest pivots, by angle but for l2; rows without a distance lie in any."""
    m = min(NEAREST_CELLS, len(pivots))
    if m < 1:
        return np.zeros((len(x), 1), np.int64)
    d = np.nan_to_num(far(x, pivots, "l2" if metric == "l2" else "cosine"), nan=np.inf)
    return np.argpartition(d, m - 1, axis=1)[:, :m].astype(np.int64)


def _start(rows: DataFrame, degree: int, metric: str) -> DataFrame:
    """Edges within cells around pivots; a large cell is dealt by key."""
    n = rows.count()
    cells = min(PIVOTS, -(-n // CELL))
    key = rows.schema["key"].dataType
    types = to_arrow_type(key)
    draws = [_pivots(rows, cells, draw) for draw in range(DRAWS if cells > 1 else 1)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _numbers(b["vector"])
                for draw, pivots in enumerate(draws):
                    for cell in _cells(x, pivots, metric).T:
                        yield pa.RecordBatch.from_arrays([pa.array(draw + len(draws) * cell), b["key"], b["vector"]], ["bucket", "key", "vector"])

    own = rows.mapInArrow(placed, f"bucket long, key {key.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}")
    parts = own.groupBy("bucket").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("parts"))
    # each row joins its bucket's count, a number for each of at most DRAWS * PIVOTS, so that a bucket of any size is dealt evenly
    dealt = own.join(F.broadcast(parts), "bucket").withColumn("bucket", F.concat_ws("-", "bucket", F.pmod(F.xxhash64("key", "bucket"), "parts"))).select("bucket", "key", "vector")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, "bucket"):
            t = t.combine_chunks()
            keys = values(t["key"].combine_chunks())
            x = _numbers(t["vector"].combine_chunks())
            at, to, d = _edges(keys, x, degree, metric, np.full(len(keys), np.inf), np.ones(len(keys), bool))
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].tolist(), types), pa.array(keys[to].tolist(), types), pa.array(d), pa.array(np.ones(len(d), bool))], ["key", "other", "distance", "new"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(local, _EDGE.format(key.simpleString()))


def _joined(rows: DataFrame, edges: DataFrame, degree: int, metric: str) -> DataFrame:
    """Candidates of one round: edges between rows that meet at a row."""
    key = rows.schema["key"].dataType
    types = to_arrow_type(key)
    back = edges.select(F.col("other").alias("key"), F.col("key").alias("other"), "distance", "new")
    w = Window.partitionBy("key").orderBy("distance", "other")
    back = back.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= degree).drop("rank")
    both = edges.unionByName(back).select(F.col("key").alias("at"), F.col("other").alias("key"), "new").repartition("at")  # twice ``degree`` rows at most
    meet = both.groupBy("at", "key").agg(F.bool_or("new").alias("new")).withColumn("some", F.bool_or("new").over(Window.partitionBy("at"))).where("some").drop("some")
    worst = edges.groupBy("key").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
    nodes = rows.join(worst, "key", "left").select("key", "vector", F.when(F.col("n") >= degree, F.col("worst")).otherwise(float("inf")).alias("worst"))
    met = meet.join(nodes, "key").repartition("at").sortWithinPartitions("at")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, "at"):  # twice ``degree`` rows at most
            new = t["new"].to_numpy()
            if t.num_rows < 2 or not new.any():
                continue
            keys = values(t["key"].combine_chunks())
            at, to, d = _edges(keys, _numbers(t["vector"].combine_chunks()), degree, metric, t["worst"].to_numpy(), new)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].tolist(), types), pa.array(keys[to].tolist(), types), pa.array(d), pa.array(np.ones(len(d), bool))], ["key", "other", "distance", "new"])

    return met.mapInArrow(local, _EDGE.format(key.simpleString()))
