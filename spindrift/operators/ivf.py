"""An index of inverted lists: trained centres, a table laid out by list, and searches that read the probed lists only.

Centres come from k-means over a bounded sample (``SAMPLE`` vectors a list, by the hash of their keys): each round every task assigns its
vectors by one matrix product and gives a sum and a count for each list, and Spark adds them up. Rows of
all the table are then assigned to their nearest centre and written in a folder for each list, a large list in
several files. A search takes a query's ``probes`` nearest lists; the filter on them reaches the scan as
a partition filter, and each file's rows meet only the queries that probe its list.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spindrift.functions import vectors as V
from spindrift.operators.knn import BROADCAST_COMPONENTS, Nearest, blocks, ranked, sized, values
from spindrift.sources import scratch

#: Vectors of the training sample for each list; rounds of training; rows of a list's file.
SAMPLE, ROUNDS, FILE_ROWS = 256, 12, 200_000


def _matrix(vectors: pa.Array, metric: str) -> np.ndarray:
    """The vectors of an Arrow array as rows, of length one under cosine."""
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n == 0, 1, n)
    return x


def _nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest centres of each row by L2, nearest first; ties go to the smaller number."""
    d = (centres**2).sum(1) - 2 * (x @ centres.T)
    return np.argmin(d, 1)[:, None] if n == 1 else np.argsort(d, 1, kind="stable")[:, :n]


def _of_size(rows: DataFrame, dims: int) -> DataFrame:
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") == dims))


def train(rows: DataFrame, lists: int, metric: str = "cosine", rounds: int = ROUNDS) -> np.ndarray:
    """Centres, at most ``lists`` (fewer where there are fewer vectors), from rows (key, vector) of the most common size."""
    size = rows.where("vector is not null").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None or not size["n"]:
        return np.zeros((0, 0))
    if lists * size["n"] > BROADCAST_COMPONENTS:
        raise ValueError(f"{lists} lists of {size['n']} numbers are more than {BROADCAST_COMPONENTS} together")
    drawn = _of_size(rows, size["n"]).orderBy(F.md5(F.col("key").cast("string")), "key").limit(SAMPLE * lists)
    sample = scratch.kept(drawn.select("key", "vector"), "sample")
    first = sample.orderBy(F.md5(F.col("key").cast("string")), "key").limit(lists).select("vector")
    centres = _matrix(first.toArrow()["vector"].combine_chunks(), metric)

    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(now), np.zeros(len(now), np.int64)
            for b in batches:
                if b.num_rows:
                    x = _matrix(b["vector"], metric)
                    at = _nearest(x, now)[:, 0]
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(now))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64()), pa.array(list(total[some]), pa.list_(pa.float64()))], ["list", "n", "total"])

        parts = sample.mapInArrow(sums, "list long, n long, total array<double>").select("list", "n", F.posexplode("total").alias("i", "x"))
        summed = parts.groupBy("list", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()  # a number for each component of a centre
        centres = now.copy()
        at = summed["list"].to_numpy(), summed["i"].to_numpy()
        centres[at] = summed["x"].to_numpy() / summed["n"].to_numpy()  # a list without vectors keeps its centre
        if metric == "cosine":
            n = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = centres / np.where(n == 0, 1, n)
        if np.abs(centres - now).max() < 1e-6:
            break
    scratch.drop(sample)
    return centres


def assigned(rows: DataFrame, centres: np.ndarray, metric: str = "cosine", probes: int = 1) -> DataFrame:
    """The rows (key, vector of the centres' size) with ``list``, once for each of their ``probes`` nearest lists."""
    key = to_arrow_type(rows.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = _nearest(_matrix(b["vector"], metric), centres, probes)
                take = pa.array(np.repeat(np.arange(b.num_rows), at.shape[1]))
                yield pa.RecordBatch.from_arrays([b["key"].take(take).cast(key), b["vector"].take(take), pa.array(at.ravel(), pa.int32())], ["key", "vector", "list"])

    own = _of_size(rows.select("key", "vector"), centres.shape[1])
    return own.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {own.schema['vector'].name} {own.schema['vector'].dataType.simpleString()}, list int")


@dataclass
class Index:
    """An index in a folder: ``rows`` by list, and ``about`` (centres, metric, counts) beside them."""

    spark: SparkSession
    path: str
    metric: str
    centres: np.ndarray
    counts: dict[int, int]

    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int, metric: str = "cosine", rounds: int = ROUNDS) -> Index:
        """Trains on a sample, and indexes every row (key, vector) that has a vector of the trained size; others can't be compared."""
        spark, centres = rows.sparkSession, train(rows, lists, metric, rounds)
        kind = rows.schema["vector"].dataType.simpleString()
        if not len(centres):
            held, counts = spark.createDataFrame([], f"key {rows.schema['key'].dataType.simpleString()}, vector {kind}, list int"), {}
        else:
            held = scratch.kept(assigned(rows, centres, metric), "assigned")
            counts = {r["list"]: r["n"] for r in held.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one number a list
        # a large list is dealt to several tasks by key
        files = F.element_at(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, max(1, -(-n // FILE_ROWS)))]), F.col("list")) if counts else F.lit(1)
        dealt = held.withColumn("_file", F.pmod(F.xxhash64("key"), files)).repartition("list", "_file").drop("_file")
        dealt.sortWithinPartitions("list").write.partitionBy("list").parquet(f"{path}/rows")
        about = {"metric": metric, "centres": centres.tolist(), "counts": {str(k): n for k, n in counts.items()}, "schema": dealt.schema.json()}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
        scratch.drop(held)
        return cls(spark, path, metric, centres, counts)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        centres = np.array(about["centres"], np.float64) if about["centres"] else np.zeros((0, 0))
        return cls(spark, path, about["metric"], centres, {int(k): n for k, n in about["counts"].items()})

    def rows(self) -> DataFrame:
        about = json.loads(self.spark.read.text(f"{self.path}/about").first()[0])
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 4, exclude_self: bool = False, most: int = BROADCAST_COMPONENTS) -> DataFrame:
        """qid, key, distance, rank: the ``k`` nearest of the rows in each query's ``probes`` nearest lists. queries: qid, vector.

        The stated queries go to the tasks in blocks of at most ``most`` numbers; null vectors, other sizes and pairs without a distance give no hit."""
        rows, out = self.rows(), None
        own = _of_size(queries.select(F.col("qid").alias("key"), "vector"), self.centres.shape[1] if len(self.centres) else -1)
        probes = min(probes, len(self.centres))
        for block in blocks(own, "key", "vector", max(1, most // max(1, probes))):
            held = assigned(block, self.centres, self.metric, probes).toArrow() if probes else None  # at most about ``most`` numbers
            hits = self._hits(held, probes, queries.schema["qid"].dataType, rows, k, exclude_self)
            out = hits if out is None else out.unionByName(hits)
        return ranked(out, k)

    def _hits(self, held: pa.Table | None, probes: int, qid_type, rows: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        key_type, metric = rows.schema["key"].dataType, self.metric
        names = ["qid", "key", "distance"]
        types = [to_arrow_type(qid_type), to_arrow_type(key_type), pa.float64()]
        own: dict[int, np.ndarray] = {}
        qids, q = np.zeros(0, np.int64), np.zeros((0, 0))
        if held is not None and held.num_rows:  # a query's lists follow one another
            first = held.take(pa.array(np.arange(0, held.num_rows, probes)))
            for at, q in sized(pa.array(np.arange(first.num_rows)), first["vector"].combine_chunks()):  # one size
                qids, lists = values(first["key"].combine_chunks())[at], held["list"].to_numpy().reshape(-1, probes)[at]
                own = {c: np.flatnonzero((lists == c).any(1)) for c in np.unique(lists).tolist()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Nearest(qids, q, k, metric, exclude_self)
            for b in batches:
                lists = b["list"].to_numpy()
                for c in np.unique(lists).tolist():
                    some = b.filter(pa.array(lists == c))
                    for keys, d in sized(some["key"], some["vector"]):
                        found.add(keys, d, own[c])
            yield found.batch(pa.schema(list(zip(names, types))))

        probed = rows.where(F.col("list").isin(sorted(own)))
        return probed.mapInArrow(run, f"qid {qid_type.simpleString()}, key {key_type.simpleString()}, distance double")
