"""Line deduplication that can be undone: sharded cuckoo filters over exact reference tables.

The exact table has one row for each (line key, document) and is all that the result depends on: from it
follow the number of documents of each key and its keeper, the largest doc_id. Keys found in enough
documents are *frequent*. Sharded cuckoo filters hold the frequent keys; a filter never misses a key it
holds, so rows whose key it doesn't have need not be joined with the frequent keys. Rows and filters meet
by shard, and a shard with many rows is split, so a task holds one filter at a time.

Inserting documents adds rows to the table and keys that became frequent to the filters; deleting
documents takes both away again, so inserting and deleting the same documents leaves what was there
before. Either recounts only the keys of the documents that came or went. Filters that have become too
full are dealt into more shards.

Keys are the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z in lower case, by their 128-bit
BLAKE2 hash.

Defined results: a null or empty text is one empty line; rows with the same doc_id count as one document;
a row without doc_id keeps all its lines and counts for no key; lines of any length and number are
handled; an empty table gives an empty table; other columns pass through dedup() as they are, but
n_lines and n_dropped are its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import arrow_stage, give_back, in_parts, semi_join, stored, texts_of, unused

_STRIP = " \t\n\x0b\x0c\r"
SHORTEST, ENOUGH = 40, 5
#: Frequent keys of a shard when filters are made; rows of a shard that are tested together.
KEYS_A_SHARD, ROWS_A_TASK = 50_000, 250_000


def key_of(line: str, shortest: int = SHORTEST) -> bytes | None:
    """16 bytes; None for a line that is too short to count."""
    s = line.strip(_STRIP)
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(s) >= shortest else None


class CuckooFilter:
    """Approximate set of 16-byte keys with deletion: buckets of four 16-bit fingerprints, two buckets a key.

    ``spare`` holds fingerprints that found no room, so an insertion never fails."""

    def __init__(self, capacity: int, cells: np.ndarray | None = None, spare: dict[tuple[int, int], int] | None = None):
        n = 1
        while n * 4 * 0.85 < max(1, capacity):
            n *= 2
        self.cells = np.zeros((n, 4), np.uint16) if cells is None else cells
        self.mask, self.spare = len(self.cells) - 1, spare or {}

    def _place(self, key: bytes) -> tuple[int, int, int]:
        f = int.from_bytes(key[8:10], "little") or 1
        a = int.from_bytes(key[:8], "little") & self.mask
        return f, a, a ^ (f * 0x5BD1E995 & self.mask)

    def _other(self, bucket: int, f: int) -> int:
        return bucket ^ (f * 0x5BD1E995 & self.mask)

    def insert(self, key: bytes) -> None:
        f, a, b = self._place(key)
        for bucket in (a, b):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = f
                return
        bucket = b
        for turn in range(200):
            slot = (turn * 7 + f) % 4
            f, self.cells[bucket, slot] = int(self.cells[bucket, slot]), f
            bucket = self._other(bucket, f)
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = f
                return
        k = (min(bucket, self._other(bucket, f)), f)
        self.spare[k] = self.spare.get(k, 0) + 1

    def delete(self, key: bytes) -> bool:
        """Only keys that were inserted may be deleted."""
        f, a, b = self._place(key)
        k = (min(a, b), f)
        if self.spare.get(k):
            self.spare[k] -= 1
            return True
        for bucket in (a, b):
            at = np.flatnonzero(self.cells[bucket] == f)
            if len(at):
                self.cells[bucket, at[0]] = 0
                return True
        return False

    def contains(self, key: bytes) -> bool:
        f, a, b = self._place(key)
        return f in self.cells[a] or f in self.cells[b] or bool(self.spare.get((min(a, b), f)))

    def contains_all(self, keys: np.ndarray) -> np.ndarray:
        """``keys``: rows of 16 bytes."""
        f = keys[:, 8:10].copy().view("<u2")[:, 0]
        f = np.where(f == 0, 1, f).astype(np.uint16)
        a = (keys[:, :8].copy().view("<u8")[:, 0] & np.uint64(self.mask)).astype(np.int64)
        b = a ^ (f.astype(np.int64) * 0x5BD1E995 & self.mask)
        found = (self.cells[a] == f[:, None]).any(1) | (self.cells[b] == f[:, None]).any(1)
        if any(self.spare.values()):
            found |= np.fromiter(((int(min(x, y)), int(z)) in self.spare for x, y, z in zip(a, b, f)), bool, len(f))
        return found

    def to_bytes(self) -> bytes:
        spare = np.array([[*k, n] for k, n in self.spare.items() if n], "<u4").reshape(-1, 3)
        return len(self.cells).to_bytes(8, "little") + self.cells.astype("<u2").tobytes() + spare.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n = int.from_bytes(data[:8], "little")
        cells = np.frombuffer(data[8 : 8 + 8 * n], "<u2").reshape(n, 4).astype(np.uint16)
        spare = {(int(a), int(f)): int(c) for a, f, c in np.frombuffer(data[8 + 8 * n :], "<u4").reshape(-1, 3)}
        return cls(0, cells, spare)


def line_keys(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, key: each distinct key of each document; rows without doc_id have none."""

    def rows(batches):
        for b in batches:
            for d, t in zip(b["doc_id"], b["text"]):
                if len(t) >= shortest:
                    yield from ((d, k) for k in {key_of(x, shortest) for x in t.split("\n")} if k)

    return arrow_stage(texts_of(docs).where("doc_id is not null"), rows, "doc_id long, key binary", batch=20_000)


#: The key's last four bytes say in which shard it is.
def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


@dataclass
class LineIndex:
    """``table``: exact (key, doc_id); ``frequent``: exact (key, refs, keeper); ``filters``: (shard, filter)."""

    table: DataFrame
    frequent: DataFrame
    filters: DataFrame
    shards: int
    enough: int = ENOUGH

    @staticmethod
    def _frequent(table: DataFrame, enough: int) -> DataFrame:
        return table.groupBy("key").agg(F.count("doc_id").alias("refs"), F.max("doc_id").alias("keeper")).where(F.col("refs") >= enough)

    @classmethod
    def build(cls, docs: DataFrame, enough: int = ENOUGH, keys_a_shard: int = KEYS_A_SHARD) -> LineIndex:
        table = stored(line_keys(docs).distinct())
        frequent = stored(cls._frequent(table, enough))
        return cls(table, frequent, *_made(frequent, keys_a_shard), enough)

    def _changed(self, table: DataFrame, touched: DataFrame, keys_a_shard: int = KEYS_A_SHARD) -> LineIndex:
        """The index over ``table``, which differs from the present one in the keys ``touched`` only: all others keep their counts."""
        table, touched = stored(table), stored(touched.select("key").distinct())
        now = self._frequent(semi_join(table, "key", touched), self.enough)
        frequent = stored(self.frequent.join(touched, "key", "left_anti").unionByName(now))
        if frequent.count() > 2 * keys_a_shard * self.shards:
            return LineIndex(table, frequent, *_made(frequent, keys_a_shard), self.enough)
        more = frequent.join(self.frequent, "key", "left_anti").select("key", F.lit(1).alias("change"))
        less = self.frequent.join(frequent, "key", "left_anti").select("key", F.lit(-1).alias("change"))
        return LineIndex(table, frequent, _updated(self.filters, more.unionByName(less), self.shards, keys_a_shard), self.shards, self.enough)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the documents in it. Keys that a document has already change nothing; one that comes with another text has the keys of both."""
        new = stored(line_keys(docs).distinct().join(self.table, ["key", "doc_id"], "left_anti").select("doc_id", "key"))
        return self._changed(self.table.unionByName(new), new)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ``ids`` (doc_id)."""
        gone = stored(ids.select("doc_id").distinct())
        return self._changed(self.table.join(gone, "doc_id", "left_anti"), semi_join(self.table, "doc_id", gone))

    def drops(self) -> DataFrame:
        """doc_id, keys: of each document, the frequent keys of which it is not the keeper."""
        return _met(self.table, self.filters, self.frequent, self.shards).groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def _made(frequent: DataFrame, keys_a_shard: int) -> tuple[DataFrame, int]:
    """(filters of all frequent keys, number of shards)."""
    shards = -(-max(1, frequent.count()) // keys_a_shard)
    empty = frequent.sparkSession.createDataFrame([], "shard int, filter binary")
    return _updated(empty, frequent.select("key", F.lit(1).alias("change")), shards, keys_a_shard), shards


def _updated(filters: DataFrame, changes: DataFrame, shards: int, keys_a_shard: int) -> DataFrame:
    """Filters with keys put in (change 1) or taken out (change -1), shard by shard; a shard's keys are bounded in number."""

    def run(key, have: pa.Table, change: pa.Table) -> pa.Table:
        f = CuckooFilter.from_bytes(have["filter"][0].as_py()) if have.num_rows else CuckooFilter(max(2 * keys_a_shard if shards > 1 else 0, 2 * change.num_rows, 1000))
        for k, c in sorted(zip(change["key"].to_pylist(), change["change"].to_pylist()), key=lambda x: (x[1], x[0])):
            f.insert(k) if c > 0 else f.delete(k)
        give_back()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.to_bytes()], pa.binary())})

    return stored(filters.groupBy("shard").cogroup(changes.withColumn("shard", _shard(shards)).groupBy("shard")).applyInArrow(run, "shard int, filter binary"))


def _met(table: DataFrame, filters: DataFrame, frequent: DataFrame, shards: int) -> DataFrame:
    """doc_id, key: the rows whose key is frequent and kept by another document.

    A shard's rows are split by document into parts of about ROWS_A_TASK; each part meets a copy of the shard's filter and of its frequent keys, which are bounded in number."""
    placed = table.select("doc_id", "key", _shard(shards).alias("shard"))
    parts = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ROWS_A_TASK).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # a row a shard, of KEYS_A_SHARD frequent keys
    null = {"filter": "binary", "keys": "array<binary>", "keepers": "array<bigint>"}
    rows = placed.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), "doc_id", "key", *[F.lit(None).cast(t).alias(c) for c, t in null.items()])
    exact = frequent.groupBy(_shard(shards).alias("shard")).agg(F.collect_list(F.struct("key", "keeper")).alias("own"))
    held = filters.join(exact, "shard").select("shard", "filter", F.col("own.key").alias("keys"), F.col("own.keeper").alias("keepers"))
    copies = held.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("key"), *null)
    met = rows.unionByName(copies).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keeper, of = None, {}, None
        for b in batches:
            shard, part = b["shard"].to_numpy(), b["part"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])))) if b.num_rows else []
            for i, j in zip(starts, [*starts[1:], b.num_rows]):
                some = b.slice(i, j - i)
                if some["filter"][0].is_valid:  # the first row of a part, if its shard has a filter at all
                    own, of = CuckooFilter.from_bytes(some["filter"][0].as_py()), (shard[i], part[i])
                    keeper, some = dict(zip(some["keys"][0].as_py(), some["keepers"][0].as_py())), some.slice(1)
                if some.num_rows and of == (shard[i], part[i]):
                    keys = np.frombuffer(b"".join(some["key"].to_pylist()), np.uint8).reshape(-1, 16)
                    passed = some.select(["doc_id", "key"]).filter(pa.array(own.contains_all(keys)))
                    yield passed.filter(pa.array([d < keeper.get(k, d) for d, k in zip(passed["doc_id"].to_pylist(), passed["key"].to_pylist())], pa.bool_()))
        give_back()

    return met.mapInArrow(run, "doc_id long, key binary")


def dedup(docs: DataFrame, index: LineIndex | None = None, enough: int = ENOUGH, counts: bool = True) -> DataFrame:
    """The documents without the lines that another document keeps, joined by line ends; with ``counts`` n_lines and n_dropped too, in place of columns of these names."""
    index = index or LineIndex.build(docs, enough)
    docs = docs.drop("n_lines", "n_dropped") if counts else docs
    names = docs.columns
    own_id, own_keys = unused(names, "_id"), unused(names, "_keys")
    joined = docs.join(index.drops().toDF(own_id, own_keys), F.col("doc_id") == F.col(own_id), "left").select(*[F.col(f"`{c}`") for c in names], own_keys)
    at = [n.lower() for n in names].index("text")
    schema = docs.withColumn(names[at], F.col("text").cast("string"))
    schema = (schema.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}) if counts else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in in_parts(whole)):
            text, lines, dropped = [], [], []
            for t, k in zip(b[names[at]].to_pylist(), b[own_keys].to_pylist()):
                own = (t or "").split("\n")
                lines.append(len(own))
                if k:
                    k = set(k)
                    kept = [x for x in own if key_of(x) not in k]
                    dropped.append(len(own) - len(kept))
                    text.append("\n".join(kept))
                else:
                    dropped.append(0)
                    text.append(t)
            columns = [b[n] for n in names]
            columns[at] = pa.array(text, pa.string())
            more = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *more], [*names, *["n_lines", "n_dropped"][: len(more)]])
        give_back()

    return joined.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of dedup()."""
    return dedup(texts_of(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
