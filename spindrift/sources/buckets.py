"""A table in hash buckets, of which a write touches only what it changes.

A version is a small manifest that names, for each bucket, a folder with its rows and folders with changes made since. A merge writes
the changed rows alone, as one more folder in the buckets they belong to; reading takes the newest row of
each key in buckets that have changes, and reads the others as they are. Compaction rewrites buckets with many
changes. A manifest is put in place by a rename that fails if another writer was first, so a failed write
leaves no version, and readers keep the version they began with until it is vacuumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer made the version first."""


class BucketTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise LookupError(f"no version {version if version is not None else ''} of {self.path}")
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{known[-1] if version is None else version:010d}.json", wholetext=True).first()[0])

    def _commit(self, m: dict) -> int:
        new, fs = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        fs.mkdirs(new.getParent())
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{m['version']:010d}.json"), none)
        except Exception as e:
            fs.delete(new, False)
            if m["version"] in self.versions():
                raise Conflict(f"version {m['version']} is there") from e
            raise
        return m["version"]

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, key: str, buckets: int) -> dict[str, str]:
        """Folder of each bucket that ``df`` has rows of."""
        name = f"data/{uuid.uuid4().hex}"
        df.withColumn("_bucket", self._bucket(key, buckets)).repartition("_bucket").write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/{name}")
        return {n.removeprefix("_bucket="): f"{name}/{n}" for n in self._names(f"{self.path}/{name}") if n.startswith("_bucket=")}

    def create(self, df: DataFrame, key: str, buckets: int = 64) -> int:
        """The first version. Keys are distinct and not null; a bucket should have some hundred megabytes at most."""
        base = self._write(df, key, buckets)
        return self._commit({"version": 1, "key": key, "buckets": buckets, "schema": df.schema.json(), "base": base, "changes": {}, "marks": {}})

    def _read(self, m: dict, wanted: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m["schema"]))
        key, buckets = m["key"], (b for b in {*m["base"], *m["changes"]} if wanted is None or b in wanted)
        plain, mixed = [], []
        for b in sorted(buckets, key=int):
            (mixed if m["changes"].get(b) else plain).append(b)
        path = lambda n: f"{self.path}/{n}"
        out = self.spark.read.schema(schema).parquet(*[path(m["base"][b]) for b in plain]) if plain else self.spark.createDataFrame([], schema)
        if not mixed:
            return out
        changed = StructType.fromJson(json.loads(m["schema"])).add("_seq", "long").add("_gone", "boolean")
        rows = self.spark.read.schema(changed).parquet(*[path(n) for b in mixed for n in m["changes"][b]])
        if base := [path(m["base"][b]) for b in mixed if b in m["base"]]:
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(*base).select("*", F.lit(0).cast("long").alias("_seq"), F.lit(False).alias("_gone")))
        others = [c for c in schema.names if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*others, "_gone"), "_seq").alias("_r")).where("not _r._gone")
        return out.unionByName(newest.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in schema.names]))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows whose key is among ``keys`` (one column); only the buckets of these are read."""
        m = self.manifest(version)
        own = keys.select(F.col(keys.columns[0]).alias(m["key"])).where(F.col(m["key"]).isNotNull()).distinct()
        wanted = {str(r[0]) for r in own.select(self._bucket(m["key"], m["buckets"])).distinct().collect()}  # a number a bucket
        return self._read(m, wanted).join(own, m["key"], "left_semi")

    def merge(self, rows: DataFrame | None = None, removed: DataFrame | None = None, mark: tuple[str, int] | None = None) -> int:
        """A version with ``rows`` put in the place of those of their keys, or added, and the keys ``removed`` (one column) gone.

        ``mark`` (a writer's name, a number): the merge is left out if a version has that writer's number or a later one."""
        m = self.manifest()
        if mark and m["marks"].get(mark[0], -1) >= mark[1]:
            return m["version"]
        schema, version = StructType.fromJson(json.loads(m["schema"])), m["version"] + 1
        parts = []
        if rows is not None:
            parts.append(rows.select(*schema.names, F.lit(version).cast("long").alias("_seq"), F.lit(False).alias("_gone")))
        if removed is not None:
            own = removed.select(F.col(removed.columns[0]).alias(m["key"])).distinct()
            parts.append(own.select(*[F.col(f.name) if f.name == m["key"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.lit(version).cast("long").alias("_seq"), F.lit(True).alias("_gone")))
        changes = {b: list(n) for b, n in m["changes"].items()}
        for df in parts:
            for b, name in self._write(df, m["key"], m["buckets"]).items():
                changes.setdefault(b, []).append(name)
        return self._commit(m | {"version": version, "changes": changes, "marks": m["marks"] | ({mark[0]: mark[1]} if mark else {})})

    def compact(self, most: int = 4) -> int:
        """A version in which buckets with more than ``most`` folders of changes are written anew; the others stay as they are."""
        m = self.manifest()
        full = {b for b, n in m["changes"].items() if len(n) > most}
        if not full:
            return m["version"]
        written = self._write(self._read(m, full), m["key"], m["buckets"])
        base = {b: n for b, n in m["base"].items() if b not in full} | written
        return self._commit(m | {"version": m["version"] + 1, "base": base, "changes": {b: n for b, n in m["changes"].items() if b not in full}})

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last ``keep`` versions and what only they had; says how many folders went."""
        known = self.versions()
        named = {n.split("/")[1] for v in known[-keep:] for m in [self.manifest(v)] for names in [*([n] for n in m["base"].values()), *m["changes"].values()] for n in names}
        old = {n.split("/")[1] for v in known[:-keep] for m in [self.manifest(v)] for names in [*([n] for n in m["base"].values()), *m["changes"].values()] for n in names}
        for v in known[:-keep]:
            p, fs = self._fs(f"{self.path}/manifests/{v:010d}.json")
            fs.delete(p, False)
        for name in old - named:  # a write that hasn't come to its manifest yet is in no version, and stays
            p, fs = self._fs(f"{self.path}/data/{name}")
            fs.delete(p, True)
        return len(old - named)
