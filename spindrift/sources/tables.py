"""Vector tables in files: discovery from schemas, versions written whole, and a pointer moved in one step."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as K

from spindrift.operators import profile as P


class SelectionError(ValueError):
    """No vector column, or more than one to choose from; ``candidates`` are their names."""

    def __init__(self, message: str, candidates: list[str] = ()):
        super().__init__(message)
        self.candidates = list(candidates)


def vector_columns(df: DataFrame) -> list[str]:
    """Columns of float or double arrays."""
    return [f.name for f in df.schema if isinstance(f.dataType, K.ArrayType) and isinstance(f.dataType.elementType, (K.FloatType, K.DoubleType))]


def select_column(df: DataFrame, wanted: str | None = None) -> str:
    found = vector_columns(df)
    if wanted is not None:
        if wanted not in found:
            raise SelectionError(f"no vector column {wanted!r}", found)
        return wanted
    if len(found) != 1:
        raise SelectionError("no vector column" if not found else "more than one vector column", found)
    return found[0]


def infer(df: DataFrame) -> dict[str, str | None]:
    """text, model, updated and group columns by name, in order of priority, and by type."""
    kinds = {f.name: f.dataType for f in df.schema}
    pick = lambda names, types: next((n for n in names if isinstance(kinds.get(n), types)), None)
    return {
        "text": pick(P.TEXT_COLUMNS, (K.StringType, K.VarcharType)), "model": pick(P.MODEL_COLUMNS, K.StringType),
        "updated": pick(P.UPDATED_COLUMNS, (K.TimestampType, K.TimestampNTZType, K.DateType)), "group": pick(P.GROUP_COLUMNS, (K.StringType, K.LongType, K.IntegerType)),
    }


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """key: every key that a column of JSON objects has."""
    from pyspark.sql import functions as F

    return df.select(F.explode(F.json_object_keys(column)).alias("key")).distinct()


@dataclass
class State:
    """What a job remembers besides the data: spending, how many rows the model rejected (which ones is a version, ``failed``), history."""

    runs: int = 0
    rows_written: int = 0
    tokens: int = 0
    spent_usd: float = 0.0
    failed: int = 0
    history: list = field(default_factory=list)
    owned: list = field(default_factory=list)


class VectorTable:
    """Versions of a table under one folder, and which is live. Paths are any that Spark's file systems know.

    The pointer is a small file that is replaced by a rename, so readers see the old or the new version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, name: str, data: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        new, fs = self._fs(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        fs.mkdirs(new.getParent())
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(data, ensure_ascii=False, default=str).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), options)

    def _get(self, name: str) -> dict:
        p, fs = self._fs(f"{self.path}/{name}")
        if not fs.exists(p):
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    @property
    def pointer(self) -> dict:
        """live, old, new and failed version names."""
        return self._get("pointer")

    @property
    def state(self) -> State:
        return State(**self._get("state"))

    def save(self, state: State) -> None:
        self._put("state", asdict(state))

    def write(self, df: DataFrame, role: str | None = None) -> DataFrame:
        """Writes a version; with a role (live, new) the pointer takes it. The result reads it."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        out._spindrift_version = name
        if role:
            self.adopt(out, role)
        return out

    def adopt(self, version: DataFrame, role: str, drop: bool = False) -> None:
        """The pointer's ``role`` is a version that write() made; the one before is removed with ``drop``."""
        p = self.pointer
        self._put("pointer", p | {role: version._spindrift_version})
        if drop and p.get(role) not in (None, version._spindrift_version, *(n for r, n in p.items() if r != role)):
            at, fs = self._fs(f"{self.path}/{p[role]}")
            fs.delete(at, True)

    def forget(self, *versions: DataFrame) -> None:
        """Removes versions that write() made, but for those that the pointer names."""
        named = set(self.pointer.values())
        for v in versions:
            if v._spindrift_version not in named:
                at, fs = self._fs(f"{self.path}/{v._spindrift_version}")
                fs.delete(at, True)

    def read(self, role: str = "live") -> DataFrame:
        if not (name := self.pointer.get(role)):
            raise SelectionError(f"no {role} version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def stage(self) -> str:
        p = self.pointer
        return "conflict" if p.get("new") and p.get("old") else "cut_over" if p.get("old") else "filling" if p.get("new") else "cleaned_up" if any(h.get("event") == "cleanup" for h in self.state.history[-1:]) else "not_started"

    def _failed(self, p: dict) -> dict:
        return {n: p[n] for n in ("failed",) if n in p}

    def _event(self, event: str) -> None:
        s = self.state
        s.history.append({"event": event})
        self.save(s)

    def cutover(self) -> None:
        """The new version is live, the live one old, in one step."""
        p = self.pointer
        if not p.get("new") or p.get("old"):
            raise SelectionError(f"nothing to switch to: {self.stage}")
        self._put("pointer", self._failed(p) | {"live": p["new"], "old": p["live"]})
        self._event("cutover")

    def rollback(self) -> None:
        p = self.pointer
        if not p.get("old"):
            raise SelectionError("nothing to go back to")
        self._put("pointer", self._failed(p) | {"live": p["old"], "new": p["live"]})
        self._event("rollback")

    def cleanup(self, typed: str) -> None:
        """Drops the old version, if its name is typed back."""
        p = self.pointer
        if not p.get("old") or typed != p["old"]:
            raise SelectionError("type the old version's name to drop it", [p.get("old") or ""])
        self._put("pointer", self._failed(p) | {"live": p["live"]})
        at, fs = self._fs(f"{self.path}/{p['old']}")
        fs.delete(at, True)
        self._event("cleanup")
