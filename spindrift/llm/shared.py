"""What the operators of this subpackage have in common: the shared folder, tokenizer paths, Arrow stages."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder.

    Only where neither is set and all runs in one process, as in tests, a temporary folder is made and used."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or getattr(spark, "_spindrift_dir", None):
        return path.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark._spindrift_dir = f"file://{tempfile.mkdtemp(prefix='spindrift-')}"
    return spark._spindrift_dir


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, which cuts the lineage.

    A lost executor loses nothing of it. The table is removed by discard(), or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindrift/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindrift_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
        pass


def discard(*tables: DataFrame | None) -> None:
    """Removes tables made by stored() that nothing reads any more."""
    for t in tables:
        if t is not None:
            _remove(t.sparkSession, t._spindrift_path)


def numbered(df: DataFrame, group: str, order: list[str], row_bytes: int, part_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with two more columns: ``place`` of each row in its group, from 0, in the order of ``order`` (nulls first), and ``n``, the group's rows.

    No group meets in one task: rows are sorted over range partitions of about ``part_bytes``, and stored; a row's place is its place in
    the partition and the rows of its group in the partitions before. Rows that are equal in all of these are
    dealt by their place in the input. ``group`` is never null."""
    rows = in_order(df, [group, *order], row_bytes=F.lit(row_bytes), part_bytes=part_bytes)
    runs = rows.groupBy(group, "part").agg(F.min("serial").alias("_first"), F.count("*").alias("_n"))  # one row for each group and partition
    w = Window.partitionBy(group)
    runs = runs.select(group, "part", (F.sum("_n").over(w.orderBy("part")) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    return rows.join(runs, [group, "part"]).select(*df.columns, (F.col("serial") + F.col("_shift")).alias("place"), "n")


def in_order(df: DataFrame, order: list[str], row_bytes: Column, part_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``df`` sorted by ``order`` (nulls first) over range partitions, stored, with ``part`` and ``serial``, which ascends in this order.

    The number of partitions follows from the sum of ``row_bytes``. Equal rows are dealt by their place in the input, so no key is a hot one."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    keys = [F.col(c).asc_nulls_first() for c in order]
    salt = unused(df.columns, "_salt")
    dealt = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(max(1, -(-int(size) // part_bytes)), *keys, F.col(salt).asc())
    return stored(dealt.sortWithinPartitions(*keys).select(*df.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("serial")))


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as make it differ from all ``columns`` in Spark's sense."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def give_back() -> None:
    """Memory that is free in this worker goes back to the system: workers live on between stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, a null text as an empty one, and the columns ``more``. Other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def in_parts(batch: pa.RecordBatch, room: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``room`` bytes (one row at least), so that Python holds few rows at a time whatever their size."""
    step = max(1, batch.num_rows * room // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def arrow_stage(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[tuple]], schema: str, batch: int = 2000) -> DataFrame:
    """mapInArrow for a generator: ``rows`` gets an iterator of {column: list} and gives tuples in the order of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
            held.clear()
            return made

        for row in rows({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for whole in batches for b in in_parts(whole)):
            held.append(row)
            if len(held) >= batch:
                yield out()
        if held:
            yield out()
        give_back()

    return df.mapInArrow(run, schema)


def maybe_in(df: DataFrame, key: str, ids: DataFrame, most_bits: int = 1 << 24) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with one more column, true for all rows whose ``key`` is among the distinct, stored ``ids`` and for few others; and a
    function that takes the column off again.

    A Bloom filter of one hash: sixteen bits an id, ``most_bits`` (2 MB) in all. The more ids beyond that, the more
    other rows pass; callers join what passes, so the filter decides about their work and never about their result."""
    (name,) = ids.columns
    n, bits = ids.count(), 1 << 16
    while bits < min(16 * n, most_bits):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = ids.select(place(F.col(name)).alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    held = [0] * (bits // 64)
    for r in words.toLocalIterator():  # as many rows as the filter has words
        held[r.w] = r.b
    own = list(df.columns)
    filter_, at, flag = unused(own, "_filter"), unused(own, "_at"), unused(own, "_maybe")
    one = df.sparkSession.createDataFrame([(held,)], f"{filter_} array<long>")
    hit = F.expr(f"shiftrightunsigned(get({filter_}, cast(shiftright({at}, 6) as int)), cast({at} & 63 as int)) & 1") == 1
    out = df.withColumn(at, place(F.col(f"`{key}`"))).crossJoin(F.broadcast(one)).select(*[F.col(f"`{c}`") for c in own], hit.alias(flag))  # one row
    return out, lambda x: x.select(*[F.col(f"`{c}`") for c in own])


def semi_join(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids`` (one column, distinct, stored). Rows that surely aren't move nowhere."""
    marked, plain = maybe_in(df, key, ids)
    own = unused(df.columns, "_id")
    return plain(marked.where(F.col(marked.columns[-1]))).join(ids.toDF(own), F.col(f"`{key}`") == F.col(own), "left_semi")


def anti_join(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is null or not among ``ids`` (one column, distinct, stored). Rows that surely aren't move nowhere."""
    marked, plain = maybe_in(df, key, ids)
    own, flag = unused(df.columns, "_id"), F.col(marked.columns[-1])
    rest = plain(marked.where(flag)).join(ids.toDF(own), F.col(f"`{key}`") == F.col(own), "left_anti")
    return plain(marked.where(~flag)).unionByName(rest)


def keep_rows(docs: DataFrame, decide: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows for whose text ``decide`` says true, with all their columns; texts are passed some megabytes at a time.

    A null text is decided as an empty one and stays null; repeated rows are decided alike; an empty table stays
    empty. Only texts go to Python and only decisions come back: the rows wait for them where they are read, and no join brings them together."""
    def kept(texts: pa.Array) -> pa.Array:
        from spindrift.llm.words import forget_units, slices

        forget_units()
        mask: list[bool] = []
        for b in in_parts(pa.RecordBatch.from_arrays([texts], ["text"])):
            own = [t or "" for t in b["text"].to_pylist()]
            for start, end in slices(own):
                mask += [bool(x) for x in decide(own[start:end])]
        give_back()
        return pa.array(mask, pa.bool_())

    text = F.col("text").cast("string")
    return docs.withColumn("text", text).where(F.arrow_udf(kept, "boolean")(F.col("text")))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)
