"""A change feed kept up with by Structured Streaming.

follow() reduces every micro-batch to the newest change of each id and merges it into the table's next version.
Applying a batch twice changes nothing, so a restarted stream needs no more than its checkpoint.

winners() keeps, in the state store, what each id's newest change is, tombstones too, and passes on the newest of all for the ids
a batch touches; keep_up() merges these into a table of buckets, so that a batch writes these ids alone and reads nothing back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.sources import scratch
from spindrift.sources.buckets import BucketTable
from spindrift.sources.tables import VectorTable


def merged(table: DataFrame, changes: DataFrame, key: str = "id", at: str = "updated_at", deleted: str = "deleted") -> DataFrame:
    """The table (with tombstones) after the changes: of each id the newest row; what is there wins ties."""
    both = table.withColumn("_order", F.lit(0)).unionByName(changes.withColumn("_order", F.lit(1)))
    others = [c for c in table.columns if c != key]
    rank = F.struct(F.col(at).isNotNull(), F.col(at), -F.col("_order"))
    return both.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("r")).select(key, "r.*").select(*table.columns)


def live(table: DataFrame, deleted: str = "deleted") -> DataFrame:
    """Without tombstones."""
    return table.where(~F.coalesce(F.col(deleted), F.lit(False)))


def follow(stream: DataFrame, table: VectorTable, checkpoint: str, key: str = "id", at: str = "updated_at", deleted: str = "deleted"):
    """Starts a query that merges what there is and ends. ``table`` has a live version with the stream's columns."""

    def merge(batch: DataFrame, _: int) -> None:
        table.write(merged(table.read(), batch, key, at, deleted), "live")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def winners(stream: DataFrame, key: str = "id", at: str = "updated_at", order: str = "event_id") -> DataFrame:
    """Of each id that a batch touches the newest change of all so far, whatever order they come in: null times are oldest, ties go to the smaller ``order``.

    An aggregate in update mode: tasks reduce a batch to a row an id, and the state store has one change an id, of deleted ones for ever, as
    nothing takes it out; so no change is ever taken for new because a tombstone was forgotten. An id whose newest change is an
    older batch's comes again, which changes nothing. Uses the RocksDB state store (state_store())."""
    when = F.col(at).cast("timestamp")
    rank = F.struct(when.isNotNull(), when, -F.col(order))
    newest = F.max_by(F.struct(*[c for c in stream.columns if c != key]), rank)
    return stream.groupBy(key).agg(newest.alias("_r")).select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in stream.columns])


def state_store(spark) -> None:
    """The session's streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep_up(stream: DataFrame, table: BucketTable, checkpoint: str, name: str = "feed", key: str = "id", at: str = "updated_at", order: str = "event_id", deleted: str = "deleted"):
    """Starts a query that merges what there is into the buckets it touches, and ends.

    A batch that was merged before a failure is known by its number and left out. ``table`` has the stream's columns without ``deleted``."""
    state_store(stream.sparkSession)

    def merge(batch: DataFrame, number: int) -> None:
        batch = scratch.kept(batch, "batch")  # read twice; the state is gone through once
        gone = F.coalesce(F.col(deleted), F.lit(False))
        table.merge(batch.where(~gone).drop(deleted), batch.where(gone).select(key), (name, number))
        scratch.drop(batch)
        table.compact()

    changes = winners(stream, key, at, order)
    return changes.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
