"""A corpus made ready for training: documents are filtered, deduplicated and packed, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import lines, neardup, packing, quality, toxicity
from spindrift.llm.queries import BYTE_BPE
from spindrift.llm.shared import discard, stored, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Null and empty texts, of which nothing is said, stay, and repeated rows are decided alike."""
    return toxicity.keep(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null text is scored as an empty one, and repeated rows are decided alike."""
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them; n_chars follows the text, where it is a column. A null text and all other columns stay as they are; a repeated row is treated as each of its copies."""
    own = {c.lower(): c for c in docs.columns}
    kept = lines.dedup(docs, counts=False)
    if n := own.get("n_chars"):
        text = F.col(f"`{own['text']}`")
        kept = kept.withColumn(n, F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(F.col(f"`{n}`")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; null texts and texts without words are near copies of none, repeated rows of each other."""
    return neardup.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1,024 ids. A null text is packed as an empty one, a repeated row as often as it is there.

    Workers that go on from stage to stage keep fewer units than where packing runs alone."""
    return packing.pack(docs, tokenizer_path(BYTE_BPE), room=200_000)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("line dedup", drop_lines), ("near-dedup", drop_near_copies), ("packing", pack)]

#: SQL can express neither the classifiers nor the near-duplicate and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if hasattr(before, "_spindrift_path"):  # a stage's table, not the input
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
