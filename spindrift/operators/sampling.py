"""Samples that are the same every time, and queries made from the texts themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.sources import scratch


def spread(df: DataFrame, n: int, key: str = "key", seed: str = "") -> DataFrame:
    """The n rows whose keys have the smallest hashes: a top-n, so no full sort and no shuffle of all rows."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def keeping(df: DataFrame, n: int, required: DataFrame, key: str = "key", seed: str = "") -> DataFrame:
    """n rows with all of ``required`` (key) among them, as far as they exist; the rest are a spread sample."""
    kept = df.join(required.select(key).distinct(), key, "left_semi")
    have = kept.count()
    rest = df.join(required.select(key).distinct(), key, "left_anti")
    return kept.unionByName(spread(rest, max(0, n - have), key, seed))


def with_both_vectors(df: DataFrame, n: int, key: str = "key", text: str = "text", old: str = "vector", new: str = "new_vector") -> DataFrame:
    """A spread sample of rows that have text and both vectors."""
    return spread(df.where(F.col(old).isNotNull() & F.col(new).isNotNull() & T.has_text(text)), n, key)


def sampling_method(total: int, taken: int, spread_out: bool = True) -> str:
    return "full table" if taken >= total else "spread across the table" if spread_out else "first rows"


def boilerplate(sentences: DataFrame) -> DataFrame:
    """norm, n: in how many texts each sentence stands (distinct within a text before it is normalized). sentences: key, sentences array."""
    return sentences.select("key", F.explode(F.array_distinct("sentences")).alias("s")).groupBy(T.normalized("s").alias("norm")).agg(F.count(F.lit(1)).alias("n"))


def _drawn(docs: DataFrame, split, low: int, high: int, seed: str) -> DataFrame:
    """key, i: of each text the place of one sentence of low to high words that stands in this text alone, in one form; the one with the smallest hash of key, seed and place.

    Texts are split once, and leave hashes and numbers behind: a sentence is unique if all that share its normalized form are the same
    by hashes of key and form, which partial aggregates of fixed size find. Keys are unique."""
    each = docs.select("key", F.posexplode(split("text")).alias("i", "s"))
    norm, own = T.normalized("s"), ("key", "s")
    places = scratch.kept(
        each.select(
            "key", "i", T.word_count("s").between(low, high).alias("fits"), F.xxhash64(norm).alias("a"), F.xxhash64(F.lit(1), norm).alias("b"), F.xxhash64(*own).alias("c"), F.xxhash64(F.lit(1), *own).alias("d")
        ),
        "sentences",
    )
    once = places.groupBy("a", "b").agg(*[f(c).alias(f"{n}_{c}") for c in "cd" for n, f in (("least", F.min), ("most", F.max))]).where("least_c = most_c and least_d = most_d")
    rank = F.struct(F.md5(F.concat_ws("|", F.col("key").cast("string"), F.lit(seed), F.col("i").cast("string"))), F.col("i"))
    return places.where("fits").join(once, ["a", "b"], "left_semi").groupBy("key").agg(F.min_by("i", rank).alias("i"))


def bench_queries(docs: DataFrame, n: int, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """(documents with the queries taken out, queries (key, query)).

    A query is a sentence of 6 to 40 words, unique among all texts, of a text of two sentences or more that
    keeps eight words; else the first third, twelve words at most, of a text of twenty words. Which
    sentence and which n texts: by hash."""
    split = docs.select("key", "text", T.bench_sentences("text").alias("parts"))
    one = _drawn(docs, T.bench_sentences, 6, 40, seed)
    joined = split.join(one, "key", "left")
    rest = F.array_join(F.filter("parts", lambda s, j: j != F.col("i")), " ")
    words = T.words("text")
    cut = F.least(F.lit(12), F.floor(F.size("w") / 3)).cast("int")
    made = joined.withColumn("rest", F.when(F.col("i").isNotNull() & (F.size("parts") >= 2), rest)).withColumn("w", words)
    good = T.word_count("rest") >= 8
    made = made.select(
        "key", F.when(good, F.get("parts", F.col("i"))).when(F.size("w") >= 20, F.array_join(F.slice("w", F.lit(1), cut), " ")).alias("query"),
        F.when(good, F.col("rest")).when(F.size("w") >= 20, F.array_join(F.slice("w", cut + 1, F.size("w")), " ")).alias("left"),
    ).where("query is not null")
    chosen = scratch.kept(spread(made, n, "key", seed), "queries")  # read for documents, queries and what is relevant: made once
    edited = docs.join(chosen.select("key", "left"), "key", "left").withColumn("text", F.coalesce("left", "text")).drop("left")
    return edited, chosen.select("key", "query")


def eval_queries(docs: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """key, query, language, doc_language, slice: sentences that stay in their texts.

    A query is a sentence of 5 to 40 words, unique among all texts; else the first half, twelve words at
    most, of a text of twelve words."""
    one = _drawn(docs, T.eval_sentences, 5, 40, seed)
    words = T.words("text")
    first = F.when(F.size(words) >= 12, F.array_join(F.slice(words, F.lit(1), F.least(F.lit(12), F.floor(F.size(words) / 2)).cast("int")), " "))
    long_enough = F.col("i").isNotNull() | (F.size(words) >= 12)  # words are only cut where no sentence was found
    placed = spread(docs.select("key", "text").join(one, "key", "left").where(long_enough).select("key", "i"), n, "key", seed)
    chosen = docs.select("key", "text").join(placed, "key").select("key", F.coalesce(F.get(T.eval_sentences("text"), F.col("i")), first).alias("query"), "text")
    own = chosen.select("key", "query", T.script("query").alias("language"), T.script("text").alias("doc_language"))
    return own.withColumn("slice", T.slice_label("language", "doc_language"))


def labelled_queries(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, query, relevant: labels that are in the corpus; queries without any are left out. queries: qid, query, relevant array."""
    exploded = queries.select("qid", "query", F.explode(F.array_distinct("relevant")).alias("key"))
    return exploded.join(docs.select("key").distinct(), "key", "left_semi").groupBy("qid", "query").agg(F.array_sort(F.collect_set("key")).alias("relevant"))
