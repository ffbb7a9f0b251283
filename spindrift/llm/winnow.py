"""Document fingerprints by winnowing, in DataFrame operations only.

Words (runs of letters, marks and digits, in lower case; in scripts written without blanks every
character is a word) are hashed. Every five words make a gram, hashed by a cyclic polynomial: the words'
hashes, each rotated by its place from the end, combined by exclusive or. So the hash of a gram rolls from
those of shorter ones: of two words from one, of four from two, of five from four, in three passes over
the text whatever the words are. Of every four grams in a row the smallest hash is chosen, the rightmost
of equal ones. The fingerprint is the list of chosen grams with their positions, each position once. Two
texts that share eight words in a row share a chosen gram of them: the guarantee of winnowing.

Hashes have 62 bits. In a window, each gram's hash carries its distance from the window's right end in
its lower bits, so that the least number is the least hash and, among equal ones, the rightmost.

Defined results: a null text counts as an empty one, whose fingerprint is empty; a text of one to four
words has one gram of them all, a text without words but not empty one of the text itself; two empty
fingerprints are alike (1); equal texts, repeated rows among them, have equal fingerprints; texts of any
length are taken whole; columns other than doc_id and text are left out. For next documents rows are in
descending order of doc_id and text, rows without doc_id last; a table of one row is followed by itself;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.shared import texts_of

GRAM, WINDOW = 5, 4
#: Documents of a range in which next documents are found.
ROWS_A_RANGE = 50_000
#: Scripts written without blanks.
_ALONE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _rotated(x: Column, by: int) -> Column:
    """The 64 bits of a number, turned left."""
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by % 64 else x


def _longer(rolling: str, source: str, width: int, more: int) -> Column:
    """Hashes of runs of ``width + more`` words from those of ``width`` words and, ``width`` places on, those of ``more``."""
    return F.transform(F.slice(rolling, 1, F.size(rolling) - more), lambda x, i: _rotated(x, more).bitwiseXOR(F.get(F.col(source), i + width)))


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: array of (pos, hash). Each step is a column of its own, so that none is computed twice."""
    words, hashes, rolling, grams, least = (f"_{out}_{x}" for x in ("words", "hashes", "rolling", "grams", "least"))
    bits = (window - 1).bit_length()
    apart = F.when(F.col(text).rlike(_ALONE), F.regexp_replace(text, f"({_ALONE})", " $1 ")).otherwise(F.col(text))
    df = df.withColumn(words, F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}\p{M}]+"), lambda x: x != ""))
    df = df.withColumn(hashes, F.transform(words, lambda x: F.xxhash64(x))).drop(words)
    n = F.size(hashes)
    df = df.withColumn(rolling, F.when(n >= gram, F.col(hashes)))
    width = 1
    for bit in bin(gram)[3:]:  # doubled, and one word more where the number's next binary digit is one
        for more, source in ((width, rolling), *([(1, hashes)] if bit == "1" else [])):
            longer = f"_{out}_{width + more}"
            df = df.withColumn(longer, _longer(rolling, source, width, more)).drop(rolling)
            rolling, width = longer, width + more
    rolled = F.transform(rolling, lambda x: F.shiftleft(x, bits))
    short = F.array(F.shiftleft(F.xxhash64(F.when(n > 0, F.col(hashes)), F.when(n == 0, F.col(text))), bits))
    df = df.withColumn(grams, F.when(n >= gram, rolled).when(F.col(text) == "", F.array().cast("array<long>")).otherwise(short))
    count = F.size(grams)
    parts = lambda x, i: [x + (window - 1), *[F.get(F.col(grams), i + k) + (window - 1 - k) for k in range(1, window)]]
    df = df.withColumn(least, F.transform(F.slice(grams, 1, F.when(count > window, count - (window - 1)).otherwise(F.least(count, F.lit(1)))), lambda x, i: F.least(*parts(x, i)) if window > 1 else x))
    # the next window chooses the same gram exactly if it stands one place further from its right end
    low = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1))
    chosen = F.transform(least, lambda x, i: F.struct((i + (window - 1) - low(x)).cast("int").alias("pos"), F.shiftright(x, bits).alias("hash")))
    df = df.withColumn(f"_{out}_all", chosen)
    df = df.withColumn(out, F.filter(F.col(f"_{out}_all"), lambda x, i: (i == 0) | (x["pos"] != F.get(F.col(f"_{out}_all"), i - 1)["pos"])))
    return df.drop(hashes, rolling, grams, least, f"_{out}_all")


def digest(fingerprint: str) -> Column:
    """128 bits of a fingerprint, positions included, as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), F.col(fingerprint))), 16, "0") for k in (1, 2)]))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(1.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint array of (pos int, hash long)."""
    return with_fingerprint(texts_of(docs), "text", "fingerprint").select("doc_id", "fingerprint")


_LEAST = -(1 << 63)


def _in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, key, bucket: in ascending ranges of ``key``, of about equal numbers of rows.

    The bounds are eight bytes a range; a row finds its range by bisection."""
    base = texts_of(docs).withColumn("key", F.coalesce("doc_id", F.lit(_LEAST)))
    at = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(base.agg(F.percentile_approx("key", at, 20 * buckets)).first()[0] or [])) if at else []
    step, steps = 1, []
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return base.withColumn("bucket", F.lit(0))
    one = F.broadcast(docs.sparkSession.createDataFrame([(bounds,)], "cells array<long>"))  # one row
    bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.get("cells", a + s - 1) <= F.col("key"), a + s).otherwise(a))
    return base.crossJoin(one).withColumn("bucket", bucket).drop("cells")


def followed(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """Every row with ``last`` false and, at the end of each range, a copy of the row that comes next with ``last`` true.

    So the next row of each row is in its own range, and no row leaves its range to find it."""
    buckets = buckets or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS_A_RANGE)
    base = _in_order(docs, buckets)
    heads = base.groupBy("bucket").agg(F.max("key").alias("key"))  # a row a range
    order = Window.orderBy(F.desc("bucket"))
    after = heads.select("bucket", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("next"))
    texts = base.join(F.broadcast(heads), ["bucket", "key"]).groupBy("bucket").agg(F.max("text").alias("text"))
    ends = after.join(texts.withColumnRenamed("bucket", "next"), "next").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(_LEAST).alias("key"), "bucket", F.lit(True).alias("last"))
    rows = base.withColumn("last", F.lit(False)).unionByName(ends)
    return rows, Window.partitionBy("bucket").orderBy("last", F.desc("key"), F.desc("text"))


def edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, marks: the document's chosen grams, (pos, hash).

    The edited text: the last half of the code points replaced by as many of the next document's first ones."""
    rows, order = followed(docs, buckets)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("next", F.lead("text").over(order))
    rows = rows.withColumn("edited", F.when(~F.col("last"), F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring("next", F.lit(1), F.col("half"))))).drop("next", "half")
    rows = with_fingerprint(rows, "text", "own")
    rows = rows.withColumn("set", F.array_distinct("own.hash"))
    rows = rows.withColumn("next_set", F.lead("set").over(order)).drop("text", "key", "bucket")
    rows = with_fingerprint(rows.where("not last"), "edited", "other")
    rows = rows.withColumn("edited_set", F.array_distinct("other.hash"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), digest("own").alias("fingerprint"), digest("other").alias("edited_fingerprint"),
        likeness("set", "edited_set").alias("near_edited"), likeness("set", "next_set").alias("near_next"), F.col("own").alias("marks"),
    )

