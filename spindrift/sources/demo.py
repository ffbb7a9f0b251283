"""A small bilingual table to try things on: topics in English and Arabic, the same rows every time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = {
    "gardens": ("soil seeds water roses shade pruning", "تربة بذور ماء ورد ظل تقليم"), "trains": ("rails station ticket platform signal timetable", "سكة محطة تذكرة رصيف إشارة جدول"),
    "cooking": ("oven flour butter onions simmer spices", "فرن طحين زبدة بصل غليان توابل"), "stars": ("telescope orbit galaxy comet eclipse planet", "تلسكوب مدار مجرة مذنب كسوف كوكب"),
    "money": ("budget savings interest invoice account tax", "ميزانية ادخار فائدة فاتورة حساب ضريبة"),
}


def articles(spark: SparkSession, rows: int = 400) -> DataFrame:
    """key, text, lang, topic: six words of a topic in an order drawn by hash, languages in turn."""
    names = sorted(TOPICS)
    words = F.array(*[F.array(*[F.split(F.lit(t), " ") for t in TOPICS[n]]) for n in names])
    base = spark.range(rows).select(F.col("id").alias("key"), (F.floor(F.col("id") / 2) % len(names)).cast("int").alias("n"), (F.col("id") % 2).cast("int").alias("l"))
    drawn = F.array_sort(F.transform(F.get(F.get(words, F.col("n")), F.col("l")), lambda w: F.struct(F.md5(F.concat(w, F.col("key").cast("string"))).alias("h"), w.alias("w"))))
    return base.select("key", F.concat(F.array_join(F.transform(drawn, lambda x: x["w"]), " "), F.lit(" "), F.col("key").cast("string")).alias("text"), F.when(F.col("l") == 0, "en").otherwise("ar").alias("lang"), F.get(F.array(*map(F.lit, names)), F.col("n")).alias("topic"))
