"""URL filtering by dated lists, in DataFrame operations only.

A list is a log of entries that were added and removed at known times. The log becomes validity
intervals, [since, until), one for each stretch in which an entry is on its list. A capture is tested
against the entries that were active when it was fetched: an as-of join, made as an equality join on the
entry's key with the time inside the interval. An entry's intervals don't overlap, so a capture meets an
entry once at most.

Keys of a capture: ``d:`` with the host and each of its parent domains of two labels or more, ``u:`` with
the host and path, and with the host and the path's first segment. Keys are lower case (paths are not),
without scheme, user, port and a leading ``www.``.

An entry's intervals are gathered by key, a handful of dates each. Captures of one host may be many: keys
with more than a thousandth of all rows, a thousand keys at most, are joined by broadcast, and only the
others by a shuffle. Results are gathered by capture, never by host.

Defined results: a null url, or one without a host, meets nothing; an add of what is on the list and a
removal of what isn't change nothing; of an add and a removal at one time the add comes last, so the
entry is on the list; repeated log rows count once; rows of the log with a null key, list or time are
left out; an empty table gives an empty table, an empty log no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_URL = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)(?::\d*)?(/[^?#]*)?"


def host_of(url: str) -> Column:
    """Lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: str) -> Column:
    return F.regexp_extract(url, _URL, 2)


def keys_of(host: str, path: str) -> Column:
    """All keys that an entry for this capture may have, each once."""
    parts = F.split(F.col(host), r"\.")
    n = F.size(parts)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(parts, i, n), ".")))
    first = F.regexp_extract(F.col(path), "^/[^/]*", 0)
    return F.when(F.col(host).isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, F.array(F.concat(F.lit("u:"), F.col(host), F.col(path)), F.concat(F.lit("u:"), F.col(host), first)))))


def intervals(log: DataFrame) -> DataFrame:
    """list, key, since, until (null: still on the list) from list, key, action ('add' or 'remove'), at."""
    log = log.select("list", "key", "at", (F.col("action") == "add").alias("on")).where("list is not null and key is not null and at is not null and on is not null")
    log = log.groupBy("list", "key", "at").agg(F.max("on").alias("on"))  # repeated rows count once; an add outweighs a removal
    order = Window.partitionBy("list", "key").orderBy("at")
    turns = log.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where("on <> was")
    return turns.withColumn("until", F.lead("at").over(order)).where("on").select("list", "key", F.col("at").alias("since"), "until")


def active(captures: DataFrame, log: DataFrame) -> DataFrame:
    """page_id, host, n_active (entries), lists (their names in order, joined by commas), first_key, blocked.

    ``captures``: page_id, url, fetched_at, one row for each capture. Its row is kept whatever it meets."""
    own = captures.select("page_id", "url", "fetched_at").withColumn("host", host_of("url")).withColumn("_row", F.monotonically_increasing_id())
    keyed = own.withColumn("path", path_of("url")).select("page_id", "host", "fetched_at", "_row", F.explode_outer(keys_of("host", "path")).alias("key"))
    entry = F.struct("list", "since", "until")
    listed = intervals(log).groupBy("key").agg(F.collect_list(entry).alias("entries"))
    often = keyed.where("key is not null").groupBy("key").count()
    total = captures.count()
    none = F.array().cast(listed.schema["entries"].dataType)  # most frequent keys are on no list
    hot = F.broadcast(often.where(F.col("count") * 1000 > total).join(listed, "key", "left").select("key", F.coalesce("entries", none).alias("hot")))
    met = keyed.join(hot, "key", "left")
    # rows that have been served, and rows without a key, are spread by their number; no key looks like that
    other = F.when(F.col("hot").isNull(), F.col("key"))
    met = met.withColumn("other", F.coalesce(other, F.concat(F.lit("#"), F.col("_row").cast("string")))).join(listed.toDF("other", "entries"), "other", "left")
    now = F.col("fetched_at")
    inside = lambda e: (now >= e["since"]) & (e["until"].isNull() | (now < e["until"]))
    met = met.withColumn("hits", F.filter(F.coalesce("hot", "entries"), inside))
    n = F.coalesce(F.when(F.col("hits").isNotNull(), F.size("hits")), F.lit(0))
    found = met.groupBy("page_id", "host", "_row").agg(
        F.sum(n).alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("hits", lambda e: e["list"]))))), ",").alias("lists"),
        F.min(F.when(n > 0, F.col("key"))).alias("first_key"),
    )
    return found.select("page_id", "host", "n_active", "lists", "first_key", (F.col("n_active") > 0).alias("blocked"))


def sample_log(pages: DataFrame) -> DataFrame:
    """A dated list log made from the pages' own hosts and paths by hash, for want of a real one in the test data."""
    own = pages.select(host_of("url").alias("host"), path_of("url").alias("path")).where("host is not null").distinct()
    keys = own.select(F.explode(keys_of("host", "path")).alias("key")).distinct().withColumn("m", F.md5("key"))
    code = lambda k: F.ascii(F.substring("m", k, 1))
    keys = keys.where(code(1) % 2 == 0).withColumn("list", F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), code(7) % 3 + 1))
    day = lambda c: F.timestamp_add("DAY", c, F.lit("2024-01-01").cast("timestamp"))
    since = (code(2) * 3 + code(3)) % 300
    until = since + (code(4) * 7) % 90 + 1
    events = F.array(
        F.struct(F.lit("add").alias("action"), day(since).alias("at")),
        F.when(code(5) % 2 == 0, F.struct(F.lit("remove").alias("action"), day(until).alias("at"))),
        F.when((code(5) % 2 == 0) & (code(6) % 3 == 0), F.struct(F.lit("add").alias("action"), day(until + 20).alias("at"))),
    )
    return keys.select("list", "key", F.explode(F.array_compact(events)).alias("e")).select("list", "key", "e.action", "e.at")


def sample_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time within 2024, by page_id."""
    days, seconds = F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"), F.pmod("page_id", F.lit(86400)).cast("int")
    return pages.select("page_id", "url", F.timestamp_add("SECOND", seconds, F.timestamp_add("DAY", days, F.lit("2024-01-01").cast("timestamp"))).alias("fetched_at"))
