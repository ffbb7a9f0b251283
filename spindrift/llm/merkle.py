"""A Merkle manifest of documents: hash trees of eight children a node, one for each language and one over their roots.

Leaves are hashed by Spark where they are read, so texts move nowhere. They are sorted by (language, doc_id)
over range partitions, and their places in their tree come from the partitions' counts: no language meets in
one task. Eight to the power ``depth`` consecutive leaves are an aligned bucket, whose hashes depend on no
other bucket. DuckDB works through each bucket's Arrow table in an executor: a level is one ordered
string_agg by runs of eight, and sha256. Spark combines the buckets' roots, a join or grouping by run a level,
eight rows a key at most, and hands each bucket the siblings above it. A second look at the bucket then makes each document's
proof, and folds the tampered leaf up to the root.

Defined results: a null field of a leaf is ``-``; an empty text is ``0:``; a null language is a tree of its own, before all others;
rows without doc_id come first in their tree, and are never tampered with; rows of one doc_id are in the
order of their leaves, so that repeated rows are leaves as often as they stand there; an empty table gives an
empty table; columns other than the five hashed are left out, a missing one of these counts as null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import discard, numbered, stored

#: Children of a node.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hashed(text: Column, columns: list[str]) -> Column:
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    have = {c.lower() for c in columns}
    values = [F.col(n).cast("string") if n in have else F.lit(None).cast("string") for n in FIELDS[:-1]]
    return F.sha2(F.concat(*[field(v) for v in values], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (of its language, null's first in order), leaf, and the leaf of the tampered row, null where nothing changes."""
    have = {c.lower() for c in docs.columns}
    text = F.col("text").cast("string") if "text" in have else F.lit(None).cast("string")
    lower = F.translate(text, UPPER, LOWER)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & (lower != text)
    lang = F.col("lang").cast("string") if "lang" in have else F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), lang), F.lit("")).alias("tree"), _hashed(text, docs.columns).alias("leaf"),
        F.when(tampered, _hashed(lower, docs.columns)).alias("other"),
    )


def _height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def _climb(con, height: int) -> None:
    """In table ``own`` (place, leaf, folded, inner_): each level's siblings are added to ``inner_``, and ``folded`` is hashed with them.

    Table ``node`` (place, h) ends as the nodes of level ``height``."""
    con.execute("create or replace temp table node as select place, leaf as h from own")
    for level in range(height):
        below, run = FAN**level, FAN ** (level + 1)
        con.execute(f"create or replace temp table run as select place // {FAN} as place, string_agg(h, '' order by place) as hs from node group by 1")
        con.execute(
            f"""create or replace temp table own as select * exclude (l, r) replace (inner_ || l || r as inner_, sha256(l || folded || r) as folded) from (
            select own.*, substr(hs, 1, 64 * (own.place // {below} % {FAN})) as l, substr(hs, 64 * (own.place // {below} % {FAN}) + 65) as r from own join run on own.place // {run} = run.place)"""
        )
        con.execute("create or replace temp table node as select place, sha256(hs) as h from run")


def _engine():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": "", "preserve_insertion_order": False})
    con.execute("set timezone = 'UTC'")
    return con


def _bucket_root(rows: pa.Table) -> pa.Table:
    """tree, bucket, place (of the bucket), n, h: the root of one bucket's leaves."""
    con, first = _engine(), rows.slice(0, 1).to_pylist()[0]
    con.register("given", rows)
    con.execute("create temp table node as select place - min(place) over () as place, leaf as h from given")
    for _ in range(first["height"]):
        con.execute(f"create or replace temp table node as select place // {FAN} as place, sha256(string_agg(h, '' order by place)) as h from node group by 1")
    ((h,),) = con.execute("select h from node").fetchall()
    con.close()
    return pa.table({"tree": [first["tree"]], "place": pa.array([first["bucket"]], pa.int64()), "n": pa.array([first["n_buckets"]], pa.int64()), "h": [h]})


def _proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
    """The result for one bucket's documents; ``above``: its siblings up to the root, from below."""
    con, height = _engine(), rows["height"][0].as_py()
    (up,) = above.to_pylist()
    con.register("given", rows)
    con.execute("create temp table own as select doc_id, leaf, place - min(place) over () as place, coalesce(other, leaf) as folded, '' as inner_ from given")
    _climb(con, height)
    folded = "folded"
    args: list[str] = []
    for s in up["path"]:
        folded = f"sha256(? || {folded} || ?)"
        args = [s["l"], *args, s["r"]]
    siblings = "".join(s["l"] + s["r"] for s in up["path"])
    out = con.sql(
        f"select doc_id, leaf, ?::varchar as subroot, ?::varchar as root, sha256(inner_ || ?) as proof_sha256, {folded} as folded_root, folded_root = ? as verified from own",
        params=[up["subroot"], up["root"], siblings, *args, up["root"]],
    ).to_arrow_table()
    con.close()
    return out.cast(pa.schema([(n, pa.int64() if n == "doc_id" else pa.bool_() if n == "verified" else pa.string()) for n in out.column_names]))


def combined(nodes: DataFrame) -> DataFrame:
    """For nodes (tree, place, n: nodes of the tree, h): tree, place, top (the tree's root), path (array of l, r: the siblings at each level, from below).

    Levels are made by runs, then the siblings go down from the top, each node's to its eight children, so no key has more rows than that."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    level = F.col("place").cast("long")
    levels, now, n = [], nodes.select("tree", "place", "n", "h"), most
    while n > 1:
        runs = now.where("n > 1").groupBy("tree", F.expr(f"place div {FAN}").alias("run"), "n").agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("own"))
        runs = stored(runs.select("tree", "run", "n", F.array_join("own.h", "").alias("hs"), F.size("own").alias("size"), F.col("own")[0]["place"].alias("first")))
        levels.append((now, runs))
        done = now.where("n = 1")
        now = runs.select("tree", F.col("run").alias("place"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.sha2("hs", 256).alias("h")).unionByName(done)
        n = -(-n // FAN)
    path = "array<struct<l: string, r: string>>"
    out = now.select("tree", level.alias("place"), F.col("h").alias("top"), F.array().cast(path).alias("path"))
    for below, runs in reversed(levels):
        own = runs.select("tree", F.col("run"), F.explode(F.expr("sequence(0, size - 1)")).alias("i"), "hs", "first")
        own = own.select("tree", "run", (F.col("first") + F.col("i")).alias("place"), F.struct(F.expr("substring(hs, 1, 64 * i)").alias("l"), F.expr("substring(hs, 64 * i + 65)").alias("r")).alias("s"))
        alone = below.where("n = 1").select("tree", "place")
        parents = out.withColumnRenamed("place", "run")
        out = own.join(parents, ["tree", "run"]).select("tree", "place", "top", F.concat(F.array("s"), "path").cast(path).alias("path")).unionByName(alone.join(out, ["tree", "place"]).select("tree", "place", "top", "path"))
    return stored(out)


def manifest(docs: DataFrame, depth: int = 4) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document. Buckets have 8 ** ``depth`` leaves."""
    per, given = FAN**depth, leaves(docs)
    # what a leaf's place needs is stored once; both looks at the buckets read it
    own = stored(numbered(given, "tree", ["doc_id", "leaf"], row_bytes=250))
    placed = own.select(
        "doc_id", "tree", "leaf", "other", "place", F.expr(f"place div {per}").alias("bucket"), F.expr(f"(n + {per - 1}) div {per}").alias("n_buckets"),
        F.when(F.col("n") > per, F.lit(depth)).otherwise(sum((F.col("n") > FAN**k).cast("int") for k in range(depth))).alias("height"),
    )
    roots = stored(placed.select("tree", "bucket", "n_buckets", "height", "place", "leaf").groupBy("tree", "bucket").applyInArrow(_bucket_root, "tree string, place long, n long, h string"))
    inner = combined(roots)
    tops = numbered(inner.where("place = 0").select("tree", F.col("top").alias("h"), F.lit("").alias("all")), "all", ["tree"], row_bytes=250)
    outer = combined(tops.select(F.col("all").alias("tree"), "place", "n", "h")).select("place", F.col("top").alias("root"), F.col("path").alias("rest"))
    trees = tops.select("tree", "place", F.col("h").alias("subroot")).join(outer, "place").drop("place")
    above = stored(inner.select("tree", F.col("place").alias("bucket"), "path").join(trees, "tree").select("tree", "bucket", "subroot", "root", F.concat("path", "rest").alias("path")))
    discard(roots, inner)
    needed = placed.select("doc_id", "tree", "bucket", "height", "place", "leaf", "other")
    return needed.groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket")).applyInArrow(_proofs, RESULT)
