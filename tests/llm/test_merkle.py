"""The Merkle manifest against plain hash trees and against SQL."""

import hashlib
import zlib

import duckdb
import pytest

from spindrift.llm import merkle
from spindrift.llm.queries import ORACLES, op11_merkle_duckdb


def H(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def plain(rows):
    """The result's rows from (doc_id, text, lang, source, n_chars), one tree after the other."""

    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def siblings(tree, i):
        for nodes in tree[:-1]:
            yield nodes[i // 8 * 8 : i], nodes[i + 1 : i // 8 * 8 + 8]
            i //= 8

    langs = sorted({r[2] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for k in langs}
    trees = {k: levels([leaf(r, r[1]) for r in own[k]]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, r in enumerate(own[k]):
            path = [*siblings(trees[k], i), *siblings(top, j)]
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf(r, text)
            for a, b in path:
                h = H(*a, h, *b)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], H(*[x for a, b in path for x in a + b]), h, h == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def returned(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd_rows():
    texts = ["", None, "Plain", "ÀÉ Ünï", "ABC\n", "日本", "same"]
    langs = [None, "", "en", "de", "é", "zz", "EN", "fr", "es", "xx", "yy"]
    rows = [(i, texts[i % 7], "en" if i % 3 else langs[i % 11], None if i % 5 == 0 else f"s{i % 4}", None if i % 6 == 0 else i) for i in range(300)]
    return rows + [(5, "same", "en", "s", 1)] * 40 + [(None, "NO ID", "en", None, None)] * 3 + [(7, "Long. " * 300_000, "de", "s", 2), (-12, "Below ZERO", "en", "s", 3)]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_against_plain_trees(spark, odd_rows, depth):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as place", "'t' as tree", "2 as n", "3 as part", "'x' as leaf")
    assert returned(merkle.manifest(df, depth)) == plain(odd_rows)


def test_lone_leaf_empty_table_missing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = [(4, "A b", "en", "s", 3)]
    assert returned(merkle.manifest(spark.createDataFrame(one, schema))) == plain(one)
    assert returned(merkle.manifest(spark.createDataFrame([], schema))) == []
    assert returned(merkle.manifest(spark.createDataFrame([(1, "x"), (2, "Y")], "DOC_ID long, Text string"))) == plain([(1, "x", None, None, None), (2, "Y", None, None, None)])


def test_every_change_is_found(spark, odd_rows):
    """A leaf that changes doesn't fold to the root; one that doesn't does."""
    for r in merkle.manifest(spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")).collect():
        assert r.verified == (r.folded_root == r.root)


def test_query_against_plain_trees_and_sql(spark, small, odd_rows):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = returned(op11_merkle_duckdb(spark, small))
    assert got == plain(rows) and 0 < sum(r[-1] for r in got) < len(got)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", odd_rows)
    rel = con.sql(ORACLES["op11_merkle_duckdb"])
    assert sorted(rel.select(*[duckdb.ColumnExpression(c) for c in COLUMNS]).fetchall(), key=repr) == plain(odd_rows)
