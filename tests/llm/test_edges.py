"""Very long texts and columns whose names operators use inside, for every operator and stage."""

import hashlib
import random
import zlib

import pytest

import corpus_pipeline
from spindrift.llm import bpe, grammar, lines, media, neardup, packing, quality, queries, shared, toxicity, units, winnow
from spindrift.llm.shared import tokenizer_path

WORD, BYTE = tokenizer_path(queries.WORD_BPE), tokenizer_path(queries.BYTE_BPE)


def _text(megabytes, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    return "".join(rng.choice(words) + (" " if rng.random() < 0.95 else "\n") for _ in range(megabytes * 160_000))


@pytest.fixture(scope="module")
def long(spark):
    """A text of 5 MB, one that differs by a word, one line of 1 MB, a word of 200,000 letters; and clashing columns."""
    t = _text(5, 1)
    rows = [(1, t), (2, t[:1000] + "changed " + t[1000:]), (3, "x" * 200_000), (4, _text(1, 2).replace("\n", " ")), (5, "short"), (6, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"doc_id as `{c}`" for c in ("_id", "_keys", "_h", "_words", "_filter", "_at", "_maybe", "key", "node", "label", "shard", "part", "bucket", "cells", "last")])


@pytest.fixture(scope="module")
def models():
    texts = ["a nice text about birds " * 5 if i % 2 else "SPAM!! idiot!! " * 9 for i in range(40)]
    return quality.fit(texts, [i % 2 for i in range(40)], steps=20), toxicity.fit(texts, [1 - i % 2 for i in range(40)])


def test_tokens_of_long_texts(long):
    want = {r.doc_id: r.text or "" for r in long.select("doc_id", "text").collect()}
    t = units.load(BYTE)
    ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in want.items()}
    got = {r.doc_id: r for r in grammar.read(grammar.write(long, BYTE)).collect()}
    assert {d: r.n_tokens for d, r in got.items()} == {d: len(i) + 1 for d, i in ids.items()}
    pieces = packing.pack(long, BYTE).collect()
    assert {d: sum(p.length for p in pieces if p.doc_id == d) for d in ids} == {d: len(i) + 1 for d, i in ids.items()}
    w = units.load(WORD)
    for r in bpe.digests(long, WORD).collect():
        own = w.encode(want[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(w.decode(own, skip_special_tokens=False).encode()).hexdigest()


def test_other_operators_on_long_texts(long, models):
    texts = {r.doc_id: r.text or "" for r in long.select("doc_id", "text").collect()}
    for r in media.digests(long).collect():
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    marks = {r.doc_id: r for r in winnow.edited(long).collect()}
    assert len(marks) == 6 and marks[1].n_chars == len(texts[1]) and len(marks[1].marks) > 100_000 and marks[2].near_next > 0.99
    q, t = models
    for m, module in ((q, quality), (t, toxicity)):
        assert module.score(long, m).count() == 6
        assert module.keep(long, m).columns == long.columns
    kept = lines.dedup(long).drop("n_lines", "n_dropped")
    assert kept.columns == long.columns and {r.doc_id: r.text or "" for r in kept.select("doc_id", "text").collect()} == texts
    assert sorted(map(tuple, neardup.classes(long).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)]
    one = neardup.one_of_each(long)
    assert one.columns == long.columns and sorted(r.doc_id for r in one.select("doc_id").collect()) == [1, 3, 4, 5, 6]


def test_stages_on_long_texts(spark, long, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, long, small)
        if name != "packing":
            assert out.columns == long.columns, name
        assert out.count() >= 1, name


def test_joins_by_a_filter(spark):
    rows = spark.range(1000).selectExpr("if(id % 100 = 7, null, id) as doc_id", "id as _id", "id as _at").withColumnRenamed("_at", "_maybe")
    ids = shared.stored(spark.range(0, 1000, 3).toDF("x"))
    there, gone = (f(rows, "doc_id", ids) for f in (shared.semi_join, shared.anti_join))
    assert there.columns == gone.columns == rows.columns
    assert sorted(r.doc_id for r in there.collect()) == [i for i in range(0, 1000, 3) if i % 100 != 7]
    assert there.count() + gone.count() == 1000 and gone.where("doc_id is null").count() == 10
    assert shared.semi_join(rows, "doc_id", shared.stored(ids.limit(0))).count() == 0
    shared.discard(ids)


def test_stages_keep_all_columns_and_repeated_rows(spark):
    """drop_lines on repeated rows, null and empty texts, other spellings, and columns with the operator's names."""
    line = "a line of more than forty characters that several documents have"
    rows = [(i, f"{line}\nown {i}", 7, "n", i) for i in range(6)] + [(5, f"{line}\nown 5", 7, "n", 5), (7, None, 7, None, 0), (8, "", 7, "n", 9)]
    docs = spark.createDataFrame(rows, "DOC_ID long, Text string, n_lines int, n_dropped string, N_CHARS long")
    out = corpus_pipeline.drop_lines(spark, docs, "")
    assert out.columns == docs.columns and out.schema["n_lines"].dataType == docs.schema["n_lines"].dataType
    want = [(i, f"own {i}", 7, "n", len(f"own {i}")) for i in range(5)] + [(5, f"{line}\nown 5", 7, "n", len(line) + 6)] * 2 + [(7, None, 7, None, 0), (8, "", 7, "n", 0)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    plan = lines.LineIndex.build(docs).drops()._jdf.queryExecution().toString()
    assert "Join Inner, (key" not in plan and "[key" not in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x)


def test_models_keep_rows_as_they_are(spark, models):
    rows = [(1, "SPAM!! idiot!! " * 9, "x"), (2, None, None), (3, "", "y"), (2, None, None), (4, "a nice text about birds " * 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    q, t = models
    got = sorted(map(repr, map(tuple, toxicity.keep(docs, t).collect())))
    assert got == sorted(map(repr, rows[1:]))
    assert toxicity.keep(docs.limit(0), t).count() == 0 and quality.keep(docs, q).columns == docs.columns
