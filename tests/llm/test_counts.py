"""Prefix counts against the library, on every prefix."""

import random

import pytest
import sentencepiece

from spindrift.llm import counts
from spindrift.llm.queries import PIECE_BPE, op13_prefix_counts
from spindrift.llm.shared import tokenizer_path
from tests.llm.conftest import ODD

PATH = tokenizer_path(PIECE_BPE)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def sums(changes):
    out, n = [0], 0
    for b in changes:
        n += b - 256 * (b > 127)
        out.append(n)
    return out


def _texts():
    rng = random.Random(1)
    letters = ["ab", "etaoin shrdlu", " \t\n▁", "éèüß日本語🙂\0", "<s></s><unk><0x0A>", "aaaa    ", "0123456789.,", "ingtheration "]
    made = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return made + [w * rng.randint(1, 40) for w in ("a", " ", "▁", "ab", "the", "\n", "=", "🙂", "...", " a", "  a", "nn", "0")] + [t[:300] for t in ODD if t]


def test_every_prefix_against_the_library(library):
    p = counts.Prefixes(PATH, room=500)  # tables are cleared on the way
    for t in _texts():
        assert sums(p.of(t)) == [len(library.encode(t[:i])) for i in range(len(t) + 1)], t


def test_counts_fall_and_the_longest_prefix_is_found(spark, library):
    t = "international understanding of the representation " * 8
    s = sums(counts.Prefixes(PATH).of(t))
    assert any(a > b for a, b in zip(s, s[1:]))
    held = counts.table(spark.createDataFrame([(1, t), (2, None), (3, "x")], "doc_id long, text string"), PATH)
    for budget in (0, 1, 5, 17, 40, 10_000):
        got = {r.doc_id: r for r in counts.cuts(held, budget).collect()}
        for d, x in ((1, t), (2, ""), (3, "x")):
            own = [len(library.encode(x[:i])) for i in range(len(x) + 1)]
            k = max(i for i, n in enumerate(own) if n <= budget)
            assert (got[d].kept_chars, got[d].kept_tokens, got[d].whole) == (k, own[k], k == len(x))
    asked = spark.createDataFrame([(1, 7), (1, 7), (1, 100), (3, 2), (3, 1), (2, 0), (9, 1), (1, -1)], "doc_id long, position long")
    assert sorted(tuple(r) for r in counts.at(held, asked).collect()) == sorted([(1, 7, s[7]), (1, 100, s[100]), (3, 1, len(library.encode("x"))), (2, 0, 0)])
    n = [len(library.encode(x)) for x in (t, "", "x")]
    assert sorted(tuple(r) for r in counts.budgets(held, [0, 3, 50]).collect()) == [(b, sum(k > b for k in n), sum(min(k, b) for k in n)) for b in (0, 3, 50)]


def test_odd_rows(spark, odd, empty, library):
    got = counts.limits(counts.table(odd, PATH), 50).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 50) for r in odd.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert counts.table(empty, PATH).count() == 0


def test_long_texts(library):
    p = counts.Prefixes(PATH)
    rng = random.Random(2)
    for t in ("x" * 200_000, "".join(rng.choices("abcde", k=100_000)), " ".join(rng.choices(["word", "Wörter", "ing"], k=300_000)), " " * 100_000):
        assert sums(p.of(t))[-1] == len(library.encode(t))


def test_query_against_the_library(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op13_prefix_counts(spark, small)
    assert got.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = {d: len(library.encode(t)) for d, t in texts.items()}
    assert {r.doc_id: tuple(r[1:4]) for r in got.collect()} == {d: (len(t.encode()), n[d], n[d] > 4096) for d, t in texts.items()}
