"""Documents with the awkward cases every operator must stand."""

import pytest

ODD = [
    "", None, " ", "\n\n", "a", "It's <|endoftext|> and<|startoftext|>so", "Ünïcödé — naïve ‘quotes’ … 日本語のテキスト مرحبا", "étude café x̸≠", "a\x1cb\x85c d e\x0bf",
    "don't we'll I'm 'sab ''s 12345 v2.0 a1b2 ###!!!", "  two  spaces \n new\n\n\nlines\t tabs ", "x" * 5000, "!!!" * 300, "Σίσυφος ΟΔΟΣ İstanbul", "🙂🙃 emoji 👩‍👩‍👧 end", "z " * 3000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated rows, a null id, and columns whose names clash with results."""
    rows = [(i, t, "en", "src0", 7) for i, t in enumerate(ODD)] + [(3, "\n\n", "en", "src0", 7), (None, "no id here", "de", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as n_tokens", "'x' as score", "2L as start")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
