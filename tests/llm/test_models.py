"""Classifiers: gradients, held-out accuracy, awkward inputs."""

import math
import random
import zlib

import numpy as np
import pytest

from spindrift.llm import labelled, quality, queries, toxicity
from tests.llm.conftest import ODD

MEDIUM = "/root/testdata/sf0.1"


def truth(spark, column, sf=MEDIUM):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", column).collect()}


def check_held_out(rows, labels, folds, fold, least):
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(own) > 500 and sum(a == b for a, b in own) / len(own) >= least
    return own


def test_quality_held_out(spark):
    rows = queries.op2_quality_attention(spark, MEDIUM).collect()
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    check_held_out(rows, truth(spark, "quality"), 5, 0, 0.98)


def test_toxicity_held_out(spark):
    rows = queries.op7_toxicity_zstd(spark, MEDIUM).collect()
    own = check_held_out(rows, truth(spark, "toxic"), 4, 2, 0.93)
    assert sum(a for a, b in own if b) / sum(b for _, b in own) > 0.9
    assert sum(a for a, b in own if not b) / sum(not b for _, b in own) < 0.04


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", MEDIUM])
def test_both_dictionaries_are_trained_on_whole_windows(spark, monkeypatch, sf):
    import zstandard

    calls, real = [], zstandard.train_dictionary

    def spy(size, samples, **more):
        d = real(size, samples, **more)
        calls.append((list(samples), d.as_bytes()))
        return d

    monkeypatch.setattr(zstandard, "train_dictionary", spy)
    texts, y = labelled.sample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "toxic", 4, 2)
    m = toxicity.fit(texts, y)
    (ordinary, base), (toxic, before) = calls[-2:]
    for label, samples in ((0, ordinary), (1, toxic)):
        words = [toxicity.Spelled([t]).codes.tobytes() for t, v in zip(texts, y) if v == label]
        windows = {w[i : i + 16 * toxicity.WINDOW] for w in words for i in range(0, len(w), 16 * toxicity.WINDOW)}
        assert windows == set(samples)
    assert m.ordinary == base and len(base) > 10_000
    # pruning only takes away: what is left stands in the trained dictionary, in its order
    for k in range(0, len(m.toxic) - 8, 8):
        assert any(m.toxic[k + j : k + j + 8] in before for j in range(8))
    assert 200 < len(m.toxic) < len(before)


def test_few_windows_and_none():
    assert toxicity.trained([], 4096) == b""
    assert 0 < len(toxicity.trained([b"abcdefgh" * 2], 4096)) <= 4096
    m = toxicity.fit(["!!!", "one two", "", "idiot idiot"], [1, 0, 0, 1])
    assert m is not None and len(m.scores(["", "idiot", "x"])) == 3


def test_toxicity_by_plain_loops():
    """Windows, compressed lengths, evidence and scores against a loop over words."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    bad, common = [word() + "x" for _ in range(9)], [word() for _ in range(300)]
    texts = [" ".join(rng.choice(bad) if k % 2 and rng.random() < 0.1 else rng.choice(common) for _ in range(rng.randint(20, 200))) for k in range(300)]
    m = toxicity.fit(texts, [k % 2 for k in range(300)])

    def symbols(w):
        own = toxicity.Spelled([w]).codes
        assert len(own) == 1
        return own[0].tobytes()

    table = {w: symbols(w) for w in bad + common}
    got = m.scores([*texts, "", *texts[:3]])
    for t, s in zip([*texts, "", *texts[:3]], got):
        own, total, n = t.split(), 0.0, 0
        for i in range(0, len(own), toxicity.WINDOW):
            w = b"".join(table[x] for x in own[i : i + toxicity.WINDOW])
            shorter = len(toxicity._compressor(b"\0" * len(m.toxic) + m.ordinary).compress(w)) - len(toxicity._compressor(m.toxic + m.ordinary).compress(w)) if n < 3 else int(m.gains([w])[0])
            total, n = total + max(0, shorter - m.threshold), n + 1
        z = m.weights[0] * math.log1p(total) + m.weights[1] * math.log1p(n) + m.weights[2]
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-9
    assert got[:3].tolist() == got[-3:].tolist()
    assert sum((got[k] >= 0.3) == k % 2 for k in range(300)) > 290


def test_quality_by_plain_loops():
    good, bad = "the quick brown fox jumps over lazy dogs " * 20, "BUY!! NOW!! " * 100
    texts = [good, bad, good + bad, "", "x"] * 2
    m = quality.fit(texts, [1, 0, 1, 0, 1] * 2, steps=30)
    x, first = quality.passages(texts)
    k = {n: v.tolist() for n, v in m.weights.items()}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    columns = lambda w: list(zip(*w))
    got = m.scores(texts)
    for i in range(5):
        hs, es = [], []
        for row in x[first[i] : first[i + 1]]:
            own = [min(6, max(-6, (v - mu) / sd)) for v, mu, sd in zip(row.tolist(), m.mean.tolist(), m.spread.tolist())]
            h = [math.tanh(dot(own, c) + b) for c, b in zip(columns(k["enc"]), k["enc0"])]
            es.append(dot([math.tanh(dot(h, c)) * sigmoid(dot(h, g)) for c, g in zip(columns(k["tan"]), columns(k["gate"]))], k["att"]))
            hs.append(h)
        weights = [math.exp(e - max(es)) for e in es]
        z = [sum(a / sum(weights) * h[j] for a, h in zip(weights, hs)) for j in range(len(hs[0]))]
        assert abs(sigmoid(dot(z, k["out"]) + k["out0"][0]) - got[i]) < 1e-5
    assert np.allclose(m.forward(m.scaled(x), first)[0], got, atol=1e-6)


def test_equal_texts_have_equal_scores_in_any_batch():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdeABC!", k=5)) for _ in range(rng.randint(0, 700))) for _ in range(60)]
    m = quality.fit(texts, [k % 2 for k in range(60)], steps=20)
    alone = [m.scores([t])[0] for t in texts]
    assert m.scores(texts).tolist() == alone and m.scores(texts[::-1]).tolist() == alone[::-1]


def test_samples_of_long_texts_are_slices_of_the_whole(spark):
    text = " ".join(f"w{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (2, "short"), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    texts, _ = labelled.sample(docs, labels, "toxic", 1000, 1001)
    (long,) = [t for t in texts if len(t) > 10]
    assert sorted(len(t) for t in texts)[:2] == [0, 5] and len(texts) == 3 and len(long) <= labelled.LONGEST + 8
    assert long.startswith("w0 ") and long.endswith("w39999") and "w20" in long


def test_quality_gradients_and_attention():
    good, bad = "the quick brown fox jumps over lazy dogs " * 20, "BUY!! NOW!! " * 100
    texts, y = [good, bad, good + bad, "", "x"] * 2, np.array([1, 0, 1, 0, 1] * 2, float)
    m = quality.fit(texts, y.astype(int).tolist(), steps=30)
    x, first = quality.passages(texts)
    p, kept = m.forward(m.scaled(x), first)
    g = m.gradients(kept, (p - y) / len(y))
    for name, w in m.weights.items():
        at = (0,) * w.ndim
        was = w[at]
        loss = []
        for step in (1e-5, -1e-5):
            w[at] = was + step
            q = m.forward(m.scaled(x), first)[0]
            loss.append(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
        w[at] = was
        assert abs((loss[0] - loss[1]) / 2e-5 - g[name][at]) < 1e-4
    assert all(abs(a.sum() - 1) < 1e-9 for a in m.attention(texts))


def test_passages_hold_the_whole_text():
    texts = [t or "" for t in ODD] + ["w " * 1000]
    x, first = quality.passages(texts)
    assert (np.diff(first) >= 1).all() and first[-1] - first[-2] == -(-1000 // quality.PASSAGE)
    one = [quality.passages([t])[0] for t in texts]
    assert np.allclose(np.concatenate(one), x)


def test_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    base = spark.createDataFrame([(i, "a nice text about birds " * 5 if i % 2 else "SPAM!! idiot!! " * 9) for i in range(40)], "doc_id long, text string")
    for module in (quality, toxicity):
        m = module.train(base, labels)
        rows = module.score(odd, m).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 3}) == 1
        assert module.score(empty, m).count() == 0 and module.keep(empty, m).columns == odd.columns
        assert module.train(empty, labels) is None and module.train(base, labels.limit(0)) is None
        assert module.score(odd, None).count() == odd.count() and module.keep(odd, None).count() == odd.count()
        kept = {(r.doc_id, r.text) for r in module.keep(odd, m).select("doc_id", "text").collect()}
        scores = {r.doc_id: r.predicted for r in rows}
        assert all(scores[d] == (1 if module is quality else 0) for d, _ in kept)
    s = {r.doc_id: r.score for r in quality.score(base, quality.train(base, labels)).collect()}
    assert min(v for k, v in s.items() if k % 2) > max(v for k, v in s.items() if not k % 2)


def test_compression_tells_known_words():
    rng = np.random.default_rng(0)
    own = rng.integers(1 << 60, size=(30, 2), dtype=np.uint64)
    m = toxicity.Model(own.tobytes().rjust(1024, b"\0"), bytes(toxicity.ORDINARY))
    other = rng.integers(1 << 60, size=(12, 2), dtype=np.uint64)
    one, two, stem = other.copy(), other.copy(), other.copy()
    one[4] = two[4] = stem[4] = own[6]
    two[8], stem[8, 0] = own[2], own[2, 0]
    none, first, both, half = m.gains([x.tobytes() for x in (other, one, two, stem)]).tolist()
    assert none == 0 and first >= 5 and both - first >= 10 and 2 <= half - first < both - first
