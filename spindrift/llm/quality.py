"""Document quality by attention over passages (multiple-instance learning).

A text is a bag of passages of 64 words. Every passage is encoded from its characters, from statistics of its
words and from the words themselves (hashed to ``HASHED`` cells), by a layer that is learned; a gated attention (a tanh branch times a sigmoid branch) weighs the passages; the
weighted mean of their encodings gives the score. All weights are learned from labels of documents, on
the driver, from a bounded sample (``labelled.SAMPLE`` documents a class); every text is scored whole.

Every text is scored by matrix products of its own passages alone, so equal texts have equal scores whatever
else is in a batch.

Defined results: a null or empty text is a bag of one passage without words and gets the score that the
model gives it; an empty table gives an empty table; equal texts, repeated rows among them, have equal
scores; texts of any length are scored whole; without a label of one of the classes every score is 0.5;
columns other than doc_id and text are left out by score() and kept by keep().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import labelled
from spindrift.llm.shared import arrow_stage, keep_rows, texts_of
from spindrift.llm.words import BY_SPACE, Words, groups, slices

PASSAGE = 64
#: Classes of bytes: upper case, lower case, digits, blanks, line ends, other controls, beyond ASCII; then each ASCII sign.
_CLASS = np.full(256, 5, np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = 6 if _c > 127 else 0 if _s.isupper() else 1 if _s.islower() else 2 if _s.isdigit() else 3 if _s == " " else 4 if _s == "\n" else 5
for _k, _c in enumerate(c for c in range(33, 127) if not chr(c).isalnum()):
    _CLASS[_c] = 7 + _k
_N = int(_CLASS.max()) + 1
#: Cells of the hashed words of a passage.
HASHED = 128
WIDTH = _N + 6 + HASHED


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, index of each text's first passage; then the number of passages)."""
    w = Words(texts, BY_SPACE)
    count = np.diff(w.first)
    own = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(own)])
    nth = np.arange(len(w.start)) - w.first[w.doc]
    of_word = first[w.doc] + nth // PASSAGE
    # a passage's bytes run from its first word (or the text's start) to the next passage's
    begin = np.full(first[-1], -1, np.int64)
    heads = np.flatnonzero(nth % PASSAGE == 0)
    begin[of_word[heads]] = w.start[heads]
    begin[first[:-1]] = w.bounds[:-1]
    size = np.diff(begin, append=len(w.data))
    of_byte = np.repeat(np.arange(first[-1]), size)
    n = first[-1]
    chars = np.bincount(of_byte * _N + _CLASS[w.data], minlength=n * _N).reshape(n, _N)
    words = np.bincount(of_word, minlength=n)
    length = (w.end - w.start).astype(np.float64)
    mean = np.bincount(of_word, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, length**2, n) / np.maximum(words, 1) - mean**2))
    same = np.zeros(len(w.start), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((w.hash, of_word))
    h, p = w.hash[order], of_word[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(p[fresh], minlength=n)
    total = np.maximum(words, 1)
    hashed = np.bincount(of_word * HASHED + (w.hash % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    more = [np.log1p(words), mean, spread, np.bincount(of_word, same, n) / total, distinct / total, np.log1p(size)]
    return np.column_stack([np.sqrt(chars / np.maximum(size, 1)[:, None]), *more, np.sqrt(hashed / total[:, None])]).astype(np.float32), first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights by name, and the means and spreads that features are scaled by."""

    def __init__(self, mean, spread, weights: dict):
        self.mean, self.spread, self.weights = mean, spread, weights

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def forward(self, x: np.ndarray, first: np.ndarray):
        """(scores of the bags, what gradients() needs) from scaled features."""
        k, at = self.weights, first[:-1]
        bag = np.repeat(np.arange(len(at)), np.diff(first))
        h = np.tanh(x @ k["enc"] + k["enc0"])
        t, g = np.tanh(h @ k["tan"]), _sigmoid(h @ k["gate"])
        e = (t * g) @ k["att"]
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        return _sigmoid(z @ k["out"] + k["out0"][0]), (x, h, t, g, a, z, bag, at)

    def attention(self, texts: list[str]) -> list[np.ndarray]:
        """Weights of each text's passages."""
        x, first = passages(texts)
        a = self.forward(self.scaled(x), first)[1][4]
        return np.split(a, first[1:-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        """One product a text, as the last digits of a matrix product depend on what else is in the matrix."""
        k = self.weights
        x, first = passages(texts)
        x, out = self.scaled(x), np.empty(len(texts))
        for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
            h = np.tanh(x[a:b] @ k["enc"] + k["enc0"])
            e = (np.tanh(h @ k["tan"]) * _sigmoid(h @ k["gate"])) @ k["att"]
            e = np.exp(e - e.max())
            out[i] = (e / e.sum()) @ (h @ k["out"])
        return _sigmoid(out + k["out0"][0])

    def gradients(self, kept, error: np.ndarray) -> dict:
        """Of the mean cross-entropy; ``error``: (score - label) / number of bags."""
        x, h, t, g, a, z, bag, at = kept
        k = self.weights
        dz = error[:, None] * k["out"][None]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, at)[bag])
        dt, dg = de[:, None] * k["att"] * g * (1 - t**2), de[:, None] * k["att"] * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ k["tan"].T + dg @ k["gate"].T) * (1 - h**2)
        return {"out": z.T @ error, "out0": np.array([error.sum()]), "att": (t * g).T @ de, "tan": h.T @ dt, "gate": h.T @ dg, "enc": x.T @ dh, "enc0": dh.sum(0)}


def fit(texts: list[str], labels: list[int], hidden: int = 16, gates: int = 8, steps: int = 150, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Model | None:
    """Adam over all bags at once; None where a class is missing."""
    if len(set(labels)) < 2:
        return None
    parts = [passages(texts[a:b]) for a, b in slices(texts)]
    x, first = np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
    y, rng = np.array(labels, np.float64), np.random.default_rng(seed)
    shapes = {"enc": (WIDTH, hidden), "enc0": (hidden,), "tan": (hidden, gates), "gate": (hidden, gates), "att": (gates,), "out": (hidden,), "out0": (1,)}
    m = Model(x.mean(0), x.std(0) + 1e-3, {k: rng.normal(size=s) / np.sqrt(s[0]) if k[-1] != "0" else np.zeros(s) for k, s in shapes.items()})
    one, two = {k: 0.0 for k in shapes}, {k: 0.0 for k in shapes}
    x = m.scaled(x)
    for step in range(1, steps + 1):
        p, kept = m.forward(x, first)
        for k, d in m.gradients(kept, (p - y) / len(y)).items():
            d = d + decay * m.weights[k]
            one[k] = 0.9 * one[k] + 0.1 * d
            two[k] = 0.999 * two[k] + 0.001 * d * d
            m.weights[k] = m.weights[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most: int = labelled.SAMPLE) -> Model | None:
    return fit(*labelled.sample(docs, labels, "quality", folds, held_out, most))


def score(docs: DataFrame, model: Model | None, folds: int = 5, held_out: int = 0, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (of label 1), predicted: 1 if score >= ``least``."""

    def rows(batches):
        for ids, texts in groups(batches):
            s = np.full(len(texts), 0.5) if model is None else model.scores(texts)
            yield from zip([d for (d,) in ids], s.tolist())

    scored = arrow_stage(texts_of(docs), rows, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(labelled.remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The documents whose quality score is at least ``least``, a null text scored as an empty one; all of them without a model."""
    return docs if model is None else keep_rows(docs, lambda texts: model.scores(texts) >= least)
