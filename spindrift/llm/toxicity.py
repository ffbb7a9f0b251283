"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into windows
of twelve words, and each window is compressed twice: with the ordinary dictionary alone, and with the
toxic one before it. The second length is the shorter one where the window says what toxic text says and
ordinary text doesn't. The score is a logistic function of how far, over all windows of the text, that
gain exceeds a threshold, and of the number of windows, as chance gains grow with it. Threshold, logistic
function and the making of the toxic dictionary are calibrated on documents that no dictionary has seen;
then the dictionaries are trained again on all documents of the sample.

What is compressed is spelled with sixteen bytes for each word: eight that stand for its first letters,
eight for the whole word. In plain letters a pointer into a dictionary costs zstandard about as much as a
short word, so a known word would save nothing, and words that share syllables with toxic ones would save
as much (measured). Spelled so, a window's first known word saves six bytes, a further one twelve, and a known
stem four beside a known word.

Both dictionaries come from zstandard's own trainer, which gets every distinct window of its class whole. A document's label doesn't
say which of its words are toxic, and most are not; the trainer puts what toxic text repeats into the dictionary,
ordinary words among it. So the trained dictionary is pruned by compression: all windows of both classes are compressed
with both dictionaries, and of the toxic one those entries stay that stand in toxic windows which it shortened,
three at least, ``ODDS`` times as often a document as in ordinary windows which it shortened. Size before pruning and odds are calibrated too.

Dictionaries are fitted on the driver to a bounded sample of labelled documents (``labelled.SAMPLE`` a
class, of each at most ``labelled.LONGEST`` characters in slices of the whole); every text is scored whole.

Defined results: a null or empty text has no windows, so no evidence; an empty table gives an empty
table; equal texts, repeated rows among them, have equal scores; texts of any length are scored whole;
without a label of one of the classes every score is 0; columns other than doc_id and text are left out
by score() and kept by keep().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import labelled
from spindrift.llm.shared import arrow_stage, keep_rows, texts_of
from spindrift.llm.words import BY_LETTER, Words, groups, slices

#: Share of toxic documents that scores are calibrated to.
PRIOR = 0.2
#: Words to a window; bytes to a stem.
WINDOW, STEM = 12, 6
#: How much oftener, a document, a dictionary's entry must serve toxic text; calibration takes one.
ODDS = (3, 10, 25)
#: Bytes of the ordinary dictionary, and of the toxic one before pruning, of which calibration takes one.
ORDINARY, TOXIC = 131_072, (4096, 16_384, 32_768, 65_536)


class Spelled:
    """Texts as symbols: ``codes`` has two for each word, its stem's and its own; ``first``: index of each text's first word, and the number of words.

    Texts are taken some at a time, as finding words needs some hundred bytes for each character."""

    def __init__(self, texts: list[str]):
        codes, first, n = [np.zeros((0, 2), np.uint64)], [np.zeros(1, np.int64)], 0
        for a, b in slices(texts):
            w = Words([t.lower() for t in texts[a:b]], BY_LETTER, STEM)
            codes.append(np.column_stack([w.stem, w.hash ^ np.uint64(0x5555)]))
            first.append(n + w.first[1:])
            n += len(w.hash)
        self.codes, self.first = np.concatenate(codes), np.concatenate(first)

    def windows(self) -> tuple[list[bytes], np.ndarray]:
        """(all windows of the texts, number of windows of each text)."""
        data, out = self.codes.tobytes(), []
        for a, b in zip(self.first.tolist(), self.first[1:].tolist()):
            out += [data[16 * i : 16 * min(i + WINDOW, b)] for i in range(a, b, WINDOW)]
        return out, -(-np.diff(self.first) // WINDOW)

    def shortened(self, gains: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For stems, then for words: (codes in order, in how many windows of a gain each stands)."""
        words = np.diff(self.first)
        n = -(-words // WINDOW)
        at = np.repeat(np.cumsum(n) - n, words) + (np.arange(len(self.codes)) - np.repeat(self.first[:-1], words)) // WINDOW
        ok = gains[at] > 0
        pairs = [np.unique(np.column_stack([self.codes[ok, k], at[ok].astype(np.uint64)]), axis=0) for k in (0, 1)]
        return [np.unique(p[:, 0], return_counts=True) for p in pairs]


def _often(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    have, n = table
    if not len(have):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(have, codes), len(have) - 1)
    return np.where(have[at] == codes, n[at], 0)


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes. The trainer needs some text: few samples are given to it several times."""
    import zstandard as z

    if not samples:
        return b""
    # at least so many samples and bytes that it accepts them
    times = max(1, -(-64 // len(samples)), -(-4 * size // sum(map(len, samples))))
    return z.train_dictionary(size, samples * min(times, 4096), k=16, d=8).as_bytes()[-size:]


def pruned(toxic: bytes, ordinary: bytes, own: Spelled, other: Spelled, least: int = 3) -> list[bytes]:
    """For each of ``ODDS``, the entries of the dictionary ``toxic`` that shorten windows of ``own`` so much oftener than windows of ``other``."""
    if len(toxic) < 8:
        return [toxic for _ in ODDS]
    m = Model(toxic, ordinary)
    n, k = max(1, len(own.first) - 1), max(1, len(other.first) - 1)
    data = np.frombuffer(toxic, np.uint8)
    entries = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    served = [x.shortened(m.gains(x.windows()[0])) for x in (own, other)]
    out = []
    for odds in ODDS:
        stay = np.zeros(len(data), bool)
        for a, b in zip(*served):
            here, there = _often(a, entries), _often(b, entries)
            for i in np.flatnonzero((here >= least) & (here / n >= odds * (there + 0.5) / k)):
                stay[i : i + 8] = True
        out.append(data[stay].tobytes())
    return out


def _compressor(dictionary: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    params = z.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=6, target_length=32, strategy=z.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    d.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=d, compression_params=params)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: float = 0.0
    #: Weights of the evidence, of the logarithm of the number of windows, and of one.
    weights: tuple[float, float, float] = (1.0, 0.0, -1.0)

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def gains(self, own: list[bytes]) -> np.ndarray:
        """For each window, how many bytes shorter it is with the toxic dictionary before the ordinary one."""
        if self._pair is None:
            self._pair = _compressor(self.toxic + self.ordinary).compress, _compressor(bytes(len(self.toxic)) + self.ordinary).compress
        a, b = self._pair
        return np.fromiter((len(b(w)) - len(a(w)) for w in own), np.int16, len(own))

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(gains of all windows, number of windows of each text)."""
        gains, count = [np.zeros(0, np.int16)], [np.zeros(0, np.int64)]
        for a, b in slices(texts):
            own, n = Spelled(texts[a:b]).windows()
            gains.append(self.gains(own))
            count.append(n)
        return np.concatenate(gains), np.concatenate(count)

    def features(self, gains: np.ndarray, count: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.maximum(0, gains - self.threshold))])
        end = np.cumsum(count)
        return np.column_stack([np.log1p(total[end] - total[end - count]), np.log1p(count), np.ones(len(count))])

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30)))

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.probabilities(self.features(*self.evidence(texts)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with a little shrinkage."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-4 * w)
    return w


def calibrated(model: Model, gains: np.ndarray, count: np.ndarray, y: np.ndarray) -> tuple[float, Model]:
    """(loss, the model with the threshold and weights of the least cross-entropy); toxic documents weigh ``PRIOR`` of all."""
    weight = np.where(y == 1, PRIOR / max(1, (y == 1).sum()), (1 - PRIOR) / max(1, (y == 0).sum()))
    best = np.inf, model
    for threshold in range(13):
        m = Model(model.toxic, model.ordinary, threshold)
        x = m.features(gains, count)
        w = _logistic(x, y, weight)
        if w[1] > 0:  # length alone is no evidence
            w = np.insert(_logistic(x[:, [0, 2]], y, weight), 1, 0.0)
        m.weights = tuple(w.tolist())
        p = np.clip(m.probabilities(x), 1e-6, 1 - 1e-6)
        loss = float(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum())
        best = min(best, (loss, m), key=lambda b: b[0])
    return best


def dictionaries(toxic: list[str], ordinary: list[str], sizes: tuple[int, ...] = TOXIC) -> tuple[list[bytes], bytes]:
    """(toxic dictionaries of all sizes before pruning, and of all odds, the ordinary one)."""
    a, b = Spelled(toxic), Spelled(ordinary)
    samples, base = list(dict.fromkeys(a.windows()[0])), trained(list(dict.fromkeys(b.windows()[0])), ORDINARY)
    return [d for size in sizes for d in pruned(trained(samples, size), base, a, b)], base


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model | None:
    """None where a class is missing.

    A third of the documents is kept from the first dictionaries, to calibrate on."""
    if len(set(labels)) < 2:
        return None
    y, part = np.array(labels), np.random.default_rng(seed).permutation(len(texts)) % 3
    of = lambda ok: [t for t, x in zip(texts, ok) if x]
    toxic, ordinary = dictionaries(of((y == 1) & (part > 0)), of((y == 0) & (part > 0)))
    best = np.inf, Model(toxic[0], ordinary), 0
    if len(set(y[part == 0].tolist())) == 2:
        for k, d in enumerate(toxic):
            m = Model(d, ordinary)
            loss, m = calibrated(m, *m.evidence(of(part == 0)), y[part == 0])
            best = min(best, (loss, m, k), key=lambda b: b[0])
    _, m, k = best
    toxic, ordinary = dictionaries(of(y == 1), of(y == 0), (TOXIC[k // len(ODDS)],))
    return Model(toxic[k % len(ODDS)], ordinary, m.threshold, m.weights)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, most: int = labelled.SAMPLE) -> Model | None:
    return fit(*labelled.sample(docs, labels, "toxic", folds, held_out, most))


def score(docs: DataFrame, model: Model | None, folds: int = 4, held_out: int = 2, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (of label 1), predicted: 1 if score >= ``least``."""

    def rows(batches):
        for ids, texts in groups(batches):
            s = np.zeros(len(texts)) if model is None else model.scores(texts)
            yield from zip([d for (d,) in ids], s.tolist())

    scored = arrow_stage(texts_of(docs), rows, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(labelled.remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The documents whose toxicity score is below ``least``, a null text scored as an empty one; all of them without a model."""
    return docs if model is None else keep_rows(docs, lambda texts: model.scores(texts) < least)
