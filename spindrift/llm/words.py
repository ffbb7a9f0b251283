"""Words of many texts at once, as numpy arrays: where they stand and a 64-bit hash of each.

The hash of a word comes from running sums of byte values times powers of an odd number modulo 2**64, so
it costs a few array operations a byte whatever the words are.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = _ODD, _INVERSE
    return np.cumprod(up), np.cumprod(down)


#: Words between white space: every byte over 32 counts.
BY_SPACE = np.where(np.arange(256) > 32, np.arange(256), 0).astype(np.uint8)
#: Words of letters and digits: ASCII letters in lower case, digits, and all characters beyond ASCII.
BY_LETTER = np.zeros(256, np.uint8)
for _c in range(256):
    if _c > 127 or chr(_c).isalnum():
        BY_LETTER[_c] = ord(chr(_c).lower()) if _c < 128 else _c


class Words:
    """``data``: bytes of the texts, one line end after each; ``start``, ``end``, ``doc``, ``hash``: of each word;
    on demand ``stem``: the hash of its first ``stem`` bytes."""

    def __init__(self, texts: list[str], kind: np.ndarray, stem: int = 0):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        mapped = kind[self.data]
        inside = np.concatenate([[False], mapped > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1
        n = 1 << max(20, int(len(self.data)).bit_length())
        up, down = _powers(n)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mapped * up[: len(mapped)])])
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        if stem:
            cut = np.minimum(self.end, self.start + stem)
            self.stem = mix((run[cut] - run[self.start]) * down[self.start] + (cut - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.bounds)  # index of each text's first word; then the number of words


def slices(texts: list[str], room: int = 500_000):
    """(first, end) of runs of texts of about ``room`` characters together: arrays for all bytes at once would take some hundred bytes for each."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (size < room or end == start):
            size += len(texts[end])
            end += 1
        yield start, end
        start = end


def forget_units() -> None:
    """Workers live on from operator to operator: what a tokenizer's operator has kept is given back before other work."""
    if units := sys.modules.get("spindrift.llm.units"):
        units.id_encoder.cache_clear()


def groups(batches, room: int = 500_000, columns: tuple[str, ...] = ("doc_id",)):
    """Lists of rows' ``columns`` and their texts, of about ``room`` characters together."""
    forget_units()
    held, texts, size = [], [], 0
    for b in batches:
        for i, t in enumerate(b["text"]):
            held.append(tuple(b[c][i] for c in columns))
            texts.append(t or "")
            size += len(texts[-1])
            if size >= room:
                yield held, texts
                held, texts, size = [], [], 0
    if texts:
        yield held, texts
