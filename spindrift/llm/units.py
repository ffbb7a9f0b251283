"""Exact reuse of tokenizer results on small units of text.

A *unit* is a stretch of text that a BPE tokenizer with a regular-expression pre-tokenizer encodes
the same way alone as inside its document. Units end only where both of the pre-tokenizers used here
must break: between a Latin letter run, a digit run, a run of ASCII punctuation and white space.
Where that can't be told from ASCII and Latin characters alone (apostrophes, other scripts,
combining marks), the unit runs on to the next white space. Texts that hold a special token's string,
or control characters on whose class the regex engines differ, are encoded whole.

Each Python worker keeps one bounded table of units, in two generations, so its memory is bounded
whatever the input is.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

_W = "A-Za-zÀ-ÖØ-öø-ɏ"
_P = "!-&(-/:-@\\[-`{-~"
_NEXT = f"(?=[\\n -&(-~{_W[6:]}]|\\Z)"
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85]")


def _pattern(space: str, rest: str) -> re.Pattern:
    return re.compile(f"{space}[{_W}]++{_NEXT}|{space}[{_P}]++{_NEXT}|{space}[0-9]++{_NEXT}|{space}\\S+{rest}")


#: A unit of a byte-level tokenizer may take the space before it, and white space is kept.
KEEPS_SPACE = _pattern(" ?", r"|\s+(?!\S)|\s")
#: For a tokenizer that drops white space.
DROPS_SPACE = _pattern("", "")


#: Units that are one piece for the pre-tokenizers, so that the merges alone decide; a tokenizer that drops white space takes digits one by one.
_ONE_KEEPS = re.compile(f" ?(?:[{_W}]+|[{_P}]+|[0-9]+)").fullmatch
_ONE_DROPS = re.compile(f"[A-Za-z]+|[{_P}]+|[0-9]").fullmatch


def _letters() -> dict[int, int]:
    """The public byte-level rule: printable bytes stand for themselves, the others for 256, 257, ... in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class UnitTable(dict):
    """unit -> value, where value is made from the unit's ids; about 2 * ``room`` entries are kept."""

    def __init__(self, tokenizer, value, room: int, keeps_space: bool):
        self.tokenizer, self.value, self.room, self.old = tokenizer, value, room, {}
        self.one, self.keeps = (_ONE_KEEPS if keeps_space else _ONE_DROPS), keeps_space
        self.merge, self.letters = tokenizer.model.tokenize, _letters()
        self.direct = True
        probes = [" the", "The", " ünd", "...", " (", "7", "École", " 2024", "x", "ſtraße"]
        self.direct = all(self.ids(p) == self._encoded(p) for p in probes if self.one(p))

    def _encoded(self, unit: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([unit], add_special_tokens=False)[0].ids

    def ids(self, unit: str) -> list[int]:
        """Through the library's merges alone where they decide, else through all of the library's steps."""
        if not (self.direct and self.one(unit)):
            return self._encoded(unit)
        if self.keeps:  # of ASCII, a unit that is one piece has no hidden byte but the space before it
            unit = unit.replace(" ", "\u0120") if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
        else:
            unit = unit.lower()
        return [t.id for t in self.merge(unit)]

    def __missing__(self, unit: str):
        v = self.old.get(unit)
        if v is None:
            if self.keeps and self.direct and unit.isascii() and self.one(unit):  # what ids() does, for most units of most texts
                v = self.value([t.id for t in self.merge(unit.replace(" ", "\u0120"))])
            else:
                v = self.value(self.ids(unit))
        self[unit] = v
        return v

    def turn(self) -> None:
        """Called now and then: when the table is full, what was not used since the last time is forgotten."""
        if len(self) > self.room:
            self.old = dict(self)
            self.clear()


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """encode(text) -> list of values of the units of a text, in order.

    ``value`` maps a list of ids to what is kept of it. Joined, the units' ids are the ids that the
    tokenizers library gives for the whole text.
    """

    def __init__(self, path: str, keeps_space: bool, value, room: int = 400_000):
        self.tokenizer = load(path)
        self.table = UnitTable(self.tokenizer, value, room, keeps_space)
        self.find = (KEEPS_SPACE if keeps_space else DROPS_SPACE).findall
        self.special = [str(t) for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values())]
        self.value = value

    def plain(self, text: str) -> bool:
        """Whether the text can be cut into units."""
        return not any(s in text for s in self.special) and not _ODD.search(text)

    def whole(self, text: str):
        return self.value(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def encode_all(self, texts):
        """For each text, in order, the list of its units' values. A null counts as empty."""
        find, get = self.find, self.table.__getitem__
        for t in texts:
            t = t or ""
            self.table.turn()
            yield list(map(get, find(t))) if self.plain(t) else [self.whole(t)]


def _little(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _small(ids: list[int]) -> bytes:
    return array("H", ids).tobytes()


@lru_cache(maxsize=4)
def id_encoder(path: str, room: int = 400_000) -> Encoder:
    """One for each worker process and size of its table. Values are ids as unsigned integers of 16 bits, or of 32 where the vocabulary is larger."""
    e = Encoder(path, True, _small, room)
    if e.tokenizer.get_vocab_size(True) > 65536:
        e.value = e.table.value = _little
    return e


def ids_of_all(path: str, texts, end: int | None = None, room: int = 400_000):
    """For each text its ids as a numpy array, and after them ``end`` where it is given."""
    import numpy as np

    e = id_encoder(path, room)
    last = b"" if end is None else e.value([end])
    kind = "<u2" if e.value is _small else "<u4"
    for parts in e.encode_all(texts):
        yield np.frombuffer(b"".join(parts) + last, kind)
