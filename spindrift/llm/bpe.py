"""BPE encoding and decoding with reuse of content-defined chunks.

Every text is cut into chunks where a rolling hash of its last 16 characters meets a pattern, so equal
passages give equal chunks wherever they stand. A chunk that was seen before is not encoded again. What
stands between the last white space of one chunk and the first of the next is a join; it is encoded anew,
in a window that grows by whole chunks until it begins and ends at white space. Then the window and the
word on either side of it are encoded once more in one piece, by the library, and must agree with what the
chunks and the join say of them, id by id; a text with a join that doesn't agree is encoded whole. So the
ids are exact for tokenizers that merge across blanks, too; such just reuse nothing.

Reuse is within a worker process, in a table of bounded size. Sharing chunks between all machines would
need a shuffle of all texts, which moves more bytes than the encoding of the repeated part costs.

Defined results: a null text counts as an empty one (no ids; the decoded text is empty); texts of any
length are encoded whole; repeated rows give repeated rows; an empty table gives an empty table; columns
other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from spindrift.llm.shared import arrow_stage, texts_of
from spindrift.llm.units import Encoder

_BREAK = re.compile("[ \n]")
_WORD = re.compile("[ \n]*[^ \n]+")


def chunk_ends(text: str, bits: int = 9, least: int = 96) -> list[int]:
    """Ends of the chunks of a text: 2**bits characters on average beyond ``least`` for each."""
    if len(text) <= least:
        return [len(text)] if text else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    for k in (1, 2, 4, 8):  # after these, h[i] depends on the characters i - 15 to i
        h[k:] += h[:-k] << np.uint32(k)
    ends, last = [], 0
    for e in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
        if e - last >= least:
            ends.append(e)
            last = e
    if last < len(text):
        ends.append(len(text))
    return ends


class ChunkCoder:
    """Encodes and decodes texts with one tokenizer that drops white space; ``room`` bounds its table of chunks."""

    def __init__(self, path: str, room: int = 12_000):
        self.encoder = Encoder(path, False, self._value, room=250_000)
        t = self.encoder.tokenizer
        self.words = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(True))]
        self.glue = t.decoder is None  # then the library joins tokens with blanks
        self.room, self.chunks, self.old = room, {}, {}
        self.reused = self.encoded = self.whole = 0
        self.digits = [str(i) for i in range(len(self.words))]

    @staticmethod
    def _value(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _new(self, chunk: str):
        """(head, core, tail) of a chunk; None without a break."""
        if not (m := _BREAK.search(chunk)):
            return None
        a, b = m.start(), max(chunk.rfind(" "), chunk.rfind("\n"))
        return chunk[:a], chunk[a : b + 1], chunk[b + 1 :]

    @staticmethod
    def _edges(core: str) -> tuple[str, str]:
        """The first word of a core with what stands before it, and the last one with what stands after it."""
        words = _WORD.findall(core)
        return (words[0], core[core.rindex(words[-1].strip()) :]) if words else ("", "")

    def _units(self, text: str) -> bytes:
        table = self.encoder.table
        return b"".join([table[u] for u in self.encoder.find(text)])

    def _agreeing(self, joins: set[tuple[str, str, str]]) -> dict[tuple[str, str, str], bytes | None]:
        """The ids of joins (word before, join, word after); None where those of all three in one piece are others."""
        told = list(joins)
        own = {t: self._units(t[1]) for t in told}
        whole = self.encoder.tokenizer.encode_batch_fast(["".join(t) for t in told], add_special_tokens=False)
        return {t: own[t] if self._value(w.ids) == self._units(t[0]) + own[t] + self._units(t[2]) else None for t, w in zip(told, whole)}

    def encode_all(self, texts):
        """The ids of each text."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= 1_000_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]):
        if len(self.chunks) > self.room:
            self.old, self.chunks = self.chunks, {}
        parts: list[list | None] = []  # of each text: joins as str and chunks in turn
        fresh: dict = {}
        for t in texts:
            if not self.encoder.plain(t):
                parts.append(None)
                continue
            row, window, start = [], "", 0
            for end in chunk_ends(t):
                c, start = t[start:end], end
                if (k := self.chunks.get(c) or self.old.get(c) or fresh.get(c)) is None:
                    self.encoded += 1
                    k = fresh[c] = [self._new(c), None]
                else:
                    self.reused += 1
                    if c not in fresh:
                        self.chunks[c] = k
                if k[0] is None:
                    window += c  # no break in it: the window grows
                else:
                    row += [window + k[0][0], k]
                    window = k[0][2]
            row.append(window)
            parts.append(row)
        self.encoder.table.turn()
        for c, k in fresh.items():
            if k[0]:
                head, core, tail = k[0]
                k[:] = (head, "", tail), self._units(core), *self._edges(core)
            self.chunks[c] = k
        rows = []
        for row in parts:
            if row:  # a join with the words on its two sides
                row = [x if k % 2 else (row[k - 1][3] if k else "", x, row[k + 1][2] if k + 1 < len(row) else "") for k, x in enumerate(row)]
            rows.append(row)
        joins = self._agreeing({x for row in rows if row for x in row[::2]})
        for t, row in zip(texts, rows):
            ids = None if row is None else [x[1] if k % 2 else joins[x] for k, x in enumerate(row)]
            whole = ids is None or None in ids
            self.whole += whole
            yield array("I", self.encoder.whole(t) if whole else b"".join(ids)).tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.glue:
            return " ".join([self.words[i] for i in ids])
        return self.encoder.tokenizer.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def coder(path: str) -> ChunkCoder:
    c = ChunkCoder(path)
    if not c.glue:
        raise ValueError("this tokenizer has a decoder of its own; use ids_of_all and its decode")
    return c


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: each whole text encoded, and decoded again."""

    def rows(batches):
        for b in batches:
            c = coder(path)
            for d, ids in zip(b["doc_id"], c.encode_all(b["text"])):
                yield d, ids, c.decode(ids)

    return arrow_stage(texts_of(docs), rows, "doc_id long, ids array<int>, decoded string", batch=200)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text string from doc_id, ids array<int>; null ids count as none."""

    def rows(batches):
        for b in batches:
            for d, ids in zip(b["doc_id"], b["ids"]):
                yield d, coder(path).decode(ids or [])

    return arrow_stage(encoded.select("doc_id", "ids"), rows, "doc_id long, text string", batch=200)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode() and decode() give, without moving the ids to the JVM."""

    def rows(batches):
        sha = hashlib.sha256
        for b in batches:
            c = coder(path)
            for d, ids in zip(b["doc_id"], c.encode_all(b["text"])):
                told = " ".join([c.digits[i] for i in ids])
                yield d, len(ids), sha(told.encode()).hexdigest(), sha(c.decode(ids).encode()).hexdigest()

    return arrow_stage(texts_of(docs), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
