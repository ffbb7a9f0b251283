"""Packing documents into windows of fixed length by the sum-of-squares rule.

Each task packs the documents of its own partition as they come: whole windows are cut off a document
first; the rest of it goes to the fill level for which the sum of the squared counts of partially filled
windows grows least (a new window counts as level 0; ties take the fullest). The counts stand in one
array with a cell for each level. No rows move between machines, and no task needs another's state.

Open windows are bounded: beyond ``most_open`` of them, and when the partition ends, the emptiest are
cut up to fill the fullest. What is left at the end, less than a window, is cut into sequences whose
lengths are powers of two, which need no padding.

Defined results: a null text counts as an empty one and is packed as its end id alone; a text of any
length is packed whole; repeated rows are packed as often as they occur; an empty table gives an empty
table; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from spindrift.llm.shared import arrow_stage, texts_of
from spindrift.llm.units import ids_of_all


class Packer:
    """add() takes a document's ids; both add() and close() give closed sequences as lists of pieces.

    A piece is [document, start, ids of the piece]."""

    def __init__(self, window: int = 1024, most_open: int = 4096):
        self.window, self.most_open = window, most_open
        self.count = np.zeros(window + 1, np.int64)  # partially filled windows of each level; the last stays 0
        self.open: list[deque] = [deque() for _ in range(window)]
        self.n_open = 0

    def level(self, size: int) -> int:
        """Where a piece of ``size`` goes: adding to level h changes the sum by 2 (n[h + size] - n[h]) + 2, a new window by 2 n[size] + 1."""
        c, top = self.count, self.window - size
        if top < 1:
            return 0
        grown = 2 * (c[size + 1 :] - c[1 : top + 1]) + 2
        grown[-1] = 1 - 2 * c[top]  # a full window is no longer counted
        grown[c[1 : top + 1] == 0] = np.iinfo(np.int64).max
        best = top - 1 - int(grown[::-1].argmin())
        return best + 1 if grown[best] <= 2 * c[size] + 1 else 0

    def _put(self, pieces: list, fill: int) -> None:
        self.open[fill].append(pieces)
        self.count[fill] += 1
        self.n_open += 1

    def add(self, doc, ids: np.ndarray):
        w, at = self.window, 0
        while len(ids) - at >= w:
            yield [[doc, at, ids[at : at + w]]]
            at += w
        if not (size := len(ids) - at):
            return
        piece = [doc, at, ids[at:]]
        if h := self.level(size):
            pieces = self.open[h].popleft()
            self.count[h] -= 1
            self.n_open -= 1
            pieces.append(piece)
            if h + size == w:
                yield pieces
            else:
                self._put(pieces, h + size)
        else:
            self._put([piece], size)
        if self.n_open > self.most_open:
            yield from self._squeeze()

    def _squeeze(self):
        """Fills the fullest open windows with pieces cut from the emptiest; one at most stays open."""
        order = deque((h, p) for h in range(self.window - 1, 0, -1) for p in self.open[h])
        self.count[:] = 0
        self.open = [deque() for _ in range(self.window)]
        self.n_open = 0
        while len(order) > 1:
            fill, pieces = order.popleft()
            while fill < self.window and order:
                have, giver = order.pop()
                piece = giver[-1]
                take = min(self.window - fill, len(piece[2]))
                keep = len(piece[2]) - take
                pieces.append([piece[0], piece[1] + keep, piece[2][keep:]])
                if keep:
                    giver[-1] = [piece[0], piece[1], piece[2][:keep]]
                else:
                    giver.pop()
                if giver:
                    order.append((have - take, giver))
                fill += take
            if fill == self.window:
                yield pieces
            else:
                order.append((fill, pieces))
        for fill, pieces in order:
            self._put(pieces, fill)

    def close(self):
        yield from self._squeeze()
        for pieces in [p for q in self.open for p in q]:
            left = sum(len(p[2]) for p in pieces)
            rest = deque(pieces)
            while left:
                room, seq = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    d, at, ids = rest.popleft()
                    seq.append([d, at, ids[:room]])
                    if len(ids) > room:
                        rest.appendleft([d, at + room, ids[room:]])
                    room -= len(seq[-1][2])
                yield seq
        self.__init__(self.window, self.most_open)


def pack(docs: DataFrame, path: str, window: int = 1024, end: int = 0, with_ids: bool = False, most_open: int = 4096, room: int = 600_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on demand its ids.

    ``path``: file of a byte-level tokenizer; ``end`` follows every document. sequence_id holds the
    number of the task in its upper bits. ``most_open``: windows that a task holds open, beyond which the emptiest are
    cut to fill the fullest; ``room``: units whose ids a worker keeps, about twice as many at most. Neither changes which ids are packed."""

    def rows(batches):
        from pyspark import TaskContext

        first, n, packer = TaskContext.get().partitionId() << 40, 0, Packer(window, most_open)

        def told(sequences):
            nonlocal n
            for pieces in sequences:
                offset = 0
                for (doc, total), start, ids in pieces:
                    yield (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, first + n, offset, *([ids.tolist()] if with_ids else []))
                    offset += len(ids)
                n += 1

        for b in batches:
            for d, ids in zip(b["doc_id"], ids_of_all(path, b["text"], end, room)):
                yield from told(packer.add((d, len(ids)), ids))
        yield from told(packer.close())

    return arrow_stage(texts_of(docs), rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
