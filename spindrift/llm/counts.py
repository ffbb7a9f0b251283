"""Exact token counts of every prefix of a text, for a sentencepiece BPE model with byte fallback.

BPE merges the best pair first, so a prefix's tokens are not the first tokens of the text. But its last token is
found from shorter prefixes: the tokens of a prefix are those of the prefix without the last
token, and that token, which is so if and only if it, and the last token before it, stay two when they are merged alone (then no merge
crosses any border). Dynamic programming over the prefixes keeps each one's last token and count; exactly one of at most
sixteen ends fits. No piece of the model has a blank after another character, so a text falls into
independent units, each a word with the blanks before it; units' counts are kept within a worker.

The result is a table: for each document, one signed byte a character, by how much the count changes with it. Sums of
it answer how many tokens any prefix has, where to cut for a budget, and whether a text exceeds a limit, and nothing
is encoded again. As counts may fall when a character is added, the longest prefix within a budget is
sought among all.

Defined results: a null or empty text has no characters and no tokens; characters that the model lacks count
as many tokens as they have bytes; names of special tokens in a text are plain text; repeated rows have equal
counts; an empty table gives an empty table; other columns than doc_id and text are left out.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import arrow_stage, stored, texts_of

BLANK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_chars long, n_tokens long, changes binary"


class Prefixes:
    """Counts of all prefixes of texts. ``room``: bound on the units and pairs that are kept."""

    def __init__(self, path: str, room: int = 1_000_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n, t = spec.normalizer_spec, spec.trainer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or t.model_type != t.BPE or not t.byte_fallback or t.treat_whitespace_as_suffix:
            raise ValueError("the model must be BPE with byte fallback that leaves texts as they are and puts one blank before them")
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)))
        self.pieces = {p.id_to_piece(i): p.get_score(i) for i in plain}
        self.longest = max(map(len, self.pieces))
        # units may only be cut where no piece goes on
        inner = any(re.search(f"[^{BLANK}]{BLANK}", x) for x in self.pieces)
        self.unit = re.compile(".+" if inner else f"{BLANK}+[^{BLANK}]*", re.DOTALL)
        # lengths of the pieces that end in given three characters, the longest first, with that of two if their last two are a piece
        self.lengths: dict[str, list[int]] = {}
        for n, end in sorted({(len(x), x[-3:]) for x in self.pieces if len(x) > 2}, reverse=True):
            self.lengths.setdefault(end, []).append(n)
        for end, n in self.lengths.items():
            n += [2] * (end[1:] in self.pieces)
        self.room, self.units, self.pairs = room, Recent(room), {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text, by merging: the best score first, then the leftmost."""
        own = list(text)
        while True:
            found = [(-self.pieces[x], i) for i in range(len(own) - 1) if (x := own[i] + own[i + 1]) in self.pieces]
            if not found:
                return own
            i = min(found)[1]
            own[i : i + 2] = [own[i] + own[i + 1]]

    def apart(self, pair: tuple[str, str]) -> bool:
        """Whether the two tokens stay these two when they are merged alone; before the first token there is none."""
        if len(self.pairs) >= self.room:
            self.pairs.clear()
        before, last = pair
        out = self.pairs[pair] = self.merged(before + last) == ([before, last] if before else [last])
        return out

    def changes(self, unit: str) -> bytes:
        """By how much the count changes with each character of a unit, a signed byte each."""
        pieces, lengths, known = self.pieces, self.lengths.get, self.pairs.get
        last, count, out, before = [""], [0], bytearray(), 0
        for i in range(1, len(unit) + 1):
            for k in lengths(unit[i - 3 : i] if i > 2 else "", (2,)):
                if k <= i and (end := unit[i - k : i]) in pieces:
                    pair = last[i - k], end
                    ok = known(pair)
                    if ok or ok is None and self.apart(pair):
                        n = count[i - k] + 1
                        break
            else:  # the last character alone: one end fits, and no longer one does
                end = unit[i - 1]
                n = before + (1 if end in pieces else len(end.encode()))
            out.append((n - before) & 255)
            last.append(end)
            count.append(n)
            before = n
        return bytes(out)

    def of(self, text: str) -> bytes:
        """The changes of a whole text: its first character's are those of the blank before it too."""
        if not text:
            return b""
        known, out = self.units.get, []
        for u in self.unit.findall(BLANK + text.replace(" ", BLANK)):
            c = known(u)
            if c is None:
                c = self.changes(u)
                if len(u) <= 64:
                    self.units.put(u, c)
            out.append(c)
        own = b"".join(out)
        first = np.frombuffer(own[:2], np.int8).sum(dtype=np.int8).tobytes()
        return first + own[2:]


class Recent:
    """A table of at most ``room`` entries: when its younger half is full, it becomes the older one, and what was that is forgotten."""

    def __init__(self, room: int):
        self.most, self.young, self.old = max(1, room // 2), {}, {}

    def get(self, key):
        out = self.young.get(key)
        if out is None and (out := self.old.get(key)) is not None:
            self.put(key, out)
        return out

    def put(self, key, value):
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


_held: dict[str, Prefixes] = {}


def held(path: str) -> Prefixes:
    """One for each worker and model."""
    if path not in _held:
        _held[path] = Prefixes(path)
    return _held[path]


def table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and changes of every whole text, stored."""

    def rows(batches):
        p = held(path)
        for b in batches:
            for d, t in zip(b["doc_id"], b["text"]):
                c = p.of(t)
                yield d, len(t.encode()), len(t), int(np.frombuffer(c, np.int8).sum(dtype=np.int64)), c

    return stored(arrow_stage(texts_of(docs), rows, SCHEMA, batch=200))


def limits(counts: DataFrame, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: from the last prefix, so the rest of the table isn't read."""
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _from_changes(counts: DataFrame, schema: str, one, *more: Column) -> DataFrame:
    def rows(batches):
        for b in batches:
            for row in zip(*b.values()):
                yield from one(*row)

    return arrow_stage(counts.select("doc_id", "changes", *more), rows, schema, batch=200)


def cuts(counts: DataFrame, budget: int) -> DataFrame:
    """doc_id, kept_chars, kept_tokens, whole: the longest prefix of each text that has at most ``budget`` tokens."""

    def one(doc, changes):
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)])
        k = int(np.flatnonzero(sums <= budget)[-1])
        yield doc, k, int(sums[k]), k == len(changes)

    if budget < 0:
        raise ValueError("a budget is 0 or more")
    return _from_changes(counts, "doc_id long, kept_chars long, kept_tokens long, whole boolean", one)


def at(counts: DataFrame, positions: DataFrame) -> DataFrame:
    """doc_id, position, n_tokens of the prefixes of ``positions`` (doc_id, position in characters); those beyond a text's end, below 0, or of unknown documents are left out."""

    def one(doc, changes, wanted):
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)])
        yield from ((doc, k, int(sums[k])) for k in wanted if 0 <= k < len(sums))

    own = positions.select("doc_id", F.col("position").cast("long").alias("position")).distinct()
    # a document's positions in lists of a bounded length, however many are asked for
    own = own.groupBy("doc_id", F.expr("position div 100000").alias("block")).agg(F.collect_list("position").alias("wanted")).drop("block")
    return _from_changes(counts.join(own, "doc_id"), "doc_id long, position long, n_tokens long", one, F.col("wanted"))


def budgets(counts: DataFrame, budgets_: list[int]) -> DataFrame:
    """budget, n_over (texts with more tokens), kept_tokens (if each is cut after as many tokens as it may have), from counts alone."""
    rows = F.explode(F.array(*[F.lit(b).cast("long") for b in budgets_])).alias("budget")
    own = counts.select("n_tokens", rows)
    return own.groupBy("budget").agg(F.count_if(F.col("n_tokens") > F.col("budget")).alias("n_over"), F.sum(F.least("n_tokens", "budget")).alias("kept_tokens"))
