"""Token ids as files, compressed by a Re-Pair grammar for each shard.

A shard holds the ids of consecutive documents. In each round its pairs are counted exactly (by sorting),
the frequent ones (16 times in a shard) become nonterminals, and their occurrences are replaced; where
occurrences overlap, that of the more frequent pair wins. Rounds go on until no pair is frequent. A pair never crosses a document's end, so each document is a run of
symbols, and documents() decodes single ones by expanding their runs alone. Stored beside the symbols: the
rules, the expansion length of every nonterminal, and where each document's run begins.

The file format is a Parquet table in the shared folder, with one row for each shard, written by range
of doc_id: rows (part, shard) in order hold the documents in ascending doc_id, equal ids by text.

Defined results: a null text counts as an empty one, of which only the end id is stored; texts of any
length are stored whole; repeated rows are stored as often as they occur; an empty table gives empty
files; columns other than doc_id and text are left out; rows without a doc_id come first.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.shared import arrow_stage, stored, texts_of
from spindrift.llm.units import ids_of_all

FORMAT = "part long, shard long, doc_ids array<long>, starts array<int>, n_tokens long, first_symbol long, rounds array<int>, rules binary, expanded binary, symbols binary"


def _frequent_pairs(codes: np.ndarray, most: int, least: int) -> np.ndarray:
    """Codes of the pairs that occur ``least`` times, by count, then by code."""
    s = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    n = np.diff(at, append=len(s))
    ok = np.flatnonzero(n >= least)
    ok = ok[np.lexsort((s[at[ok]], -n[ok]))][:most]
    return s[at[ok]]


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = 16):
    """(symbols, starts of the documents' runs, rules, expansion lengths, number of rules of each round).

    ``ends``: a true cell at the last id of each document. ``first``: the first free symbol. Rounds go on until no
    pair occurs ``least`` times, or symbols run out: while all fit in 16 bits, there are 65,536 - ``first``."""
    s, last, size = ids.astype(np.uint32), ends.copy(), len(ids)
    last[-1:] = True
    # positions stay where they are; the next and the one before of those still in use
    after, before, live = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32), np.ones(size, bool)
    rules: list[np.ndarray] = []
    per_round: list[int] = []
    lengths = np.ones(first, np.uint32)
    limit = 65536 if first <= 65536 else 1 << 32
    wide = limit > 65536
    half = np.uint64(32) if wide else np.uint32(16)
    mul, shift = (np.uint64(0x9E3779B97F4A7C15), np.uint64(48)) if wide else (np.uint32(2654435761), np.uint32(16))
    changed = None  # where the last round put symbols: pairs elsewhere have become no more frequent by it
    while (room := limit - first - sum(per_round)) > 0:
        whole = changed is None
        if not rules:
            open_ = np.flatnonzero(~last)
            codes = (s[:-1].astype(np.uint64) << half | s[1:] if wide else s[:-1] << half | s[1:])[~last[:-1]]
        elif whole:
            open_ = np.flatnonzero(live & ~last)
        else:
            near = np.zeros(size + 1, bool)
            near[changed] = near[before[changed]] = True  # of the first position none is before: -1 is the spare cell
            open_ = np.flatnonzero(near[:-1] & ~last)
        if rules:
            right = s[after[open_]]
            codes = s[open_].astype(np.uint64) << half | right if wide else s[open_] << half | right
        pairs = _frequent_pairs(codes, room, least)
        if not len(pairs):
            if whole:
                break
            changed = None  # a last look at all pairs: some may have lost their places to others
            continue
        # rank of each position's pair through a small hash table; of pairs that share a cell the more frequent stays, the other has its turn later
        cells = (pairs * mul >> shift).astype(np.int64)
        cells, kept = np.unique(cells, return_index=True)
        order = np.argsort(kept)
        cells, pairs = cells[order], pairs[kept[order]]
        key, rank = np.zeros(1 << 16, codes.dtype), np.full(1 << 16, len(pairs), np.int32)
        key[cells], rank[cells] = pairs, np.arange(len(pairs), dtype=np.int32)
        cell = codes * mul >> shift
        hit = np.flatnonzero(key[cell] == codes)
        r = rank[cell[hit]]
        at, r = open_[hit[r < len(pairs)]], r[r < len(pairs)]
        # of occurrences that overlap, the more frequent pair's stays; of a run of one pair every second
        left_of, right_of = np.full(len(at), len(pairs), np.int32), np.full(len(at), len(pairs), np.int32)
        near = np.flatnonzero(after[at[:-1]] == at[1:])
        left_of[near + 1], right_of[near] = r[near], r[near + 1]
        take = (r <= left_of) & (r <= right_of)
        run = np.flatnonzero(left_of == r)  # all of a run but its first
        begin = np.flatnonzero(np.diff(run, prepend=-2) != 1)
        odd = run[(np.arange(len(run)) - np.repeat(begin, np.diff(begin, append=len(run)))) % 2 == 0]
        take[odd] = False
        used = np.flatnonzero(np.bincount(r[take], minlength=len(pairs)) >= max(2, least // 4))  # a pair that lost most of its places makes no rule yet
        if not len(used):
            if not whole:
                changed = None
                continue
            take, used = r == 0, np.zeros(1, np.int64)  # the most frequent pair alone, so that every look gets on
            take[odd] = False
        at, r = at[take], r[take]
        place = np.full(len(pairs), -1, np.int64)
        place[used] = np.arange(len(used))
        own = place[r]
        at, own = at[own >= 0], own[own >= 0]
        two = pairs[used]
        s[at] = first + sum(per_round) + own.astype(np.uint32)
        gone = after[at]
        last[at], live[gone] = last[gone], False
        after[at] = after[gone]
        follow = after[at] < size
        before[after[at[follow]]] = at[follow]
        changed = at
        two = np.stack([two >> half, two & codes.dtype.type((1 << int(half)) - 1)], 1).astype(np.uint32)
        rules.append(two)
        per_round.append(len(two))
        lengths = np.concatenate([lengths, lengths[two[:, 0]] + lengths[two[:, 1]]])
    s, last = s[live], last[live]
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(s) else np.zeros(0, np.int64)
    return s, starts, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths[first:], per_round


def expand(symbols: np.ndarray, rules: np.ndarray, first: int, per_round: list[int]) -> np.ndarray:
    """The ids of a run of symbols. Rules of a round refer to earlier rounds only, so rounds are undone from the last."""
    s, base = symbols.astype(np.uint32), first + sum(per_round)
    for n in reversed(per_round):
        base -= n
        at = np.flatnonzero(s >= base)
        if not len(at):
            continue
        two = rules[s[at] - first]
        wide = np.ones(len(s), np.int64)
        wide[at] = 2
        s = np.repeat(s, wide)
        at = at + np.arange(len(at))
        s[at], s[at + 1] = two[:, 0], two[:, 1]
    return s


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, per_round: list[int]) -> np.ndarray:
    """As expand(), for a whole shard: every rule is expanded once, then all ids are gathered in one step."""
    each = np.concatenate([np.ones(first, np.int64), lengths])[symbols]
    if lengths.sum(dtype=np.int64) > 4 * each.sum():  # many rules nested in a line
        return expand(symbols, rules, first, per_round)
    table = np.concatenate([np.arange(first, dtype=np.uint32), expand(np.arange(first, first + len(rules)), rules, first, per_round)])
    begin = np.concatenate([np.arange(first), first + np.cumsum(lengths, dtype=np.int64) - lengths])
    out = np.cumsum(each)
    return table[np.repeat(begin[symbols] - (out - each), each) + np.arange(out[-1] if len(out) else 0)]


def document(row, k: int) -> np.ndarray:
    """Random access: the ids of the k-th document of a stored shard, from its run of symbols alone."""
    symbols = np.frombuffer(row["symbols"], "<u2" if row["first_symbol"] <= 65536 else "<u4")
    starts = [*row["starts"], len(symbols)]
    return expand(symbols[starts[k] : starts[k + 1]], np.frombuffer(row["rules"], "<u4").reshape(-1, 2), row["first_symbol"], row["rounds"])


def n_tokens(row, k: int) -> int:
    """Number of ids of the k-th document, from the expansion lengths, without expanding it."""
    symbols = np.frombuffer(row["symbols"], "<u2" if row["first_symbol"] <= 65536 else "<u4")
    starts = [*row["starts"], len(symbols)]
    own = symbols[starts[k] : starts[k + 1]].astype(np.int64) - row["first_symbol"]
    grown = np.frombuffer(row["expanded"], "<u4")
    return int((own < 0).sum() + grown[own[own >= 0]].sum())


def write(docs: DataFrame, path: str, end: int = 0, shard_tokens: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """Encodes every whole text, and writes the shards to the shared folder; the result reads the files."""
    own = texts_of(docs)
    # by range of doc_id; adaptive execution sets the number of partitions by their bytes where it is not given
    keys = F.col("doc_id"), F.xxhash64("text")
    sized = (own.repartitionByRange(partitions, *keys) if partitions else own.repartitionByRange(*keys)).sortWithinPartitions("doc_id", "text")

    def rows(batches):
        from pyspark import TaskContext

        from spindrift.llm.units import id_encoder

        first, part, shard = id_encoder(path, 1_000_000).tokenizer.get_vocab_size(True), TaskContext.get().partitionId(), 0
        names: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def made():
            ids = np.concatenate(held)
            ends = np.zeros(len(ids), bool)
            ends[np.cumsum([len(x) for x in held]) - 1] = True
            s, starts, rules, lengths, per_round = compress(ids, ends, first)
            kind = "<u2" if first <= 65536 else "<u4"
            return (part, shard, list(names), starts.tolist(), len(ids), first, per_round, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), s.astype(kind).tobytes())

        for b in batches:
            for d, ids in zip(b["doc_id"], ids_of_all(path, b["text"], end, room=1_000_000)):
                names.append(d)
                held.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    yield made()
                    names, held, size, shard = [], [], 0, shard + 1
        if names:
            yield made()

    return stored(arrow_stage(sized, rows, FORMAT, batch=4))


def documents(files: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids of the documents of ``ids`` (doc_id): only shards that hold one are read on, and in them only its run is expanded.

    A document that is stored several times is returned as often; a null id finds nothing."""
    own = files.withColumn("wanted", F.explode("doc_ids")).join(ids.select(F.col("doc_id").alias("wanted")).distinct(), "wanted", "left_semi")
    chosen = own.select("part", "shard", "wanted").distinct().groupBy("part", "shard").agg(F.collect_list("wanted").alias("wanted"))  # at most the documents of a shard
    held = files.join(chosen, ["part", "shard"])

    def rows(batches):
        for b in batches:
            for i in range(len(b["part"])):
                row = {k: v[i] for k, v in b.items()}
                wanted = set(row["wanted"])
                yield from ((d, n_tokens(row, k), document(row, k).tolist()) for k, d in enumerate(row["doc_ids"]) if d in wanted)

    return arrow_stage(held, rows, "doc_id long, n_tokens long, ids array<int>", batch=200)


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, and on demand its ids, from the files.

    start counts the ids of all documents before it: those before its part, its shard and itself."""

    def rows(batches):
        for b in batches:
            for i in range(len(b["part"])):
                row = {k: v[i] for k, v in b.items()}
                symbols = np.frombuffer(row["symbols"], "<u2" if row["first_symbol"] <= 65536 else "<u4")
                grown = np.concatenate([np.ones(row["first_symbol"], np.int64), np.frombuffer(row["expanded"], "<u4")])
                ids = expand_all(symbols, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["expanded"], "<u4"), row["first_symbol"], row["rounds"]).astype("<u4", copy=False)
                at = np.concatenate([[0], np.cumsum(grown[symbols])])[[*row["starts"], len(symbols)]]
                for k, d in enumerate(row["doc_ids"]):
                    own = ids[at[k] : at[k + 1]]
                    yield (row["part"], row["shard"], d, int(at[k]), len(own), zlib.crc32(own), *([own.tolist()] if with_ids else []))

    docs = arrow_stage(files, rows, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    sizes = files.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    shards = sizes.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("before_shard"))
    offsets = shards.join(parts, "part")
    return docs.join(offsets, ["part", "shard"]).select("doc_id", (F.col("before_part") + F.col("before_shard") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
