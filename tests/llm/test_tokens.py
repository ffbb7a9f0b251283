"""Encoding, packing and id files against the tokenizers library itself."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import bpe, grammar, packing, queries, units
from spindrift.llm.shared import tokenizer_path
from tests.llm.conftest import ODD

WORD, BYTE = tokenizer_path(queries.WORD_BPE), tokenizer_path(queries.BYTE_BPE)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def test_units_equal_the_library(spark, small):
    rng = random.Random(1)
    alphabet = "ab éß'’.,!- \n\t0９́ 日<|>s"
    more = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    every = [t or "" for t in ODD] + more + list(texts(spark, small).values())
    for path, keeps in ((WORD, False), (BYTE, True)):
        e = units.Encoder(path, keeps, list)
        for t, parts in zip(every, e.encode_all(every)):
            assert [i for p in parts for i in p] == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_are_reused_and_exact(spark, small):
    c = bpe.ChunkCoder(WORD, room=50)
    base = list(texts(spark, small).values())
    shared = base[0][:3000]
    every = [t or "" for t in ODD] + base + [b[:777] + shared + b[777:] for b in base[:40]]
    for t, ids in zip(every, c.encode_all(every)):
        want = c.encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids == want
        assert c.encoder.tokenizer.decode(want, skip_special_tokens=False) == c.decode(ids)
    assert c.reused > 100 and c.whole < 0.1 * len(every)


def test_joins_that_do_not_agree_are_encoded_whole(spark, small, monkeypatch):
    """A table of units that is wrong about joins must not show: every text with such a join is encoded whole."""
    c = bpe.ChunkCoder(WORD)
    every = list(texts(spark, small).values())[:40]
    right = c._units
    monkeypatch.setattr(c, "_units", lambda t: right(t) + (b"\x05\0\0\0" if len(t) < 25 and t[:1] not in ("", " ", "\n") else b""))
    for t, ids in zip(every, c.encode_all(every)):
        assert ids == c.encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert c.whole > 10


def test_op1_on_odd_and_empty(spark, odd, empty):
    got = bpe.digests(odd, WORD).collect()
    t = units.load(WORD)
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(empty, WORD).count() == 0
    enc = bpe.encode(odd, WORD)
    assert sorted(map(tuple, bpe.decode(enc, WORD).collect()), key=str) == sorted(map(tuple, enc.select("doc_id", "decoded").collect()), key=str)


def check_pieces(rows, docs, most_padding):
    """rows with ids; docs: ids of each document, as a list."""
    seqs, by_doc = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    padding = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    for d, ids in docs.items():
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        assert [i for p in pieces for i in p.ids] == ids and {p.doc_tokens for p in pieces} == {len(ids)}
    assert padding <= most_padding


def test_packing_is_whole(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    t = units.load(BYTE)
    want = {d: t.encode(x, add_special_tokens=False).ids + [0] for d, x in texts(spark, small).items()}
    check_pieces(packing.pack(docs, BYTE, with_ids=True).collect(), want, 0)


def test_packing_odd(odd, empty):
    rows = packing.pack(odd.where("doc_id is null or doc_id <> 3"), BYTE, with_ids=True).collect()
    t = units.load(BYTE)
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in odd.where("doc_id is null or doc_id <> 3").collect()}
    check_pieces(rows, want, 0)
    assert sum(r.length for r in packing.pack(odd.where("doc_id = 3"), BYTE).collect()) == 2 * len(t.encode("\n\n").ids + [0])
    assert packing.pack(empty, BYTE).count() == 0


def test_sum_of_squares_level():
    rng = random.Random(3)
    p = packing.Packer(64)
    for step in range(4000):
        size = rng.choice([rng.randint(1, 63), 20, 44, 31])
        n = p.count.copy()
        costs = {}
        for h in range(0, 64 - size + 1):
            if h and not n[h]:
                continue
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 64:
                m[h + size] += 1
            costs[h] = int((m[:64] ** 2).sum())
        h = p.level(size)
        assert costs[h] == min(costs.values())
        assert h == max(k for k, v in costs.items() if v == costs[h])
        list(p.add(step, np.arange(size)))


def test_packer_bounds_open_windows():
    p = packing.Packer(64, most_open=50)
    out = [s for i in range(2000) for s in p.add(i, np.full(40, i))]
    assert p.n_open <= 51
    out += p.close()
    assert sum(len(x[2]) for s in out for x in s) == 80_000
    assert all((n := sum(len(x[2]) for x in s)) == 64 or n & (n - 1) == 0 for s in out)


@pytest.mark.parametrize("first", [50257, 70000])
def test_repair_round_trip_and_random_access(first):
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.5, n).clip(0, 300) % first for n in (1, 5000, 20, 1, 3000)] + [np.full(501, 7), np.tile([1, 2, 3, 0], 400), np.zeros(0, int)]
    docs = [np.append(d, 0) for d in docs]
    ids = np.concatenate(docs)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    s, starts, rules, grown, rounds = grammar.compress(ids, ends, first)
    assert len(s) < 0.7 * len(ids) and len(rules) == len(grown) == sum(rounds)
    assert np.array_equal(grammar.expand(s, rules, first, rounds), ids)
    kind = "<u2" if first < 65536 else "<u4"
    row = {"symbols": s.astype(kind).tobytes(), "first_symbol": first, "starts": starts.tolist(), "rules": rules.astype("<u4").tobytes(), "rounds": rounds, "expanded": grown.astype("<u4").tobytes()}
    for k, d in enumerate(docs):
        assert np.array_equal(grammar.document(row, k), d) and grammar.n_tokens(row, k) == len(d)


def test_most_frequent_pair_becomes_the_first_rule():
    ids = np.array([5, 6] * 50 + [7, 8] * 20 + [9])
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    s, _, rules, _, rounds = grammar.compress(ids, ends, 100)
    assert rules[0].tolist() == [5, 6] and rules[1].tolist() == [7, 8] and rounds[0] == 2
    assert Counter(zip(s[:-1].tolist(), s[1:].tolist())).most_common(1)[0][1] < 16


@pytest.mark.parametrize("kind", ["prose", "runs", "copies"])
def test_no_frequent_pair_is_left(kind):
    rng = np.random.default_rng(3)
    if kind == "prose":
        docs = [rng.zipf(1.3, 400).clip(0, 900) for _ in range(60)]
    elif kind == "runs":
        docs = [np.repeat(rng.integers(0, 4, 30), rng.integers(1, 90, 30)) for _ in range(30)]
    else:
        part = rng.integers(0, 50000, 700)
        docs = [np.concatenate([part[rng.integers(300) :], rng.integers(0, 50000, 20)]) for _ in range(40)]
    docs = [np.append(d, 0) for d in docs]
    ids, ends = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    s, starts, rules, grown, rounds = grammar.compress(ids, ends, 50257)
    assert np.array_equal(grammar.expand(s, rules, 50257, rounds), ids) and len(rounds) < 60
    assert np.array_equal(grammar.expand_all(s, rules, grown, 50257, rounds), ids)
    left, edges = Counter(), [*starts.tolist(), len(s)]
    for a, b in zip(edges, edges[1:]):
        k, own = a, s[a:b].tolist()
        pairs = list(zip(own[:-1], own[1:]))
        left.update(p for i, p in enumerate(pairs) if i == 0 or p != pairs[i - 1])
    assert max(left.values(), default=0) < 16
    assert kind != "copies" or grown.max() > 300


def test_id_files(spark, odd, empty, small):
    t = units.load(BYTE)
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet").repartition(5)):
        want, at = [], 0
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
        for r in rows:
            ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
            want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = grammar.read(grammar.write(docs, BYTE, shard_tokens=5000)).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
        files = grammar.write(docs, BYTE, shard_tokens=5000)
        some = grammar.documents(files, docs.where("doc_id % 3 = 1").select("doc_id")).collect()
        assert sorted((r.doc_id, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in some) == sorted((d, n, c) for d, _, n, c in want if d is not None and d % 3 == 1)
    assert grammar.read(grammar.write(empty, BYTE)).count() == 0
