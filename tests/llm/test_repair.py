"""Conversation repair: the automaton against all edit sequences, the operator against a plain version and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from spindrift.llm import repair
from spindrift.llm.queries import ORACLES

WHITE = " \t\n\x0b\f\r"


def damage(rows):
    """{conv_id: damaged rows (turn, role, text) in order} by plain Python."""
    show = lambda v: " " if v is None else str(v)
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    same = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
    return {c: sorted(r, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), same(r))) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by a table of whole strings over (row, role letters so far as a state)."""
    accept = {"": True, "s": False, "u": False, "a": True}
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {(len(rows), q): (0, "", ()) if accept[q] else None for q in step}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            _, role, text = rows[i]
            for q in step:
                options = [(4, "D", None, q)]
                if found[i] not in ("blank", "duplicate"):
                    more = 3 * (found[i] == "truncated")
                    options += [(more, "K", (role, text), step[q][role[:1]])] if role[:1] in step[q] else []
                    options += [(3 + more, "R", (r, text), step[q][r[0]]) for r in ("user", "assistant") if r[0] in step[q]]
                best[i, q] = min((c + best[i + 1, n][0], e + best[i + 1, n][1], ((line,) if line else ()) + best[i + 1, n][2]) for c, e, line, n in options)
        for _ in range(4):  # insertions, until nothing changes
            for q in step:
                for r in ("user", "assistant"):
                    if r[0] in step[q] and best[i, step[q][r[0]]]:
                        c, e, lines = best[i, step[q][r[0]]]
                        new = (c + 3, "I" + e, ((r, ""), *lines))
                        best[i, q] = min(best[i, q], new, key=lambda b: b[:2]) if best[i, q] else new
    return best[0, ""]


def plain(rows):
    out = {}
    for conv, own in damage(rows).items():
        found = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        letters = [r[:1] for _, r, _ in own]
        cost, audit, lines = cheapest(own, found)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def returned(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_automaton_against_all_edits():
    lazy, arcs = repair.Lazy(), repair._arcs
    words = [w for n in range(5) for w in itertools.product("adeghimp", repeat=n)]
    for word in random.Random(3).sample(words, 600):
        word = "".join(word)
        best = {(0, 0): (0, "")}  # forward, over (row, state), whole strings
        for i in range(len(word) + 1):
            for _ in range(4):
                for q in range(4):
                    if (i, q) in best:
                        c, e = best[i, q]
                        to = (i, repair.FILL[q][1])
                        best[to] = min(best.get(to, (99999, "")), (c + 3, e + "I"))
            for q in range(4):
                if i < len(word) and (i, q) in best:
                    for e, c, r in arcs(word[i], q):
                        best[i + 1, r] = min(best.get((i + 1, r), (99999, "")), (best[i, q][0] + c, best[i, q][1] + e))
        want = min(best[len(word), q] for q in (0, 3) if (len(word), q) in best)
        states, total = lazy.scan(word)
        edits, q, cost = lazy.trace(word, states, 0)
        more, c = repair.ending(q)
        assert cost + c == want[0] == lazy.vectors[states[0]][0] + total
        assert len(edits + more) <= 3 * len(word) + 2
    assert len(lazy.vectors) < 200


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "", " \t", "cut off", "Why? \n", "end.\x0b", "a.b", None, "é", "Long " * 500 + ".", " "]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u"]
    rows = [(c, rng.choice([None, *range(12)]) if c % 3 == 0 else t, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 14))]
    rows += [(None, t, "user", "Hi.") for t in range(4)] + [(7, 0, "user", "Yes.")] * 3
    return rows + [(99, t, rng.choice(roles), rng.choice(texts)) for t in range(400)] + [(98, 3, "user", "Same.")] * 50


@pytest.mark.parametrize("part_bytes", [32 << 20, 9000, 600])
def test_against_plain_version(spark, odd_rows, part_bytes):
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as serial", "'x' as conv", "0 as n")
    assert returned(repair.repaired(df, part_bytes)) == plain(odd_rows)


def test_empty_and_all_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repaired(spark.createDataFrame([], schema)).count() == 0
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = returned(repair.repaired(spark.createDataFrame([(*gone, "user", "Hi.")], schema)))
    assert got == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_against_plain_version_and_sql(spark, small, odd_rows):
    from spindrift.llm.queries import op12_repair_lazy

    got = returned(op12_repair_lazy(spark, small))
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", odd_rows)
    rel = con.sql(ORACLES["op12_repair_lazy"])
    at = [rel.columns.index(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")]
    assert {r[rel.columns.index("conv_id")]: tuple(r[k] for k in at) for r in rel.fetchall()} == plain(odd_rows)
