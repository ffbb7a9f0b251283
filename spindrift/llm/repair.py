"""Conversation structure repair by lazy weighted determinisation.

The rows of a conversation, in order, are a word; what may be done with each (keep, rerole, delete, insert
before it) is a weighted automaton over the four states of the role pattern ``(s?(ua)+)?``: nothing yet,
after s, after u, after a. The costs from all four states to the end are a vector. Less their smallest member, such
vectors are the states of a deterministic automaton, of which a conversation needs few: each is made when it is
first met, and its transitions are kept in a table with the costs taken off. A scan of the table
gives the cost. The scan goes from the last row to the first, so that the trace, which goes back over the
arcs that are tight (whose cost is what the vectors differ by), meets the rows in order, and can take the
ASCII-least letter each time.

Conversations of any length are split. Rows are sorted over range partitions; what a partition has
of a conversation is a block, of which one letter a row goes on. The few conversations of several
blocks take two more steps: a block's costs between all pairs of states are a small matrix, from which its end's vector
follows, and its traces from all four states, of which the blocks before choose one. Only the repaired text's SHA-256
must be taken in order: rows stream through, and nothing of them is kept.

Defined results: a null conv_id, turn, role or text is one space in what is compared and hashed, and null
conv_ids are one conversation, returned as null; rows of one turn are in the order of their role, then of the SHA-256 of
role and text; roles are classed by their first letter, and all but s, u and a need an edit; a conversation that
damage leaves without rows has zeros; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import arrow_stage, in_order, stored

#: White space that a blank text may have.
BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The next state by the letter of a role; the only role that may be put in, by state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FILL = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
FINAL, FAR = (0, 6, 3, 0), 1 << 40
#: Rows as letters: role s, u, a or another; no fault, blank, duplicate or truncated.
ROLES, CODES = "suax", "abcdefghijklmnop"


def code(role: str, fault: int) -> str:
    """The letter of a row. Faults: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    return CODES[4 * ROLES.index(role) + fault]


def _arcs(letter: str, q: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that consume a row, in ASCII order."""
    k = CODES.index(letter)
    role, fault = ROLES[k // 4], k % 4
    out = [("D", DELETE, q)]
    if fault in (0, 3):
        more = TRUNCATED if fault == 3 else 0
        if role in NEXT[q]:
            out.append(("K", KEEP + more, NEXT[q][role]))
        out.append(("R", REROLE + more, FILL[q][1]))
    return out


def _closed(v: list[int]) -> tuple[int, ...]:
    """``v`` with insertions before the row: two at most, as a third would repeat a state."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return tuple(min(FAR, x) for x in (min(v[0], INSERT + u), min(v[1], INSERT + u), u, a))


class Lazy:
    """The deterministic automaton as far as words have needed it."""

    def __init__(self):
        self.ids: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: list[dict[str, tuple[int, int]]] = []
        self.moves: dict[tuple[int, str, int], tuple[str, int, int]] = {}

    def state(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """(state of the normalised vector, what was taken off)."""
        least = min(vector)
        v = tuple(x - least if x < FAR else FAR for x in vector)
        if v not in self.ids:
            self.ids[v] = len(self.vectors)
            self.vectors.append(v)
            self.table.append({})
        return self.ids[v], least

    def step(self, s: int, letter: str) -> tuple[int, int]:
        """The transition before ``letter``: found, or made and kept."""
        t = self.table[s].get(letter)
        if t is None:
            v = self.vectors[s]
            t = self.table[s][letter] = self.state(_closed([min(c + v[r] for _, c, r in _arcs(letter, q)) for q in range(4)]))
        return t

    def scan(self, word: str, end: tuple[int, ...] = FINAL) -> tuple[list[int], int]:
        """(states before each letter and at the end, sum of what was taken off)."""
        s, total = self.state(end)
        states = [s]
        for letter in reversed(word):
            s, off = self.step(s, letter)
            states.append(s)
            total += off
        states.reverse()
        return states, total

    def move(self, after: int, letter: str, q: int) -> tuple[str, int, int]:
        """(edits, next state, their cost) from ``q`` over ``letter``, by tight arcs, the ASCII-least first; ``after``: the state behind the letter."""
        key = after, letter, q
        if key not in self.moves:
            v, (before, off) = self.vectors[after], self.step(after, letter)
            u, edits, cost = self.vectors[before], "", 0
            while True:
                tight = [(e, c, r) for e, c, r in _arcs(letter, q) if c + v[r] == u[q] + off]
                if not tight or tight[0][0] > "I" and INSERT + u[FILL[q][1]] == u[q]:
                    q, edits, cost = FILL[q][1], edits + "I", cost + INSERT
                    continue
                e, c, r = tight[0]
                self.moves[key] = edits + e, r, cost + c
                break
        return self.moves[key]

    def trace(self, word: str, states: list[int], q: int) -> tuple[str, int, int]:
        """(edits, last state, their cost) of the whole word from state ``q``, but for insertions after its last row."""
        edits, total = [], 0
        for letter, after in zip(word, states[1:]):
            e, q, c = self.move(after, letter, q)
            edits.append(e)
            total += c
        return "".join(edits), q, total

    def matrix(self, word: str) -> list[int]:
        """Costs from each state before the word (rows) to each after it, insertions after it left out."""
        columns = []
        for r in range(4):
            states, total = self.scan(word, tuple(0 if q == r else FAR for q in range(4)))
            columns.append([min(FAR, x + total) for x in self.vectors[states[0]]])
        return [columns[r][q] for q in range(4) for r in range(4)]


def ending(q: int) -> tuple[str, int]:
    """(insertions after the last row, their cost)."""
    return "I" * (FINAL[q] // INSERT), FINAL[q]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text after the damage."""
    given = conversations.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    kind = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    hurt = given.withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.expr("sequence(1, if(kind = 3, 2, 1))")
    return hurt.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(twice).alias("copy")).drop("copy")


def _rows(conversations: DataFrame, part_bytes: int) -> DataFrame:
    """The damaged rows in order, stored, each with its facts."""
    letters = "".join(f"chr({ord(c)}), " for c in BLANKS)[:-2]
    d = damaged(conversations).withColumn("bare", F.expr(f"trim(trailing concat({letters}) from text)"))
    first = F.substring("role", 1, 1)
    d = d.select(
        "conv", "turn", "role", "text", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"),
        F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("letter"), (F.col("bare") == "").alias("blank"), F.substring(F.col("bare"), -1, 1).isin(".", "!", "?").alias("ends"),
    )
    return in_order(d, ["conv", "turn", "role", "same"], row_bytes=F.octet_length("text") + 200, part_bytes=part_bytes)


def _blocks(rows: DataFrame) -> DataFrame:
    """conv, part, first (serial), word, parts (of the conversation): one letter for each row of a block.

    A row is a duplicate if it isn't the first of its content in the conversation. First rows are found by partial aggregation and joined by
    the row's serial number, so that neither a hot conversation nor a row that is everywhere meets in one task."""
    firsts = rows.groupBy("conv", "same").agg(F.min("serial").alias("serial")).select("serial", F.lit(True).alias("is_first"))
    r = rows.select("conv", "part", "serial", "letter", "blank", "ends").join(firsts, "serial", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("is_first").isNull(), 2).when(~F.col("ends"), 3).otherwise(0)
    lettered = r.withColumn("c", F.substring(F.lit(CODES), 4 * (F.expr(f"instr('{ROLES}', letter)") - 1) + fault + 1, F.lit(1)))
    words = lettered.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("serial", "c"))).alias("own"))  # rows of one range partition
    words = words.select("conv", "part", F.col("own")[0]["serial"].alias("first"), F.array_join("own.c", "").alias("word"))
    return words.join(words.groupBy("conv").agg(F.count("*").alias("parts"), F.max("part").alias("last_part")), "conv")


def _alone(batches):
    """Edits of the blocks that are whole conversations."""
    lazy = Lazy()
    for b in batches:
        for conv, part, first, word in zip(b["conv"], b["part"], b["first"], b["word"]):
            states, _ = lazy.scan(word)
            edits, q, cost = lazy.trace(word, states, 0)
            more, c = ending(q)
            yield conv, part, first, word, 0, edits + more, cost + c


def _matrices(batches):
    lazy = Lazy()
    for b in batches:
        for conv, part, word in zip(b["conv"], b["part"], b["word"]):
            yield conv, part, lazy.matrix(word)


def _traces(batches):
    """Of each block, given the costs behind it: edits, last states and costs from all four states."""
    lazy = Lazy()
    for b in batches:
        for conv, part, word, end, last in zip(b["conv"], b["part"], b["word"], b["end"], b["is_last"]):
            states, _ = lazy.scan(word, tuple(end))
            for q in range(4):
                edits, r, cost = lazy.trace(word, states, q)
                if last:
                    more, c = ending(r)
                    edits, cost = edits + more, cost + c
                yield conv, part, q, edits, r, cost


def _ends(blocks):
    """One conversation's blocks, sixteen numbers each: the costs behind each, from the last to the first."""
    import pandas as pd

    out, v = [], FINAL
    for b in blocks.sort_values("part", ascending=False).itertuples():
        out.append((b.conv, b.part, list(v)))
        m = b.costs
        v = _normal([min(m[4 * q + r] + v[r] for r in range(4)) for q in range(4)])
    return pd.DataFrame(out, columns=["conv", "part", "end"])


def _normal(v: list[int]) -> list[int]:
    least = min(v)
    return [min(FAR, x - least) for x in v]


def _entries(blocks):
    """One conversation's blocks, four numbers each: the state in which each is entered."""
    import pandas as pd

    out, q = [], 0
    for _, own in blocks.sort_values(["part", "q"]).groupby("part", sort=True):
        out.append((own.conv.iloc[0], own.part.iloc[0], q))
        q = int(own.after.iloc[q])
    return pd.DataFrame(out, columns=["conv", "part", "q"])


_EDITED = "conv string, part int, first long, word string, q int, edits string, cost long"


def edited(blocks: DataFrame) -> DataFrame:
    """conv, part, first, word, q (state before), edits, cost of each block."""
    alone = arrow_stage(blocks.where("parts = 1").select("conv", "part", "first", "word"), _alone, _EDITED)
    split = blocks.where("parts > 1")
    costs = arrow_stage(split.select("conv", "part", "word"), _matrices, "conv string, part int, costs array<long>")
    ends = costs.groupBy("conv").applyInPandas(_ends, "conv string, part int, end array<long>")
    given = split.join(ends, ["conv", "part"]).select("conv", "part", "word", "end", (F.col("part") == F.col("last_part")).alias("is_last"))
    traces = stored(arrow_stage(given, _traces, "conv string, part int, q int, edits string, after int, cost long"))
    entries = traces.select("conv", "part", "q", "after").groupBy("conv").applyInPandas(_entries, "conv string, part int, q int")
    several = split.join(traces.join(entries, ["conv", "part", "q"]), ["conv", "part"])
    names = [x.split()[0] for x in _EDITED.split(", ")]
    return alone.unionByName(several.select(*names))


def _hashed(batches):
    """From rows sorted by conversation and serial number, each block's edits before its rows: a row for each conversation."""
    conv, edits, out = None, iter(()), None

    class Out:
        def __init__(self):
            self.hash, self.lines, self.q, self.edits = hashlib.sha256(), 0, 0, []
            self.counts, self.cost, self.before, self.illegal = [0, 0, 0, 0], 0, "", 0

        def line(self, role, text):
            self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
            self.lines += 1

        def insert(self):
            role, self.q = FILL[self.q]
            self.line(role, "")

        def row(self):
            return conv, self.counts[1], self.counts[2], self.counts[3], self.illegal, self.cost, "".join(self.edits), self.hash.hexdigest()

    def rest():
        for _ in edits:  # insertions after a block's last row
            out.insert()

    for b in batches:
        for c, role, text, letter, word, made, cost in zip(*(b[k] for k in ("conv", "role", "text", "letter", "word", "edits", "cost"))):
            if c != conv:
                if out:
                    rest()
                    yield out.row()
                conv, edits, out = c, iter(()), Out()
            if word is not None:
                rest()
                edits = iter(made)
                out.edits.append(made)
                out.cost += cost
                for k in (1, 2, 3):
                    out.counts[k] += sum(word.count(code(r, k)) for r in ROLES)
                continue
            out.illegal += bool(out.before) and out.before + letter not in ("su", "ua", "au")
            out.before = letter
            while (e := next(edits)) == "I":
                out.insert()
            if e == "K":
                out.q = NEXT[out.q][letter]
                out.line(role, text)
            elif e == "R":
                role, out.q = FILL[out.q]
                out.line(role, text)
    if out:
        rest()
        yield out.row()


def repaired(conversations: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``part_bytes``: of rows in a task, and so in a block."""
    rows = _rows(conversations, part_bytes)
    done = edited(stored(_blocks(rows)))
    null = lambda kind: F.lit(None).cast(kind)
    lines = rows.select("conv", "serial", F.lit(1).alias("kind"), "role", "text", "letter", null("string").alias("word"), null("string").alias("edits"), null("long").alias("cost"))
    heads = done.select("conv", F.col("first").alias("serial"), F.lit(0).alias("kind"), null("string").alias("role"), null("string").alias("text"), null("string").alias("letter"), "word", "edits", "cost")
    ordered = lines.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "serial", "kind").drop("serial", "kind")
    found = arrow_stage(ordered, _hashed, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    all_ = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return all_.join(found.join(turns, "conv"), "conv", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
