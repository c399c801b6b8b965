"""Conversation structure repair by Four-Russians block tables.

A conversation becomes a string of row symbols: what has to go (blank or a duplicate), or its role's initial (system, user,
assistant, another) with a mark where the text is cut off. The repaired roles must read ``(s?(ua)+)?``, an automaton of four
states. A cost-to-go vector holds the least cost of the rest of the rows from each state; less its minimum it takes few
values, as an insertion leads from any state to the next. So for every such vector and every block of ``BLOCK`` symbols the
vector before the block, and what it costs, are computed once: a conversation is then one look-up a block, from its end to
its start. Tracing goes forward: each block is expanded backward from the vector behind it, and of the edits that keep the
least cost the one with the least letter is taken, so among all cheapest repairs the audit is the least string.

Spark flags the rows (no text is read twice), shuffles them once by conversation and sorts them; the tables work on sorted
batches. A conversation is one value: its turns are in memory together, other conversations' are not.

Defined results: a null role or text is one space (so such a text is blank); turns order nulls first, equal turns by role and
text; a null conv_id is a conversation like others; rows that repeat are duplicates; a role counts by its first character as
it stands; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbols looked up at once.
BLOCK = 4
#: What a row symbol stands for: 0 is a row that has to go, 1 + 2 * role + cut another row.
ROLES, SYMBOLS = "sua", 9
#: States: nothing yet, after the system's turn, after an assistant's turn, after a user's turn.
START, OPENED, ANSWERED, ASKED = range(4)
SPACES = " \t\n\x0b\x0c\r"
_NEXT = [ASKED, ASKED, ASKED, ANSWERED]
_KEPT = {"s": {START: OPENED}, "u": {START: ASKED, OPENED: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}}
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: Cost to go behind the last row.
_END = (0, 2 * INSERT, 0, INSERT)

OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, letters ascending; insertions come apart."""
    out = [("D", DELETE, state)]
    if symbol:
        role, cut = divmod(symbol - 1, 2)
        to = _KEPT[ROLES[role]].get(state) if role < len(ROLES) else None
        if to is not None:
            out.append(("K", CUT * cut, to))
        out.append(("R", REROLE + CUT * cut, _NEXT[state]))
    return out


def before(symbol: int, rest: tuple[int, ...]) -> tuple[int, ...]:
    """The cost-to-go vector before a row, from the one behind it."""
    v = [min(cost + rest[to] for _, cost, to in edits(symbol, q)) for q in range(4)]
    for _ in range(2):  # two insertions lead round
        v = [min(v[q], INSERT + v[_NEXT[q]]) for q in range(4)]
    return tuple(v)


class Tables:
    """Vectors (less their minimum) by number, and for each vector and block the vector before it and the cost between."""

    def __init__(self, block: int = BLOCK):
        self.block, self.vectors = block, [_END]
        number, steps = {_END: 0}, []
        for v in self.vectors:  # grows as new ones are reached
            row = []
            for symbol in range(SYMBOLS):
                got = before(symbol, v)
                least = min(got)
                got = tuple(x - least for x in got)
                if got not in number:
                    number[got] = len(self.vectors)
                    self.vectors.append(got)
                row.append((number[got], least))
            steps.append(row)
        one = np.array(steps, np.int64)
        self.step_to, self.step_cost = one[:, :, 0], one[:, :, 1]
        to, cost = self.step_to, self.step_cost
        for _ in range(block - 1):  # one more symbol in front of what the tables span
            front, price = self.step_to[to], self.step_cost[to] + cost[:, :, None]
            to, cost = (x.transpose(0, 2, 1).reshape(len(x), -1) for x in (front, price))
        self.to, self.cost = to.tolist(), cost.tolist()
        self.expanded: dict[tuple[int, tuple[int, ...], int], tuple[str, int]] = {}

    def code(self, symbols: tuple[int, ...]) -> int:
        n = 0
        for s in symbols:
            n = n * SYMBOLS + s
        return n

    def expand(self, rest: int, symbols: tuple[int, ...], state: int) -> tuple[str, int]:
        """The least letters that go through a block at the least cost, and the state behind it; ``rest`` is the vector there."""
        known = self.expanded.get((rest, symbols, state))
        if known is None:
            behind = [rest]
            for s in reversed(symbols):
                behind.append(int(self.step_to[behind[-1], s]))
            behind.reverse()
            letters, q = [], state
            for i, s in enumerate(symbols):
                here, after = self.vectors[behind[i]], self.vectors[behind[i + 1]]
                base = int(self.step_cost[behind[i + 1], s])
                while True:
                    ways = [("I", INSERT + here[_NEXT[q]] + base, _NEXT[q]), *((x, cost + after[to], to) for x, cost, to in edits(s, q))]
                    letter, _, q = min(w for w in ways if w[1] == here[q] + base)
                    letters.append(letter)
                    if letter != "I":
                        break
            known = self.expanded[rest, symbols, state] = ("".join(letters), q)
        return known

    def repair(self, symbols: list[int]) -> tuple[int, str]:
        """The least cost and the least audit of a conversation."""
        head = len(symbols) % self.block
        cuts = [0, *range(head, len(symbols) + 1, self.block)] if head else list(range(0, len(symbols) + 1, self.block))
        blocks = [tuple(symbols[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        at, total, behind = 0, 0, []
        for b in reversed(blocks):
            behind.append(at)
            if len(b) == self.block:
                k = self.code(b)
                at, total = self.to[at][k], total + self.cost[at][k]
            else:
                for s in reversed(b):
                    at, total = int(self.step_to[at, s]), total + int(self.step_cost[at, s])
        state, audit = START, []
        total += self.vectors[at][START]
        for b, rest in zip(blocks, reversed(behind)):
            letters, state = self.expand(rest, b, state)
            audit.append(letters)
        while _END[state]:
            audit.append("I")
            state = _NEXT[state]
        return total, "".join(audit)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def rewritten(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns that the edits of an audit make of these turns."""
    out, at = [], 0
    for letter in audit:
        asks = not out or not out[-1][0].startswith("u")
        if letter == "I":
            out.append(("user" if asks else "assistant", ""))
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            out.append((role, text))
        elif letter == "R":
            out.append(("user" if asks else "assistant", text))
    return out


class Conversation:
    """The rows of one conversation, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.turns = conv_id, [], []
        self.symbols: list[int] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.seen: set[tuple[str, str]] = set()

    def add(self, turn: int | None, role: str, text: str, blank: bool, cut: bool) -> None:
        same = (role, text) in self.seen
        self.seen.add((role, text))
        if blank:
            self.blank += 1
        elif same:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        initial = role[:1]
        if self.rows and self.rows[-1][0][:1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        place = ROLES.find(initial) if initial else -1
        self.symbols.append(0 if blank or same else 1 + 2 * (place if place >= 0 else len(ROLES)) + cut)
        self.rows.append((role, text))
        if turn is not None:
            self.turns.append(turn)

    def result(self) -> tuple:
        cost, audit = tables().repair(self.symbols)
        gaps = max(self.turns) - min(self.turns) + 1 - len(set(self.turns)) if self.turns else 0
        repaired = [{"role": r, "text": t} for r, t in rewritten(self.rows, audit)]
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, repaired


_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
     ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)
#: Conversations in a batch that is given back, and characters after which one is given back earlier.
_ROWS, _SIZE = 1_000, 16 << 20


def _batch(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _SCHEMA)], schema=_SCHEMA)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done, size = None, [], 0
    for batch in batches:
        for conv_id, turn, role, text, here, blank, cut in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = Conversation(conv_id)
            if here:
                now.add(turn, role, text, blank, cut)
                size += len(text)
            if len(done) >= _ROWS or size > _SIZE and done:
                yield _batch(done)
                done, size = [], 0
    if now is not None:
        done.append(now.result())
    if done:
        yield _batch(done)


def repaired(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """Of each conversation: its gaps, faults, the least cost, the audit of edits and the repaired turns. Rows where ``gone``
    holds are no turns, they only name their conversation (which then has an empty result if it has no others)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    here = F.lit(True) if gone is None else ~F.coalesce(gone, F.lit(False))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.when(here, text).alias("text"), here.alias("here"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    flagged = rows.select("conv_id", "turn", "role", "text", "here", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    return flagged.mapInArrow(_repairs, OUT)


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage: by the checksum of ``conv_id:turn`` a row goes (column ``gone``), loses its text or its closing marks,
    is repeated or becomes the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), F.col("gone"))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


QUERIES = {"op13_repair": op13_repair}
ORACLES: dict[str, str] = {}
