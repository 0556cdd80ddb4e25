"""Conversation structure repair by the least big-integer weight over a DAG of edits.

Nodes of the DAG are (row, state of the role grammar ``(s?(ua)+)?``), edges are edits:
keep, give the role that the grammar wants, delete, insert a turn. An edge's weight
is one integer: its cost above, and below it, in a field of fixed width, the
digit of its letter at the letter's own place, places past the end being zero.
Weights are added up and the least integer at a node decides at once which way is cheapest and,
among the cheapest, whose letters come first in ASCII order.

A conversation may be of any length, so it is cut into blocks of rows. A block is
solved from every state it may be entered in; of two ways of equal cost through the
same rows neither's letters can begin the other's (costs follow from letters, and only an
insertion, which costs, is no row's letter), so the best way between two states of a
block is one whatever surrounds it, and blocks are put together by costs and their own letters alone.

Rows are dealt by ranges of (conversation, turn), so a conversation of a third of all rows is spread over
tasks; only its blocks' summaries meet. Its letters are a string in its result row, a byte a row. The
digest of the repaired rows is SHA-256 of one stream, so that is read in order by one
task, row by row, with no more held than the letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import join_hot, materialize

#: States of the role grammar: nothing yet, after the system turn, after a user's, after an assistant's (the first and last may end).
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a row's initial leads to, by state; a pair that is not here breaks the grammar.
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after the turn that the grammar wants next, which is the user's or the assistant's.
WANTED = (USER, USER, ASSISTANT, USER)
#: Costs (fixed values of the contract) and the letters' digits, in ASCII order; 0 stands for the end.
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
LETTERS = " DIKR"
D, I, K, R = range(1, 5)
BITS = 3
#: Rows that are solved together.
BLOCK = 128
WHITE = " \t\n\x0b\x0c\r"

Node = tuple[int, int]  # weight, letters so far
BLANK, DUPLICATE, TRUNCATED = range(1, 4)


def solve(rows: list[tuple[str, int]], start: int) -> dict[int, tuple[int, str]]:
    """Cheapest cost and letters from ``start`` to each state that can be reached through ``rows``, of (role's initial, first fault or 0)."""
    width = 3 * len(rows)  # a row's letter and at most two insertions before it
    cost_at = BITS * width

    def step(node: Node, cost: int, digit: int) -> Node:
        weight, used = node
        return weight + (cost << cost_at) + (digit << BITS * (width - 1 - used)), used + 1

    def offer(nodes: dict[int, Node], state: int, node: Node) -> None:
        if state not in nodes or node < nodes[state]:
            nodes[state] = node

    now: dict[int, Node] = {start: (0, 0)}
    for initial, fault in rows:
        for state in (START, SYSTEM, ASSISTANT, USER):  # inserted turns; two in a row at most are ever worth it
            if state in now:
                offer(now, WANTED[state], step(now[state], INSERT, I))
        after: dict[int, Node] = {}
        more = CUT_OFF if fault == TRUNCATED else 0
        for state, node in now.items():
            offer(after, state, step(node, DELETE, D))
            if fault not in (BLANK, DUPLICATE):
                offer(after, WANTED[state], step(node, RENAME + more, R))
                if (state, initial) in FOLLOWS:
                    offer(after, FOLLOWS[state, initial], step(node, KEEP + more, K))
        now = after
    out = {}
    for state, (weight, used) in now.items():
        letters = "".join(LETTERS[weight >> BITS * (width - 1 - k) & (1 << BITS) - 1] for k in range(used))
        out[state] = (weight >> cost_at, letters)
    return out


#: What ends a conversation in each state: cost and letters.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def join_blocks(blocks: list[list[dict[int, tuple[int, str]]]]) -> tuple[int, str]:
    """Cheapest cost and letters of a conversation from its blocks, each a list by state of entry of what ``solve`` gave."""
    rest: list[tuple[int, list]] = [(cost, [letters, None]) for cost, letters in ENDS]
    for block in reversed(blocks):
        entered = []
        for ways in block:
            best = min(((cost + rest[t][0], letters, t) for t, (cost, letters) in ways.items()), default=None)
            entered.append((best[0], [best[1], rest[best[2]][1]]) if best else (1 << 62, None))
        rest = entered
    cost, chain = rest[START]
    parts = []
    while chain:
        parts.append(chain[0])
        chain = chain[1]
    return cost, "".join(parts)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): ``rows`` with one in four spoilt, as crc32 of ``conversation:turn`` modulo 20 has it.

    0 marks the row as gone, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 doubles the row, 4 makes its role the user's.
    Null roles and texts are one space; so is a null conversation or turn in the hashed text.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(conv_col).cast("string"), blank), F.coalesce(F.col(turn_col).cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col(text_col).cast("string"), blank)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col).cast("string"), blank)).alias("role"),
                       F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                       (kind == 0).alias("gone"), copies).drop("copy")


def _named(conv: Column) -> Column:
    """A conversation's id as text that keeps null and empty apart."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("null"))


def _digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))


def _codes(rows: DataFrame) -> DataFrame:
    """(conv, turn, digest, code, initial, later): rows without their texts.

    ``code``: 0, ``BLANK``, ``TRUNCATED``, or -1 for a row that is gone. ``later``: an equal role and text stand at an earlier turn.
    """
    ending = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    code = F.when(F.col("gone"), -1).when(ending == "", BLANK).when(~ending.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    slim = materialize(rows.select(_named(F.col("conv")).alias("conv"), "turn", _digest().alias("digest"), code.cast("int").alias("code"), F.substring("role", 1, 1).alias("initial")), "repair-codes")
    there = slim.where("code >= 0")
    copied = (there.groupBy("conv", "digest").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("first"))
              .where("copies > 1").withColumn("copied", F.lit(True)))
    later = F.coalesce(F.col("copied") & ~F.col("turn").eqNullSafe(F.col("first")), F.lit(False))
    return join_hot(slim, materialize(copied, "repair-copies"), ["conv", "digest"], "copies", "left").select("conv", "turn", "digest", "code", "initial", later.alias("later"))


_BLOCK = ("conv string, part int, block int, first_turn long, last_turn long, turns long, first_initial string, last_initial string, "
          "illegal long, blank long, duplicate long, truncated long, costs array<long>, letters array<string>")
_PAIRS = ("su", "ua", "au")


class _Open:
    """A block that still takes rows."""

    def __init__(self, conv: str, whole: bool):
        self.conv, self.whole = conv, whole
        self.rows: list[tuple[str, int]] = []
        self.turns: list[int | None] = []

    def summary(self, part: int, number: int) -> tuple:
        known = [t for t in self.turns if t is not None]
        initials = [i for i, _ in self.rows]
        faults = [f for _, f in self.rows]
        ways = [solve(self.rows, s) if s == START or not self.whole else {} for s in range(4)]
        flat = [w.get(t, (-1, "")) for w in ways for t in range(4)]
        return (self.conv, part, number, known[0] if known else None, known[-1] if known else None, len(set(known)), initials[0] if initials else None, initials[-1] if initials else None,
                sum(a + b not in _PAIRS for a, b in zip(initials, initials[1:])), *[faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)], [c for c, _ in flat], [x for _, x in flat])


def _blocks(codes: DataFrame) -> DataFrame:
    """Rows dealt by ranges of (conversation, turn, digest) and summed up block by block, each block within one task."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, begun = TaskContext.get().partitionId(), 0, False
        now: _Open | None = None
        before = None
        for batch in batches:
            out = []
            turns = [None if t is None or t != t else int(t) for t in batch["turn"].tolist()]
            for conv, turn, digest, code, initial, later in zip(batch["conv"], turns, batch["digest"], batch["code"], batch["initial"], batch["later"]):
                if now is None or conv != now.conv or len(now.rows) >= BLOCK:
                    if now is not None:
                        out.append(now.summary(part, number))
                        number += 1
                    # only a conversation that begins in this task is known to be entered with nothing before it
                    now = _Open(conv, begun and (now is None or conv != now.conv))
                    begun = True
                if code < 0:
                    continue
                copy = later or before == (conv, turn, digest)
                before = conv, turn, digest
                now.rows.append((initial, BLANK if code == BLANK else DUPLICATE if copy else code))
                now.turns.append(turn)
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([now.summary(part, number)], columns=names)

    order = ["conv", "turn", "digest"]
    # turns as text, so that pandas keeps whole numbers whole
    return (codes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("turn", F.col("turn").cast("string")).mapInPandas(sum_up, _BLOCK))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plan_repairs(codes: DataFrame) -> DataFrame:
    """(conv, ``COUNTS``, audit) from rows as ``_codes`` gives them: faults, and the cheapest edits' letters."""
    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[tuple] = []

        def done() -> tuple:
            blocks, totals = [], [0] * 4
            least = most = last = ending = None
            distinct = 0
            for _, _, _, first_turn, last_turn, turns, first_initial, last_initial, illegal, blank, duplicate, truncated, costs, letters in own:
                if turns:
                    least = first_turn if least is None else least
                    distinct += turns - (last == first_turn)
                    most = last = last_turn
                if first_initial is not None:
                    totals[3] += illegal + (ending is not None and ending + first_initial not in _PAIRS)
                    ending = last_initial
                for k, n in enumerate((blank, duplicate, truncated)):
                    totals[k] += n
                blocks.append([{t: (int(costs[4 * s + t]), letters[4 * s + t]) for t in range(4) if costs[4 * s + t] >= 0} for s in range(4)])
            cost, audit = join_blocks(blocks)
            gaps = most - least + 1 - distinct if least is not None else 0
            return (own[0][0], gaps, *totals, cost, audit)

        def numbers(rows: pd.DataFrame) -> Iterator[tuple]:
            firsts, lasts = (["" if t is None else t for t in rows[c]] for c in ("first_turn", "last_turn"))
            for row, a, b in zip(rows.itertuples(index=False, name=None), firsts, lasts):
                yield (*row[:3], int(a) if a else None, int(b) if b else None, *row[5:])

        for batch in batches:
            out = []
            for row in numbers(batch):
                if own and own[0][0] != row[0]:
                    out.append(done())
                    own.clear()
                own.append(row)
            yield pd.DataFrame(out, columns=["conv", *COUNTS, "audit"])
        if own:
            yield pd.DataFrame([done()], columns=["conv", *COUNTS, "audit"])

    blocks = _blocks(codes).withColumns({c: F.col(c).cast("string") for c in ("first_turn", "last_turn")})
    return blocks.repartition("conv").sortWithinPartitions("conv", "part", "block").mapInPandas(settle, "conv string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


def apply_repairs(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired rows, (conv, place, role, text), in order of ``place``: ``rows`` as ``damage`` gives them, edited as ``plans`` say."""
    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, letters, at, state, place = None, "", 0, START, 0
        for batch in batches:
            out = []

            def put(role: str, text: str) -> None:
                nonlocal place
                out.append((conv, place, role, text))
                place += 1

            def insertions() -> None:
                nonlocal at, state
                while at < len(letters) and letters[at] == "I":
                    state = WANTED[state]
                    put("user" if state == USER else "assistant", "")
                    at += 1

            for own, head, role, text in zip(batch["conv"], batch["head"], batch["role"], batch["text"]):
                if head:
                    conv, letters, at, state, place = own, text, 0, START, 0
                    insertions()
                    continue
                letter = letters[at]
                at += 1
                if letter == "K":
                    state = FOLLOWS[state, role[:1]]
                    put(role, text)
                elif letter == "R":
                    state = WANTED[state]
                    put("user" if state == USER else "assistant", text)
                insertions()
            yield pd.DataFrame(out, columns=["conv", "place", "role", "text"])

    body = rows.where(~F.col("gone")).select(_named(F.col("conv")).alias("conv"), F.lit(False).alias("head"), "turn", _digest().alias("digest"), "role", "text")
    heads = plans.select("conv", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return (body.unionByName(heads).repartition("conv").sortWithinPartitions("conv", F.desc("head"), "turn", "digest").select("conv", "head", "role", "text")
            .mapInPandas(edit, "conv string, place long, role string, text string"))


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans and repaired rows of conversations given as ``damage`` gives them (columns conv, turn, role, text, gone).

    Plans: (conv, ``COUNTS``, audit), one row per conversation. Repaired rows: (conv, place, role, text). In both ``conv`` is
    the id as text behind ``=``, or ``null``. Rows go by turn, nulls first; rows of one turn by a digest of role and text, so
    that equal rows are neighbours. A row's first fault counts: blank (nothing but white space), duplicate (an equal role and text
    stand earlier), truncated (the last character that is not white space is none of ``.!?``). A conversation all of whose rows are gone has zeros
    and an empty audit. Rows with a null conversation form one. Other columns are not read. An empty table gives no rows.
    """
    plans = materialize(plan_repairs(_codes(rows)), "repair-plans")
    return plans, apply_repairs(rows, plans)


def repair_digests(rows: DataFrame, conv_type: str) -> DataFrame:
    """(conv_id, ``COUNTS``, audit, repaired_sha256): plans with a running digest of ``role:text``, newline-joined, of the repaired rows."""
    plans, repaired = repair_conversations(rows)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, sha = None, None
        for batch in batches:
            out = []
            for own, role, text in zip(batch["conv"], batch["role"], batch["text"]):
                if own == conv:
                    sha.update(b"\n")
                else:
                    if conv is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = own, hashlib.sha256()
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(out, columns=["conv", "sha"])
        if conv is not None:
            yield pd.DataFrame([(conv, sha.hexdigest())], columns=["conv", "sha"])

    # repaired rows come conversation by conversation in order, so their digest needs no other shuffle
    shas = repaired.select("conv", "role", "text").mapInPandas(digest, "conv string, sha string")
    back = F.when(F.col("conv") != "null", F.substr("conv", F.lit(2)).cast(conv_type))
    return plans.join(shas, "conv", "left").select(back.alias("conv_id"), *COUNTS, "audit", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
