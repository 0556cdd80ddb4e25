import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from tapeloom.llm import registry, turn_repair
from tests.llm.helpers import DIR

GRAMMAR = re.compile(r"(s?(ua)+)?")


def everything(rows):
    """Cheapest (cost, letters, repaired rows) by trying every edit of every row, (role, text, fault); insertions as the grammar wants them."""
    best = None

    def go(k, state, cost, letters, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows) and GRAMMAR.fullmatch("".join(r[0][:1] for r in out)):
            if best is None or (cost, letters) < best[:2]:
                best = cost, letters, out
        wanted = "assistant" if state == "u" else "user"
        if not letters.endswith("II"):
            go(k, wanted[0], cost + 3, letters + "I", out + [(wanted, "")])
        if k < len(rows):
            role, text, fault = rows[k]
            go(k + 1, state, cost + 4, letters + "D", out)
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                go(k + 1, wanted[0], cost + 3 + more, letters + "R", out + [(wanted, text)])
                if role and role[0] in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                    go(k + 1, role[0], cost + more, letters + "K", out + [(role, text)])

    go(0, "", 0, "", [])
    return best


def faults(rows):
    """(role, text, fault) from (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        ink = re.sub("[\x20\x09-\x0D]", "", text)
        out.append((role, text, 1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def whole(rows, block=10_000):
    codes = [(r[:1], f) for r, _, f in rows]
    cut = [codes[k:k + block] for k in range(0, len(codes), block)]
    return turn_repair.join_blocks([[turn_repair.solve(b, s) for s in range(4)] for b in cut])


def some_rows(rng, n):
    return faults([(rng.choice(["system", "user", "assistant", "tool", " "]), rng.choice(["Yes.", "No!", "cut", "", " \n", "x?"]) + rng.choice(["", "", str(rng.random()) + "."])) for _ in range(n)])


def test_least_weight_against_every_edit():
    rng = random.Random(7)
    for _ in range(400):
        rows = some_rows(rng, rng.randrange(6))
        assert whole(rows) == everything(rows)[:2]


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_change_nothing(block):
    rng = random.Random(block)
    for _ in range(200):
        rows = some_rows(rng, rng.randrange(40))
        assert whole(rows, block) == whole(rows)


def by_hand(rows):
    """The contract's columns of conversations given as (conv, turn, role, text)."""
    out, kept = {}, []
    for conv, turn, role, text in rows:
        out[conv] = None
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    for conv in out:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        rows = faults([r[2:] for r in own])
        known = [r[1] for r in own if r[1] is not None]
        illegal = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
        cost, audit, repaired = everything(rows)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[[f for _, _, f in rows].count(k) for k in (1, 2, 3)], illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def shown(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query_against_every_edit(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(registry.queries()["op12_turn_repair"](spark, DIR)) == by_hand(rows)


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, 2, "assistant", "Ho"), (None, 0, "user", "a."), (None, None, "assistant", "b"),
            (3, 9, "system", "s."), (3, 10**15, "user", "q?"), (4, 0, "assistant", " \x0b\x0c"), (5, 1, "", "text."), (5, 3, "uncle", "u."), (5, 7, "ant", "a.\n ")]
    rows += [(k, t, r, f"{t} text.") for k in range(100, 160) for t, r in enumerate(["system", "user", "assistant"][k % 3:])] + [(1, 2, "user", "Hi.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, gone int")
    got = shown(turn_repair.repair_digests(turn_repair.damage(df), "bigint"))
    assert got == by_hand(rows)
    assert any(v[:6] == (0,) * 6 and v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in got.values())
    assert turn_repair.repair_digests(turn_repair.damage(df.limit(0)), "bigint").count() == 0


def test_one_conversation_of_a_third_of_all_rows(spark):
    """It is spread over tasks, cut into blocks, and comes out as if it were one."""
    rng = random.Random(2)
    rows = [(0, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"{t}."])) for t in range(3000)]
    rows += [(1 + k // 4, k % 4, ["user", "assistant"][k % 2], f"{k}.") for k in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        damaged = turn_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        blocks = turn_repair._blocks(turn_repair._codes(damaged)).where("conv = '=0'").collect()
        assert len({b.part for b in blocks}) > 2 and len(blocks) > 3000 / turn_repair.BLOCK
        got = shown(turn_repair.repair_digests(damaged, "bigint"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = []
    for c, t, role, text in rows[:3000]:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind:
            kept += [("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (1 + (kind == 3))
    assert got[0][5:7] == whole(faults(kept)) and len(got) == 1001
