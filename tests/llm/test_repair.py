"""Conversation repair against a search of all edit scripts."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import queries, repair

ROWS = "conv_id long, turn long, role string, text string"


def accepts(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def viable(initials):
    return re.fullmatch("(s?(ua)*u?)?", initials) is not None


def cheapest(rows):
    """(cost, audit, repaired turns) by uniform-cost search over whole scripts: of equal cost the least audit is met first."""
    heap, seen = [(0, "", 0, (), "")], set()
    while heap:
        cost, audit, i, out, initials = heapq.heappop(heap)
        if i == len(rows) and accepts(initials):
            return cost, audit, list(out)
        if (cost, audit, i, initials) in seen:
            continue
        seen.add((cost, audit, i, initials))
        ways = [(2, "I", 0, r, "") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            late = fault == "truncated"
            ways.append((3, "D", 1, None, None))
            if fault not in ("blank", "duplicate"):
                ways += [(0 + late, "K", 1, role, text)] + [(2 + late, "R", 1, r, text) for r in ("user", "assistant")]
        for price, edit, step, role, text in ways:
            after = initials if role is None else initials + (role[:1] or "?")
            if viable(after) and cost + price <= 3 * len(rows):
                heapq.heappush(heap, (cost + price, audit + edit, i + step, out if role is None else (*out, (role, text)), after))


def plain(rows):
    """The contract, in plain Python, for rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = convs[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                faults[fault] += 1
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit, fixed = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in repair.summarise(repair.repair(repair.mark_faults(repair.damage(df)), spill=64)).collect()}


def test_program_against_all_scripts():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "u", "assist", "tool", "", " "]
    for _ in range(1500):
        rows = [(rng.choice(roles[:3] if rng.random() < 0.8 else roles), f"t{rng.randint(0, 9)}", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 7))]
        steps = list(repair.repair_rows(((i, *r) for i, r in enumerate(rows)), spill=rng.choice([1, 1 << 20])))
        cost, audit, fixed = cheapest(rows)
        assert (sum(s[7] for s in steps), "".join(s[1] for s in steps)) == (cost, audit)
        assert [(s[5], s[6]) for s in steps if s[1] != "D"] == fixed and [s[0] for s in steps] == list(range(len(steps)))


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(11)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "assistant", "no turn"), (1, 0, "system", ""), (1, 5, "user", " \n\t"), (1, 5, "user", "b?"), (1, 5, "user", "a!")]
    rows += [(c, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", None, "Tool"]), rng.choice(["Yes.", "no", "", None, "why? "])) for c in range(40, 80) for _ in range(rng.randint(1, 6))]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone"))
    df = spark.createDataFrame(rows, ROWS).withColumns({"alive": F.lit(False), "fault": F.lit("x"), "cost": F.lit(1), "__seen": F.lit(2)})
    got = found(df)
    assert got == plain(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], ROWS)
    assert found(empty) == {}


def test_long_conversation_spills(spark):
    n = 150_000
    rows = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "id", F.lit(".")).alias("text"))
    steps = repair.repair(rows.withColumn("fault", F.when(F.col("turn") % 1000 == 999, "blank")), spill=1 << 12)
    total = steps.agg(F.sum("cost").alias("cost"), F.count("*").alias("n"), F.sum((F.col("edit") == "D").cast("int")).alias("gone")).first()
    assert total.gone == n // 1000 and total.cost == 3 * total.gone + 2 * total.gone
    audit = repair.summarise(steps).first().audit
    assert len(audit) == total.n and audit.count("I") + audit.count("R") + audit.count("D") == 2 * total.gone


@pytest.mark.parametrize("end", range(1, 4))
def test_blocks_of_backpointers_come_back_in_order(end):
    program = repair.Program(spill=1 << 10)
    size = (1 << 16) * end - (end == 2)
    for i in range(size):
        program.add("ua"[i % 2] if i % 5000 else "u", "")
    assert len(list(program.edits())) == size
