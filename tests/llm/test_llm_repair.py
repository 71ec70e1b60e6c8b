"""Operator 12 against an exhaustive search of edits."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from fixtures import SF
from sessionlens.llm import repair

SPACE = " \t\n\v\f\r"
ROWS = "conv_id long, turn long, role string, text string"


sys.setrecursionlimit(10_000)


def cheapest(rows):
    """(cost, audit, repaired rows) over all edits; `rows` are (role, text, fault)."""

    @lru_cache(maxsize=None)
    def best(i, made, inserts):
        """The least (cost, letters, rows) from row i on; `made` are the initials so far, reduced to what matters."""
        ways = []
        if i == len(rows) and made in ("", "a"):
            ways.append((0, "", ()))
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[made]
        if inserts < 3:
            for role in ("user", "assistant"):
                if role[0] in nexts:
                    cost, letters, rest = best(i, role[0], inserts + 1)
                    ways.append((cost + 3, "I" + letters, (f"{role}:", *rest)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, letters, rest = best(i + 1, made, 0)
            ways.append((cost + 4, "D" + letters, rest))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in nexts:
                    cost, letters, rest = best(i + 1, role[0], 0)
                    ways.append((cost + more, "K" + letters, (f"{role}:{text}", *rest)))
                for new in ("user", "assistant"):
                    if new[0] in nexts:
                        cost, letters, rest = best(i + 1, new[0], 0)
                        ways.append((cost + 3 + more, "R" + letters, (f"{new}:{text}", *rest)))
        return min(ways) if ways else (10**9, "", ())

    return best(0, "", 0)


def expected(conv_id, rows):
    """The contract's row of a conversation after damage; `rows` are (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for turn, role, text in rows:
        solid = text.rstrip(SPACE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: sum(m[2] == f for m in marked)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(tuple(marked))
    return (conv_id, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def after_damage(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kept = out.setdefault(conv_id, [])
        role, text = show(role), show(text)
        code = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if code == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(rng, convs, most):
    rows = []
    for c in convs:
        for t in range(rng.randint(0, most)):
            turn = rng.choice((t, t, t, t + rng.randint(0, 3), None))
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "s"))
            text = rng.choice(("Yes.", "No!", "and then", "  ", None, "", "ok?\n", "Yes. ", "é…", f"{rng.random()}."))
            rows.append((c, turn, role, text))
    return rows


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = random_rows(rng, [*range(1500), None], 7)
    df = spark.createDataFrame(rows, ROWS).withColumn("symbol", F.lit(1)).withColumn("at", F.lit("x")).repartition(5)
    want = sorted((expected(c, r) for c, r in after_damage(rows).items()), key=str)
    assert found(repair.op12_repair(df)) == want
    assert repair.op12_repair(df.limit(0)).count() == 0


def test_given_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(repair.op12_repair(df)) == sorted((expected(c, r) for c, r in after_damage(rows).items()), key=str)


def test_conversations_cut_over_pieces_and_tasks(spark, monkeypatch):
    """Small pieces and many partitions give what whole conversations give."""
    rng = random.Random(7)
    rows = random_rows(rng, [0, 0, 1, 2, 3], 40) + [(9, t, rng.choice(("user", "assistant")), f"{t % 50}.") for t in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    want = sorted((expected(c, r) for c, r in after_damage(rows).items()), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert found(repair.op12_repair(df)) == want
        scan = repair._scan

        def small(batches):
            repair.PIECE_ROWS, repair.HELD = 3, 2
            yield from scan(batches)

        monkeypatch.setattr(repair, "_scan", small)
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert found(repair.op12_repair(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_single_steps(seed):
    """Powers of the min-plus matrix and blocks of unrolled rows equal one row after the other."""
    rng = random.Random(seed)
    runs = [(rng.randrange(12), rng.choice((1, 2, 5, 3000))) for _ in range(8)]
    costs, single = repair.END, repair.END
    for symbol, n in reversed(runs):
        costs = repair.advanced(symbol, n, costs)
        for _ in range(n):
            single = repair.before(symbol, single)
    assert costs == single and repair.applied(repair.matrix_of(runs), repair.END) == costs
    letters, total, state = "", 0, repair.EMPTY
    steps = repair.unrolled(runs, repair.END, state)
    for symbol, n in runs:
        for _ in range(n):
            edit, state = next(steps)
            letters += edit
            fault = symbol % 3
            total += 3 * (len(edit) - 1) + {"D": 4, "K": 0, "R": 3}[edit[-1]] + (3 if fault == repair.CUT_OFF and edit[-1] != "D" else 0)
            assert fault != repair.UNFIT or edit[-1] == "D"
    assert total + 3 * len(repair.last_inserts(state)) == costs[repair.EMPTY]
