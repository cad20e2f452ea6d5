import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwright.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def damaged(rows):
    """The contract's damage: (conv, turn, role, text) rows, and all ids."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def brute(rows, ids):
    """Report of every conversation; all sequences of edits are weighed state by state, as strings."""
    convs = defaultdict(list)
    for conv, *row in rows:
        convs[conv].append(row)
    out = {conv: NOTHING for conv in ids}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else
                          "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] or " " for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

        # what has been written so far -> cheapest (cost, audit, lines); a state is the last initial
        def grow(states):
            todo = dict(states)
            for _ in range(4):
                for last, (cost, audit, lines) in list(todo.items()):
                    new, word = ("a", "assistant") if last == "u" else ("u", "user")
                    offer = (cost + 5, audit + "I", [*lines, word + ":"])
                    todo[new] = min(todo.get(new, offer), offer)
            return todo

        best = {"": (0, "", [])}
        for (_, role, text), fault, initial in zip(own, faults, initials):
            after = {}
            for last, (cost, audit, lines) in grow(best).items():
                offers = [(last, (cost + 2, audit + "D", lines))]
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault == "truncated" else 0
                    legal = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
                    if initial in legal:
                        offers.append((initial, (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
                    for new, word in (("u", "user"), ("a", "assistant")):
                        if new in legal:
                            offers.append((new, (cost + 1 + more, audit + "R", [*lines, f"{word}:{text}"])))
                for state, offer in offers:
                    after[state] = min(after.get(state, offer), offer)
            best = after
        cost, audit, lines = min(v for k, v in grow(best).items() if k in ("", "a"))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def some_rows(n=60, seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        turn = rng.choice([0, 0, -3, 10 ** 12])
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            text = rng.choice(["Yes.", "No", "", " \t\x0b", "Why?", "a\nb! ", "Fine. \x1c", None, "x. ", f"n{rng.random()}."])
            role = rng.choice(["user"] * 5 + ["assistant"] * 5 + ["system", "sys", "", None, "tool", "User", "ux"])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text))
            turn += rng.choice([1, 1, 1, 0, 2])
    return rows


def test_powers_are_repeated_steps():
    known = tr.Transitions()
    for symbol in range(9):
        slow = known.matrix([])
        for length in range(1, 40):
            slow = tr.times(slow, tr.transition(symbol))
            assert known.matrix([(symbol, length)]) == slow
            v, low = known.before(symbol, length, tr.AT_END)
            assert [c + low for c in v] == [min(m + c for m, c in zip(row, tr.AT_END)) for row in slow]


def test_a_long_run_costs_little_to_cross():
    known = tr.Transitions()
    v, low = known.before(1, 10 ** 15 + 1, tr.AT_END)       # users only: every second one is given the other role
    assert low + v[tr.START] == 5 * 10 ** 14 + 2 and len(known._steps) < 60


@pytest.mark.parametrize("hot_rows,block_rows", [(10_000, 50_000), (0, 3), (4, 1), (0, 10_000)])
def test_reports_and_edits(spark, hot_rows, block_rows):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("k"), "seq": F.lit(1), "digest": F.lit(""), "position": F.lit(9)})
    hurt = tr.damage(df)
    want = brute(damaged(rows), {r[0] for r in rows})
    assert got(tr.report(hurt, hot_rows=hot_rows, block_rows=block_rows)) == want
    edits = defaultdict(list)
    for r in tr.repair(hurt, hot_rows=hot_rows, block_rows=block_rows).collect():
        edits[r["conv_id"]].append((r["position"], r["edit"], r["role"], r["text"], r["turn"]))
    for conv, report in want.items():
        own = sorted(edits[conv])
        assert [p for p, *_ in own] == list(range(1, len(own) + 1)) and "".join(e for _, e, *_ in own) == report[6]
        lines = "\n".join(f"{role}:{text}" for _, e, role, text, _ in own if e != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == report[7]
        assert all(turn is None and text == "" for _, e, _, text, turn in own if e == "I")


def test_one_conversation_of_most_rows(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"row {t % 700}" + "." * (t % 5 > 0)) for t in range(4000)]
    rows += [(7, 4000, "user", "same.")] * 500 + [(i, 0, "user", "Hi.") for i in range(10, 60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, {r[0] for r in rows})
    assert got(tr.report(df, hot_rows=100, block_rows=64)) == want
    assert got(tr.report(df)) == want


def test_repaired_conversations_stay_as_they_are(spark):
    df = tr.damage(spark.createDataFrame(some_rows(seed=9), SCHEMA))
    once = tr.repair(df).where("edit <> 'D'")
    again = tr.report(once.select("conv_id", F.col("position").alias("turn"), "role",
                                  F.concat("position", F.when(F.col("text") == "", "x").otherwise(F.col("text")), F.lit(".")).alias("text")))
    assert {r["cost"] for r in again.collect()} == {0}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tr.report(tr.damage(empty)).count() == 0 and tr.repair(empty, hot_rows=0).count() == 0


def test_sample_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(tr.report(tr.damage(df))) == brute(damaged(rows), {r[0] for r in rows})
