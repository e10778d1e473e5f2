"""Conversation repair against a plain search over all edits, and on awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from plumbline.llm import repair

TURNS = "conv_id long, turn long, role string, text string"


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying every edit, with at most two inserts in a row (more never pay)."""

    @cache
    def rest(i, state, inserts):
        role, after = repair.FOLLOWS[state]
        found = [(0, "", ())] if i == len(rows) and state in repair.WHOLE else []

        def step(edit, cost, i, state, inserts, line):
            tail = rest(i, state, inserts)
            if tail is not None:
                found.append((cost + tail[0], edit + tail[1], line + tail[2]))

        if inserts < 2:
            step("I", 2, i, after, inserts + 1, (f"{role}:",))
        if i < len(rows):
            own, text, fault = rows[i]
            step("D", 3, i + 1, state, 0, ())
            if fault not in "bd" or not fault:
                late = fault == "t"
                step("R", 2 + late, i + 1, after, 0, (f"{role}:{text}",))
                if own[:1] == "s" and state == repair.START:
                    step("K", late, i + 1, repair.SYSTEM, 0, (f"{own}:{text}",))
                elif own[:1] == role[0]:
                    step("K", late, i + 1, after, 0, (f"{own}:{text}",))
        return min(found, key=lambda f: f[:2], default=None)

    return rest(0, repair.START, 0)


def by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damage_by_hand(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in mine:
            said = text.strip(repair.SPACES)
            faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in mine} - {None}
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(mine, faults)])
        initials = [r[2][:1] for r in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def random_rows(seed, convs, most):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, rng.choice(["Yes.", "No", "What? ", "", "  ", None, f"Text {turn}!", f"é{turn} ", "a\nb.\n"])))
    return rows + [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (99, 1, "user", "x" * 100_000 + ".")]


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_repair_equals_every_edit(spark):
    from pyspark.sql import functions as F

    rows = random_rows(5, 150, 9)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("gone", "hit", "seen", "fault", "copy")})
    assert got(repair.repair(df)) == by_hand(rows)


def test_segments_give_the_same():
    rng = random.Random(3)
    for _ in range(200):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"{k}{rng.choice('.,')}", rng.choice(["", "", "t", "b", "d"])) for k in range(rng.randint(0, 12))]
        whole = cheapest(rows)
        for segment in (1, 3, 5):
            talk = repair.Conversation(1)
            held, repair.SEGMENT = repair.SEGMENT, segment
            for role, text, fault in rows:
                talk.add(0, role, text, fault)
            repair.SEGMENT = held
            assert talk.result()[6:] == (whole[0], whole[1], hashlib.sha256("\n".join(whole[2]).encode()).hexdigest())


def test_heuristic_never_overrates():
    rows = [("u", f, "user", "x") for f in ("b", "t", "", "d", "t")]
    for k in range(len(rows) + 1):
        bound = sum({"b": 3, "d": 3, "t": 1}.get(r[1], 0) for r in rows[k:])
        for state in range(4):
            assert min(c for c, _ in repair.search(rows[k:], state, repair.WHOLE).values()) >= bound


def test_long_conversation_streams(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"Turn {k}.") for k in range(5_000)]
    (found,) = repair.repair(spark.createDataFrame(rows, TURNS)).collect()
    assert len(found["audit"]) >= 4_000 and found["truncated"] + found["blank"] > 0


def test_query_and_empty_table(spark):
    from plumbline.llm import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_repair(spark, "/root/testdata/sf0.01")) == by_hand(rows)
    assert repair.repair(spark.createDataFrame([], TURNS)).count() == 0
