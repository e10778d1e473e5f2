"""Trials that are stored, resumed and aligned, and flips between two runs, against plain versions."""

import random

import pytest

from plumbline.operators import trials
from plumbline.sources.sheets import Refusal

CASES = "case_id string, verdict string, target boolean"


def cases(spark, n=12):
    return spark.createDataFrame([(f"c{k}", "drift" if k % 3 == 0 else "new", None if k == 11 else k % 3 == 0) for k in range(n)], CASES)


def test_an_interrupted_run_resumes_without_a_second_answer(spark, tmp_path):
    store, asked = trials.trial_store(spark, str(tmp_path / "s"), "corpus"), []

    def judge(missing):
        asked.append(sorted((r["trial"], r["case_id"]) for r in missing.collect()))
        return missing.selectExpr("case_id", "trial", "CASE WHEN trial = 1 THEN NULL ELSE case_id < 'c5' END AS answer")

    some = cases(spark).where("case_id < 'c4'")
    assert trials.run_trials(store, some, "m", 2, judge) == (0, some.count() * 2)
    assert trials.run_trials(store, cases(spark), "m", 3, judge) == (some.count() * 2, 36 - some.count() * 2)
    assert trials.run_trials(store, cases(spark), "m", 3, judge) == (36, 0)
    every = sum(asked, [])
    assert len(every) == len(set(every)) == 36
    assert trials.run_trials(store, cases(spark), "other", 1, judge) == (0, 12)
    with pytest.raises(Refusal):
        trials.trial_store(spark, store.root, "another corpus")
    with pytest.raises(ValueError):
        trials.run_trials(store, cases(spark), "m", 0, judge)
    rows = {(r["judge"], r["case_id"]): r for r in trials.align(store.read(), cases(spark), 3).collect()}
    assert len(rows) == 22 and rows["m", "c0"]["answers"] == ["false", "abstain", "false"] and rows["m", "c0"]["state"] == "abstention_flip"
    assert all(r["state"] == "partial" for (j, _), r in rows.items() if j == "other")


def test_alignment_equals_a_plain_count(spark, tmp_path):
    rng = random.Random(9)
    said = [("j", t, f"c{k}", rng.choice(["false", "not-false", "abstain"] if k % 4 else ["false"])) for k in range(12) for t in range(3) if not (k == 5 and t == 2) and k != 6]
    said += [("j", 7, "c1", "false"), ("j", 0, "unknown", "false"), said[0]]
    df = spark.createDataFrame(said, "judge string, trial int, case_id string, answer string")
    by = {}
    for _, t, c, a in dict.fromkeys(said):
        if t < 3:
            by.setdefault(c, {})[t] = a
    want = {}
    for k in range(11):
        mine = [by.get(f"c{k}", {})[t] for t in sorted(by.get(f"c{k}", {}))]
        decided = {a for a in mine if a != "abstain"}
        want[f"c{k}"] = (mine, "partial" if len(mine) < 3 else "contradiction" if len(decided) > 1 else "abstention_flip" if decided and "abstain" in mine else "stable")
    lined = trials.align(df, cases(spark), 3)
    assert {r["case_id"]: (r["answers"], r["state"]) for r in lined.collect()} == want
    s = trials.stability(lined).first()
    states = [v[1] for v in want.values()]
    moved = [c for c, v in want.items() if v[1] in ("contradiction", "abstention_flip")]
    assert (s["n"], s["partial"], s["contradictions"], s["abstention_flips"], s["unstable"]) == (9, 2, states.count("contradiction"), states.count("abstention_flip"), len(moved))
    pos = [c for c in want if int(c[1:]) % 3 == 0 and want[c][1] != "partial"]
    assert s["positives"] == len(pos) and s["positive_unstable_rate"] == round(sum(c in moved for c in pos) / len(pos), 6)
    assert {r["verdict"]: r["n"] for r in trials.unstable_by_verdict(lined).collect()} == {"drift": len(pos), "new": 9 - len(pos)}
    trials.write_matrix(lined, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == 11
    with pytest.raises(Exception, match="(?i)exists"):
        trials.write_matrix(lined, str(tmp_path / "m"))
    assert trials.align(df.where("false"), cases(spark), 3).count() == 0


def test_flips(spark):
    schema = "case_id string, word string, truncated boolean"
    before = spark.createDataFrame([("a", "false", False), ("b", "false", False), ("c", "false", True), ("c", "unclear", False), ("d", None, False), ("e", "false", None), ("f", "false", True)], schema)
    after = spark.createDataFrame([("a", "not-false", False), ("b", "false", False), ("c", "false", False), ("d", "false", False), ("f", "false", False), ("g", "false", False)], schema)
    got = {r["case_id"]: tuple(r[1:]) for r in trials.flips(before, after).collect()}
    assert got == {
        "a": ("false", "not-false", "flipped"), "b": ("false", "false", "same"), "c": ("unclear", "false", "flipped"), "d": ("unparsed", "false", "untested"),
        "e": ("false", "missing", "untested"), "f": ("truncated", "false", "untested"), "g": ("missing", "false", "untested"),
    }
    assert {(r["was"], r["now"]): (r["n"], r["first"]) for r in trials.transitions(trials.flips(before, after)).collect()}["missing", "false"] == (1, "g")
