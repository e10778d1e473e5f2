"""Contexts of the three arms against a plain reading of small trees, and the judge of absent identifiers."""

import math

import pytest

from plumbline.operators import contexts
from plumbline.sources.sheets import Refusal

TREE = {
    "docs/a.md": "Call `poolLimit` and `maxRetries` or ``fooBar`` here.\n" + "openSocket text. " * 4,
    "src/a.py": "poolLimit = 3\nopenSocket()\n", "src/b.py": "maxRetries = 1\npoolLimit = 2\nopenSocket()\n",
    "src/c.py": "zebraStripe = 1\n", "src/d.py": "openSocket = quietMode\n", "src/e.py": "x = 1\n",
}
LONG = "import os\n" + "filler_line = 1\n" * 200 + "def poolLimit():\n    return 7\n" + "filler_line = 2\n" * 200


def blobs(spark, *trees):
    return spark.createDataFrame([("r", sha, p, t) for sha, tree in trees for p, t in tree.items()], "repo string, sha string, path string, text string")


def cases(spark, *rows):
    return spark.createDataFrame(rows, "example_id string, repo string, at_sha string, doc_path string, code_path string")


def plain_ranking(tree, doc):
    """Inverse document frequencies of shared tokens over the root of the file's tokens, by hand-listed tokens."""
    toks = {"src/a.py": {"poollimit", "pool", "limit", "opensocket", "open", "socket"}, "src/b.py": {"maxretries", "max", "retries", "poollimit", "pool", "limit", "opensocket", "open", "socket"},
            "src/c.py": {"zebrastripe", "zebra", "stripe"}, "src/d.py": {"opensocket", "open", "socket", "quietmode", "quiet", "mode"}, "src/e.py": set()}
    want = {"poollimit", "pool", "limit", "maxretries", "max", "retries", "foobar", "foo", "bar", "opensocket", "open", "socket", "call", "text", "here"}
    df = {t: sum(t in s for s in toks.values()) for t in want}
    idf = lambda t: math.log(1 + (len(toks) - df[t] + 0.5) / (df[t] + 0.5))
    score = {p: sum(idf(t) for t in s & want) / math.sqrt(len(s)) if s else 0.0 for p, s in toks.items()}
    return sorted(toks, key=lambda p: (-score[p], p))


def test_arms(spark):
    rows = cases(spark, ("1", "r", "s", "docs/a.md", "src/d.py"), ("2", "r", "s", "docs/a.md", "src/e.py"), ("3", "r", "s", "docs/gone.md", "src/new.py"))
    order = plain_ranking(TREE, "docs/a.md")
    for arm, k in (("oracle", 2), ("seeded", 2), ("retrieved", 5)):
        got = {r["example_id"]: r for r in contexts.build(rows, blobs(spark, ("s", TREE)), arm, k).collect()}
        assert set(got) == {"1", "2", "3"}
        for i, own in (("1", "src/d.py"), ("2", "src/e.py")):
            shown = [(f["path"], f["rank"]) for f in got[i]["files"]]
            ranked = [(p, n) for n, p in enumerate(order, 1) if arm == "retrieved" or p != own]
            assert shown == {"oracle": [(own, None)], "seeded": ([(own, None)] + ranked)[:k], "retrieved": ranked[:k]}[arm], (arm, k)
            assert got[i]["oracle_rank"] == order.index(own) + 1 and got[i]["pool_size"] == 5 and got[i]["usable"]
            assert all(f["text"] == TREE[f["path"]] and not f["truncated"] for f in got[i]["files"])
        assert got["3"]["missing"] == ["docs/gone.md"] + ["src/new.py"] * (arm != "retrieved") and not got["3"]["usable"]
        assert got["3"]["oracle_rank"] is None and [f["path"] for f in got["3"]["files"]] == ([] if arm == "oracle" else sorted(p for p in TREE if p.startswith("src"))[:k])


def test_budgets_and_refusals(spark):
    tree = {"docs/a.md": "See `poolLimit`. " * 50, "src/a.py": LONG}
    r = contexts.build(cases(spark, ("1", "r", "s", "docs/a.md", "src/a.py")), blobs(spark, ("s", tree)), "oracle", 5, 100, 600).first()
    assert r["doc_truncated"] and r["doc_text"].startswith(tree["docs/a.md"][:100]) and r["doc_full"] == tree["docs/a.md"]
    assert r["files"][0]["truncated"] and "def poolLimit" in r["files"][0]["text"]
    without = cases(spark, ("1", "r", "s", "docs/a.md", None))
    for arm in ("oracle", "seeded"):
        with pytest.raises(Refusal):
            contexts.build(without, blobs(spark, ("s", tree)), arm)
    with pytest.raises(Refusal):
        contexts.build(without, blobs(spark, ("s", tree)), "other")
    r = contexts.build(without, blobs(spark, ("s", tree)), "retrieved").first()
    assert r["oracle_rank"] is None and [f["path"] for f in r["files"]] == ["src/a.py"]
    assert contexts.build(without.limit(0), blobs(spark, ("s", tree)), "retrieved").count() == 0


def test_absence(spark):
    files = "array<struct<path string, text string>>"
    rows = [("1", "oracle", TREE["docs/a.md"], [("src/a.py", TREE["src/a.py"]), ("src/n.py", None)]), ("2", "oracle", None, []), ("3", "oracle", "no marks, poolLimit", [])]
    shown = spark.createDataFrame(rows, f"example_id string, arm string, doc_text string, files {files}")
    got = {(r["example_id"], r["judge"]): (r["answer"], r["claim"]) for r in contexts.absence_judges(shown, (1, 6, 7)).collect()}
    lacks = ["bar", "foo", "foobar", "max", "maxretries", "retries"]
    claim = got["1", "lexical-absence(>=1)"][1].split(", ")
    assert claim == [t for t in lacks if t in claim] and {"foobar", "maxretries"} <= set(claim)
    assert [got["1", f"lexical-absence(>={t})"][0] for t in (1, 7)] == [True, False]
    assert {v for (i, _), v in got.items() if i != "1"} == {(False, None)}


def test_names(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("model:x",), ("always-false",), ("lexical-absence(>=3)",), ("per-claim:x",), ("modelled",)], "j string")
    assert [tuple(r) for r in d.select(contexts.is_paid(F.col("j")), contexts.is_deterministic(F.col("j"))).collect()] == [(True, False), (False, True), (False, True), (True, False), (False, True)]
