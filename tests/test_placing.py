"""Passages found, and ranks counted, in the tasks that read the texts, against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import tokens
from plumbline.operators import lexicon, passages, placing
from plumbline.operators import retrieval as rt
from plumbline.plans import rank_queries
from plumbline.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "gammaRay", "delta_one", "omega", "sigma"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [("t" if k % 5 else "u", f"p{k:02d}", " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for k in range(80)]
    rows += [("t", f"é{k}", "alpha beta") for k in range(4)] + [("t", "p01", "beta"), ("t", "none", None)]  # ties, and a path in two rows
    return spark.createDataFrame(rows, "tree string, path string, text string").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_passages_wherever_they_stand(spark):
    asked = [(1, "ab"), (2, "b"), (3, ""), (4, None), (5, "ab"), (6, "a.b"), (7, "ñ\nab"), (None, "zz")]
    texts = [("p", "xabx"), ("q", "ñ\nab a.b"), ("r", ""), ("s", None), ("p", "b b b"), (None, "zzz")]
    got = rows(passages.holders(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(texts, "path string, text string")))
    assert got == sorted([(i, p) for i, a in asked for p, t in texts if a is not None and t is not None and a in t], key=repr)
    assert rows(passages.holders(spark.createDataFrame([], "query_id int, text string"), spark.createDataFrame(texts, "path string, text string"))) == []


def test_relevant_shuffles_no_word(spark, monkeypatch):
    found = rank_queries.relevant(spark, DIR)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    monkeypatch.setattr(passages, "FEW_ROWS", 3)  # many passages go by their words
    assert rows(found) == rows(rank_queries.relevant(spark, DIR))


@pytest.mark.parametrize("first", [1, 3, 10])
@pytest.mark.parametrize("limit", [{}, {"FEW_ROWS": 1}])
def test_ranks_equal_those_of_whole_rankings(spark, docs, monkeypatch, first, limit):
    for name, value in limit.items():
        monkeypatch.setattr(placing, name, value)
    asked = [(1, "t", "alpha beta"), (2, "t", "gamma delta sigma"), (3, "u", "omega"), (4, "t", "zeta"), (5, "t", "omega")]
    q = spark.createDataFrame([(k, t, w, w == "omega") for k, t, ws in asked for w in ws.split()], "query_id long, tree string, tok string, evidence boolean")
    relevant = spark.createDataFrame([(1, "p01"), (1, "é1"), (1, "é3"), (1, "none"), *[(k, f"p{n:02d}") for k in (1, 2, 3, 4, 5) for n in range(0, 60, 7)], (3, "p05"), (9, "p01")], "query_id long, path string")
    cand = rt.token_table(docs, tokens.occurrences(F.col("text")), "tree", "path")
    weights, left = rt.idf(cand, docs), F.when(~F.col("evidence"), F.col("idf"))
    every = rt.long(rt.score_arms(q, cand, weights, {"a": rt.lexical_part(), "b": left, "c": rt.tf_part(1.2)}), ["a", "b", "c"]).cache()
    ranks, shown = placing.first_ranks(q, docs, weights, {"a": lexicon.arm(), "b": lexicon.arm(idf=left), "c": lexicon.arm(1.2)}, relevant, first)
    want: dict = {}
    for arm, query, path, rank in rows(rt.ranks_of(every, relevant).select("arm", "query_id", "path", "rank")):
        want.setdefault((arm, query), []).append((rank, path))
    got: dict = {}
    for arm, query, path, rank in rows(ranks.select("arm", "query_id", "path", "rank")):
        got.setdefault((arm, query), []).append((rank, path))
    cut = (lambda x: sorted(x)) if limit else (lambda x: sorted(x)[:first])
    assert {k: cut(v) for k, v in want.items()} == {k: sorted(v) for k, v in got.items()}
    assert rows(shown) == rows(every.where("query_id IN (1, 2, 3, 4, 5)").select("arm", "query_id").distinct())


def refuse(*_, **__):
    raise AssertionError("a table of all scores was made")


@pytest.mark.parametrize("name", ["oracle_rank", "recall_mrr", "retrieval_lexical", "rank_fusion_cells"])
def test_no_table_of_all_scores(spark, monkeypatch, name):
    monkeypatch.setattr(rt, "ranks_of", refuse)
    assert QUERIES[name](spark, DIR).count() >= 1
