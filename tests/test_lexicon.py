"""Counts and scores made where the texts are read, against tables of tokens."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import tokens
from plumbline.operators import lexicon
from plumbline.operators import retrieval as rt
from plumbline.plans import rank_queries, text_queries  # noqa: F401  (they register)
from plumbline.plans.registry import QUERIES

WORDS = ["parseHTTPHeader", "snake_case_name", "__init__", "self", "value9Total", "x1_2345", "alphaBeta", "alphabeta", "ALPHA", "été_accent", "9lives", "ab", "naïveUser", "_1234", "gammaRay", "delta", "a\x01Bcde", "versionNumber"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [("t" if k % 4 else "u", f"p{k:02d}", " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for k in range(60)]
    rows += [("t", "p01", "alphaBeta delta delta"), ("t", "p01", "gammaRay"), ("t", "none", None), (None, "p01", "delta")]  # a path in several rows is one candidate
    return spark.createDataFrame(rows, "tree string, path string, text string").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("held", [3, 500_000])
def test_counts_equal_table_of_tokens(docs, monkeypatch, held):
    monkeypatch.setattr(lexicon, "HELD", held)
    cand = rt.token_table(docs, tokens.occurrences(F.col("text")), "tree", "path")
    assert rows(lexicon.counts(docs, "path")) == rows(cand.groupBy("tree", "tok").agg(F.sum("tf").alias("n"), F.count("*").alias("df")))
    assert rows(lexicon.idf(docs)) == rows(rt.idf(cand, docs))


@pytest.mark.parametrize("limit", [{}, {"FEW_ROWS": 2}, {"CELLS": 1}, {"TOGETHER": 3}])
def test_scores_equal_join(spark, docs, monkeypatch, limit):
    for name, value in limit.items():
        monkeypatch.setattr(lexicon, name, value)
    q = spark.createDataFrame([(k, t, w, w == "delta") for k, t, ws in ((1, "t", "delta alpha zzzz"), (2, "t", "beta header snake"), (3, "u", "delta"), (4, "v", "delta"), (5, "t", "zzzz")) for w in ws.split()], "query_id long, tree string, tok string, evidence boolean")
    cand = rt.token_table(docs, tokens.occurrences(F.col("text")), "tree", "path")
    weights = rt.idf(cand, docs)
    left = F.when(~F.col("evidence"), F.col("idf"))
    want = rt.score_arms(q, cand, weights, {"a": rt.lexical_part(), "b": left, "c": rt.tf_part(1.2), "d": rt.tf_part(0)})
    got = lexicon.score_arms(q, docs, weights, {"a": lexicon.arm(), "b": lexicon.arm(idf=left), "c": lexicon.arm(1.2), "d": lexicon.arm(0)})
    assert rows(got) == rows(want) and any(r["b"] is None for r in got.collect())
    first = lexicon.score_arms(q, docs, weights, {"score": lexicon.arm()}, k=2)
    assert {tuple(r) for r in rows(rt.rank(first)) if r[3] <= 2} == {tuple(r) for r in rows(rt.rank(want.withColumnRenamed("a", "score"))) if r[3] <= 2}


@pytest.mark.parametrize("name", ["tok_counts", "idf_table"])
def test_no_token_of_a_text_is_shuffled(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate" not in plan


@pytest.mark.parametrize("few", [2, 50_000])
def test_frequencies_of_queries_tokens_alone(spark, docs, monkeypatch, few):
    monkeypatch.setattr(lexicon, "FEW_ROWS", few)
    q = spark.createDataFrame([(t, w) for t in "tuv" for w in "delta alpha header beta snake_case_name self 1234 zzzz alphabeta alphabeta total".split()], "tree string, tok string")
    cand = rt.token_table(docs, tokens.occurrences(F.col("text")), "tree", "path")
    want = rt.idf(cand, docs).join(q.distinct(), ["tree", "tok"], "left_semi")
    assert rows(lexicon.idf(docs, q)) == rows(want) and want.count() > 8


def test_ranking_counts_and_scores_no_more_than_queries_ask(spark, monkeypatch):
    """Frequencies are counted of the passages' tokens alone, and no matrix of all tokens and queries is multiplied."""
    def refuse(*_, **__):
        raise AssertionError("all tokens counted")

    monkeypatch.setattr(lexicon, "counts", refuse)
    assert QUERIES["rank_lexical_ablated"](spark, "/root/testdata/sf0.001").limit(1).count() == 1


ODD = ["12abcD", "12", "1_a", "A123", "the", "The", "____", "___1", "é", "x" * 50, "HTTPServer", "a1_b2_cdef", "été4lives_on"]


@pytest.mark.parametrize("cut", [1, 40, 1 << 20])
def test_tally_of_texts_laid_end_to_end(monkeypatch, cut):
    """Tokens of many texts at once equal those of each text; no word goes on from one text to the next."""
    import pyarrow as pa

    monkeypatch.setattr(lexicon, "CUT_BYTES", cut)
    rng = random.Random(cut)
    texts = [None, "", "alpha", "Beta", None] + [None if rng.random() < 0.1 else rng.choice(["", " ", "-", "é"]).join(rng.choices(WORDS + ODD, k=rng.randint(0, 12))) for _ in range(300)]
    got: list[dict] = []
    for part in lexicon.cuts(pa.RecordBatch.from_arrays([pa.array(["no"] + texts)], names=["text"]).slice(1), 0):
        tally = lexicon.tallied(part.column(0))
        here: list[dict] = [{} for _ in range(part.num_rows)]
        for text, token, n in zip(tally.text.tolist(), tally.token.tolist(), tally.n.tolist()):
            here[text][tally.tokens[token].as_py()] = n
        assert [len(x) for x in here] == tally.sizes.tolist()
        got += here
    assert got == [lexicon.counted(t) for t in texts]


def test_one_reading_serves_passages_frequencies_and_scores(spark, docs):
    """Passages with and without a whole word, in rows whose key repeats, too; frequencies and scores are those of separate readings."""
    asked = [(1, "delta"), (2, "a delta b"), (3, ""), (4, None), (5, "é"), (6, " alphaBeta "), (7, " delta delt"), (8, "ab alphabeta"), (9, "x"), (10, "ser self d"), (11, " alphaBeta ")]
    passages = spark.createDataFrame(asked, "query_id int, text string")
    more = docs.unionByName(spark.createDataFrame([("t", "q1", "x a delta b"), ("t", "q2", "a delta bé"), ("t", "q3", "ab alphabeta9"), ("u", "q4", ""), ("u", "q5", "user self dial")], docs.schema))
    q = spark.createDataFrame([(k, "t", w) for k in (1, 2) for w in "delta alpha alphabeta header".split()], "query_id int, tree string, tok string")
    parts = lexicon.once(more, "tree", "path", queries=q, passages=passages)
    want = [(i, r["path"]) for r in more.collect() for i, p in asked if p is not None and r["text"] is not None and p in r["text"]]
    assert rows(parts.holders) == sorted(want, key=repr) and {i for i, _ in want} >= {1, 2, 3, 5, 6, 7, 8, 9, 10, 11}
    weights = lexicon.idf(more, q, parts)
    assert rows(weights) == rows(lexicon.idf(more, q)) and weights.count() > 2
    scores = lexicon.score_arms(q, more, weights, {"score": lexicon.arm()}, parts=parts)
    assert rows(scores) == rows(lexicon.score_arms(q, more, weights, {"score": lexicon.arm()}))
    assert "text" not in parts.found.columns and "InMemoryRelation" in scores._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["oracle_rank", "context_topk"])
def test_texts_are_read_once(spark, monkeypatch, name):
    from plumbline.operators import passages

    calls = []
    read = lexicon.asked_of

    def refuse(*_, **__):
        raise AssertionError("texts read for passages alone")

    monkeypatch.setattr(passages, "holders", refuse)
    monkeypatch.setattr(lexicon, "asked_of", lambda *args: calls.append(1) or read(*args))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 1
    assert calls == [1]
