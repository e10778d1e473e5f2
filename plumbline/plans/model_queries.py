"""Queries over injected models: stored pair scores, blocks of vectors, heads of rankings, and their reuse.

A stand-in model scores a pair of windows by the md5 of both, below zero as a model's raw output may be.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, pairs, scoring, topk, trials
from ..operators import evaluation as ev
from ..sources import digests
from ..sources.stores import shared_dir
from .label_queries import CASES_SQL, COUNTS_SQL, TRIAL, TRIALS_SQL, cases
from .rank_queries import BASE_SQL, LEX, MAXSIM_SQL, PATH, UNIFORM_SQL, lexical, sql_rank
from .registry import query, table

MODEL = "md5-of-both"


class Md5Scorer:
    """A pair scorer without a model, the same in Python and SQL."""

    def score(self, rows: list[tuple[str, str]]) -> list[float]:
        return [-int(hashlib.md5(f"{a}|{b}".encode()).hexdigest()[:8], 16) / 4294967296.0 for a, b in rows]


@query(f"SELECT * FROM ({BASE_SQL}{sql_rank(LEX)}) WHERE rank <= 20")
def rank_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty documents of each passage (a top-k report), by bounded heaps."""
    return topk.top_k(lexical(spark, sf, k=20), 20)


@query(f"SELECT * FROM (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM {MAXSIM_SQL}) WHERE rank <= 20")
def maxsim_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors whose id is divisible by 50 against all, by products of matrices; the first twenty of each (a top-k report)."""
    e = table(spark, sf, "embeddings")
    path = F.concat_ws("/", F.lpad(F.col("label").cast("string"), 3, "0"), F.lpad(F.floor(F.col("vec_id") / 4).cast("string"), 6, "0"))
    q = e.where("vec_id % 50 = 0").select(F.lit("all").alias("tree"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    c = e.select(F.lit("all").alias("tree"), path.alias("path"), F.col("embedding").alias("v"))
    return topk.top_k(dense.maxsim(q, c, k=20), 20)


def _heads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, queries, code): the first twenty documents of each benchmark passage, and both sides' texts."""
    base = topk.top_k(lexical(spark, sf, k=pairs.TOP_N), pairs.TOP_N)
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("tree"), "text")
    return base, queries, table(spark, sf, "documents").select(F.lit("all").alias("tree"), F.expr(PATH).alias("path"), "text")


def _windows_sql(name: str, key: str, source: str) -> str:
    return f"{name} AS (SELECT {key}, substr(text, i + 1, {pairs.SIZE}) AS {name[0]} FROM {source}, unnest(range(0, greatest(length(text), 1), {pairs.SIZE - pairs.OVERLAP})) AS u(i) WHERE (i = 0 OR i + {pairs.OVERLAP} < length(text)) AND regexp_matches(text, '\\S'))"


PAIRS_SQL = BASE_SQL + f""", b AS (SELECT * FROM ({sql_rank(LEX)}) WHERE rank <= {pairs.TOP_N}),
{_windows_sql("qw", "item_id AS query_id", "benchmark")},
{_windows_sql("pw", "path", "docs SEMI JOIN b USING (path)")},
pr AS (SELECT query_id, path, q, p FROM b JOIN qw USING (query_id) JOIN pw USING (path))
"""


@query(PAIRS_SQL + f""", m AS (SELECT query_id, path, max(-{UNIFORM_SQL.format("q || '|' || p")}) AS pair FROM pr GROUP BY ALL)
SELECT query_id, path, score, CASE WHEN count(pair) OVER (PARTITION BY query_id) = 0 OR count(*) OVER (PARTITION BY query_id) < 2 THEN rank ELSE row_number() OVER (PARTITION BY query_id ORDER BY coalesce(pair, '-inf'::DOUBLE) DESC, path) END AS rank FROM b LEFT JOIN m USING (query_id, path)""")
def rerank_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Heads of twenty in the order of their best pair of windows; every distinct pair is scored once and stored."""
    store = pairs.pair_store(spark, shared_dir(spark), MODEL)
    out, _ = pairs.rerank_heads(*_heads(spark, sf), store, MODEL, Md5Scorer)
    return out.select("query_id", "path", "score", F.col("rank").cast("long").alias("rank"))


@query(PAIRS_SQL + """, d AS (SELECT count(*) AS n FROM (SELECT DISTINCT q, p FROM pr))
SELECT r.run::BIGINT AS run, CASE WHEN r.run = 1 THEN 0 ELSE n END::BIGINT AS found, CASE WHEN r.run = 1 THEN n ELSE 0 END::BIGINT AS scored, 1::BIGINT AS parts FROM d, (VALUES (1), (2), (3)) AS r(run)""")
def pair_store_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs over one store, the last after compaction: what each found and what it had to score."""
    store, out = pairs.pair_store(spark, shared_dir(spark), MODEL), []
    wanted, q, p = pairs.head_pairs(*_heads(spark, sf))
    for run in (1, 2, 3):
        found, scored = store.fill(wanted, lambda missing: pairs.score_pairs(missing, q, p, MODEL, Md5Scorer))
        out.append((run, found, scored, len(store.live())))
        if run == 2:
            store.compact()
    return spark.createDataFrame(out, "run long, found long, scored long, parts long")


# ---------------------------------------------------------------- runs


def _noisy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(cases, answers by case and trial) of the label queries' noisy judge."""
    every = cases(spark, sf).select(F.col("doc_id").cast("string").alias("case_id"), F.col("lang").alias("verdict"), "target", "doc_id", "n_chars")
    return every, every.where("target IS NOT NULL")


def _answered(missing: DataFrame) -> DataFrame:
    return missing.withColumn("answer", F.expr(TRIAL))


@query(f"WITH {CASES_SQL}, n AS (SELECT count(*) AS n FROM cases WHERE target IS NOT NULL) SELECT run::BIGINT AS run, (CASE run WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 3 END * n)::BIGINT AS found, (CASE run WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END * n)::BIGINT AS asked FROM n, (VALUES (1), (2), (3)) AS r(run)")
def trial_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two trials, then three, then three again: what each run found stored and what it had to ask for."""
    _, scoreable = _noisy(spark, sf)
    store, out = trials.trial_store(spark, shared_dir(spark), sf), []
    for run, k in ((1, 2), (2, 3), (3, 3)):
        out.append((run, *trials.run_trials(store, scoreable, "noisy", k, _answered)))
    return spark.createDataFrame(out, "run long, found long, asked long")


@query(f"""WITH {TRIALS_SQL}, c AS (SELECT case_id, lang AS verdict, t.target, CASE WHEN max(t.answer::INT) <> min(t.answer::INT) THEN 'contradiction' WHEN count(t.answer) BETWEEN 1 AND count(*) - 1 THEN 'abstention_flip' ELSE 'stable' END AS state,
  string_agg(CASE WHEN t.answer THEN 'false' WHEN NOT t.answer THEN 'not-false' ELSE 'abstain' END, ',' ORDER BY trial) AS answers FROM trials t JOIN cases ON doc_id = case_id WHERE judge = 'noisy' GROUP BY ALL)
SELECT case_id::VARCHAR AS case_id, verdict, target, answers, state FROM c""")
def trial_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every scoreable case with its answers over three stored trials, and whether they agree."""
    every, scoreable = _noisy(spark, sf)
    store = trials.trial_store(spark, shared_dir(spark), sf)
    trials.run_trials(store, scoreable, "noisy", 3, _answered)
    return trials.align(store.read(), every, 3).select("case_id", "verdict", "target", F.array_join("answers", ",").alias("answers"), "state")


WORD_SQL = "CASE event_type WHEN 'error' THEN 'false' WHEN 'click' THEN 'not-false' WHEN 'view' THEN 'unparsed' WHEN 'purchase' THEN 'truncated' ELSE 'unclear' END"


@query(f"""WITH w AS (SELECT user_id, arg_min({WORD_SQL}, event_id) AS was, arg_max({WORD_SQL}, event_id) AS now FROM events GROUP BY user_id)
SELECT was, now, CASE WHEN was IN ('unparsed', 'truncated') OR now IN ('unparsed', 'truncated') THEN 'untested' WHEN was = now THEN 'same' ELSE 'flipped' END AS outcome, count(*)::BIGINT AS n, min(user_id::VARCHAR) AS first FROM w GROUP BY ALL""")
def case_flips(spark: SparkSession, sf: str) -> DataFrame:
    """Events stand for replies: from the first reply of each user to the last, how many went from which answer to which."""
    word = F.expr("CASE event_type WHEN 'error' THEN 'false' WHEN 'click' THEN 'not-false' WHEN 'view' THEN NULL ELSE 'unclear' END")
    said = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("case_id"), "event_id", F.struct(word.alias("word"), (F.col("event_type") == "purchase").alias("truncated")).alias("r"))
    run = lambda pick: said.groupBy("case_id").agg(pick("r", "event_id").alias("r")).select("case_id", "r.*")
    return trials.transitions(trials.flips(run(F.min_by), run(F.max_by)))


@query("""WITH c AS (SELECT sha256(coalesce(text, '')) AS h, count(*) AS n FROM documents GROUP BY 1),
l AS (SELECT substr(h, 1, 6) AS h, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS x FROM c GROUP BY substr(h, 1, 6)),
m AS (SELECT substr(h, 1, 3) AS h, sha256(string_agg(h || ':' || x, chr(10) ORDER BY h || ':' || x)) AS x FROM l GROUP BY substr(h, 1, 3))
SELECT sha256(string_agg(h || ':' || x, chr(10) ORDER BY h || ':' || x)) AS digest, (SELECT sum(n) FROM c)::BIGINT AS n FROM m""")
def text_digest(spark: SparkSession, sf: str) -> DataFrame:
    """One digest of all texts, whatever files, order and partitions they lie in."""
    docs = table(spark, sf, "documents").select("text")
    return docs.agg(F.lit(digests.tree_digest(docs, "text")).alias("digest"), F.count("*").alias("n"))


@query(f"""WITH {CASES_SQL}, f AS (SELECT user_id, arg_min(event_type, event_id) AS e FROM events GROUP BY user_id), r AS (SELECT lang, target, e, CASE e WHEN 'error' THEN true WHEN 'click' THEN false WHEN 'purchase' THEN n_chars < 600 END AS answer FROM cases JOIN f ON user_id = doc_id WHERE target IS NOT NULL)
SELECT lang, {COUNTS_SQL}, count_if(e = 'view')::BIGINT AS unparsed, count_if(e = 'view')::BIGINT AS unparsed_only, count_if(e = 'purchase')::BIGINT AS truncated, count_if(e = 'purchase' AND answer IS NOT NULL)::BIGINT AS truncated_answered FROM r GROUP BY lang""")
def confusion_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts with replies that could not be read or were cut; the first event of a user is its reply."""
    first = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.min_by("event_type", "event_id").alias("e"))
    answer = F.expr("CASE e WHEN 'error' THEN true WHEN 'click' THEN false WHEN 'purchase' THEN n_chars < 600 END")
    judged = cases(spark, sf).drop("answer").join(first, "doc_id").select("lang", "target", answer.alias("answer"), (F.col("e") == "view").alias("unparsed"), (F.col("e") == "purchase").alias("truncated"))
    return ev.confusion(judged, "lang")


@query("""WITH j AS (SELECT lang, quality = 0 AS hit, n_chars > 1000 AS kept, CASE quality WHEN 0 THEN 'drift' WHEN 1 THEN 'new' END AS v FROM documents JOIN labels USING (doc_id)),
b AS (SELECT * FROM j UNION ALL SELECT 'all', hit, kept, v FROM j),
g AS (SELECT lang, count_if(kept)::BIGINT AS n, count_if(kept AND v = 'drift')::BIGINT AS h, count_if(v = 'drift')::BIGINT AS before, count_if(kept AND v = 'new')::BIGINT AS kept_new, count_if(NOT kept AND v = 'new')::BIGINT AS dropped_new FROM b GROUP BY lang)
SELECT lang, n AS retained_n, h AS retained_hits, before AS positives_before, round(CASE WHEN n > 0 THEN h / n::DOUBLE END, 4) AS precision, kept_new, dropped_new,
 round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, (h / n::DOUBLE + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n::DOUBLE * (1 - h / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)) END, 4) AS lo,
 round(CASE WHEN n = 0 THEN 0 ELSE least(1, (h / n::DOUBLE + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(h / n::DOUBLE * (1 - h / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)) END, 4) AS hi FROM g""")
def retention_report(spark: SparkSession, sf: str) -> DataFrame:
    """What a stricter label set (long documents) keeps of the judged ones, with intervals, by language and blended."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    verdicts = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "drift").when(F.col("quality") == 1, "new").alias("verdict"))
    r = scoring.retention_report(docs, docs.where("n_chars > 1000"), verdicts, "doc_id", "lang")
    of = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit("new")), F.lit(0)).alias(f"{c}_new")
    return r.select("lang", "retained_n", "retained_hits", "positives_before", "precision", of("kept"), of("dropped"), "lo", "hi")


@query("SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND n_chars <= 1000")
def lost_positives(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    verdicts = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "drift").otherwise("new").alias("verdict"))
    return scoring.lost_positives(docs, docs.where("n_chars > 1000"), verdicts, "doc_id").select("doc_id", "lang")
