"""What a judge is shown: a document and up to k code files of its tree, and the judge that compares their identifiers.

Three arms: ``oracle`` shows the file that the correcting commit touched, ``retrieved`` the best ranked files,
``seeded`` the known file first and ranked ones after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts, tokens, windowing
from ..sources.sheets import Refusal
from . import retrieval as rt

ARMS = ("oracle", "seeded", "retrieved")
#: Characters of a document and of one code file that are shown.
DOC_BUDGET, CODE_BUDGET = 12_000, 6_000
#: Judges whose name begins so call a model; all others are functions of what they are shown.
PAID = ("model:", "per-claim")


def is_paid(judge: Column) -> Column:
    return F.exists(F.array(*map(F.lit, PAID)), lambda p: F.startswith(judge, p))


def is_deterministic(judge: Column) -> Column:
    return ~is_paid(judge)


def ranked_heads(scores: DataFrame, cases: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """(example_id, path, rank): the first ``n`` files of each case's tree, by score and then by path.

    Files that share no token score 0 and follow in path order.  Only the first ``n`` paths of a tree can be
    wanted from them when fewer than ``n`` are scored, so no case meets its whole pool.
    """
    best = scores.where("score > 0").select(F.col("query_id").alias("example_id"), "path", "score")
    by_path = pool.withColumn("pos", F.row_number().over(Window.partitionBy("tree").orderBy("path"))).where(F.col("pos") <= n)
    rest = cases.select("example_id", "tree").join(by_path, "tree").select("example_id", "path", F.lit(0.0).alias("score"))
    top = Window.partitionBy("example_id").orderBy(F.desc("score"), "path")
    first = best.withColumn("nr", F.row_number().over(top)).where(F.col("nr") <= n).drop("nr")
    # a scored file may also stand among the first paths; where it was not among the best it has no place at all
    either = first.unionByName(rest).groupBy("example_id", "path").agg(F.max("score").alias("score"))
    return either.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= n).select("example_id", "path", "rank")


def known_ranks(scores: DataFrame, cases: DataFrame, pool: DataFrame) -> DataFrame:
    """(example_id, oracle_rank) of each case's own code file in its full ranking; a file outside the pool has no row."""
    places = pool.withColumn("pos", F.row_number().over(Window.partitionBy("tree").orderBy("path")))
    known = cases.where("code_path IS NOT NULL").select("example_id", "tree", F.col("code_path").alias("path"))
    own = known.join(places, ["tree", "path"]).select("example_id", F.col("path").alias("own"), "pos")
    best = scores.where("score > 0").select(F.col("query_id").alias("example_id"), "path", "score").cache()
    mine = own.join(best.withColumnRenamed("path", "own").withColumnRenamed("score", "s"), ["example_id", "own"], "left")
    before = F.coalesce((F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("path") < F.col("own"))), F.lit(False))
    counted = mine.join(best, "example_id", "left").groupBy("example_id", "pos", "s").agg(
        F.count_if(before).alias("above"), F.count("path").alias("scored"), F.count_if(F.col("path") < F.col("own")).alias("earlier"))
    unscored = F.col("scored") + (F.col("pos") - 1 - F.col("earlier"))
    return counted.select("example_id", (F.when(F.col("s").isNotNull(), F.col("above")).otherwise(unscored) + 1).cast("long").alias("oracle_rank"))


def contexts(cases: DataFrame, held: DataFrame, pool: DataFrame, scores: DataFrame, arm: str, k: int = 5, doc_budget: int = DOC_BUDGET, code_budget: int = CODE_BUDGET) -> DataFrame:
    """One row a case: (example_id, tree, arm, doc_path, doc_text, doc_truncated, doc_full, files, pool_size, oracle_rank, missing, usable).

    ``cases(example_id, tree, doc_path, code_path)`` with distinct ids, ``held(tree, path, text)`` the texts of
    the trees, ``pool(tree, path)`` their code files, ``scores(query_id, path, score)`` of scored files.
    ``files`` holds structs (path, text, truncated, rank), the known file without a rank.  What a tree lacks is
    listed in ``missing`` and nothing takes its place.  The oracle and seeded arms refuse a case without a code path.
    """
    if arm not in ARMS:
        raise Refusal(f"unknown arm {arm}, none of {ARMS}")
    if k < 1:
        raise ValueError("k must be 1 or more")
    if arm != "retrieved" and cases.where("code_path IS NULL").limit(1).count():
        raise Refusal(f"the {arm} arm needs the code path of every case")
    held = held.where("text IS NOT NULL").select("tree", "path", "text")
    pages = cases.join(held.select("tree", F.col("path").alias("doc_path"), F.col("text").alias("doc_full"), F.lit(True).alias("has_doc")), ["tree", "doc_path"], "left")
    pages = pages.withColumn("doc_full", F.coalesce("doc_full", F.lit("")))
    wanted = pages.select("example_id", "tree", tokens.extract(tokens.literal_spans(F.col("doc_full")), with_versions=False).alias("wanted"))

    seeds = cases.select("example_id", F.col("code_path").alias("path"), F.lit(0).alias("rank"))
    shown = None if arm == "retrieved" else seeds
    if arm != "oracle":
        ranked = ranked_heads(scores, cases, pool, k + 1)
        shown = ranked if shown is None else shown.unionByName(ranked.join(seeds, ["example_id", "path"], "left_anti"))
    texts_of = shown.join(wanted, "example_id").join(held, ["tree", "path"], "left")
    here = Window.partitionBy("example_id").orderBy("rank")
    chosen = texts_of.where("text IS NOT NULL").withColumn("place", F.row_number().over(here)).where(F.col("place") <= k)
    cut = chosen.withColumn("w", windowing.select_relevant(F.col("text"), code_budget, F.col("wanted")))
    file = F.struct("place", F.col("path").alias("path"), F.col("w.text").alias("text"), F.col("w.cut").alias("truncated"), F.when(F.col("rank") > 0, F.col("rank")).alias("rank"))
    files = cut.groupBy("example_id").agg(F.transform(F.array_sort(F.collect_list(file)), lambda f: f.dropFields("place")).alias("files"))  # k at most
    lost = texts_of.where("text IS NULL AND rank = 0").select("example_id", F.col("path").alias("lost"))

    sizes = pool.groupBy("tree").agg(F.count("*").alias("pool_size"))
    out = pages.join(files, "example_id", "left").join(lost, "example_id", "left").join(sizes, "tree", "left").join(known_ranks(scores, cases, pool), "example_id", "left")
    none = F.array().cast("array<struct<path:string,text:string,truncated:boolean,rank:int>>")
    out = out.withColumns({"files": F.coalesce("files", none), "doc_text": texts.truncate(F.col("doc_full"), doc_budget)})
    return out.select(
        "example_id", "tree", F.lit(arm).alias("arm"), "doc_path", "doc_text", (F.length("doc_full") > doc_budget).alias("doc_truncated"), "doc_full", "files",
        F.coalesce("pool_size", F.lit(0)).alias("pool_size"), "oracle_rank", F.array_compact(F.array(F.when(F.col("has_doc").isNull(), F.col("doc_path")), "lost")).alias("missing"),
        (F.col("doc_text").rlike(r"\S") & (F.size("files") > 0)).alias("usable"))


def absent(doc: Column, code: Column) -> Column:
    """The identifiers that a document marks up and none of the texts in the array ``code`` names, sorted."""
    marked = tokens.extract(tokens.literal_spans(F.coalesce(doc, F.lit(""))), with_versions=False)
    present = F.flatten(F.transform(code, lambda c: tokens.extract(F.coalesce(c, F.lit("")), with_versions=False)))
    return F.array_sort(F.array_except(marked, present))


def absence_judges(shown: DataFrame, thresholds: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """(example_id, arm, judge, answer, claim): flagged from each threshold of absent identifiers on; the claim names six."""
    rows = shown.select("example_id", "arm", absent(F.col("doc_text"), F.transform("files", lambda f: f["text"])).alias("lacks"))
    at = rows.withColumn("t", F.explode(F.array(*map(F.lit, thresholds))))
    return at.select("example_id", "arm", F.format_string("lexical-absence(>=%d)", "t").alias("judge"), (F.size("lacks") >= F.col("t")).alias("answer"), F.nullif(F.array_join(F.slice("lacks", 1, 6), ", "), F.lit("")).alias("claim"))


def build(cases: DataFrame, blobs: DataFrame, arm: str, k: int = 5, doc_budget: int = DOC_BUDGET, code_budget: int = CODE_BUDGET) -> DataFrame:
    """Contexts from ``cases(example_id, repo, at_sha, doc_path, code_path)`` and ``blobs(repo, sha, path, text)``.

    Every distinct text is tokenised once; scores are those of the lexical ranker for the whole document.
    """
    held, pool, cand = rt.tree_tokens(blobs)
    rows = cases.select("example_id", F.concat_ws("@", "repo", "at_sha").alias("tree"), "doc_path", "code_path")
    docs = rows.join(held.select("tree", F.col("path").alias("doc_path"), "text"), ["tree", "doc_path"])
    q = docs.select(F.col("example_id").alias("query_id"), "tree", F.explode(tokens.extract(F.col("text"), with_versions=False)).alias("tok"))
    scores = rt.score_tokens(q, cand, rt.idf(cand, pool))
    return contexts(rows, held, pool.select("tree", "path"), scores, arm, k, doc_budget, code_budget)
