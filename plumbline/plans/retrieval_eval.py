"""From labels and trees to a recall table: query building, pools, arms and their evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts, tokens
from ..operators import contexts, dense, pairs
from ..operators import evaluation as ev
from ..operators import retrieval as rt
from ..sources.stores import Store, written


def queries_of(labels: DataFrame, shape: str = "A") -> DataFrame:
    """(query_id, repo, tree, doc_path, relevant, evidence): one a repository, tree and document."""
    rows = labels.where((F.col("shape") == shape) & (F.col("label") == "drift") & F.col("code_path").isNotNull())
    g = rows.groupBy("repo", "at_sha", "doc_path").agg(F.collect_set("code_path").alias("relevant"), F.array_distinct(F.flatten(F.collect_list("shared_identifiers"))).alias("evidence"))
    return g.select(F.concat_ws(":", "repo", F.substring("at_sha", 1, 12), "doc_path").alias("query_id"), "repo", F.concat_ws("@", "repo", "at_sha").alias("tree"), "doc_path", "relevant", "evidence")


@dataclass(frozen=True)
class Encoding:
    """The arm of text vectors: a store for them, the model's name and what builds its encoder."""

    store: Store
    model: str
    encoder: Callable[[], dense.Encoder]


@dataclass(frozen=True)
class Reranking:
    """The arm that reorders the first ``top_n`` of the lexical one by scores of pairs."""

    store: Store
    model: str
    scorer: Callable[[], pairs.PairScorer]
    top_n: int = pairs.TOP_N

    @property
    def arm(self) -> str:
        return f"rerank(lexical@{self.top_n})"


def _dense_scores(spec: Encoding, wanted: DataFrame, code: DataFrame) -> tuple[DataFrame, list[str]]:
    """Scores of the vectors' arm and of its twin that reads documents without their evidence."""
    files, _ = dense.text_vectors(code.select("tree", "path", "text"), spec.store, spec.model, spec.encoder)
    files, arms, out = written(files, "vectors"), {"dense": F.col("text"), "dense-ablated": texts.redact(F.col("text"), F.col("evidence"))}, None
    for arm, text in arms.items():
        docs, _ = dense.text_vectors(wanted.select("query_id", "tree", text.alias("text")), spec.store, spec.model, spec.encoder)
        scores = dense.maxsim(docs, files).select(F.lit(arm).alias("arm"), "query_id", "path", "score")
        out = scores if out is None else out.unionByName(scores)
    return out, list(arms)


def _reranked(spec: Reranking, base_arm: str, ranks: DataFrame, scores: DataFrame, wanted: DataFrame, code: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """The relevant files' ranks once the head of ``base_arm`` is reordered; past the head they are the base's."""
    base = contexts.ranked_heads(scores.where(F.col("arm") == base_arm), wanted.select(F.col("query_id").alias("example_id"), "tree"), code.select("tree", "path"), spec.top_n)
    base = base.select(F.col("example_id").alias("query_id"), "path", F.lit(0.0).alias("score"), "rank")
    head, _ = pairs.rerank_heads(base, wanted.select("query_id", "tree", "text"), code, spec.store, spec.model, spec.scorer, spec.top_n, evidence)
    mine = ranks.where(F.col("arm") == base_arm).select("query_id", "path", F.col("rank").alias("was"))
    moved = mine.join(head.select("query_id", "path", F.col("rank").alias("now")), ["query_id", "path"], "left")
    return moved.select(F.lit(spec.arm + ("" if evidence is None else "-ablated")).alias("arm"), "query_id", "path", F.coalesce("now", "was").cast("long").alias("rank"))


def evaluate(queries: DataFrame, blobs: DataFrame, ks: tuple[int, ...] = (1, 3, 10), k1: float = 1.2, trials: int = 5, encoding: Encoding | None = None, reranking: Reranking | None = None) -> DataFrame:
    """(repo, arm, n, lost, mrr, recall_k..) for lexical, its ablated twin, term frequency, paths and shuffles.

    With ``encoding`` and ``reranking`` the models' arms and their ablated twins come on top.  ``blobs(repo, sha, path,
    text)``.  Every distinct text is tokenised and encoded once, however many trees hold it; relevant files that a tree lacks
    are counted as lost and leave the query.  Candidates that share nothing with a query are counted, not listed.
    """
    held, pool, cand = rt.tree_tokens(blobs)
    wanted = queries.join(held.select("tree", F.col("path").alias("doc_path"), "text"), ["tree", "doc_path"])
    rel = wanted.select("query_id", "tree", F.explode("relevant").alias("path"))
    present = rel.join(pool, ["tree", "path"], "left_semi").cache()
    lost = rel.join(pool, ["tree", "path"], "left_anti").groupBy("query_id").agg(F.count("*").alias("lost"))
    wanted = wanted.join(present.select("query_id").distinct(), "query_id", "left_semi").cache()
    files = pool.select("tree", "path")
    evidence = wanted.select("query_id", F.explode("evidence").alias("tok"))
    q = wanted.select("query_id", "tree", F.explode(tokens.extract(F.col("text"), with_versions=False)).alias("tok"))
    parts = {"lexical": rt.lexical_part(), "lexical-ablated": F.when(~F.col("evidence"), rt.lexical_part()), "lexical-tf": rt.tf_part(k1)}
    scores = rt.long(rt.score_arms(rt.marked(q, evidence), cand, rt.idf(cand, pool), parts), list(parts))
    by_path = rt.score_paths(wanted, files).where("score > 0").select(F.lit("path").alias("arm"), "query_id", "path", "score")
    arms, scores = [*parts, "path"], scores.unionByName(by_path)
    code = held.join(files, ["tree", "path"], "left_semi").select("tree", "path", "text")
    if encoding:
        more, names = _dense_scores(encoding, wanted, code)
        arms, scores = arms + names, scores.unionByName(more)
    scores = written(scores, "scores")
    asked = present.withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    ranks = rt.ranks_with_tail(scores, asked, files)
    if reranking:
        ranks = written(ranks, "ranks")
        for base, marks in (("lexical", None), ("lexical-ablated", evidence)):
            ranks = ranks.unionByName(_reranked(reranking, base, ranks, scores, wanted, code, marks))
            arms = [*arms, reranking.arm + ("" if marks is None else "-ablated")]
    ranks = ranks.unionByName(rt.shuffled_ranks(wanted, present, files, trials))
    arms = arms + [f"shuffle-{t}" for t in range(trials)]
    shown = wanted.select("query_id", F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    metrics = ev.per_query(ranks, present, ks, shown=shown)
    keyed = metrics.join(wanted.select("query_id", "repo"), "query_id").join(lost, "query_id", "left")
    names = [c for c in metrics.columns if c == "rr" or c.startswith("recall_")]
    trial = keyed.groupBy("repo", "arm").agg(F.count("*").alias("n"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"), *[F.avg(c).alias(c) for c in names])
    # shuffles: the mean over trials, with the range that they span
    trial = trial.withColumn("arm", F.regexp_replace("arm", r"^shuffle-\d+$", "shuffle"))
    return trial.groupBy("repo", "arm").agg(F.max("n").alias("n"), F.max("lost").alias("lost"), *[F.round(F.avg(c), 6).alias("mrr" if c == "rr" else c) for c in names], F.round(F.min("rr"), 6).alias("mrr_lo"), F.round(F.max("rr"), 6).alias("mrr_hi"))
