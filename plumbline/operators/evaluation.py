"""Rank metrics, confusion counts, noise and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def per_query(ranking: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 10), shown: DataFrame | None = None) -> DataFrame:
    """(query_id[, arm, trial], rr, recall_k..): queries without a hit keep 0.

    ``shown`` has the queries to answer for where the ranking holds relevant rows only.
    """
    keys = [c for c in ("arm", "trial", "query_id") if c in ranking.columns]
    rel = relevant.select("query_id", "path", F.lit(1).alias("rel")).distinct()
    hits = ranking.join(rel, ["query_id", "path"])
    total = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    found = hits.groupBy(*keys).agg(F.max(1 / F.col("rank")).alias("rr"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in ks])
    shown = (ranking if shown is None else shown).select(*keys).distinct().join(total, "query_id").join(found, keys, "left")
    return shown.select(*keys, F.coalesce("rr", F.lit(0.0)).alias("rr"), *[(F.coalesce(f"h{k}", F.lit(0)) / F.col("n_rel")).alias(f"recall_{k}") for k in ks])


def macro(metrics: DataFrame, *keys: str) -> DataFrame:
    """Means over queries."""
    names = [c for c in metrics.columns if c == "rr" or c.startswith("recall_")]
    return metrics.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias("mrr" if c == "rr" else c) for c in names])


def noise(trials: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, lowest, highest and width over trials."""
    return trials.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("lo"), F.round(F.max(value), 6).alias("hi"), F.round(F.max(value) - F.min(value), 6).alias("width"))


def confusion(judged: DataFrame, *keys: str) -> DataFrame:
    """Counts over rows (target, answer[, unparsed, truncated]); a null answer abstains, a null target is held out.

    With the two flags also: unparsed, those of them that were not cut (unparsed_only), truncated, and truncated_answered, a
    verdict of a reply that was cut.
    """
    t, a = F.col("target"), F.col("answer")
    extra = []
    if {"unparsed", "truncated"} <= set(judged.columns):
        odd, cut = F.coalesce("unparsed", F.lit(False)), F.coalesce("truncated", F.lit(False))
        extra = [F.count_if(odd).alias("unparsed"), F.count_if(odd & ~cut).alias("unparsed_only"), F.count_if(cut).alias("truncated"), F.count_if(cut & a.isNotNull()).alias("truncated_answered")]
    return judged.where("target IS NOT NULL").groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("answer").alias("answered"), F.count_if(a.isNull()).alias("abstained"),
        F.count_if(t & a).alias("tp"), F.count_if(~t & a).alias("fp"), F.count_if(t & ~a).alias("fn"), F.count_if(~t & ~a).alias("tn"), *extra,
    )


def rates(counts: DataFrame) -> DataFrame:
    c = F.col
    return counts.withColumns({
        "precision": F.round(stats.precision(c("tp"), c("fp")), 6),
        "recall": F.round(stats.recall(c("tp"), c("fn")), 6),
        "f1": F.round(stats.f1(c("tp"), c("fp"), c("fn")), 6),
        "accuracy_answered": F.round(stats.ratio(c("tp") + c("tn"), c("answered")), 6),
        "accuracy_all": F.round(stats.ratio(c("tp") + c("tn"), c("n")), 6),
        "abstention_rate": F.round(stats.ratio(c("abstained"), c("n")), 6),
        "false_flag_rate": F.round(F.when(c("fp") + c("tn") > 0, c("fp") / (c("fp") + c("tn"))), 6),
        "readable": c("n") >= 10,
    })


def stability(trials: DataFrame) -> DataFrame:
    """Per case over trials (case_id, trial, answer): contradiction, abstention_flip or stable."""
    by = trials.groupBy("judge", "case_id").agg(F.max("answer").alias("hi"), F.min("answer").alias("lo"), F.count_if(F.col("answer").isNull()).alias("silent"), F.count("*").alias("k"))
    state = F.when(F.col("hi") != F.col("lo"), "contradiction").when((F.col("silent") > 0) & (F.col("silent") < F.col("k")), "abstention_flip").otherwise("stable")
    return by.select("judge", "case_id", "k", state.alias("state"))


def page_answer(answer: Column) -> Column:
    """Any claim flagged flags the page; else any decided claim clears it; else the page abstains."""
    return F.when(F.bool_or(answer), True).when(F.count(answer) > 0, False)


def gate(scores: DataFrame, floors: DataFrame, width: float, chance_f1: float) -> DataFrame:
    """A submission passes if all answered, and it beats the best free floor, the constant and chance; ties fail."""
    best = floors.agg(F.max("f1").alias("best_f1"), F.max_by("judge", "f1").alias("best_judge"), F.max(F.when(F.col("judge").startswith("always-"), F.col("accuracy_all"))).alias("constant_accuracy"))
    reason = lambda bad, name: F.when(bad, F.lit(name))
    out = scores.crossJoin(F.broadcast(best))  # one row
    reasons = F.array_compact(F.array(
        reason(F.col("answered") < F.col("n"), "unanswered"),
        reason(F.round(F.col("f1") - F.col("best_f1"), 9) <= width, "within_noise_of_best_floor"),
        reason(F.col("accuracy_all") <= F.col("constant_accuracy"), "no_better_than_constant"),
        reason(F.col("f1") <= chance_f1, "no_better_than_chance"),
    ))
    return out.withColumn("reasons", reasons).withColumn("admissible", F.size("reasons") == 0)


def decompose(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """unknown, missing or scored for every id of either side."""
    p = predictions.select(F.col("case_id"), F.lit(1).alias("p")).distinct()
    c = cases.select(F.col("case_id"), F.lit(1).alias("c")).distinct()
    state = F.when(F.col("c").isNull(), "unknown").when(F.col("p").isNull(), "missing").otherwise("scored")
    return p.join(c, "case_id", "full_outer").select("case_id", state.alias("state"))


def macro_raw(metrics: DataFrame, *keys: str) -> DataFrame:
    """Means over queries, not rounded, for means over trials of them."""
    names = [c for c in metrics.columns if c == "rr" or c.startswith("recall_")]
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias("mrr" if c == "rr" else c) for c in names])
