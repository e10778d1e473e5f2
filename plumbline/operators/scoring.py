"""Label statistics, samples, free judges and distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def precision_by(rows: DataFrame, key: str) -> DataFrame:
    """Share of ``hit`` overall and by key with its Wilson interval; one pass over grouping sets."""
    g = rows.groupingSets([[], [key]], key).agg(F.count("*").alias("n"), F.count_if("hit").alias("h"), F.grouping(key).alias("g"))
    lo, hi = stats.wilson(F.col("h"), F.col("n"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.col(key)).alias(key), "n", "h", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), F.round(stats.ratio(F.col("h"), F.col("n")), 6).alias("precision"))


def retention(old: DataFrame, new: DataFrame, verdicts: DataFrame, id_col: str, key: str) -> DataFrame:
    """Judged rows of the old label set that the new one keeps or drops, by key and blended."""
    kept = new.select(id_col).distinct().withColumn("kept", F.lit(True))
    j = verdicts.select(id_col, "hit").join(old.select(id_col, key), id_col).join(kept, id_col, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    k, h = F.col("kept"), F.col("hit")
    return j.rollup(key).agg(F.count("*").alias("judged"), F.count_if(k).alias("kept"), F.count_if(~k).alias("dropped"), F.count_if(k & h).alias("kept_hits"), F.count_if(~k & h).alias("lost_hits")).withColumn(key, F.coalesce(key, F.lit("all")))


def _judged_old(old: DataFrame, new: DataFrame, verdicts: DataFrame, id_col: str) -> DataFrame:
    kept = new.select(id_col).distinct().withColumn("kept", F.lit(True))
    return verdicts.join(old, id_col).join(kept, id_col, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def retention_report(old: DataFrame, new: DataFrame, verdicts: DataFrame, id_col: str, key: str, positive: str = "drift") -> DataFrame:
    """What a rebuilt label set keeps of ``verdicts(id, verdict)``, by key and blended ("all").

    Precision is the share of positive verdicts among the kept ones, with its Wilson interval; it holds for rules that only
    remove.  ``kept`` and ``dropped`` count by verdict.  Verdicts whose case the old set lacks are not in here: see
    ``not_in_old``.
    """
    j = _judged_old(old.select(id_col, key), new, verdicts.select(id_col, "verdict"), id_col)
    by = j.groupBy(key, "verdict").agg(F.count_if("kept").alias("k"), F.count_if(~F.col("kept")).alias("d"))
    both = by.unionByName(by.groupBy("verdict").agg(F.sum("k").alias("k"), F.sum("d").alias("d")).withColumn(key, F.lit("all")))
    hit = F.col("verdict") == positive
    counts = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("verdict", c)))))
    g = both.groupBy(key).agg(F.sum("k").alias("retained_n"), F.sum(F.when(hit, F.col("k")).otherwise(0)).alias("retained_hits"), F.sum(F.when(hit, F.col("k") + F.col("d")).otherwise(0)).alias("positives_before"), counts("k").alias("kept"), counts("d").alias("dropped"))
    lo, hi = stats.wilson(F.col("retained_hits"), F.col("retained_n"))
    return g.withColumns({"precision": F.when(F.col("retained_n") > 0, F.round(F.col("retained_hits") / F.col("retained_n"), 4)), "lo": F.round(lo, 4), "hi": F.round(hi, 4)})


def lost_positives(old: DataFrame, new: DataFrame, verdicts: DataFrame, id_col: str, positive: str = "drift") -> DataFrame:
    """The rows of the old set, judged positive, that the new one lacks: what to read before a rule is made stricter."""
    return old.join(verdicts.where(F.col("verdict") == positive).select(id_col).distinct(), id_col, "left_semi").join(new.select(id_col), id_col, "left_anti")


def not_in_old(old: DataFrame, verdicts: DataFrame, id_col: str) -> DataFrame:
    """Verdicts that can't be scored, for the old set never held their case."""
    return verdicts.join(old.select(id_col), id_col, "left_anti")


def prefer_version(rows: DataFrame, id_col: str, file_col: str, preferred: list[str], fields: list[str], ties: list[str]) -> DataFrame:
    """One row an id: preferred files first, then the lowest name; ``disagrees`` if the fields vary."""
    order = reduce(lambda e, p: e.when(F.col(file_col) == p[1], p[0]), enumerate(preferred[1:], 1), F.when(F.col(file_col) == preferred[0], 0)).otherwise(len(preferred))
    w = Window.partitionBy(id_col).orderBy(order, file_col, *ties)
    first = rows.withColumn("nr", F.row_number().over(w)).where("nr = 1").drop("nr")
    n = rows.groupBy(id_col).agg(F.countDistinct(F.struct(*fields)).alias("n"))
    return first.join(n, id_col).withColumn("disagrees", F.col("n") > 1).drop("n")


def sample(rows: DataFrame, id_col: str, key: str, n: int, seed: str) -> DataFrame:
    """The first n of each key in hash order; a larger n holds the smaller sample."""
    w = Window.partitionBy(key).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), id_col)
    return rows.select(id_col, key).withColumn("nr", F.row_number().over(w).cast("long")).where(F.col("nr") <= n)


def free_judges(cases: DataFrame, id_col: Column, rate: float, seed: str) -> DataFrame:
    """Every case with the answers of the judges that cost nothing: constants, abstention and a prior."""
    said = F.array(
        F.struct(F.lit("always-false").alias("judge"), F.lit(True).alias("answer")),
        F.struct(F.lit("always-not-false").alias("judge"), F.lit(False).alias("answer")),
        F.struct(F.lit("abstain").alias("judge"), F.lit(None).cast("boolean").alias("answer")),
        F.struct(F.lit("prior").alias("judge"), (stats.uniform(F.lit(seed), id_col.cast("string")) < rate).alias("answer")),
    )
    return cases.withColumn("j", F.explode(said)).select("*", "j.judge", "j.answer").drop("j")


def sweep(absent: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, doc_id, answer): flagged from ``threshold`` absent identifiers on."""
    t = absent.withColumn("threshold", F.explode(F.array(*[F.lit(t).cast("long") for t in thresholds])))
    return t.select("threshold", "doc_id", (F.col("absent") >= F.col("threshold")).alias("answer"))


def located_answer(answer: Column, located: Column) -> Column:
    return F.when(F.bool_or(answer & located), True).when(F.bool_or(answer), F.lit(None).cast("boolean")).when(F.count(answer) > 0, False)


def chance_trials(cases: DataFrame, id_col: Column, rate: float, trials: int) -> DataFrame:
    """(trial, f1) of seeded guesses: each case counts in every trial by a conditional sum, without a product."""
    c = cases.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    guess = stats.uniform(F.lit("c"), F.col("trial").cast("string"), id_col.cast("string")) < rate
    n = c.withColumn("a", guess).groupBy("trial").agg(F.count_if(F.col("target") & F.col("a")).alias("tp"), F.count_if(~F.col("target") & F.col("a")).alias("fp"), F.count_if(F.col("target") & ~F.col("a")).alias("fn"))
    return n.select("trial", stats.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def spend(prompts: DataFrame, key: str, system: int = 400, per_token: float = 2.7, ceiling: int = 512) -> DataFrame:
    """Calls, estimated input tokens, the longest prompt and the most tokens that replies may take."""
    return prompts.groupBy(key).agg(F.count("*").alias("calls"), F.round(F.sum(F.length("prompt") + system) / per_token).cast("long").alias("input_tokens"), F.max(F.length("prompt")).cast("long").alias("longest"), (F.count("*") * ceiling).alias("output_bound"))


def distribution(rows: DataFrame, key: str) -> DataFrame:
    """n, mean, upper median, p90 (position int(0.9 n)) and maximum of ``v``, from counts of equal values."""
    c = rows.groupBy(key, "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(key))})
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v"))).cast("long")
    return c.groupBy(key).agg(F.max("n").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 6).alias("mean"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.lit(0.9) * F.col("n"))).alias("p90"), F.max("v").cast("long").alias("longest"))
