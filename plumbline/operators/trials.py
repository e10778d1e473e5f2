"""Repeated answers of a judge: stored by trial, resumed by what is missing, aligned by case.

A trial is a whole pass over the cases.  Answers are rows of a store (``sources.stores``) by judge, trial and case, so a
run that was interrupted asks again for what it lacks only, and two trials never share a reply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import Store

#: How the three answers are written; to abstain is an answer, too.
WORDS = {True: "false", False: "not-false", None: "abstain"}


def trial_store(spark: SparkSession, root: str, corpus: str, buckets: int = 16) -> Store:
    """Answers by (judge, trial, case_id); ``corpus`` names what was judged, and another one is refused."""
    return Store.open(spark, root, {"judge": "string", "trial": "int", "case_id": "string"}, ("answer", "string"), corpus, buckets)


def written_answer(answer):
    return F.when(answer, WORDS[True]).when(~answer, WORDS[False]).otherwise(WORDS[None])


def read_answer(word):
    return F.when(word == WORDS[True], True).when(word == WORDS[False], False)


def run_trials(store: Store, cases: DataFrame, judge: str, trials: int, answer: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
    """Complete ``trials`` passes of a judge over ``cases(case_id, ..)``; (answers found, answers asked for).

    ``answer`` takes the cases that lack one, with their columns and ``trial``, and gives them back with a nullable
    boolean ``answer``.
    """
    if trials < 1:
        raise ValueError("trials must be 1 or more")
    every = F.explode(F.sequence(F.lit(0), F.lit(trials - 1)).cast("array<int>"))
    wanted = cases.select(F.lit(judge).alias("judge"), F.col("case_id").cast("string").alias("case_id"), every.alias("trial"))

    def compute(missing: DataFrame) -> DataFrame:
        asked = answer(missing.join(cases.withColumn("case_id", F.col("case_id").cast("string")), "case_id").drop("judge"))
        return asked.select(F.lit(judge).alias("judge"), "trial", "case_id", written_answer(F.col("answer")).alias("answer"))

    return store.fill(wanted, compute)


def align(answers: DataFrame, cases: DataFrame, trials: int) -> DataFrame:
    """(judge, case_id, verdict, target, answers, state) of scoreable cases; ``answers`` in the order of trials.

    ``answers(judge, trial, case_id, answer)`` with written answers.  ``state`` is partial where a trial lacks the case,
    else contradiction (both ways), abstention_flip (answered and abstained) or stable.  Trials beyond ``trials`` are
    not looked at; a case that no trial has is partial, with no answers.
    """
    said = answers.where((F.col("trial") >= 0) & (F.col("trial") < trials)).select("judge", "trial", F.col("case_id").cast("string").alias("case_id"), "answer").dropDuplicates(["judge", "trial", "case_id"])
    by = said.groupBy("judge", "case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("trial", "answer"))), lambda s: s["answer"]).alias("answers"), F.count("*").alias("n"),
        F.count_if(F.col("answer") == WORDS[None]).alias("silent"), F.count_if(F.col("answer") == WORDS[True]).alias("yes"), F.count_if(F.col("answer") == WORDS[False]).alias("no"),
    )
    scoreable = cases.where("target IS NOT NULL").select(F.col("case_id").cast("string").alias("case_id"), "verdict", "target")
    judges = said.select("judge").distinct()  # a row a judge
    every = scoreable.join(F.broadcast(judges), how="cross").join(by, ["judge", "case_id"], "left")
    state = (
        F.when(F.coalesce("n", F.lit(0)) < trials, "partial").when((F.col("yes") > 0) & (F.col("no") > 0), "contradiction")
        .when((F.col("silent") > 0) & (F.col("yes") + F.col("no") > 0), "abstention_flip").otherwise("stable")
    )
    return every.select("judge", "case_id", "verdict", "target", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), state.alias("state"))


def stability(aligned: DataFrame) -> DataFrame:
    """One row a judge: complete, partial, stable and unstable cases, and the rates of unstable ones by target."""
    state, whole = F.col("state"), F.col("state") != "partial"
    moved = state.isin("contradiction", "abstention_flip")
    rate = lambda cond: F.round(F.coalesce(F.avg(F.when(whole & cond, moved.cast("int"))), F.lit(0.0)), 6)
    return aligned.groupBy("judge").agg(
        F.count_if(whole).alias("n"), F.count_if(~whole).alias("partial"), F.count_if(state == "stable").alias("stable"), F.count_if(moved).alias("unstable"),
        F.count_if(state == "contradiction").alias("contradictions"), F.count_if(state == "abstention_flip").alias("abstention_flips"),
        rate(F.lit(True)).alias("unstable_rate"), rate(F.col("target")).alias("positive_unstable_rate"), rate(~F.col("target")).alias("negative_unstable_rate"),
        F.count_if(whole & F.col("target")).alias("positives"), F.count_if(whole & ~F.col("target")).alias("negatives"),
    )


def unstable_by_verdict(aligned: DataFrame) -> DataFrame:
    """Where the flips lie: complete and unstable cases by judge and verdict."""
    return aligned.where("state <> 'partial'").groupBy("judge", "verdict").agg(F.count("*").alias("n"), F.count_if(F.col("state") != "stable").alias("unstable"))


def matrix_json(aligned: DataFrame) -> DataFrame:
    """(judge, value): a JSON object a case, with its answers in the order of trials; written by judge."""
    row = F.struct("case_id", "verdict", "target", "answers", "state")
    return aligned.select("judge", F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def write_matrix(aligned: DataFrame, path: str) -> None:
    """One folder a judge; an existing matrix is refused."""
    matrix_json(aligned).repartition("judge").write.partitionBy("judge").mode("errorifexists").text(path)


def states_of(replies: DataFrame) -> DataFrame:
    """(case_id, said): the word of the best reply of each case: one that came to its end before one that was cut.

    ``replies(case_id, word, truncated)``; a null word is a reply that can't be read.
    """
    order = F.struct(F.coalesce("truncated", F.lit(False)), F.col("word").isNull(), F.coalesce("word", F.lit("")))
    best = replies.groupBy("case_id").agg(F.min(order).alias("b"))
    word = F.when(F.col("b.col1"), "truncated").when(F.col("b.col2"), "unparsed").otherwise(F.col("b.col3"))
    return best.select("case_id", word.alias("said"))


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, was, now, outcome) of every case of either run: flipped, same or untested.

    ``before``, ``after``: replies as ``states_of`` takes them.  A reply that was cut, can't be read or is missing is no
    answer, so it is no flip either.
    """
    was, now = (states_of(r).withColumnRenamed("said", c) for r, c in ((before, "was"), (after, "now")))
    j = was.join(now, "case_id", "full_outer").select("case_id", *[F.coalesce(c, F.lit("missing")).alias(c) for c in ("was", "now")])
    silent = F.col("was").isin("missing", "truncated", "unparsed") | F.col("now").isin("missing", "truncated", "unparsed")
    return j.withColumn("outcome", F.when(silent, "untested").when(F.col("was") == F.col("now"), "same").otherwise("flipped"))


def transitions(flipped: DataFrame) -> DataFrame:
    """How many cases went from which state to which, and the first of them."""
    return flipped.groupBy("was", "now", "outcome").agg(F.count("*").alias("n"), F.min("case_id").alias("first"))
