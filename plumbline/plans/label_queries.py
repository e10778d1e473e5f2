"""Queries over labels, judges, noise, gates and mined examples.

``labels.quality`` is the target (0 is a finding), ``labels.toxic`` a second rater; documents without a
label are held out.  Conversations stand for commits: a conversation is a commit, its turns are files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, stats, tokens
from ..operators import evaluation as ev
from ..operators import mining
from ..operators import scoring
from .registry import query, table
from .text_queries import NL, TURNS_SQL, sql_any, sql_extract, sql_kind, sql_longest, sql_related, sql_urls, turns

WILSON_LO = "greatest(0, (h / n::DOUBLE + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n::DOUBLE * (1 - h / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n))"
WILSON_HI = WILSON_LO.replace("greatest(0", "least(1").replace("- 1.96 * sqrt", "+ 1.96 * sqrt")


def joined(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")


# ---------------------------------------------------------------- counts, precision, retention


@query("""SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'cell' END AS by, coalesce(lang, source, quality || '/' || toxic) AS value, count(*)::BIGINT AS n
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (quality, toxic))""")
def label_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Independent groupings in one pass."""
    j = joined(spark, sf)
    g = j.groupingSets([["lang"], ["source"], ["quality", "toxic"]], "lang", "source", "quality", "toxic").agg(F.count("*").alias("n"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    by = F.when(F.col("gl") == 0, "lang").when(F.col("gs") == 0, "source").otherwise("cell")
    return g.select(by.alias("by"), F.coalesce("lang", "source", F.concat_ws("/", "quality", "toxic")).alias("value"), "n")


@query("SELECT lang, source, quality, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_cell_counts(spark: SparkSession, sf: str) -> DataFrame:
    return joined(spark, sf).groupBy("lang", "source", "quality").agg(F.count("*").alias("n"))


@query(f"SELECT lang, n, h, round({WILSON_LO}, 6) AS lo, round({WILSON_HI}, 6) AS hi, round(h / n::DOUBLE, 6) AS precision FROM (SELECT coalesce(lang, 'all') AS lang, count(*)::BIGINT AS n, count_if(quality = 0)::BIGINT AS h FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang)))")
def wilson_precision(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.precision_by(joined(spark, sf).withColumn("hit", F.col("quality") == 0), "lang")


@query("SELECT source, n, round(1 - pow(0.05, 1.0 / n), 6) AS upper_bound FROM (SELECT source, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def zero_success_bound(spark: SparkSession, sf: str) -> DataFrame:
    return joined(spark, sf).groupBy("source").agg(F.count("*").alias("n")).select("source", "n", F.round(stats.zero_success_bound(F.col("n")), 6).alias("upper_bound"))


@query("""SELECT coalesce(lang, 'all') AS lang, count(*)::BIGINT AS judged, count_if(n_chars > 1000)::BIGINT AS kept, count_if(n_chars <= 1000)::BIGINT AS dropped, count_if(n_chars > 1000 AND quality = 0)::BIGINT AS kept_hits, count_if(n_chars <= 1000 AND quality = 0)::BIGINT AS lost_hits
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def label_rollup_retention(spark: SparkSession, sf: str) -> DataFrame:
    """What a stricter label set (long documents) keeps of the judged ones, by language and blended."""
    old = table(spark, sf, "documents").select("doc_id", "lang")
    new = table(spark, sf, "documents").where("n_chars > 1000").select("doc_id")
    return scoring.retention(old, new, table(spark, sf, "labels").withColumn("hit", F.col("quality") == 0), "doc_id", "lang")


@query("SELECT (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id))::BIGINT AS unlabelled, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id))::BIGINT AS unknown, (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id))::BIGINT AS matched")
def verdict_join(spark: SparkSession, sf: str) -> DataFrame:
    d, v = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    states = ev.decompose(v.withColumnRenamed("doc_id", "case_id"), d.withColumnRenamed("doc_id", "case_id")).groupBy().agg(F.count_if(F.col("state") == "missing").alias("unlabelled"), F.count_if(F.col("state") == "unknown").alias("unknown"), F.count_if(F.col("state") == "scored").alias("matched"))
    return states


@query("""WITH v AS (SELECT doc_id % 50 AS id, source, lang, n_chars FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, source, lang, n_chars) AS nr FROM v)
SELECT r.id, r.source, r.lang, d.n_versions > 1 AS disagrees FROM r JOIN (SELECT id, count(DISTINCT (lang, source)) AS n_versions FROM v GROUP BY id) d USING (id) WHERE nr = 1""")
def version_preference(spark: SparkSession, sf: str) -> DataFrame:
    """An id in several label files: the preferred file wins, disagreement over fixed fields is told."""
    v = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("id"), "source", "lang", "n_chars")
    return scoring.prefer_version(v, "id", "source", ["src0", "src1"], ["lang", "source"], ["lang", "n_chars"]).select("id", "source", "lang", "disagrees")


@query("""WITH j AS (SELECT doc_id, source, md5('7:' || doc_id) AS o FROM documents ANTI JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, doc_id) AS nr FROM j)
SELECT source, doc_id, nr FROM r WHERE nr <= 3""")
def anti_excluded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded sample of three documents a source that nobody judged yet."""
    return scoring.sample(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti"), "doc_id", "source", 3, "7").select("source", "doc_id", "nr")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) AS nr FROM documents WHERE length(text) >= 400)
SELECT source, count_if(nr <= 5)::BIGINT AS small, count_if(nr <= 12)::BIGINT AS large, sum(CASE WHEN nr <= 5 THEN doc_id END)::BIGINT AS small_sum, sum(CASE WHEN nr <= 12 THEN doc_id END)::BIGINT AS large_sum FROM r GROUP BY source""")
def nested_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A larger sample holds the smaller one."""
    s = scoring.sample(table(spark, sf, "documents").where(F.length("text") >= 400), "doc_id", "source", 12, "3")
    return s.groupBy("source").agg(F.count_if(F.col("nr") <= 5).alias("small"), F.count("*").alias("large"), F.sum(F.when(F.col("nr") <= 5, F.col("doc_id"))).alias("small_sum"), F.sum("doc_id").alias("large_sum"))


# ---------------------------------------------------------------- judges

#: answer: short documents are flagged, long ones cleared, those between abstain.
RULE = "CASE WHEN n_chars < 600 THEN true WHEN n_chars > 1500 THEN false END"
CASES_SQL = f"cases AS (SELECT doc_id, lang, source, n_chars, CASE quality WHEN 0 THEN true WHEN 1 THEN false END AS target, {RULE} AS answer FROM documents LEFT JOIN labels USING (doc_id))"
RATES_SQL = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1, round(CASE WHEN answered = 0 THEN 0 ELSE (tp + tn) / answered::DOUBLE END, 6) AS accuracy_answered,
 round(CASE WHEN n = 0 THEN 0 ELSE (tp + tn) / n::DOUBLE END, 6) AS accuracy_all, round(CASE WHEN n = 0 THEN 0 ELSE abstained / n::DOUBLE END, 6) AS abstention_rate,
 round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE END, 6) AS false_flag_rate, n >= 10 AS readable"""
COUNTS_SQL = "count(*)::BIGINT AS n, count(answer)::BIGINT AS answered, count_if(answer IS NULL)::BIGINT AS abstained, count_if(target AND answer)::BIGINT AS tp, count_if(NOT target AND answer)::BIGINT AS fp, count_if(target AND NOT answer)::BIGINT AS fn, count_if(NOT target AND NOT answer)::BIGINT AS tn"


def cases(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", "lang", "source", "n_chars", F.when(F.col("quality") == 0, True).when(F.col("quality") == 1, False).alias("target"), F.expr(RULE).alias("answer"))


@query(f"WITH {CASES_SQL} SELECT *, {RATES_SQL} FROM (SELECT lang, {COUNTS_SQL} FROM cases WHERE target IS NOT NULL GROUP BY lang)")
def confusion_prf(spark: SparkSession, sf: str) -> DataFrame:
    return ev.rates(ev.confusion(cases(spark, sf), "lang"))


@query(f"WITH {CASES_SQL} SELECT coalesce(target::VARCHAR, 'held-out') AS verdict, count_if(answer)::BIGINT AS said_false, count_if(NOT answer)::BIGINT AS said_not_false, count_if(answer IS NULL)::BIGINT AS abstain FROM cases GROUP BY 1")
def confusion_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("answer"), "said_false").when(~F.col("answer"), "said_not_false").otherwise("abstain")
    c = cases(spark, sf).select(F.coalesce(F.col("target").cast("string"), F.lit("held-out")).alias("verdict"), said.alias("said"))
    return c.groupBy("verdict").pivot("said", ["said_false", "said_not_false", "abstain"]).count().na.fill(0)


@query(f"WITH {CASES_SQL} SELECT round(avg(CASE WHEN target IS NULL THEN (answer IS NULL)::INT END), 6) AS held_out_rate, round(avg(CASE WHEN target IS NOT NULL THEN (answer IS NULL)::INT END), 6) AS scoreable_rate, round(avg(CASE WHEN target IS NULL THEN (answer IS NULL)::INT END) / avg(CASE WHEN target IS NOT NULL THEN (answer IS NULL)::INT END), 6) AS lift FROM cases")
def abstention_lift(spark: SparkSession, sf: str) -> DataFrame:
    silent = F.col("answer").isNull().cast("int")
    rate = cases(spark, sf).agg(F.avg(F.when(F.col("target").isNull(), silent)).alias("a"), F.avg(F.when(F.col("target").isNotNull(), silent)).alias("b"))
    return rate.select(F.round("a", 6).alias("held_out_rate"), F.round("b", 6).alias("scoreable_rate"), F.round(stats.ratio(F.col("a"), F.col("b")), 6).alias("lift"))


@query(f"WITH {CASES_SQL} SELECT count(*)::BIGINT AS n, count_if(target)::BIGINT AS positives, round(count_if(target) / count(*)::DOUBLE, 6) AS positive_rate, round(greatest(count_if(target), count_if(NOT target)) / count(*)::DOUBLE, 6) AS majority_accuracy, CASE WHEN count_if(target) > count_if(NOT target) THEN 'false' ELSE 'not-false' END AS majority FROM cases WHERE target IS NOT NULL")
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    p, q = F.count_if(F.col("target")), F.count_if(~F.col("target"))
    return cases(spark, sf).where("target IS NOT NULL").agg(F.count("*").alias("n"), p.alias("positives"), F.round(p / F.count("*"), 6).alias("positive_rate"), F.round(F.greatest(p, q) / F.count("*"), 6).alias("majority_accuracy"), F.when(p > q, "false").otherwise("not-false").alias("majority"))


@query(f"WITH {CASES_SQL} SELECT *, n >= 10 AS readable FROM (SELECT coalesce(lang, source) AS cell, grouping(lang) = 0 AS by_lang, {COUNTS_SQL} FROM cases WHERE target IS NOT NULL GROUP BY GROUPING SETS ((lang), (source)))")
def cell_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = cases(spark, sf).where("target IS NOT NULL").select("target", "answer", F.explode(F.array(F.struct("lang", F.lit(True).alias("by_lang")), F.struct(F.col("source").alias("lang"), F.lit(False).alias("by_lang")))).alias("k"))
    return ev.confusion(c.select("target", "answer", F.col("k.lang").alias("cell"), F.col("k.by_lang").alias("by_lang")), "cell", "by_lang").withColumn("readable", F.col("n") >= 10)


JUDGES_SQL = f"""{CASES_SQL}, j AS (
 SELECT doc_id, target, 'always-false' AS judge, true AS answer FROM cases UNION ALL SELECT doc_id, target, 'always-not-false', false FROM cases UNION ALL SELECT doc_id, target, 'abstain', NULL FROM cases
 UNION ALL SELECT doc_id, target, 'prior', CAST('0x' || substr(md5('11:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 FROM cases)"""


@query(f"WITH {JUDGES_SQL} SELECT *, {RATES_SQL} FROM (SELECT judge, {COUNTS_SQL} FROM j WHERE target IS NOT NULL GROUP BY judge)")
def judge_constants(spark: SparkSession, sf: str) -> DataFrame:
    return ev.rates(ev.confusion(scoring.free_judges(cases(spark, sf).drop("answer"), F.col("doc_id"), 0.3, "11"), "judge"))


@query("SELECT doc_id, CAST('0x' || substr(md5('11:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 AS answer FROM documents")
def judge_prior(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", (stats.uniform(F.lit("11"), F.col("doc_id").cast("string")) < 0.3).alias("answer"))


MARKED_WORDS = ["thatthe", "tion", "andthe", "lich", "ment", "para"]


@query("WITH w AS (SELECT unnest(['" + "', '".join(MARKED_WORDS) + f"""']) AS tok),
a AS (SELECT doc_id, (SELECT count(*) FROM w WHERE NOT list_contains(t, tok)) AS absent FROM (SELECT doc_id, {sql_extract('text', versions=False)} AS t FROM documents))
SELECT threshold::BIGINT AS threshold, doc_id, absent >= threshold AS answer FROM a, (VALUES (1), (3), (6)) AS s(threshold)""")
def judge_absence_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Marked identifiers that a text lacks, against three thresholds."""
    d = table(spark, sf, "documents").select("doc_id", F.size(F.array_except(F.array(*map(F.lit, MARKED_WORDS)), tokens.extract(F.col("text"), with_versions=False))).alias("absent"))
    return scoring.sweep(d, [1, 3, 6])


@query("""WITH c AS (SELECT conv_id, CASE role WHEN 'system' THEN NULL ELSE length(text) % 3 = 0 END AS a FROM conversations)
SELECT conv_id, CASE WHEN bool_or(a) THEN true WHEN count(a) > 0 THEN false END AS answer, count(*)::BIGINT AS claims FROM c GROUP BY conv_id""")
def page_from_claims(spark: SparkSession, sf: str) -> DataFrame:
    a = F.when(F.col("role") != "system", F.length("text") % 3 == 0)
    return table(spark, sf, "conversations").withColumn("a", a).groupBy("conv_id").agg(ev.page_answer(F.col("a")).alias("answer"), F.count("*").alias("claims"))


@query("""WITH c AS (SELECT conv_id, length(text) % 3 = 0 AS a, regexp_matches(text, '(?:^|[^A-Za-z0-9_.])(?:the|die|les)(?:$|[^A-Za-z0-9_])') AS loc FROM conversations)
SELECT conv_id, CASE WHEN bool_or(a AND loc) THEN true WHEN bool_or(a) THEN NULL WHEN count(a) > 0 THEN false END AS answer FROM c GROUP BY conv_id""")
def restrict_located(spark: SparkSession, sf: str) -> DataFrame:
    """A finding none of whose claims names a known identifier becomes an abstention."""
    from ..functions import texts

    c = table(spark, sf, "conversations").select("conv_id", (F.length("text") % 3 == 0).alias("a"), texts.locates(F.col("text"), F.array(*map(F.lit, ("the", "die", "les")))).alias("loc"))
    return c.groupBy("conv_id").agg(scoring.located_answer(F.col("a"), F.col("loc")).alias("answer"))


# ---------------------------------------------------------------- noise, stability, gate

DRAWS = 40
CHANCE_SQL = f"""{CASES_SQL}, d AS (SELECT t, target, CAST('0x' || substr(md5('c:' || t || ':' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 AS answer FROM cases, unnest(range(0, {DRAWS})) AS u(t) WHERE target IS NOT NULL),
f AS (SELECT t, 2.0 * count_if(target AND answer) / nullif(2 * count_if(target AND answer) + count_if(NOT target AND answer) + count_if(target AND NOT answer), 0) AS f1 FROM d GROUP BY t),
s AS (SELECT list_sort(list(round(coalesce(f1, 0), 9))) AS v FROM f)"""


@query(f"WITH {CHANCE_SQL} SELECT round(v[floor(0.05 * (len(v) - 1))::INT + 1], 6) AS p5, round(v[len(v) // 2 + 1], 6) AS median, round(v[floor(0.95 * (len(v) - 1))::INT + 1], 6) AS p95 FROM s")
def chance_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded guesses at a fixed rate, many trials; order statistics by floor index."""
    f1 = scoring.chance_trials(cases(spark, sf).where("target IS NOT NULL").select("doc_id", "target"), F.col("doc_id"), 0.3, DRAWS)
    v = f1.agg(F.collect_list(F.round("f1", 9)).alias("v"))  # one number a trial
    return v.select(F.round(stats.at_floor(F.col("v"), 0.05), 6).alias("p5"), F.round(stats.upper_median(F.col("v")), 6).alias("median"), F.round(stats.at_floor(F.col("v"), 0.95), 6).alias("p95"))


TRIAL = "CASE WHEN CAST(conv(substr(md5(concat_ws(':', 't', cast(trial AS STRING), cast(doc_id AS STRING))), 1, 2), 16, 10) AS INT) < 20 THEN NULL WHEN CAST(conv(substr(md5(concat_ws(':', 't', cast(trial AS STRING), cast(doc_id AS STRING))), 1, 2), 16, 10) AS INT) < 40 THEN n_chars >= 600 ELSE n_chars < 600 END"
TRIALS_SQL = f"""{CASES_SQL}, x AS (SELECT trial, doc_id AS case_id, target, n_chars, CAST('0x' || substr(md5('t:' || trial || ':' || doc_id), 1, 2) AS INT) AS u FROM cases, unnest(range(0, 3)) AS s(trial) WHERE target IS NOT NULL),
trials AS (SELECT trial, case_id, target, 'noisy' AS judge, CASE WHEN u < 20 THEN NULL WHEN u < 40 THEN n_chars >= 600 ELSE n_chars < 600 END AS answer FROM x UNION ALL SELECT trial, case_id, target, 'fixed', n_chars < 600 FROM x)"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    c = cases(spark, sf).where("target IS NOT NULL").drop("answer").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(2))))
    both = c.withColumn("judge", F.explode(F.array(F.lit("noisy"), F.lit("fixed"))))
    return both.select("trial", F.col("doc_id").alias("case_id"), "target", "judge", F.expr(f"CASE WHEN judge = 'fixed' THEN n_chars < 600 ELSE {TRIAL} END").alias("answer"))


@query(f"WITH {TRIALS_SQL}, s AS (SELECT judge, trial, {COUNTS_SQL} FROM trials GROUP BY ALL), r AS (SELECT judge, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM s) SELECT judge, round(min(f1), 6) AS lo, round(max(f1), 6) AS hi, round(max(f1) - min(f1), 6) AS width, round(list_sort(list(f1))[count(*) // 2 + 1], 6) AS median FROM r GROUP BY judge")
def nullrun_spread(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.confusion(trials(spark, sf), "judge", "trial").withColumn("f1", stats.f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return s.groupBy("judge").agg(F.round(F.min("f1"), 6).alias("lo"), F.round(F.max("f1"), 6).alias("hi"), F.round(F.max("f1") - F.min("f1"), 6).alias("width"), F.round(stats.upper_median(F.collect_list("f1")), 6).alias("median"))


@query(f"""WITH {TRIALS_SQL}, c AS (SELECT judge, case_id, CASE WHEN max(answer::INT) <> min(answer::INT) THEN 'contradiction' WHEN count(answer) BETWEEN 1 AND count(*) - 1 THEN 'abstention_flip' ELSE 'stable' END AS state FROM trials GROUP BY ALL)
SELECT judge, count_if(state = 'stable')::BIGINT AS stable, count_if(state = 'contradiction')::BIGINT AS contradiction, count_if(state = 'abstention_flip')::BIGINT AS abstention_flip FROM c GROUP BY judge""")
def nullrun_stability(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.stability(trials(spark, sf))
    n = lambda v: F.count_if(F.col("state") == v).alias(v)
    return s.groupBy("judge").agg(n("stable"), n("contradiction"), n("abstention_flip"))


@query(f"WITH {TRIALS_SQL}, s AS (SELECT trial, count_if(target = answer) AS ok FROM trials WHERE judge = 'fixed' GROUP BY trial) SELECT 'fixed' AS judge, count(*)::BIGINT AS n_trials, max(ok) - min(ok) = 0 AS controlled FROM s")
def harness_control(spark: SparkSession, sf: str) -> DataFrame:
    """A judge that can't vary must have width zero."""
    s = trials(spark, sf).where("judge = 'fixed'").groupBy("trial").agg(F.count_if(F.col("target") == F.col("answer")).alias("ok"))
    return s.agg(F.lit("fixed").alias("judge"), F.count("*").alias("n_trials"), (F.max("ok") - F.min("ok") == 0).alias("controlled"))


@query(f"""WITH {JUDGES_SQL}, fl AS (SELECT judge, {COUNTS_SQL} FROM j WHERE target IS NOT NULL AND judge LIKE 'always%' GROUP BY judge),
fr AS (SELECT *, {RATES_SQL} FROM fl), b AS (SELECT max(f1) AS best_f1, max_by(judge, f1) AS best_judge, max(accuracy_all) AS acc FROM fr),
s AS (SELECT *, {RATES_SQL} FROM (SELECT lang, {COUNTS_SQL} FROM cases WHERE target IS NOT NULL GROUP BY lang)),
g AS (SELECT lang, f1, best_judge, list_filter([CASE WHEN answered < n THEN 'unanswered' END, CASE WHEN round(f1 - best_f1, 9) <= 0.05 THEN 'within_noise_of_best_floor' END, CASE WHEN accuracy_all <= acc THEN 'no_better_than_constant' END, CASE WHEN f1 <= 0.2 THEN 'no_better_than_chance' END], lambda x: x IS NOT NULL) AS r FROM s, b)
SELECT lang, f1, best_judge, array_to_string(r, ',') AS reasons, len(r) = 0 AS admissible FROM g""")
def bench_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = cases(spark, sf)
    floors = ev.rates(ev.confusion(scoring.free_judges(c.drop("answer"), F.col("doc_id"), 0.3, "11").where("judge LIKE 'always%'"), "judge"))
    g = ev.gate(ev.rates(ev.confusion(c, "lang")), floors, 0.05, 0.2)
    return g.select("lang", "f1", "best_judge", F.array_join("reasons", ",").alias("reasons"), "admissible")


@query("""WITH p AS (SELECT DISTINCT user_id AS case_id FROM events), c AS (SELECT DISTINCT doc_id AS case_id FROM labels)
SELECT CASE WHEN c.case_id IS NULL THEN 'unknown' WHEN p.case_id IS NULL THEN 'missing' ELSE 'scored' END AS state, count(*)::BIGINT AS n FROM p FULL JOIN c USING (case_id) GROUP BY 1""")
def bench_decompose(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.decompose(table(spark, sf, "events").select(F.col("user_id").alias("case_id")), table(spark, sf, "labels").select(F.col("doc_id").alias("case_id")))
    return d.groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*)::BIGINT AS calls, round(sum(length(text) + 400) / 2.7)::BIGINT AS input_tokens, max(length(text))::BIGINT AS longest, (count(*) * 512)::BIGINT AS output_bound FROM documents GROUP BY lang")
def spend_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.spend(table(spark, sf, "documents").select("lang", F.col("text").alias("prompt")), "lang")


@query("SELECT count(*)::BIGINT AS prompts, (count(*) - count(DISTINCT md5(text)))::BIGINT AS duplicates FROM documents")
def duplicate_prompts(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "documents").groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("prompts"), F.sum(F.col("n") - 1).alias("duplicates"))


@query("SELECT role, count(*)::BIGINT AS n, round(avg(length(text)), 6) AS mean, list_sort(list(length(text)))[count(*) // 2 + 1]::BIGINT AS median, list_sort(list(length(text)))[floor(0.9 * count(*))::INT + 1]::BIGINT AS p90, max(length(text))::BIGINT AS longest FROM conversations GROUP BY role")
def output_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Order statistics by position; equal lengths are counted first, so no list of all values is built."""
    return scoring.distribution(table(spark, sf, "conversations").select("role", F.length("text").alias("v")), "role")


# ---------------------------------------------------------------- mined examples

FILES_SQL = f"""{TURNS_SQL},
files AS (
  SELECT 'r' || (conv_id % 5) AS repo, 'c' || conv_id AS sha, 'c' || (conv_id - 1) AS parent_sha, CASE WHEN conv_id % 11 = 0 THEN 2 ELSE 1 END AS n_parents,
    CASE WHEN conv_id % 7 = 3 THEN 'fix typo' ELSE 'turn ' || conv_id END AS subject,
    CASE WHEN role = 'user' OR conv_id % 3 = 0 THEN 'docs/guide' || (conv_id % 7) || '_' || turn || '.md' WHEN role = 'assistant' THEN 'src/mod' || (conv_id % 7) || '/part' || turn || '.py' ELSE 'misc/' || turn || '.txt' END AS path,
    CASE WHEN (conv_id + turn) % 17 = 0 THEN 'src/old/part' || turn || '.py' END AS old_path, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'A' ELSE 'M' END AS status, added, removed, all_lines
  FROM sides),
k AS (SELECT *, {sql_kind('path')} AS kind FROM files WHERE n_parents = 1 AND NOT {sql_any('lower(subject)', paths.COSMETIC)}),
rows AS (SELECT * FROM (SELECT *, count(*) OVER w AS n_files, count_if(kind = 'doc') OVER w AS n_docs, count_if(kind = 'code') OVER w AS n_code FROM k WINDOW w AS (PARTITION BY repo, sha)) WHERE n_files <= 20 AND n_docs > 0),
e AS (SELECT *, {sql_extract(sql_urls(f"array_to_string(added, {NL})"))} AS ta, {sql_extract(sql_urls(f"array_to_string(removed, {NL})"))} AS tr, {sql_extract(sql_urls(f"array_to_string(list_concat(added, removed), {NL})"))} AS tb FROM rows WHERE status = 'M'),
shape_b AS (SELECT repo, parent_sha, sha, path AS doc_path, NULL::VARCHAR AS code_path, len(all_lines)::BIGINT AS n_doc_lines, 'B' AS shape, list_slice({sql_longest("list_filter(tr, lambda x: NOT list_contains(ta, x))")}, 1, 12) AS shared
  FROM e WHERE kind = 'doc' AND n_code = 0 AND n_docs = n_files AND len(all_lines) >= 2 AND len(list_filter(tr, lambda x: NOT list_contains(ta, x) AND NOT starts_with(x, 'ver:'))) > 0),
pr AS (SELECT d.repo, d.sha, d.parent_sha, d.path AS doc_path, c.path AS code_path, len(d.all_lines)::BIGINT AS n_doc_lines, list_intersect(d.tb, c.tb) AS toks, list_filter(d.tr, lambda x: NOT list_contains(d.ta, x) AND list_contains(c.tr, x) AND NOT list_contains(c.ta, x)) AS withdrawn
  FROM e d JOIN e c ON d.repo = c.repo AND d.sha = c.sha AND d.kind = 'doc' AND c.kind = 'code' WHERE len(d.all_lines) >= 2),
shape_a AS (SELECT repo, parent_sha, sha, doc_path, code_path, n_doc_lines, 'A' AS shape, list_slice({sql_longest('toks')}, 1, 12) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha, doc_path ORDER BY code_path) AS nr FROM pr WHERE len(toks) > 0 AND len(withdrawn) > 0) WHERE nr <= 6),
pos AS (SELECT * FROM shape_b UNION ALL SELECT * FROM shape_a)
"""
ID_SQL = "substr(sha256(repo || chr(0) || {at} || chr(0) || doc_path || chr(0) || coalesce(code_path, '') || chr(0) || '{label}'), 1, 16)"


def history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(files, diffs): conversations as commits, turns as the files they changed."""
    t = turns(spark, sf)  # every third commit changes documents alone
    files = t.select(
        F.expr("concat('r', conv_id % 5)").alias("repo"), F.expr("concat('c', conv_id)").alias("sha"), F.expr("concat('c', conv_id - 1)").alias("parent_sha"),
        F.expr("if(conv_id % 11 = 0, 2, 1)").alias("n_parents"), F.col("conv_id").alias("committed_at"), F.expr("if(conv_id % 7 = 3, 'fix typo', concat('turn ', conv_id))").alias("subject"),
        F.expr("CASE WHEN role = 'user' OR conv_id % 3 = 0 THEN concat('docs/guide', conv_id % 7, '_', turn, '.md') WHEN role = 'assistant' THEN concat('src/mod', conv_id % 7, '/part', turn, '.py') ELSE concat('misc/', turn, '.txt') END").alias("path"),
        F.expr("CASE WHEN (conv_id + turn) % 17 = 0 THEN concat('src/old/part', turn, '.py') END").alias("old_path"), F.expr("if((conv_id + turn) % 13 = 0, 'A', 'M')").alias("status"), "diff")
    return files.drop("diff"), files.select("repo", "sha", "path", "diff")


def _shown(examples: DataFrame) -> DataFrame:
    return examples.select("example_id", "repo", "doc_path", "code_path", (F.col("doc_lines_added") + F.col("doc_lines_removed")).alias("n_doc_lines"), F.array_join("shared_identifiers", " ").alias("shared"))


@query(f"WITH {FILES_SQL} SELECT {ID_SQL.format(at='parent_sha', label='drift')} AS example_id, repo, doc_path, code_path, n_doc_lines, array_to_string(shared, ' ') AS shared FROM shape_b")
def mine_shape_b(spark: SparkSession, sf: str) -> DataFrame:
    files, diffs = history(spark, sf)
    return _shown(mining.shape_b(mining.eligible(files), diffs))


@query(f"WITH {FILES_SQL} SELECT {ID_SQL.format(at='parent_sha', label='drift')} AS example_id, repo, doc_path, code_path, n_doc_lines, array_to_string(shared, ' ') AS shared FROM shape_a")
def mine_shape_a(spark: SparkSession, sf: str) -> DataFrame:
    files, diffs = history(spark, sf)
    return _shown(mining.shape_a(mining.eligible(files), diffs))


@query(f"""WITH {FILES_SQL}, u AS (SELECT {ID_SQL.format(at='parent_sha', label='drift')} AS example_id, 'drift' AS label, shape FROM pos UNION ALL SELECT {ID_SQL.format(at='sha', label='clean')}, 'clean', 'negative' FROM pos),
d AS (SELECT example_id, max(label) AS label, min(shape) AS shape FROM u GROUP BY example_id) SELECT example_id, label, shape FROM d""")
def mine_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Positives of both shapes with their matched negatives, one row an id."""
    files, diffs = history(spark, sf)
    return mining.mine(files, diffs).select("example_id", "label", "shape")


@query(f"WITH {FILES_SQL}, n AS (SELECT repo, sha, path FROM files UNION SELECT repo, sha, old_path FROM files WHERE old_path IS NOT NULL), kk AS (SELECT *, {sql_kind('path')} AS kind FROM n) SELECT DISTINCT d.repo, d.path AS doc_path, c.path AS code_path FROM kk d JOIN kk c USING (repo, sha) WHERE d.kind = 'doc' AND c.kind = 'code'")
def mine_cochanged(spark: SparkSession, sf: str) -> DataFrame:
    return mining.cochanged(history(spark, sf)[0])


@query(f"""WITH {FILES_SQL}, tree AS (SELECT DISTINCT repo, path, {sql_kind('path')} AS kind FROM files), n AS (SELECT repo, sha, path FROM files UNION SELECT repo, sha, old_path FROM files WHERE old_path IS NOT NULL), kk AS (SELECT *, {sql_kind('path')} AS kind FROM n),
tg AS (SELECT DISTINCT d.repo, d.path AS doc_path, c.path AS code_path FROM kk d JOIN kk c USING (repo, sha) WHERE d.kind = 'doc' AND c.kind = 'code'),
sl AS (SELECT * FROM (SELECT repo, path, kind, row_number() OVER (PARTITION BY repo, kind ORDER BY md5('5:' || path), path) AS slot FROM tree WHERE kind = 'code' OR (kind = 'doc' AND NOT {sql_any('lower(path)', [*paths.TEST_DIRS, '.github/'])})) WHERE slot <= 1000),
sz AS (SELECT repo, count_if(kind = 'doc') AS nd, count_if(kind = 'code') AS nc FROM sl GROUP BY repo HAVING nd > 0 AND nc > 0),
tr AS (SELECT z.repo, t, d.path AS doc_path, c.path AS code_path FROM sz z, unnest(range(0, 1000)) AS u(t) JOIN sl d ON d.repo = z.repo AND d.kind = 'doc' AND d.slot = CAST('0x' || substr(md5('5:doc:' || t), 1, 8) AS BIGINT) % z.nd + 1 JOIN sl c ON c.repo = z.repo AND c.kind = 'code' AND c.slot = CAST('0x' || substr(md5('5:code:' || t), 1, 8) AS BIGINT) % z.nc + 1),
un AS (SELECT repo, doc_path, code_path, min(t) AS t FROM tr ANTI JOIN tg USING (repo, doc_path, code_path) WHERE NOT {sql_related('doc_path', 'code_path')} GROUP BY ALL),
re AS (SELECT d.repo, d.path AS doc_path, c.path AS code_path FROM sl d JOIN tree c USING (repo) WHERE d.kind = 'doc' AND c.kind = 'code' AND {sql_related('d.path', 'c.path')}),
ra AS (SELECT repo, doc_path, code_path, row_number() OVER (PARTITION BY repo, doc_path ORDER BY md5('5:' || doc_path || ':' || code_path), code_path) AS t FROM re ANTI JOIN tg USING (repo, doc_path, code_path)),
o AS (SELECT *, row_number() OVER (PARTITION BY repo, arm ORDER BY t, md5('5:' || doc_path), doc_path, code_path) AS nr FROM (SELECT repo, doc_path, code_path, t, 'related' AS arm FROM ra UNION ALL SELECT repo, doc_path, code_path, t, 'easy' FROM un))
SELECT repo, doc_path, code_path, arm FROM o WHERE nr <= 10""")
def mine_easy_negative(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty pairs a repository that never changed together, half of them path-related if there are."""
    files, _ = history(spark, sf)
    tree = files.select("repo", F.lit("head").alias("sha"), F.lit(0).alias("committed_at"), "path").distinct()
    e = mining.easy_negatives(tree, mining.cochanged(files), 20, "5")
    return e.select("repo", "doc_path", "code_path", F.when(F.col("label_basis") == mining.BASIS["related"], "related").otherwise("easy").alias("arm"))
