"""Reading labels, review sheets, checklists and predictions; writing labels, sheets and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXAMPLE = "example_id string, repo string, label string, label_basis string, shape string, doc_path string, code_path string, at_sha string, fix_sha string, parent_sha string, committed_at long, subject string, doc_lines_added long, doc_lines_removed long, files_in_commit long, shared_identifiers array<string>"
#: The patterns by which review sheets and checklists are read, as reviewers fill them in.
POSITIONAL_CASE, POSITIONAL_VERDICT = r"(?m)^##\s+Case\s+\d+\s+—\s+`([0-9a-f]+)`", r"(?m)^\*\*VERDICT:\s*`?\*?\*?([A-Za-z?]+)\*?\*?`?\*\*"
CASE, VERDICT = r"(?m)^## Case \d+ — `([^`]+)`", r"(?m)^\*\*VERDICT: `([a-z]+)`\*\*"
CHECK_CASE = r"(?m)^## Case \d+ — `([^`]+)` · `([^`]+)`"
TICK, NONE, EXTRA, TREE = r"(?m)^- \[[xX]\][ \t]+(\S+)[ \t]*$", r"(?m)^\*\*NONE:\*\*[ \t]*\[([ xX])\]", r"(?m)^\*\*EXTRA:\*\*[ \t]*(.*)$", r"(?m)^- \*\*tree\*\* `([0-9a-f]+)`"
#: The verdicts and their targets: only drift says that the page was false; unclear is held out (null).
TARGETS = {"drift": True, "new": False, "cosmetic": False, "unrelated": False, "unclear": None}
#: What each verdict means, as the sheets written here explain it.
LEGEND = {
    "drift": "before this commit the page claimed what the code did not do",
    "new": "the page speaks of something that came into being with this commit",
    "cosmetic": "words, layout or links changed; what the page claims did not",
    "unrelated": "page and code changed for different reasons",
    "unclear": "the diffs shown do not decide it",
}


class Refusal(ValueError):
    """An input that must not be scored."""


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files (one JSON object a line) under a fixed schema, with the file each row came from."""
    rows = spark.read.schema(EXAMPLE).option("mode", "FAILFAST").json(path)
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def sheets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("sheet"), F.col("value").alias("content"))


def positional(sheets: DataFrame) -> DataFrame:
    """(sheet, pos, example_id, verdict): the n-th verdict goes with the n-th case; counts must agree and not be 0."""
    ids, said = (F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in (POSITIONAL_CASE, POSITIONAL_VERDICT))
    found = sheets.select("sheet", ids.alias("ids"), F.transform(said, F.lower).alias("said"))
    fits = (F.size("ids") == F.size("said")) & (F.size("ids") > 0)
    checked = F.when(fits, F.arrays_zip("ids", "said")).otherwise(F.raise_error(F.format_string("%s: %d headings and %d verdicts", F.col("sheet"), F.size("ids"), F.size("said"))))
    return found.select("sheet", F.posexplode(checked)).select("sheet", "pos", F.col("col.ids").alias("example_id"), F.col("col.said").alias("verdict"))


def _blocks(sheets: DataFrame, case: str) -> DataFrame:
    """(sheet, pos, b): the text of each case, from its heading to the next; a sheet without one is refused."""
    cut = F.filter(F.split("content", "(?m)(?=" + case.replace("(?m)", "") + ")"), lambda b: b.rlike("\\A" + case.replace("(?m)^", "")))
    some = F.when(F.size(cut) > 0, cut).otherwise(F.raise_error(F.format_string("%s: no case headings", F.col("sheet"))))
    return sheets.select("sheet", F.posexplode(some).alias("pos", "b"))


def scoped(sheets: DataFrame) -> DataFrame:
    """(sheet, pos, example_id, verdict): a verdict belongs to the heading above it; unknown words and open cases are left out."""
    rows = _blocks(sheets, CASE).select("sheet", "pos", F.regexp_extract("b", CASE, 1).alias("example_id"), F.regexp_extract("b", VERDICT, 1).alias("verdict"))
    return rows.where(F.col("verdict").isin(*TARGETS))


def first_verdicts(scoped_rows: DataFrame) -> DataFrame:
    """One verdict an id, that of the first sheet (of its last case, if it has several); ``n_seen`` tells repeats."""
    w = Window.partitionBy("example_id")
    rows = scoped_rows.withColumns({"nr": F.row_number().over(w.orderBy("sheet", F.desc("pos"))), "n_seen": F.count("*").over(w)})
    return rows.where("nr = 1").select("example_id", "verdict", "n_seen", target().alias("target"))


def target(verdict: str = "verdict") -> Column:
    c = F.col(verdict)
    return F.when(c.isin(*[k for k, v in TARGETS.items() if v]), True).when(c.isin(*[k for k, v in TARGETS.items() if v is False]), False)


def checklist(sheets: DataFrame) -> DataFrame:
    """(sheet, repo, doc_path, sha_prefix, marked, extra, none, answered) of each document: ticked files, files
    added by hand, and whether it was said that there are none; a document without any of these was skipped."""
    last = lambda p: F.coalesce(F.try_element_at(F.regexp_extract_all("b", F.lit(p), F.lit(1)), F.lit(-1)), F.lit(""))
    extra = F.filter(F.transform(F.split(last(EXTRA), r"\s+"), lambda x: F.btrim(x, F.lit(" `,"))), lambda x: x != "")
    rows = _blocks(sheets, CHECK_CASE).select(
        "sheet", F.regexp_extract("b", CHECK_CASE, 1).alias("repo"), F.regexp_extract("b", CHECK_CASE, 2).alias("doc_path"), last(TREE).alias("sha_prefix"),
        F.regexp_extract_all("b", F.lit(TICK), F.lit(1)).alias("marked"), extra.alias("extra"), last(NONE).isin("x", "X").alias("none"))
    return rows.withColumn("answered", (F.size("marked") > 0) | (F.size("extra") > 0) | F.col("none"))


#: Answers in words; "false" says that the document is false, so it flags.
ANSWERS = {"false": True, "stale": True, "true": True, "not-false": False, "not_false": False, "fresh": False, "false_positive": False, "abstain": None, "unknown": None, "": None}


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(example_id, answer) of a submission, true where it says that the document is false; anything that can't be read exactly is refused.

    Answers are booleans, words of ``ANSWERS``, null or missing (both abstain).  Blank lines and lines that begin
    with # are passed over.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    got = lines.select(F.try_parse_json("value").alias("v"))
    of = lambda what, kind: F.try_variant_get("v", f"$.{what}", kind)
    said = F.coalesce(F.schema_of_variant(of("answer", "variant")), F.lit("VOID"))
    rows = got.select(
        F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("json"), F.nullif(of("example_id", "string"), F.lit("")).alias("example_id"),
        said.alias("kind"), F.lower(F.trim(of("answer", "string"))).alias("said"), F.when(said == "BOOLEAN", of("answer", "boolean")).alias("flag"))
    word = (F.col("kind") == "STRING") & F.col("said").isin(*ANSWERS)
    checks = rows.agg(
        F.count("*").alias("n"), F.count_if(~F.col("json")).alias("no JSON object"), F.count_if(F.col("example_id").isNull()).alias("no id"),
        F.count_if(~(F.col("kind").isin("BOOLEAN", "VOID") | word)).alias("unreadable answer"),
    ).first().asDict()
    if not checks.pop("n"):
        raise Refusal(f"{path}: no predictions")
    if bad := {k: v for k, v in checks.items() if v}:
        raise Refusal(f"{path}: {bad}")
    if rows.groupBy("example_id").count().where("count > 1").limit(1).count():
        raise Refusal(f"{path}: an id occurs twice")
    yes, no = ([k for k, v in ANSWERS.items() if v is x] for x in (True, False))
    in_words = F.when(F.col("said").isin(*yes), True).when(F.col("said").isin(*no), False)
    return rows.select("example_id", F.when(F.col("kind") == "BOOLEAN", F.col("flag")).when(F.col("kind") == "STRING", in_words).alias("answer"))


#: Fields by which two measurements are of one corpus.
SAME = ("verdicts", "scoreable", "with_code_path")
FREE = ("always-", "lexical-absence")
CONSTANT = "always-not-false"
_CORPUS = "provenance struct<corpus: struct<verdicts: long, scoreable: long, with_code_path: long>>"
_FLOORS = f"{_CORPUS}, arms map<string, struct<judges: map<string, struct<f1: double, accuracy_all: double>>>>"
_WIDTH = f"{_CORPUS}, judges map<string, struct<minimum_detectable_effect_f1: double, chance_range: map<string, array<double>>>>"


def _report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A nested JSON report as one row of the fields named; what is no report has no corpus and is refused."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r")).select("r.*")
    if row.where("provenance.corpus IS NULL").limit(1).count() or not row.limit(1).count():
        raise Refusal(f"UNUSABLE_MEASUREMENT: {path} names no corpus")
    return row


def bars(spark: SparkSession, floors: str, width: str, corpus: dict[str, int], arm: str = "seeded") -> dict:
    """What a submission must beat, merged field by field from a report of floors and one of a null run.

    Keys: best_free_name, best_free_f1, constant_accuracy, chance_f1_p95, width_f1.  Refused by name: CORPUS_MISMATCH if
    either was measured on a corpus other than ``corpus``, UNUSABLE_MEASUREMENT if a field is not there.
    """
    held = {"floors": _report(spark, floors, _FLOORS), "width": _report(spark, width, _WIDTH)}
    for name, row in held.items():
        was = row.select("provenance.corpus.*").first().asDict()
        if differ := {k: (was[k], corpus[k]) for k in SAME if k in corpus and was[k] != corpus[k]}:
            raise Refusal(f"CORPUS_MISMATCH: the recorded {name} are of another corpus: " + ", ".join(f"{k} was {a} and is now {b}" for k, (a, b) in differ.items()))
    judges = held["floors"].select(F.explode(F.col("arms")[arm]["judges"]).alias("judge", "s")).select("judge", "s.f1", "s.accuracy_all").collect()  # a row a judge
    best = min((r for r in judges if r["judge"].startswith(FREE) and r["f1"] is not None), key=lambda r: (-r["f1"], r["judge"]), default=None)
    constant = next((r for r in judges if r["judge"] == CONSTANT), None)
    first = F.col("judges")[F.get(F.map_keys("judges"), F.lit(0))]
    measured = held["width"].select(F.coalesce(F.size("judges"), F.lit(0)).alias("n"), first["minimum_detectable_effect_f1"].alias("mde"), F.get(first["chance_range"]["f1"], F.lit(2)).alias("p95")).first()
    for bad, why in (
        (not judges, f"{floors} has no arm {arm!r}"), (best is None, f"{floors} records no free floors"), (constant is None or constant["accuracy_all"] is None, f"{floors} does not include {CONSTANT!r}"),
        (measured["n"] <= 0, f"{width} records no judges"), (measured["mde"] is None, f"{width} has no minimum_detectable_effect_f1"), (measured["p95"] is None, f"{width} has no chance range of f1"),
    ):
        if bad:
            raise Refusal(f"UNUSABLE_MEASUREMENT: {why}")
    return {"best_free_name": best["judge"], "best_free_f1": best["f1"], "constant_accuracy": constant["accuracy_all"], "chance_f1_p95": measured["p95"], "width_f1": measured["mde"]}


def id_list(spark: SparkSession, values: list[str]) -> DataFrame:
    """Ids given directly or, as @file, one a line with # comments."""
    given = spark.createDataFrame([(v,) for v in values if not v.startswith("@")], "id string")
    for v in values:
        if v.startswith("@"):
            given = given.union(spark.read.text(v[1:]).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("id")))
    return given.where("id <> ''").distinct()


def select_cases(cases: DataFrame, only: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Cases by id (unknown ids are refused) and, in order of their ids, the first ``limit``."""
    if only is not None:
        unknown = [r["id"] for r in only.join(cases, only["id"] == cases["example_id"], "left_anti").limit(5).collect()]
        if unknown:
            raise Refusal(f"unknown ids: {unknown}")
        cases = cases.join(only, cases["example_id"] == only["id"], "left_semi")
    return cases.orderBy("example_id").limit(limit) if limit else cases


def write_labels(rows: DataFrame, path: str, config: dict, repos: dict[str, str] | None = None, replay: list[str] | None = None) -> dict:
    """Write JSON lines (an existing output is refused) and a manifest beside it; the manifest comes back."""
    from . import digests

    spark = rows.sparkSession
    rows.write.mode("errorifexists").json(path)
    counts = {"/".join(map(str, (r["repo"], r["label"], r["shape"]))): r["count"] for r in spark.read.schema(rows.schema).json(path).groupBy("repo", "label", "shape").count().collect()}
    manifest = digests.manifest_of(spark, path, counts, config, repos or {}, replay or [])
    digests.write_manifest(spark, manifest, path + ".manifest")
    return manifest


def freeze(cases: DataFrame, path: str) -> None:
    """Joined cases with the file they come from; freezing the frozen keeps the first origin."""
    origin = F.coalesce("frozen_from", "file") if "frozen_from" in cases.columns else F.col("file")
    cases.withColumn("frozen_from", origin).repartitionByRange("example_id").sortWithinPartitions("example_id").write.mode("errorifexists").json(path)


def review_sheet(examples: DataFrame, diffs: DataFrame, seed: str = "0", limit: int = 4_000) -> DataFrame:
    """(nr, block): the legend, then a block an example in the order of a seeded hash, as the readers above take them.

    ``diffs(example_id, doc_diff, code_diff)``; each is shown up to ``limit`` characters.
    """
    from ..functions.texts import truncate

    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "example_id")), "example_id")  # a sheet is what one person reads
    quoted = F.array_join(F.transform("shared_identifiers", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ")
    caption = F.when(F.col("shape") == "B", "no longer asserted after this commit").otherwise("shared identifiers")
    fold = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"<details><summary>{name}</summary>\n\n```diff\n"), truncate(F.col(c), limit), F.lit("\n```\n\n</details>\n")))
    line = lambda name, c, back="`": F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"- **{name}** {back}"), c, F.lit(back)))
    j = examples.join(diffs, "example_id", "left").withColumn("nr", F.row_number().over(order))
    block = F.concat_ws("\n", F.format_string("## Case %d — `%s`\n", "nr", "example_id"), line("repo", "repo"), line("basis", "label_basis"), line("subject", "subject", ""), line("commit", "fix_sha"), line("doc", "doc_path"), line("code", "code_path"), F.when(F.size("shared_identifiers") > 0, F.concat(F.lit("- **"), caption, F.lit("** "), quoted)), F.lit("\n**VERDICT: ?**\n"), fold("doc diff", "doc_diff"), fold("code diff", "code_diff"), F.lit("---\n"))
    head = "For each case, replace the question mark of its verdict with one of these in backticks:\n\n" + "".join(f"- `{k}` — {why}\n" for k, why in LEGEND.items()) + "\n---\n"
    first = examples.sparkSession.createDataFrame([(0, head)], "nr int, block string")
    return first.unionByName(j.select("nr", block.alias("block")))


def results_json(results: DataFrame, provenance: dict) -> DataFrame:
    """One JSON text: provenance first, then the result rows (bounded: a row an arm and cell)."""
    parts = [F.lit(json.dumps(provenance, sort_keys=True)).alias("provenance"), F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(results.columns))))).alias("results")]
    return results.agg(F.concat(F.lit('{"provenance": '), parts[0], F.lit(', "results": '), parts[1], F.lit("}")).alias("value"))


def merge_provenance(old: dict, new: dict) -> dict:
    """Both, with differing values of the old kept under <key>_conflict."""
    return {**old, **new, **{f"{k}_conflict": old[k] for k in old if k in new and old[k] != new[k]}}
