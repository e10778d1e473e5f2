"""python -m plumbline COMMAND: the batch entry points.  Exit 0: done or admissible, 1: not admissible, 2: refused."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation as ev
from .operators import contexts, dense, judging, mining, pairs, scoring, trials
from .plans import retrieval_eval
from .sources import digests, reports, sheets, stores
from .sources.git import GitSource


def _git(spark: SparkSession, repos: str, table: str, **options: str) -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("plumb_git").options(repos=repos, table=table, **options).load()


def _verdicts(spark: SparkSession, path: str) -> DataFrame:
    return sheets.first_verdicts(sheets.scoped(sheets.sheets(spark, path)))


def _cases(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return _verdicts(spark, a.sheets).join(sheets.labels(spark, a.labels).drop("verdict"), "example_id")


def _revs(a: argparse.Namespace) -> str:
    """Pins (name=sha; comma-separated, options add up) as the revisions of their repositories.

    One of no repository is refused, and so are two of one.
    """
    pairs = [p.split("=", 1) for some in a.pin for p in some.split(",") if p]
    pins = dict(pairs)
    if len(pins) < len(pairs):
        raise sheets.Refusal("more than one pin of a repository")
    if unknown := sorted(pins.keys() - {p.split("=", 1)[0] for p in a.repos.split(",")}):
        raise sheets.Refusal(f"pins of no repository: {unknown}")
    return ",".join(f"{k}={v}" for k, v in pins.items())


def mine(spark, a) -> int:
    limits = {k: v for k, v in (("limit", str(a.limit) if a.limit else ""), ("since", a.since), ("rev", a.rev), ("revs", _revs(a))) if v}
    commits = _git(spark, a.repos, "commits", **limits)
    files = commits.select("repo", "sha", F.get("parents", F.lit(0)).alias("parent_sha"), F.size("parents").alias("n_parents"), "committed_at", "subject", F.explode("files").alias("f"))
    files = files.select("repo", "sha", "parent_sha", "n_parents", "committed_at", "subject", "f.path", "f.old_path", "f.status")
    cfg = mining.MineConfig(max_files=a.max_files, min_doc_lines=a.min_doc_lines, min_shared=a.min_shared, literals_only=bool(a.literals_only), require_withdrawn=bool(a.require_withdrawn), require_symbol=bool(a.require_symbol))
    found = mining.mine(files, _git(spark, a.repos, "diffs", **limits), cfg)
    if a.easy:
        tree = _git(spark, a.repos, "tree", **{k: v for k, v in limits.items() if k in ("rev", "revs")})
        found = mining.dedupe(found.unionByName(mining.easy_negatives(tree, mining.cochanged(files), a.easy, a.seed)))
    trees = _git(spark, a.repos, "tree", **{k: v for k, v in limits.items() if k in ("rev", "revs")}).select("repo", "sha").distinct()
    revisions = {r["repo"]: r["sha"] for r in trees.collect()}  # a row a repository
    replay = ["mine", "--repos", a.repos, "--out", a.out, *[w for k, v in sorted(revisions.items()) for w in ("--pin", f"{k}={v}")]]
    manifest = sheets.write_labels(found, a.out, {k: v for k, v in vars(a).items() if k != "run"}, revisions, replay)
    print(manifest["counts"])
    return 0


def stats(spark, a) -> int:
    rows = sheets.labels(spark, a.labels)
    keys = ["repo", "label", "shape", "label_basis"]
    g = rows.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), *[F.grouping(k).alias(f"g_{k}") for k in keys])
    by = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, k) for k in keys])
    print(reports.table_text(g.select(by.alias("by"), F.coalesce(*keys).alias("value"), "n"), ["by", F.desc("n"), "value"]))
    return 0


def sample(spark, a) -> int:
    rows = sheets.labels(spark, a.labels).where((F.col("label") == "drift") & (F.col("shape") == a.shape))
    if a.sheets:
        rows = rows.join(_verdicts(spark, a.sheets), "example_id", "left_anti")
    ids = scoring.sample(rows.withColumn("all", F.lit("all")), "example_id", "all", a.n, a.seed)
    picked = rows.join(ids.select("example_id"), "example_id", "left_semi")
    diffs = spark.createDataFrame([], "example_id string, doc_diff string, code_diff string")
    if a.repos:
        held = _git(spark, a.repos, "diffs").select("repo", F.col("sha").alias("fix_sha"), "path", "diff")
        of = lambda path, name: picked.select("example_id", "repo", "fix_sha", F.col(path).alias("path")).join(held, ["repo", "fix_sha", "path"]).select("example_id", F.col("diff").alias(name))
        diffs = of("doc_path", "doc_diff").join(of("code_path", "code_diff"), "example_id", "left")
    _text(sheets.review_sheet(picked, diffs, a.seed), a.out)
    return 0


def _text(blocks: DataFrame, out: str) -> None:
    """Write (nr, block) as one text in order: a sheet for a person."""
    blocks.repartition(1).sortWithinPartitions(*[c for c in ("nr", "pos") if c in blocks.columns]).select("block").write.mode("errorifexists").text(out)


def score(spark, a) -> int:
    cases = _cases(spark, a).withColumn("hit", F.col("verdict") == "drift")
    for key in ("shape", "label_basis"):
        print(reports.table_text(scoring.precision_by(cases, key), [key]))
    return 0


def retention(spark, a) -> int:
    """What the new labels keep of the judged ones, with the positives that they lose."""
    verdicts, old, new = _verdicts(spark, a.sheets).select("example_id", "verdict"), sheets.labels(spark, a.old), sheets.labels(spark, a.labels)
    report = scoring.retention_report(old, new, verdicts, "example_id", "shape")
    print(reports.table_text(report.select("shape", "retained_n", "retained_hits", "positives_before", "precision", "lo", "hi", F.to_json("kept").alias("kept"), F.to_json("dropped").alias("dropped")), ["shape"]))
    print(scoring.not_in_old(old, verdicts, "example_id").count(), "verdicts of cases that the old labels lack")
    print(reports.table_text(scoring.lost_positives(old, new, verdicts, "example_id").select("example_id", "repo", "shape", "doc_path", "code_path", "fix_sha"), ["example_id"]))
    return 0


def _blobs(spark, repos: str, queries: DataFrame) -> DataFrame:
    """The trees that queries name; the list of trees is a row a commit and comes to the driver to ask git."""
    out = None
    named = dict(p.split("=", 1) for p in repos.split(","))
    for r in queries.select("tree").distinct().orderBy("tree").collect():
        repo, sha = r["tree"].split("@", 1)
        part = _git(spark, f"{repo}={named[repo]}", "blobs", rev=sha)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise sheets.Refusal("no queries")
    return out


def _named(path: str):
    """What ``module:name`` names; imported where it is called, so that workers load their own."""

    def build():
        from importlib import import_module

        module, _, name = path.partition(":")
        return getattr(import_module(module), name)()

    return build


def _models(spark, a) -> dict:
    """The arms that --encoder and --scorer (module:factory) ask for, with stores by model and windows."""
    out = {}
    if a.encoder:
        root = a.vector_store or stores.default_root(stores.shared_dir(spark), a.encoder, dense.SIZE, dense.OVERLAP)
        out["encoding"] = retrieval_eval.Encoding(dense.vector_store(spark, root, a.encoder), a.encoder, _named(a.encoder))
    if a.scorer:
        root = a.pair_store or stores.default_root(stores.shared_dir(spark), a.scorer, pairs.SIZE, pairs.OVERLAP)
        out["reranking"] = retrieval_eval.Reranking(pairs.pair_store(spark, root, a.scorer), a.scorer, _named(a.scorer), a.top_n)
    return out


def _report(spark, a, rows: DataFrame, by: tuple[str, ...] = ("repo", "arm")) -> None:
    """Print the rows; with --out also write them as one JSON text, how they came about first."""
    print(reports.table_text(rows, list(by)))
    if a.out:
        made = {"command": a.command, "config": {k: v for k, v in vars(a).items() if k != "out"}, "code": digests.code_revision()}
        sheets.results_json(rows, made).coalesce(1).write.mode("errorifexists").text(a.out)


def retrieve_eval(spark, a) -> int:
    queries = retrieval_eval.queries_of(sheets.labels(spark, a.labels))
    _report(spark, a, retrieval_eval.evaluate(queries, _blobs(spark, a.repos, queries), a.ks, a.tf_k1, a.trials, **_models(spark, a)).cache())
    return 0


def doc_sample(spark, a) -> int:
    from .functions import paths

    blobs = _git(spark, a.repos, "blobs", rev=a.rev)
    docs = blobs.where((paths.kind(F.col("path")) == "doc") & paths.documents_code(F.col("path")) & (F.length("text") >= 400))
    picked = scoring.sample(docs.withColumnRenamed("path", "doc_path"), "doc_path", "repo", a.n, a.seed)
    pool = blobs.where(paths.kind(F.col("path")) == "code").select("repo", "sha", "path")
    if a.bundle:
        read = blobs.where(paths.kind(F.col("path")) == "code").unionByName(docs.join(picked.select("repo", F.col("doc_path").alias("path")), ["repo", "path"], "left_semi"))
        reports.bundle(picked, read.select("repo", "path", "text"), a.bundle)
    _text(reports.checklist(picked, pool, a.bundle or None), a.out)
    return 0


def doc_eval(spark, a) -> int:
    """Sheets against the trees that they name; a document is asked only of its own repository."""
    ticked = sheets.checklist(sheets.sheets(spark, a.sheets)).where("answered AND NOT none")
    blobs = _git(spark, a.repos, "blobs", rev=a.rev)
    trees = blobs.select("repo", "sha").distinct()
    empty = F.array().cast("array<string>")
    named = ticked.join(trees, "repo").where(F.expr("startswith(sha, sha_prefix)"))
    lost = ticked.count() - named.count()
    if lost:
        raise sheets.Refusal(f"{lost} cases name a tree that was not read")
    queries = named.select(F.concat_ws(":", "repo", "doc_path").alias("query_id"), "repo", F.concat_ws("@", "repo", "sha").alias("tree"), "doc_path", F.array_union("marked", "extra").alias("relevant"), empty.alias("evidence"))
    rows = retrieval_eval.evaluate(queries, blobs, a.ks, a.tf_k1, a.trials, **_models(spark, a)).where("NOT endswith(arm, '-ablated')")
    _report(spark, a, rows.cache())
    return 0


def judge_cases(spark, a) -> int:
    seen = sheets.scoped(sheets.sheets(spark, a.sheets)).withColumn("target", sheets.target())
    print(reports.table_text(judging.case_tally(seen, sheets.labels(spark, a.labels)), ["cases"]))
    return 0


def judge_freeze(spark, a) -> int:
    sheets.freeze(_cases(spark, a), a.out)
    return 0


def _judged(spark, a) -> DataFrame:
    cases = _cases(spark, a).where("target IS NOT NULL").select("example_id", "repo", "shape", "target")
    return scoring.free_judges(cases, F.col("example_id"), a.rate, a.seed)


def _shown(spark, a, cases: DataFrame) -> DataFrame:
    """What judges see of the cases in the arm asked for, read from the trees that the cases name."""
    trees = cases.select(F.concat_ws("@", "repo", "at_sha").alias("tree"))
    return contexts.build(cases, _blobs(spark, a.repos, trees), a.arm, a.k, a.doc_budget, a.code_budget)


def _chosen(spark, a) -> DataFrame:
    """Scoreable cases, those that --only names (ids or @file), the first --limit of them; with a code path where the arm needs one."""
    cases = _cases(spark, a).where("target IS NOT NULL")
    if a.repos and a.arm != "retrieved":
        cases = cases.where("code_path IS NOT NULL")
    only = sheets.id_list(spark, a.only.split(",")) if a.only else None
    return sheets.select_cases(cases, only, a.limit or None)


def judge_eval(spark, a) -> int:
    """The judges that --judges names: free ones; with --repos also absence and, from stored --replies, paid ones over the same cases."""
    free, paid = judging.roster((a.judges or "floors").split(","), a.model)
    if paid and not (a.repos and a.replies):
        raise sheets.Refusal(f"{', '.join(paid.values())} need --repos and --replies")
    cases = _chosen(spark, a)
    judged = scoring.free_judges(cases.select("example_id", "target"), F.col("example_id"), a.rate, a.seed).where(F.col("judge").isin(free))
    if a.repos:
        shown = _shown(spark, a, cases).cache()
        if unusable := shown.where(~F.col("usable")).count():
            print(f"{unusable} cases without a document or code to show are left out")
        usable = shown.where("usable")
        judged = judged.join(usable.select("example_id"), "example_id", "left_semi")
        more = [contexts.absence_judges(usable, a.lexical_thresholds).select("example_id", "judge", "answer")] if "lexical-absence" in free else []
        if paid:
            replies = spark.read.schema("key string, reply string, truncated boolean").json(a.replies)
            model = next(iter(paid.values())).partition(":")[2]
            answers = judging.paid_answers(usable, replies, paid, model, a.claim_batch).withColumnRenamed("case_id", "example_id").cache()
            for name in paid.values():
                print(f"{name}: {answers.where(F.col('judge') == name).count()} of {usable.count()} cases answered")
            more.append(answers)
        for rows in more:
            judged = judged.unionByName(rows.join(cases.select("example_id", "target"), "example_id"))
    _report(spark, a, ev.rates(ev.confusion(judged, "judge")), ("judge",))
    return 0


def judge_prompts(spark, a) -> int:
    """Write (case_id, key, prompt, and of claims first and n) of an arm for the paid judges; refused before anything is written if the estimate exceeds --max-tokens."""
    free, paid = judging.roster((a.judges or "model").split(","), a.model)
    if free:
        raise sheets.Refusal(f"{', '.join(free)} need no prompt")
    shown, model = _shown(spark, a, _chosen(spark, a)).where("usable"), next(iter(paid.values())).partition(":")[2]
    made = {"model": lambda: judging.page_requests(shown, model), "per-claim": lambda: judging.claim_requests(shown, model, a.claim_batch)}
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [made[k]().withColumn("judge", F.lit(name)) for k, name in paid.items()]).cache()
    print(judging.check_spend(rows, a.max_tokens), "tokens, estimated")
    rows.write.mode("errorifexists").json(a.out)
    return 0


def judge_null_run(spark, a) -> int:
    """Free judges over --trials passes; with --store answers are kept, and a run that was interrupted goes on."""
    cases = _cases(spark, a).where("target IS NOT NULL").withColumn("case_id", F.col("example_id"))
    judged = scoring.free_judges(cases.select("example_id", "target"), F.col("example_id"), a.rate, a.seed).cache()
    store = trials.trial_store(spark, a.store or stores.shared_dir(spark), f"{a.labels}|{a.sheets}|{a.rate}|{a.seed}")
    for name in [r[0] for r in judged.select("judge").distinct().orderBy("judge").collect()]:  # a row a judge
        mine = judged.where(F.col("judge") == name).select(F.col("example_id").alias("case_id"), "answer")
        found, asked = trials.run_trials(store, cases.select("case_id"), name, a.trials, lambda missing, mine=mine: missing.join(mine, "case_id"))
        print(f"{name}: {found} answers found, {asked} asked for")
    lined = trials.align(store.read(), cases.select("case_id", "verdict", "target"), a.trials).cache()
    print(reports.table_text(trials.stability(lined), ["judge"]))
    if a.out:
        trials.write_matrix(lined, a.out)
    return 0


def bench(spark, a) -> int:
    """The scoreable cases with a code path, against floors that were recorded on the same corpus."""
    every = _cases(spark, a)
    cases = every.where("target IS NOT NULL AND code_path IS NOT NULL").select("example_id", "repo", "shape", "target")
    size = every.agg(F.count("*").alias("verdicts"), F.count("target").alias("scoreable"), F.count_if(F.col("target").isNotNull() & F.col("code_path").isNotNull()).alias("with_code_path")).first().asDict()
    recorded = sheets.bars(spark, a.floors, a.width, size, a.arm)
    said = sheets.predictions(spark, a.predictions)
    states = {r["state"]: r["count"] for r in ev.decompose(said.withColumnRenamed("example_id", "case_id"), cases.withColumnRenamed("example_id", "case_id")).groupBy("state").count().collect()}
    judged = cases.join(said, "example_id", "left").withColumn("judge", F.lit("submission"))
    floors = spark.createDataFrame([(recorded["best_free_name"], recorded["best_free_f1"], None), (sheets.CONSTANT, None, recorded["constant_accuracy"])], "judge string, f1 double, accuracy_all double")
    verdict = ev.gate(ev.rates(ev.confusion(judged, "judge")), floors, recorded["width_f1"], recorded["chance_f1_p95"]).first()
    print(states, verdict["reasons"])
    return 0 if verdict["admissible"] and not states.get("unknown") else 1


COMMANDS = {
    "mine": (mine, ["repos", "out"]), "stats": (stats, ["labels"]), "sample": (sample, ["labels", "out"]), "score": (score, ["labels", "sheets"]),
    "retention": (retention, ["old", "labels", "sheets"]), "retrieve-eval": (retrieve_eval, ["labels", "repos"]), "doc-sample": (doc_sample, ["repos", "out"]),
    "doc-eval": (doc_eval, ["sheets", "repos"]), "judge-cases": (judge_cases, ["labels", "sheets"]), "judge-freeze": (judge_freeze, ["labels", "sheets", "out"]),
    "judge-eval": (judge_eval, ["labels", "sheets"]), "judge-prompts": (judge_prompts, ["labels", "sheets", "repos", "out"]), "judge-null-run": (judge_null_run, ["labels", "sheets"]), "bench": (bench, ["labels", "sheets", "floors", "width", "predictions"]),
}
OPTIONAL = {"limit": 0, "easy": 0, "max-files": 20, "n": 20, "trials": 3, "rate": 0.3, "seed": "0", "shape": "A", "rev": "HEAD", "sheets": "", "repos": "", "since": "", "pin": [], "min-doc-lines": 2, "min-shared": 1, "literals-only": 0, "require-withdrawn": 1, "require-symbol": 1, "ks": (1, 5, 10), "tf-k1": 1.2,
            "arm": "seeded", "k": 5, "doc-budget": contexts.DOC_BUDGET, "code-budget": contexts.CODE_BUDGET, "lexical-thresholds": (1, 3, 6), "only": "", "model": "model", "max-tokens": 1_000_000, "bundle": "", "store": "", "out": "",
            "judges": "", "replies": "", "claim-batch": judging.CLAIM_BATCH, "encoder": "", "scorer": "", "vector-store": "", "pair-store": "", "top-n": pairs.TOP_N}


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("plumbline")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, needed) in COMMANDS.items():
        p = sub.add_parser(name)
        for option in needed:
            p.add_argument(f"--{option}", required=True)
        for option, default in OPTIONAL.items():
            if option not in needed:
                many = {"action": "append"} if isinstance(default, list) else {"type": _numbers if isinstance(default, tuple) else type(default)}
                p.add_argument(f"--{option}", default=list(default) if isinstance(default, list) else default, **many)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return COMMANDS[a.command][0](spark, a)
    except sheets.Refusal as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
