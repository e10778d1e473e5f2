"""Weak labels from a history of changes: positives of two shapes and three kinds of negatives.

Inputs: ``files(repo, sha, parent_sha, n_parents, committed_at, subject, path, old_path, status)``, one
row per file a commit changed, and ``diffs(repo, sha, path, diff)``.  Cheap guards run before diffs are
joined; docs meet code through their tokens, by an equi join, never by a product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, texts, tokens


@dataclass(frozen=True)
class MineConfig:
    max_files: int = 20
    min_doc_lines: int = 2
    min_shared: int = 1
    require_withdrawn: bool = True
    require_symbol: bool = True
    claim_from_both: bool = True
    max_code_per_doc: int = 6
    keep_tokens: int = 12
    literals_only: bool = False


BASIS = {
    "B": "doc_only_commit_modified_existing_prose",
    "A": "doc_and_code_both_modified_sharing_identifier",
    "negative": "state_immediately_after_human_fix",
    "easy": "pair_never_cochanged_in_mined_history",
    "related": "pair_never_cochanged_but_path_related",
}
#: Draws that an arm of easy negatives may take for each pair it wants, and at least.
DRAWS, LEAST_DRAWS = 50, 1000


def eligible(files: DataFrame, cfg: MineConfig = MineConfig()) -> DataFrame:
    """Files of commits with one parent, few files and no cosmetic subject, with their kind and the commit's counts."""
    rows = files.where((F.col("n_parents") == 1) & ~paths.is_cosmetic(F.col("subject"))).withColumn("kind", paths.kind(F.col("path")))
    w = Window.partitionBy("repo", "sha")
    rows = rows.withColumns({"n_files": F.count("*").over(w), "n_docs": F.count_if(F.col("kind") == "doc").over(w), "n_code": F.count_if(F.col("kind") == "code").over(w)})
    return rows.where((F.col("n_files") <= cfg.max_files) & (F.col("n_docs") > 0))


def _example(rows: DataFrame, label: str, shape: str, basis: str, at: Column, code: Column, shared: Column) -> DataFrame:
    """The sixteen fields of an example; ``rows`` has the commit's and the document's own."""
    key = texts.stable_id(F.col("repo"), at, F.col("doc_path"), code, F.lit(label))
    return rows.select(
        key.alias("example_id"), "repo", F.lit(label).alias("label"), F.lit(basis).alias("label_basis"), F.lit(shape).alias("shape"), "doc_path", code.alias("code_path"), at.alias("at_sha"),
        "fix_sha", "parent_sha", F.col("committed_at").cast("long").alias("committed_at"), "subject", F.col("doc_lines_added").cast("long").alias("doc_lines_added"),
        F.col("doc_lines_removed").cast("long").alias("doc_lines_removed"), F.col("files_in_commit").cast("long").alias("files_in_commit"), shared.alias("shared_identifiers"))


COMMIT = ("repo", "fix_sha", "parent_sha", "committed_at", "subject", "files_in_commit")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns computed once a row: as what a generator gives, no filter on them is moved below, to compute them again."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _doc_sides(rows: DataFrame, diffs: DataFrame) -> DataFrame:
    docs = rows.where("kind = 'doc' AND status = 'M'").select("repo", F.col("sha").alias("fix_sha"), "parent_sha", "committed_at", "subject", F.col("n_files").alias("files_in_commit"), F.col("path").alias("doc_path"))
    docs = docs.join(diffs.select("repo", F.col("sha").alias("fix_sha"), F.col("path").alias("doc_path"), "diff"), ["repo", "fix_sha", "doc_path"])
    sides = {"added": "+", "removed": "-"}
    docs = once(docs, **{f"{name}_lines": tokens.changed(F.col("diff"), mark) for name, mark in sides.items()})
    docs = once(docs, **{f"doc_lines_{name}": F.size(f"{name}_lines") for name in sides}, **{name: F.array_join(f"{name}_lines", "\n") for name in sides})
    return docs.drop(*[f"{name}_lines" for name in sides])



def _tokens_of_sides(added: Column, removed: Column) -> Column:
    """[tokens added, tokens removed], by one expression over both; tokens never reach across lines, so all are their union."""
    return F.transform(F.array(added, removed), lambda t: tokens.extract(tokens.strip_urls(t)))


def _long_enough(cfg: MineConfig) -> Column:
    return F.col("doc_lines_added") + F.col("doc_lines_removed") >= cfg.min_doc_lines


def shape_b(rows: DataFrame, diffs: DataFrame, cfg: MineConfig = MineConfig()) -> DataFrame:
    """Commits of documents alone that withdraw tokens from existing prose."""
    docs = _doc_sides(rows.where("n_code = 0 AND n_docs = n_files"), diffs)
    docs = docs.where(_long_enough(cfg) & ~F.concat_ws("\n", "added", "removed").rlike(r"tutorial\d+|docs_src"))
    if cfg.literals_only:
        gone = tokens.delta(F.col("added"), F.col("removed"), literals_only=True)["removed_only"]
    else:
        docs, gone = once(docs, sides=_tokens_of_sides(F.col("added"), F.col("removed"))), tokens.longest_first(F.array_except(F.col("sides")[1], F.col("sides")[0]))
    docs = once(docs, gone=gone)
    if cfg.require_withdrawn:
        docs = docs.where(F.size("gone") > 0)
    if cfg.require_symbol:
        docs = docs.where(F.exists("gone", lambda t: ~t.startswith("ver:")))
    return _example(docs, "drift", "B", BASIS["B"], F.col("parent_sha"), F.lit(None).cast("string"), F.slice("gone", 1, cfg.keep_tokens))


def shape_a(rows: DataFrame, diffs: DataFrame, cfg: MineConfig = MineConfig()) -> DataFrame:
    """Modified documents with modified code of the same commit that share tokens, withdrawn on both sides."""
    docs = _doc_sides(rows.where("n_code > 0"), diffs).where(_long_enough(cfg))
    both = lambda t: once(t, all=F.array_union(F.col("sides")[0], F.col("sides")[1]), gone=F.array_except(F.col("sides")[1], F.col("sides")[0])).drop("sides")
    docs = both(once(docs, sides=_tokens_of_sides(F.col("added"), F.col("removed"))).drop("added", "removed", "diff"))
    code = rows.where("kind = 'code' AND status = 'M'").select("repo", "sha", F.col("path").alias("code_path")).join(diffs.withColumnRenamed("path", "code_path"), ["repo", "sha", "code_path"])
    bare = lambda marks: tokens.strip_comment_lines(tokens.changed_text(F.col("diff"), marks))
    code = once(code.select("repo", F.col("sha").alias("fix_sha"), "code_path", "diff"), sides=_tokens_of_sides(bare("+"), bare("-")))
    code = both(code.drop("diff"))
    flat = lambda t, path: t.select("repo", "fix_sha", path, F.explode("all").alias("tok"), "gone").withColumn("gone", F.array_contains("gone", F.col("tok")))
    pairs = flat(docs, "doc_path").withColumnRenamed("gone", "dg").join(flat(code, "code_path").withColumnRenamed("gone", "cg"), ["repo", "fix_sha", "tok"])
    pairs = pairs.groupBy("repo", "fix_sha", "doc_path", "code_path").agg(F.collect_set("tok").alias("toks"), F.count_if(F.col("dg") & F.col("cg")).alias("both"))
    pairs = pairs.where(F.size("toks") >= cfg.min_shared)
    if cfg.claim_from_both:
        pairs = pairs.where("both > 0")
    w = Window.partitionBy("repo", "fix_sha", "doc_path").orderBy("code_path")
    pairs = pairs.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= cfg.max_code_per_doc)
    pairs = pairs.join(docs.drop("all", "gone"), ["repo", "fix_sha", "doc_path"])
    return _example(pairs, "drift", "A", BASIS["A"], F.col("parent_sha"), F.col("code_path"), F.slice(tokens.longest_first(F.col("toks")), 1, cfg.keep_tokens))


def with_negatives(positives: DataFrame) -> DataFrame:
    """The positives and the same pairs right after the fix, labelled clean; each row is made once and gives both."""
    clean = {"example_id": texts.stable_id(F.col("repo"), F.col("fix_sha"), F.col("doc_path"), F.col("code_path"), F.lit("clean")), "label": F.lit("clean"), "label_basis": F.lit(BASIS["negative"]), "shape": F.lit("negative"), "at_sha": F.col("fix_sha")}
    each = F.array(F.struct(*positives.columns), F.struct(*[clean.get(c, F.col(c)).alias(c) for c in positives.columns]))
    return positives.select(F.explode(each).alias("e")).select("e.*")


def cochanged(files: DataFrame) -> DataFrame:
    """(repo, doc_path, code_path) that ever changed together, former names included."""
    named = files.select("repo", "sha", F.explode(F.array_distinct(F.array_compact(F.array("path", "old_path")))).alias("path")).withColumn("kind", paths.kind(F.col("path")))
    docs = named.where("kind = 'doc'").select("repo", "sha", F.col("path").alias("doc_path"))
    code = named.where("kind = 'code'").select("repo", "sha", F.col("path").alias("code_path"))
    return docs.join(code, ["repo", "sha"]).select("repo", "doc_path", "code_path").distinct()


def related_pairs(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Docs and code of a tree whose stems or path words meet, through an inverted index of words and stems."""
    keys = lambda p: F.array_union(F.transform(paths.words(p), lambda w: F.concat(F.lit("w:"), w)), F.array(F.concat(F.lit("s:"), paths.stem(p))))
    flat = lambda t, c: t.select("repo", c, F.explode(keys(F.col(c))).alias("k"))
    return flat(docs, "doc_path").join(flat(code, "code_path"), ["repo", "k"]).select("repo", "doc_path", "code_path").distinct()


def easy_negatives(tree: DataFrame, together: DataFrame, target: int, seed: str = "0") -> DataFrame:
    """Pairs that never changed together: half of path-related ones, the rest uniform; a shortfall stays one.

    ``tree(repo, sha, committed_at, path)``.  An arm that wants n pairs of a repository may draw 50 n times, a
    thousand at least.  Draws are numbered: each takes the doc and the code at hashed places of the first so many in
    hash order, which tasks cut down before anything is shuffled; the product of docs and code is never built.
    The related arm takes a code file of each of these docs, then a second one, and so on.
    """
    half = target // 2
    order = lambda *c: F.md5(F.concat_ws(":", F.lit(seed), *c))
    tree = tree.withColumn("kind", paths.kind(F.col("path")))
    budget = max(DRAWS * (target - half), LEAST_DRAWS)

    def first(rows: DataFrame, name: str) -> DataFrame:
        slot = F.row_number().over(Window.partitionBy("repo").orderBy(order(F.col("path")), "path"))
        return rows.select("repo", F.col("path").alias(name), slot.alias("slot")).where(F.col("slot") <= budget)

    docs = first(tree.where((F.col("kind") == "doc") & paths.documents_code(F.col("path"))), "doc_path")
    all_code = tree.where("kind = 'code'")
    code = first(all_code, "code_path")
    size = docs.groupBy("repo").agg(F.count("*").alias("nd")).join(code.groupBy("repo").agg(F.count("*").alias("nc")), "repo")
    place = lambda side, n: (F.conv(F.substring(order(F.lit(side), F.col("t").cast("string")), 1, 8), 16, 10).cast("long") % F.col(n) + 1).cast("int")
    draws = size.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(budget - 1)))).select("repo", "t", place("doc", "nd").alias("d"), place("code", "nc").alias("c"))
    uniform = draws.join(docs.withColumnRenamed("slot", "d"), ["repo", "d"]).join(code.withColumnRenamed("slot", "c"), ["repo", "c"]).where(~paths.related(F.col("doc_path"), F.col("code_path")))
    uniform = uniform.groupBy("repo", "doc_path", "code_path").agg(F.min("t").alias("t"))
    near = related_pairs(docs.drop("slot"), all_code.select("repo", F.col("path").alias("code_path")))
    never = lambda pairs: pairs.join(together, ["repo", "doc_path", "code_path"], "left_anti")
    w = Window.partitionBy("repo", "doc_path").orderBy(order(F.col("doc_path"), F.col("code_path")), "code_path")
    near = never(near).withColumn("t", F.row_number().over(w)).where(F.col("t") <= max(half, 1))
    head = tree.groupBy("repo").agg(F.max("sha").alias("sha"), F.max("committed_at").alias("committed_at"))

    def draw(pairs: DataFrame, n: int, basis: str) -> DataFrame:
        by = Window.partitionBy("repo").orderBy("t", order(F.col("doc_path")), "doc_path", "code_path")
        kept = pairs.withColumn("nr", F.row_number().over(by)).where(F.col("nr") <= n).join(head, "repo")
        none = F.concat(F.lit("(no commit: "), "doc_path", F.lit(" and "), "code_path", F.lit(" never co-changed)"))
        kept = kept.select("repo", "doc_path", "code_path", "sha", "committed_at", none.alias("subject"), *[F.lit("").alias(c) for c in ("fix_sha", "parent_sha")], *[F.lit(0).alias(c) for c in ("doc_lines_added", "doc_lines_removed", "files_in_commit")])
        return _example(kept, "clean", "negative_easy", basis, F.col("sha"), F.col("code_path"), F.array().cast("array<string>"))

    return draw(near, half, BASIS["related"]).unionByName(draw(never(uniform), target - half, BASIS["easy"]))


def dedupe(examples: DataFrame) -> DataFrame:
    """One row an id: positives first, then by basis and paths."""
    w = Window.partitionBy("example_id").orderBy(F.desc("label"), "label_basis", "doc_path", "fix_sha")
    return examples.withColumn("nr", F.row_number().over(w)).where("nr = 1").drop("nr")


def mine(files: DataFrame, diffs: DataFrame, cfg: MineConfig = MineConfig()) -> DataFrame:
    rows = eligible(files, cfg)
    positives = shape_b(rows, diffs, cfg).unionByName(shape_a(rows, diffs, cfg))
    return dedupe(with_negatives(positives))
