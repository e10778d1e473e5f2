"""Text reports of small result tables, checklists, and the bundles of texts they link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_text(rows: DataFrame, order: list[str | Column], most: int = 500) -> str:
    """A fixed-width table of a result; meant for aggregates, so more than ``most`` rows are refused."""
    got = rows.orderBy(*order).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows are no report")
    cells = [rows.columns] + [["-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in got]
    widths = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join("  ".join(v.ljust(w) if k == 0 else v.rjust(w) for k, (v, w) in enumerate(zip(r, widths))).rstrip() for r in cells) + "\n"


def place(root: str | None, repo: Column, path: Column) -> Column:
    """Where a bundle keeps a file's text: a folder a repository and file, named so that no two files share one."""
    name = F.concat(F.regexp_replace(path, "[^A-Za-z0-9._-]+", "_"), F.lit("-"), F.substring(F.md5(path), 1, 8))
    return F.concat_ws("/", *([F.lit(root)] if root else []), F.concat(F.lit("repo="), F.regexp_replace(repo, "[^A-Za-z0-9._-]+", "__")), F.concat(F.lit("file="), name))


def bundle(cases: DataFrame, held: DataFrame, path: str) -> None:
    """Write the texts a checklist asks about: each document and each file of its repository in a folder of its own.

    ``cases(repo, doc_path)``, ``held(repo, path, text)``.  A row is a file, so a repository's pool is never together in
    one task; an existing bundle is refused.
    """
    spots = held.join(cases.select("repo").distinct(), "repo", "left_semi").select(F.split(place(None, F.col("repo"), F.col("path")), "/").alias("at"), "text")
    rows = spots.select(*[F.regexp_replace(F.col("at")[k], "^[a-z]+=", "").alias(c) for k, c in enumerate(("repo", "file"))], F.coalesce("text", F.lit("")).alias("text"))
    rows.repartition("repo", "file").write.partitionBy("repo", "file").mode("errorifexists").text(path)


def checklist(cases: DataFrame, pool: DataFrame, root: str | None = None) -> DataFrame:
    """cases(repo, doc_path), pool(repo, sha, path): (nr, pos, block), a case a document with the files of its tree to tick.

    A row is a line of the sheet, in order of nr and pos.  With ``root`` the document and every file have a link into the
    bundle that lies there.
    """
    numbered = cases.select("repo", "doc_path").distinct().withColumn("nr", F.row_number().over(Window.orderBy("repo", "doc_path")))  # what one person reads
    trees = pool.groupBy("repo").agg(F.max("sha").alias("sha"))
    link = lambda path: [F.concat(F.lit("  [text]("), place(root, F.col("repo"), path), F.lit(")"))] if root else []
    line = lambda rows, pos, *parts: rows.select("nr", F.lit(pos).alias("pos"), F.lit("").alias("path"), F.concat_ws("\n", *parts).alias("block"))
    known = numbered.join(trees, "repo")
    head = F.format_string("## Case %d — `%s` · `%s`\n", "nr", "repo", "doc_path")
    tree = F.concat(F.lit("- **tree** `"), F.substring("sha", 1, 12), F.lit("`\n"))
    ticks = known.join(pool.select("repo", "path").distinct(), "repo").select("nr", F.lit(1).alias("pos"), "path", F.concat_ws("\n", F.concat(F.lit("- [ ] "), "path"), *link(F.col("path"))).alias("block"))
    rows = line(known, 0, head, *link(F.col("doc_path")), tree).unionByName(ticks).unionByName(line(known, 2, F.lit("\n**NONE:** [ ]\n"), F.lit("**EXTRA:**\n"), F.lit("**NOTES:**\n"), F.lit("---\n")))
    return rows.select("nr", F.struct("pos", "path").alias("pos"), "block")
