"""A digest of written files that depends on their lines alone, and manifests that hold it.

Lines are hashed and counted; equal lines meet before anything else, so a line may stand any number of times.  The hashes form a
tree by their leading digits: a leaf hashes the sorted hashes of its range with their counts, a node the
leaves below it.  The same lines in any files, order and partitioning give one digest; one changed byte gives another.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sheets import Refusal

#: Leading hex digits of a leaf and of a node of the tree: 16 million leaves hold some thousand lines each at 10^10 lines.
LEAF, NODE = 6, 3


def tree_digest(lines: DataFrame, column: str = "value") -> str:
    """SHA-256 of the tree over the lines of a table; the driver gets 4,096 hashes at most."""
    counted = lines.select(F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    level = counted.select("h", F.concat_ws(":", "h", F.col("n").cast("string")).alias("item"))
    for digits in (LEAF, NODE):
        whole = F.sha2(F.array_join(F.array_sort(F.collect_list("item")), "\n"), 256)
        level = level.groupBy(F.substring("h", 1, digits).alias("h")).agg(whole.alias("item")).select("h", F.concat_ws(":", "h", "item").alias("item"))
    return hashlib.sha256("\n".join(sorted(r["item"] for r in level.collect())).encode()).hexdigest()


def file_digest(spark: SparkSession, path: str) -> str:
    return tree_digest(spark.read.text(path))


def code_revision(root: str | None = None) -> dict[str, str]:
    """The package's own state: a hash of its files, and where they lie in a git repository its commit and whether they differ from it."""
    root = root or os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = hashlib.sha256()
    for folder, names, files in sorted(os.walk(root)):
        for name in sorted(f for f in files if f.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as f:
                found.update(os.path.relpath(f.name, root).encode() + b"\0" + f.read() + b"\0")
    out = {"files": found.hexdigest(), "commit": "unknown", "dirty": "unknown"}
    try:
        git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout.strip()
        out |= {"commit": git("rev-parse", "HEAD"), "dirty": "yes" if git("status", "--porcelain", "--", ".") else "no"}
    except (subprocess.CalledProcessError, OSError):
        pass  # said as unknown, which is not the same as clean
    return out


def manifest_of(spark: SparkSession, path: str, counts: dict, config: dict, repos: dict[str, str], replay: list[str]) -> dict:
    return {
        "output": {"path": path, "examples": sum(counts.values()), "digest": file_digest(spark, path)},
        "repos": repos, "code": code_revision(), "counts": counts, "config": config, "replay": replay,
    }


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def check_manifest(spark: SparkSession, path: str, manifest: str) -> dict:
    """The manifest of the files in ``path``; refused if they are not the ones it was written for."""
    held = json.loads(spark.read.text(manifest).first()[0])
    if (now := file_digest(spark, path)) != held["output"]["digest"]:
        raise Refusal(f"{path}: its digest is {now}, the manifest has {held['output']['digest']}")
    return held
