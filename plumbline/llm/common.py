"""Helpers shared by the text operators: table access, Arrow batches, shared storage, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table  # noqa: F401  (queries read through it)

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Bytes of words as they are (A-Z lower-cased), all others to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for workers that hold very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only where driver and executors are one process (tests on local masters) may the setting be missing; a
    cluster's executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            root = tempfile.mkdtemp(prefix="plumbline-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(root, f"plumbline-{uuid.uuid4().hex}")


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in files every executor sees.

    The files go when the application ends, or before with ``dropped``.
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    files, place = _place(spark, folder)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.folder = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read any more."""
    for df in tables:
        files, place = _place(df.sparkSession, df.folder)
        files.delete(place, True)


def pack(*arrays: np.ndarray) -> tuple[bytes, int]:
    """Arrays in compressed form; the bytes of a number stand in planes, so that high bytes compress away."""
    raw = b"".join(len(a).to_bytes(8, "little") + np.ascontiguousarray(a.view("u1").reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return pa.compress(raw, "zstd", asbytes=True), len(raw)


def unpack(payload: bytes, size: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = pa.decompress(payload, size, "zstd", asbytes=True), 0, []
    for kind in kinds:
        n, item = int.from_bytes(raw[at : at + 8], "little"), np.dtype(kind).itemsize
        planes = np.frombuffer(raw, "u1", n * item, at + 8).reshape(item, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 8 + n * item
    return out


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, null as empty, without a list of all of them."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names: other columns, whatever they are called, never reach an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, component), the component being its smallest node.

    Alternating large-star and small-star steps until nothing changes; every round moves some node to a
    smaller one, so they end.  Every round is written to the shared folder and the one before deleted, so
    plans stay short and lost executors cost one round.  The work per node is one group-by with
    map-side combine and one join; no group is ever gathered in one task.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    link = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    link = written(link, "edges")
    before = None
    while True:
        # large star: every larger neighbour of a node is linked with that node's smallest neighbour
        near = written(both(link).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both(link).join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "large")
        dropped(link, near)
        # small star: a node and its smaller neighbours are linked with the smallest of them
        near = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(near, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        link = written(small.union(near.select("a", F.col("m").alias("b"))).distinct(), "small")
        dropped(large, near)
        state = link.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    out = link.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(link.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
