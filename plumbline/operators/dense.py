"""Vectors of text windows, stored once a text, and the best cosine of two texts' windows by blocks of matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..sources.stores import Store, stamp_of, written
from . import retrieval as rt
from .topk import first_of_each

#: Characters of a window and of its overlap with the next.
SIZE, OVERLAP = 1_600, 200
#: Owners a block, and blocks of queries that are sent to every executor.
OWNERS, FEW = 512, 8


class Encoder(Protocol):
    """Anything that turns texts into rows of unit length."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


_ENCODERS: dict[str, Encoder] = {}


def vector_store(spark: SparkSession, root: str, model: str, size: int = SIZE, overlap: int = OVERLAP, buckets: int = 16) -> Store:
    """The vectors of a text's windows by the text's hash; a blank text has an empty list, which is a value too."""
    return Store.open(spark, root, {"blob": "binary"}, ("vectors", "array<array<float>>"), stamp_of(model, size, overlap), buckets)


def encode(rows: DataFrame, model: str, encoder: Callable[[], Encoder], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(blob, vectors) of ``rows(blob, text)``; the windows of a batch of texts go to the model together."""
    cut = rows.select("blob", texts.chunks(F.col("text"), size, overlap).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model not in _ENCODERS:
                _ENCODERS[model] = encoder()
            column = batch.column("cut")
            pieces, counts = column.flatten().to_pylist(), np.diff(np.asarray(column.offsets))
            found = np.asarray(_ENCODERS[model].encode(pieces), np.float32) if pieces else np.zeros((0, 1), np.float32)
            if len(found) != len(pieces):
                raise ValueError(f"{model}: {len(found)} vectors of {len(pieces)} texts")
            rows = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.ListArray.from_arrays(ends, rows)], names=["blob", "vectors"])

    return cut.mapInArrow(run, "blob binary, vectors array<array<float>>")


def text_vectors(rows: DataFrame, store: Store, model: str, encoder: Callable[[], Encoder], size: int = SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, tuple[int, int]]:
    """``rows(.., text)`` with a row a window and its vector ``v`` in place of the text, and (found, encoded) in distinct texts.

    Null texts count as empty.  Every distinct text is encoded once, however many rows or runs hold it.
    """
    held = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.unhex(F.md5("text")))
    texts_of = held.select("blob", "text").dropDuplicates(["blob"])
    counts = store.fill(held, lambda missing: encode(texts_of.join(missing, "blob"), model, encoder, size, overlap))
    out = held.drop("text").join(store.read(), "blob").select(*[c for c in rows.columns if c != "text"], F.explode("vectors").alias("v"))
    return out, counts


def blocks(vectors: DataFrame, owner: str, per_block: int = OWNERS) -> DataFrame:
    """(tree, owners, ends, m): the vectors of ``vectors(tree, <owner>, v)`` as matrices, all of one owner in one block.

    ``ends`` says where each owner's rows end in the float32 matrix ``m``; a block holds some ``per_block`` owners.
    """
    n = vectors.select("tree", owner).distinct().groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    many = -(-n // per_block)
    kind = next(f.dataType.simpleString() for f in vectors.schema if f.name == owner)
    rows = vectors.select("tree", F.col(owner).alias("owner"), F.col("v").cast("array<float>").alias("v"), F.pmod(F.xxhash64(owner), F.lit(many)).alias("block"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("owner").combine_chunks()
        owners = group.column("owner").combine_chunks()
        column = group.column("v").combine_chunks()
        m = np.asarray(column.flatten(), np.float32)
        new = np.flatnonzero(np.asarray(owners.slice(1).to_numpy(False) != owners.slice(0, len(owners) - 1).to_numpy(False))) + 1
        first, ends = np.concatenate([[0], new]), np.concatenate([new, [len(owners)]])
        lists = [pa.array([owners.take(pa.array(first)).to_pylist()], pa.list_(owners.type)), pa.array([ends.tolist()], pa.list_(pa.int32()))]
        return pa.table({"tree": group.column("tree").slice(0, 1), "owners": lists[0], "ends": lists[1], "m": pa.array([m.tobytes()])})

    return rows.groupBy("tree", "block").applyInArrow(pack, f"tree string, owners array<{kind}>, ends array<int>, m binary")


def best_of_blocks(left: np.ndarray, left_ends: np.ndarray, right: np.ndarray, right_ends: np.ndarray) -> np.ndarray:
    """[left owner, right owner]: the greatest product of a row of one with a row of the other."""
    starts = lambda ends: np.concatenate([[0], ends[:-1]])
    close = left.astype(np.float64) @ right.astype(np.float64).T
    return np.maximum.reduceat(np.maximum.reduceat(close, starts(right_ends), axis=1), starts(left_ends), axis=0)


def maxsim(query_vectors: DataFrame, vectors: DataFrame, k: int | None = None, per_block: int = OWNERS) -> DataFrame:
    """(query_id, tree, path, score), rounded to five places, of every query and every candidate of its tree that has vectors.

    ``query_vectors(tree, query_id, v)``, ``vectors(tree, path, v)``.  One matrix product serves a pair of blocks.  With
    ``k`` a pair of blocks gives back a query's best k of it only, for ``topk.top_k`` to merge.
    """
    q = blocks(query_vectors, "query_id", per_block).select("tree", F.col("owners").alias("q_owners"), F.col("ends").alias("q_ends"), F.col("m").alias("q_m"), F.monotonically_increasing_id().alias("query_id"))
    q = written(q, "blocks")  # counted and joined
    c = blocks(vectors, "path", per_block)
    kind = next(f.dataType.simpleString() for f in query_vectors.schema if f.name == "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                ends = [np.asarray(row.column(c).flatten()) for c in ("q_ends", "ends")]
                sides = [np.frombuffer(row.column(c)[0].as_buffer(), np.float32).reshape(e[-1], -1) for c, e in zip(("q_m", "m"), ends)]
                best = np.floor(best_of_blocks(sides[0], ends[0], sides[1], ends[1]) * 1e5 + 0.5) / 1e5
                queries, paths = row.column("q_owners").flatten(), row.column("owners").flatten()
                a, b = np.divmod(np.arange(best.size), best.shape[1])
                if k is not None and best.shape[1] > k:  # ties at the edge stay until paths decide
                    edge = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
                    some = np.flatnonzero(best.ravel() >= edge[a])
                    a, b = a[some], b[some]
                out = pa.table({"query_id": queries.take(pa.array(a)), "path": paths.take(pa.array(b)), "score": pa.array(best[a, b])})
                if k is not None:
                    out = first_of_each(out, ["query_id"], k)[0]
                for part in out.combine_chunks().to_batches(max_chunksize=10_000):
                    tree = row.column("tree").take(pa.array(np.zeros(part.num_rows, np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column("query_id"), tree, part.column("path"), part.column("score")], names=["query_id", "tree", "path", "score"])

    pairs = rt.in_blocks(q, c, FEW)
    return pairs.select("tree", "q_owners", "q_ends", "q_m", "owners", "ends", "m").mapInArrow(run, f"query_id {kind}, tree string, path string, score double")
