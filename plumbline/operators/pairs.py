"""Scores of (document window, code window) pairs: computed once, stored, and used to reorder the heads of rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..sources.stores import Store, stamp_of, written
from . import retrieval as rt

#: Both windows of a pair must fit one model window, so they are half of what the vectors' are.
SIZE, OVERLAP, TOP_N = 800, 100, 20


class PairScorer(Protocol):
    """Anything that scores pairs: higher is better, without a sign or range to rely on."""

    def score(self, pairs: list[tuple[str, str]]) -> Sequence[float]: ...


#: Scorers of this worker process, by model: one is built however many tasks the worker runs.
_SCORERS: dict[str, PairScorer] = {}


def pair_store(spark: SparkSession, root: str, model: str, size: int = SIZE, overlap: int = OVERLAP, buckets: int = 16) -> Store:
    """Scores by (q, p), the hashes of a document window and a code window; a swapped pair is another key."""
    return Store.open(spark, root, {"q": "binary", "p": "binary"}, ("score", "double"), stamp_of(model, size, overlap), buckets)


def windows(rows: DataFrame, name: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The other columns of ``rows(.., text)`` with a row a window: its hash ``name`` and its text; blank texts have none."""
    cut = rows.select(*[c for c in rows.columns if c != "text"], F.explode(texts.chunks(F.col("text"), size, overlap)).alias("window"))
    return cut.withColumn(name, F.unhex(F.md5("window")))


def score_pairs(pairs: DataFrame, q_texts: DataFrame, p_texts: DataFrame, model: str, scorer: Callable[[], PairScorer], batch: int = 128) -> DataFrame:
    """(q, p, score) of distinct ``pairs(q, p)``; texts by hash in ``q_texts(q, window)`` and ``p_texts(p, window)``.

    Pairs go to the model in batches of ``batch``; one scorer is built a worker process and model.
    """
    q, p = q_texts.select("q", F.col("window").alias("a")).dropDuplicates(["q"]), p_texts.select("p", F.col("window").alias("b")).dropDuplicates(["p"])
    rows = pairs.join(q, "q").join(p, "p").select("q", "p", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if model not in _SCORERS:
                _SCORERS[model] = scorer()
            for k in range(0, rows.num_rows, batch):
                part = rows.slice(k, batch)
                found = [float(s) for s in _SCORERS[model].score(list(zip(part.column("a").to_pylist(), part.column("b").to_pylist())))]
                if len(found) != part.num_rows:
                    raise ValueError(f"{model}: {len(found)} scores of {part.num_rows} pairs")
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("p"), pa.array(found, pa.float64())], names=["q", "p", "score"])

    return rows.mapInArrow(run, "q binary, p binary, score double")


def head_pairs(base: DataFrame, queries: DataFrame, code: DataFrame, top_n: int = TOP_N, evidence: DataFrame | None = None, size: int = SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, q windows, p windows) of the first ``top_n`` of each ranking.

    ``base(query_id, path, rank)``, ``queries(query_id, tree, text)``, ``code(tree, path, text)``.  With
    ``evidence(query_id, tok)`` those tokens are taken out of what the model reads.  pairs: (query_id, path, q, p).
    """
    docs = queries.select("query_id", "tree", "text")
    if evidence is not None:
        words = evidence.groupBy("query_id").agg(F.collect_set("tok").alias("words"))
        docs = docs.join(words, "query_id", "left").withColumn("text", texts.redact(F.col("text"), F.coalesce("words", F.array().cast("array<string>")))).drop("words")
    # the head is read twice, and a ranking may be dear; without a look at its size, all texts would be shuffled to meet it
    head = written(base.where(F.col("rank") <= top_n).select("query_id", "path").join(queries.select("query_id", "tree"), "query_id"), "head")
    q = written(windows(docs.select("query_id", "text"), "q", size, overlap), "q")
    # a file that stands in many heads is cut once
    p = written(windows(code.join(rt.small(head.select("tree", "path").distinct()), ["tree", "path"], "left_semi").select("tree", "path", "text"), "p", size, overlap), "p")
    pairs = head.join(p.select("tree", "path", "p"), ["tree", "path"]).join(q.select("query_id", "q"), "query_id")
    return written(pairs.select("query_id", "path", "q", "p"), "pairs"), q, p


def rerank_heads(base: DataFrame, queries: DataFrame, code: DataFrame, store: Store, model: str, scorer: Callable[[], PairScorer], top_n: int = TOP_N, evidence: DataFrame | None = None, size: int = SIZE, overlap: int = OVERLAP, batch: int = 128) -> tuple[DataFrame, tuple[int, int]]:
    """The rankings with their heads in the order of the best pair of windows, and (found, scored) in distinct pairs.

    Past ``top_n`` nothing moves.  A file without a window goes to the end of its head; a query without one keeps its order.
    """
    if top_n < 2:
        raise ValueError("top_n must be 2 or more")
    base = written(base, "base")  # its head is read twice and its tail once
    pairs, q, p = head_pairs(base, queries, code, top_n, evidence, size, overlap)
    counts = store.fill(pairs, lambda missing: score_pairs(missing, q, p, model, scorer, batch))
    best = pairs.join(store.read(), ["q", "p"]).groupBy("query_id", "path").agg(F.max("score").alias("score"))
    return rt.rerank(base, best, top_n), counts
