"""Ranks of the best relevant candidates in whole rankings, by counting what stands before them as it is scored.

The relevant ones are scored first, from their own texts; those that can count (the first few of each query) go to every
task, which counts the scores that pass by.  No pair is kept, cached, sorted or shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon
from . import retrieval as rt
from .topk import top_k

#: Relevant candidates, and queries, that go to every task.
FEW_ROWS = 200_000


class Before:
    """Counts by arm, query and place: how many candidates stand after ``place`` of the listed ones, in the order of score falling, then path."""

    def __init__(self, arms: list[str], queries: pa.Array, listed: dict[tuple[str, object], list[tuple[float, str]]]):
        self.arms, self.queries, self.listed = arms, queries, listed
        self.width = max(map(len, listed.values()), default=0)
        self.scores = {a: np.full((len(queries), self.width), -np.inf) for a in arms}
        self.ids = queries.to_pylist()
        for k, query in enumerate(self.ids):
            for a in arms:
                own = listed.get((a, query), ())
                self.scores[a][k, : len(own)] = [s for s, _ in own]
        self.counts = {a: np.zeros(len(queries) * (self.width + 1), np.int64) for a in arms}

    def add(self, batch: pa.RecordBatch) -> None:
        at = pc.index_in(batch.column("query_id"), value_set=self.queries)
        for a in self.arms:
            score = batch.column(a)
            some = np.flatnonzero(np.asarray(pc.and_(at.is_valid(), score.is_valid())))
            query, s = np.asarray(at.fill_null(0))[some], np.asarray(score.fill_null(0.0))[some][:, None]
            own = self.scores[a][query]
            place = (own > s).sum(axis=1)
            tied = np.flatnonzero((own == s).any(axis=1))
            for k, path in zip(tied, batch.column("path").take(pa.array(some[tied])).to_pylist()):
                place[k] = bisect.bisect_right(self.listed[a, self.ids[query[k]]], (-s[k, 0], path), key=lambda x: (-x[0], x[1]))
            self.counts[a] += np.bincount(query * (self.width + 1) + place, minlength=len(self.counts[a]))

    def rest(self) -> pa.Table:
        parts = []
        for a, n in self.counts.items():
            some = np.flatnonzero(n)
            query, place = some // (self.width + 1), some % (self.width + 1)
            parts.append(pa.table({"arm": pa.array([a] * len(some), pa.string()), "query_id": self.queries.take(pa.array(query)), "place": pa.array(place, pa.int64()), "n": pa.array(n[some], pa.int64())}))
        return pa.concat_tables(parts)


def first_ranks(
    queries: DataFrame, docs: DataFrame, weights: DataFrame, arms: dict[str, tuple[Column, float | None]], relevant: DataFrame, first: int,
    parts: lexicon.Parts | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The ranks (arm, query_id, path, rank) of the ``first`` best of ``relevant(query_id, path)`` in each ranking, and (arm, query_id) of the rankings.

    The arguments are those of ``lexicon.score_arms``.  Queries without a relevant candidate are left out; ``relevant`` is read more
    than once.  More than ``FEW_ROWS`` are ranked over a cached table of all scores.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rel = relevant.select("query_id", "path").distinct()
    parts = parts or lexicon.once(docs.select("tree", "path", "text"), "tree", "path")
    wanted = rt.small(rel.select("path").distinct())
    near = lambda some: None if some is None else some.join(wanted, "path", "left_semi")
    scores = lexicon.score_arms(queries, near(docs), weights, arms, parts=parts._replace(single=near(parts.single), again=near(parts.again), found=near(parts.found)))
    own = top_k(rt.long(scores, list(arms)).join(rt.small(rel), ["query_id", "path"]), first, "arm", "query_id").cache()
    held, asked = own.limit(FEW_ROWS + 1).collect(), rel.select("query_id").distinct().limit(FEW_ROWS + 1).collect()
    if max(len(held), len(asked)) > FEW_ROWS:
        every = rt.long(lexicon.score_arms(queries, docs, weights, arms, parts=parts), list(arms)).cache()
        return rt.ranks_of(every, rel), every.join(rel.select("query_id").distinct(), "query_id", "left_semi").select("arm", "query_id").distinct()
    listed: dict[tuple[str, object], list[tuple[float, str]]] = {}
    for row in sorted(held, key=lambda r: r["rank"]):
        listed.setdefault((row["arm"], row["query_id"]), []).append((row["score"], row["path"]))
    kind = queries.schema["query_id"].dataType
    names, ids = list(arms), pa.array([r["query_id"] for r in asked], to_arrow_type(kind))
    make: Callable[[], Before] = lambda: Before(names, ids, listed)
    counts = lexicon.score_arms(queries, docs, weights, arms, parts=parts, fold=(make, f"arm string, query_id {kind.simpleString()}, place long, n long"))
    counts = counts.groupBy("arm", "query_id", "place").agg(F.sum("n").alias("n")).cache()
    before = F.sum(F.when(F.col("place") < F.col("nr"), F.col("n")).otherwise(0))
    mine = own.select("arm", "query_id", "path", F.col("rank").alias("nr")).join(counts, ["arm", "query_id"]).groupBy("arm", "query_id", "path").agg((before + 1).alias("rank"))
    return mine, counts.select("arm", "query_id").distinct()
