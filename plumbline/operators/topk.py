"""The first k of each query by a bounded heap in two steps, without sorting or gathering a query's candidates.

Every task keeps the best k it has seen of each query and passes by what cannot be among them; only those travel,
and the tasks that receive them merge them in the same way.  Heaps merge in any order, so lost tasks just run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a task holds before it cuts them down.
HELD = 100_000


def first_of_each(rows: pa.Table, keys: list[str], k: int) -> tuple[pa.Table, np.ndarray]:
    """The first k rows of each key by falling score, then path, and their places from 0."""
    order = pc.sort_indices(rows, sort_keys=[*((c, "ascending") for c in keys), ("score", "descending"), ("path", "ascending")])
    rows = rows.take(order).combine_chunks()
    new = np.zeros(rows.num_rows, bool)
    if rows.num_rows:
        new[0] = True
    for c in keys:
        column = rows.column(c)
        this, before = column.slice(1), column.slice(0, max(0, rows.num_rows - 1))
        new[1:] |= np.asarray(pc.fill_null(pc.not_equal(this, before), False)) | np.asarray(pc.xor(this.is_null(), before.is_null()))
    at = np.arange(rows.num_rows)
    place = at - np.maximum.accumulate(np.where(new, at, 0))
    return rows.filter(pa.array(place < k)), place[place < k]


class Heaps:
    """The best k of every query among the batches seen; ``floor`` is the score below which a full query takes no more."""

    def __init__(self, keys: list[str], k: int):
        self.keys, self.k = keys, k
        self.held: list[pa.RecordBatch | pa.Table] = []
        self.rows = 0
        self.full = self.floor = None

    def add(self, batch: pa.RecordBatch) -> pa.Table | None:
        """Take a batch in; rows come back when too many queries are open for this task."""
        if self.full is not None:
            at = pc.index_in(batch.column(self.keys[0]), value_set=self.full)
            floor = np.where(np.asarray(at.is_valid()), self.floor[np.asarray(at.fill_null(0))], -np.inf)
            batch = batch.filter(pa.array(np.asarray(batch.column("score")) >= floor))
        self.held.append(pa.Table.from_batches([batch]))
        self.rows += batch.num_rows
        if self.rows <= HELD:
            return None
        out, place = self.cut()
        if out.num_rows > HELD // 2:
            self.held, self.rows, self.full, self.floor = [], 0, None, None
            return out
        self.held, self.rows = [out], out.num_rows
        last = place == self.k - 1
        if len(self.keys) == 1 and last.any():
            self.full, self.floor = out.column(self.keys[0]).filter(pa.array(last)).combine_chunks(), np.asarray(out.column("score"))[last]
        return None

    def cut(self) -> tuple[pa.Table, np.ndarray]:
        return first_of_each(pa.concat_tables(self.held), self.keys, self.k)


def top_k(scores: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, path, score, rank) of the first ``k`` rows of each key: score falling (null counts as 0), then path.

    ``keys`` is ``query_id`` where none is given.  Other columns are left out, NaN comes last, and fewer
    than k candidates are all given.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    names = list(keys or ("query_id",))
    rows = scores.select(*names, F.col("path"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(names, k)
        for batch in batches:
            early = heaps.add(batch)
            if early is not None:
                yield from early.combine_chunks().to_batches()
        if heaps.held:
            yield from heaps.cut()[0].combine_chunks().to_batches()

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows > HELD:  # what is left is k rows a query of this partition at most
                held = [first_of_each(pa.concat_tables(held), names, k)[0]]
                rows = held[0].num_rows // 2
        if held:
            out, place = first_of_each(pa.concat_tables(held), names, k)
            yield from out.append_column("rank", pa.array(place + 1)).combine_chunks().to_batches()

    return rows.mapInArrow(some, schema).repartition(*names).mapInArrow(all_of, schema + ", rank long")
