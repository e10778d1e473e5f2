"""Near-duplicate vectors by cross-polytope hashing, multiprobe buckets and verified pairs.

A hash rotates a vector pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and takes the
nearest of the 2 d axis directions; ``functions`` of them make a table's key.  A vector lives in the bucket of its own
key in every table and visits the ``probes - 1`` next likely buckets of each.  Home vectors of a bucket meet each other
and its visitors; cosines are computed for all who meet, in double precision, so no link is false.  The number of
tables follows from a simulation of pairs at the threshold: a pair just at it is missed once in ``1 / miss`` times.

Vectors that are equal stand as one class with a weight, so copies are never compared.  A large bucket is cut into
tiles of ``TILE`` vectors, and each pair of tiles is a cell of bounded size; a task streams its cells one after another.
A cell gives back, for each vector, how many links it found and one edge of a spanning forest, so pairs are never
rows.  A pair that meets in many cells counts in the first: both vectors' keys are derived again, and the first
table (and of two buckets there the smaller) in which they meet is theirs.

``functions`` is for the size of the table: with two, 64 dimensions have 16,384 buckets a table, good for some
millions of vectors; with three there are two million, for a thousand million vectors, and about twice the tables.  The
links found are the same within ``miss``.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
are their own component; so are rows with a null id (their component is null and they are kept); vectors of different
lengths don't link; rows that repeat an id and its vector are one vector; an id with several vectors counts once for
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, dropped, written

TILE = 1024
#: Vectors, pairs at a time inside a task.
ROWS, PAIRS = 256, 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform of the last axis, by butterflies of sums and differences."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return x


class Tables:
    """The keys of vectors of one dimension in all tables; the same in every task, for sums of doubles are exact steps."""

    def __init__(self, dim: int, tables: int, functions: int, probes: int, seed: int = 42):
        self.dim, self.tables, self.functions, self.probes = dim, tables, functions, probes
        self.width = max(8, 1 << (dim - 1).bit_length())
        self.signs = np.random.default_rng([seed, self.width]).integers(0, 2, size=(3, tables * functions, self.width)) * 2.0 - 1
        choices = [c for c in product(range(probes), repeat=functions) if math.prod(k + 1 for k in c) <= probes]
        self.choices = np.array(choices).T  # per function the rank of the direction taken

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Keys [vector, table, probe]; the first probe is the vector's home."""
        return np.concatenate([self._keys(x[i : i + ROWS]) for i in range(0, len(x), ROWS)])

    def _keys(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        y = np.zeros((n, 1, self.width))
        y[:, 0, : self.dim] = x / np.abs(x).max(axis=1, keepdims=True)
        for signs in self.signs:
            y = hadamard(y * signs)
        y = y.reshape(n * self.tables * self.functions, self.width)
        size, every = np.abs(y), np.arange(len(y))
        axes, lost = [], []
        for _ in range(self.probes):  # argmax takes the first of equals, so ties fall alike everywhere
            best = size.argmax(axis=1)
            axes.append(2 * best + (y[every, best] < 0))
            lost.append(size[every, best])
            size[every, best] = -1
        shape = (n, self.tables, self.functions, self.probes)
        axes, lost = (np.stack(a, 1).reshape(shape) for a in (axes, lost))
        lost = (lost[..., :1] - lost) ** 2
        base, key, cost = 2 * self.width, 0, 0.0
        for f, ranks in enumerate(self.choices):
            key, cost = key * base + axes[:, :, f, ranks], cost + lost[:, :, f, ranks]
        likely = np.argsort(cost, axis=2, kind="stable")[:, :, : self.probes]
        return np.take_along_axis(key, likely, 2)


@lru_cache
def tables_for(dim: int, functions: int, probes: int, threshold: float, miss: float) -> int:
    """Tables needed so that a pair at the threshold fails to meet in all of them at most ``miss`` times."""
    rng, n = np.random.default_rng(7), 4_000
    x, z = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    one = Tables(dim, 1, functions, probes, seed=7)
    met = meeting(one.keys(x), one.keys(y))[:, 0].mean()
    met = min(max(met - 3 * math.sqrt(met * (1 - met) / n), 1e-3), 1 - 1e-9)
    return max(2, math.ceil(math.log(miss) / math.log(1 - met)))


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tables in which the pairs' vectors meet: one's home is among the other's probes."""
    return (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)


def owned(a: np.ndarray, b: np.ndarray, table: int, key: int) -> np.ndarray:
    """Whether the bucket ``key`` of ``table`` is the first place where the pairs with keys ``a``, ``b`` meet."""
    earlier = meeting(a[:, :table], b[:, :table]).any(1)
    home_a, home_b = a[:, table, 0], b[:, table, 0]
    at_a, at_b = (b[:, table] == home_a[:, None]).any(1), (a[:, table] == home_b[:, None]).any(1)
    place = np.where(at_a & at_b, np.minimum(home_a, home_b), np.where(at_a, home_a, home_b))
    return ~earlier & (place == key)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def trees(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest that links (a, b) lead to."""
    root = np.arange(n)
    while True:
        least, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if np.array_equal(root, before):
            return root


def cell_links(tables: Tables, table: int, key: int, x: np.ndarray, weight: np.ndarray, left: int, right: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and roots of one cell's vectors: ``left`` homes, then homes of another tile up to ``right`` (0: none, the left ones meet each other), then visitors."""
    u, n = unit(x), len(x)
    keys: dict[int, np.ndarray] = {}
    add, pairs = np.zeros(n, np.int64), []
    for i in range(0, left, ROWS):
        to = min(i + ROWS, left)
        near = u[i:to] @ u.T >= threshold
        near[:, :left] = np.triu(near[:, :left], i + 1) if not right else False
        a, b = np.nonzero(near)
        a += i
        if not len(a):
            continue
        new = [k for k in np.unique(np.concatenate([a, b])).tolist() if k not in keys]
        if new:
            keys |= zip(new, tables.keys(x[new]))
        for k in range(0, len(a), PAIRS):
            p, q = a[k : k + PAIRS], b[k : k + PAIRS]
            mine = owned(np.stack([keys[m] for m in p.tolist()]), np.stack([keys[m] for m in q.tolist()]), table, key)
            pairs.append((p[mine], q[mine]))
    if not pairs:
        return add, np.arange(n)
    a, b = (np.concatenate(side) for side in zip(*pairs))
    np.add.at(add, a, weight[b])
    np.add.at(add, b, weight[a])
    return add, trees(n, a, b)


def matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def links(classes: DataFrame, threshold: float, functions: int = 2, probes: int = 4, miss: float = 1e-4) -> DataFrame:
    """node, add, root: for each cell in which a class has links their weights and one edge of the forest (not yet summed)."""
    dims = [r[0] for r in classes.agg(F.max(F.size("x"))).collect()]
    tables = tables_for(max(dims[0] or 1, 8), functions, probes, threshold, miss)
    kind = next(f.dataType.simpleString() for f in classes.schema if f.name == "x")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for batch in batches:
            x = batch.column("x")
            sizes = np.diff(np.asarray(x.offsets))
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                if dim not in known:
                    known[dim] = Tables(dim, tables, functions, probes)
                keys = known[dim].keys(matrix(part.column("x"))).reshape(part.num_rows, -1)
                column = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("w"), part.column("x"), column], names=["node", "w", "x", "keys"])

    placed = written(classes.select("node", "w", "x").mapInArrow(keyed, f"node long, w long, x {kind}, keys array<long>"), "keys")
    spot = [F.size("x").alias("dim"), (F.col("pos") / probes).cast("int").alias("tab"), "key", (F.col("pos") % probes == 0).alias("home")]
    spots = placed.select("x", F.posexplode("keys").alias("pos", "key")).select(*spot)
    sizes = spots.groupBy("dim", "tab", "key").agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).where("homes > 0 AND all > 1")
    sizes = written(sizes.select("dim", "tab", "key", F.ceil(F.col("homes") / TILE).cast("int").alias("a"), F.ceil((F.col("all") - F.col("homes")) / TILE).cast("int").alias("b")), "sizes")
    rows = placed.select("node", "w", "x", F.posexplode("keys").alias("pos", "key")).select("node", "w", "x", *spot).join(sizes, ["dim", "tab", "key"])
    # cells (i, j) hold tile i of the homes, tile j of the homes if j > i, and tile j of the visitors
    dealt = lambda n: F.pmod(F.xxhash64("node", "tab"), F.greatest(F.col(n), F.lit(1))).cast("int")
    mine = F.when(F.col("home"), dealt("a")).otherwise(dealt("b"))
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    rows = rows.withColumn("mine", mine)
    lefts = F.transform(F.sequence(F.lit(0), F.greatest("a", "b") - 1), lambda j: cell(F.col("mine"), j, 0))
    lefts = F.filter(lefts, lambda c: (c.j >= c.i) | (c.j < F.col("b")))
    rights = F.filter(F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda i: cell(i, F.col("mine"), 1)), lambda c: c.i < c.j)
    visits = F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda i: cell(i, F.col("mine"), 2))
    rows = rows.withColumn("c", F.explode(F.when(F.col("home"), F.concat(lefts, rights)).otherwise(visits)))
    cells = rows.select("dim", "tab", "key", "c.i", "c.j", "c.role", "node", "w", "x")
    cells = cells.repartition("dim", "tab", "key", "i", "j").sortWithinPartitions("dim", "tab", "key", "i", "j", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        held: list[pa.RecordBatch] = []

        def cell_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            dim, table, key, i, j = (t.column(c)[0].as_py() for c in ("dim", "tab", "key", "i", "j"))
            if t.num_rows < 2:
                return None
            role = np.asarray(t.column("role"))
            left, right = int((role == 0).sum()), int((role == 1).sum())
            # with j < i the homes of tile j met those of tile i in cell (j, i): here only visitors come
            if dim not in known:
                known[dim] = Tables(dim, tables, functions, probes)
            add, root = cell_links(known[dim], table, key, matrix(t.column("x")), np.asarray(t.column("w")), left, 1 if i != j else 0, threshold)
            some = np.flatnonzero(add)
            if not len(some):
                return None
            node = np.asarray(t.column("node"))
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(add[some]), pa.array(node[root[some]])], names=["node", "add", "root"])

        def all_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = cell_of(parts) if parts else None
            if found is not None:
                yield found

        last = None
        for batch in batches:
            names = ("dim", "tab", "key", "i", "j")
            where = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in names])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                now = tuple(where[:, lo].tolist())
                if now != last:
                    yield from all_of(held)
                    held, last = [], now
                held.append(batch.slice(lo, hi - lo))
        yield from all_of(held)

    out = written(cells.mapInArrow(compare, "node long, add long, root long"), "links")
    dropped(placed, sizes)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, functions: int = 2, probes: int = 4, miss: float = 1e-4) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links at a cosine of ``threshold`` or more."""
    bounded_batches(vectors.sparkSession)
    kind = next(f.dataType for f in vectors.schema if f.name == "embedding").simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    fine = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("x", F.when(fine, F.col("x")))
    rows = rows.withColumn("h", F.xxhash64("x")).withColumn("g", F.hash("x"))
    one = rows.where("x IS NOT NULL").select("vec_id", "x", "h", "g").distinct()
    one = one.groupBy("x", "h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    classes = written(one.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = links(classes, threshold, functions, probes, miss)
    counts = found.groupBy("node").agg(F.sum("add").alias("n"))
    reached = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    reached = written(reached.join(classes.select("node", "rep"), "node"), "reached")
    least = written(reached.groupBy("component").agg(F.min("rep").alias("least")), "least")
    named = reached.join(least, "component").select("node", "least")
    about = classes.select("node", "h", "g", "rep", "w").join(counts, "node", "left").join(named, "node", "left")
    about = written(about.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("least", "rep").alias("least")), "about")
    ids = rows.select("vec_id", F.when(F.col("x").isNotNull(), F.col("h")).alias("h"), "g")
    out = ids.join(about, ["h", "g"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def one_of_each(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The rows with all their columns, of each component the smallest id, and every row without id."""
    found = near_duplicates(vectors, threshold).where("kept AND vec_id IS NOT NULL").select(F.col("vec_id").alias("_kept")).distinct()
    return vectors.join(found, vectors["vec_id"].cast("long") == found["_kept"], "left_semi").unionByName(vectors.where("vec_id IS NULL"))
