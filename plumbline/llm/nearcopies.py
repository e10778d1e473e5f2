"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one class.  Other candidates share one of ``BANDS`` keys, each made of ``ROWS`` minimum
hashes: a pair at exactly 0.8 has none in common once in 20,000 times, a closer pair more rarely.  Every
link is a candidate pair whose exact Jaccard reaches the threshold.

Buckets are first compared with one leader, the member that stands in the largest buckets (of a group
of edited copies the one nearest to all).  What a bucket then still holds in different components meets
in cells of two tiles, exactly, over an index of the shingles in the cell; a cell returns a spanning
forest, so no group emits its pairs and none is gathered in one task.

Defined results: words are those of the fingerprints of operator 10; fewer words than a shingle give one
shingle; texts without words are one class; repeated rows repeat; rows with a null id are never linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, dropped, slim, texts, written
from .simhash import LOWER, WORDS, Forest, once_each

WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
#: Members of a bucket that one task compares with their leader.
SLICE = 2_000
#: Members of a bucket in one tile, and about how many bytes of their sets.
TILE, TILE_BYTES = 2_048, 8 << 20
_ODD = np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS + ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    import xxhash

    encoded = [w.encode() for w in WORDS.findall(text.translate(LOWER))]
    if not encoded:
        return np.zeros(0, np.uint64)
    joined = b" ".join(encoded)
    k = min(width, len(encoded))
    ends = np.cumsum([len(w) + 1 for w in encoded]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    found = {digest(joined[a:b], 42) for a, b in zip(starts[: len(encoded) - k + 1].tolist(), ends[k - 1 :].tolist())}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the minima of the set under ROWS of the hash functions."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        low = np.minimum(low, (hashes[at : at + 512, None] * _ODD[None, : BANDS * ROWS]).min(axis=0))
    return (low.reshape(BANDS, ROWS) * _ODD[BANDS * ROWS :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[0]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit key of the shingle set, the set's size, and the keys of its bands."""
    import xxhash  # noqa: F401  (fails here rather than in a task)

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, sizes, bands = [], [], []
            for text in texts(batch):
                found = shingles(text)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                bands.append(band_keys(found).view(np.int64) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "size", "bands"])

    return slim(docs).mapInArrow(run, "doc_id long, key binary, size long, bands array<long>")


def sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in texts(batch)], pa.binary())], names=["node", "held"])

    return slim(docs).mapInArrow(run, "node long, held binary")


def verified(pairs: DataFrame, held: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold; a ``b`` of many pairs is dealt in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(batch.schema.get_field_index(c)) for c in ("left", "right"))
            near = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    slices = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / SLICE).alias("slices")), "slices")
    pairs = pairs.join(slices.where("slices > 1"), "b", "left").withColumn("slice", F.pmod(F.xxhash64("a"), F.coalesce("slices", F.lit(1))))
    left = pairs.join(held.select(F.col("node").alias("a"), F.col("held").alias("left")), "a").select("a", "b", "slice", "left")
    right = held.join(slices, held.node == slices.b).select("b", F.col("held").alias("right"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    return left.join(right.hint("merge"), ["b", "slice"]).select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def joins(sets: list[np.ndarray], component: np.ndarray, similarity: float = SIMILARITY, between: int | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of positions whose similarity reaches the threshold, as few as join all components that such pairs join.

    ``between``: only pairs of a position below it with one from it on.  One end of a pair lies outside the
    largest component, so only the others look up who shares their shingles.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    counts, ends = np.bincount(ids), np.cumsum(sizes)
    starts, owners = np.cumsum(counts) - counts, np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    labels = np.unique(component, return_inverse=True)[1]
    forest, right = Forest(int(labels.max()) + 1), np.arange(n) >= (between or 0)
    for x in np.flatnonzero(labels != np.bincount(labels).argmax()).tolist():
        mine = ids[ends[x] - sizes[x] : ends[x]]
        width = counts[mine]
        at = np.repeat(starts[mine] - np.cumsum(width) + width, width) + np.arange(width.sum())
        both = np.bincount(owners[at], minlength=n)
        near = (both / np.maximum(sizes + sizes[x] - both, 1) >= similarity) & (labels != labels[x])
        if between is not None:
            near &= right != right[x]
        hits = np.flatnonzero(near)
        for y in hits[np.unique(labels[hits], return_index=True)[1]].tolist():
            if forest.join(int(labels[x]), int(labels[y])):
                yield x, y


def across(rows: DataFrame, held: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) that join the members ``rep`` of each bucket which ``component`` keeps apart although they are similar.

    A bucket is cut into tiles of bounded rows and bytes, and each pair of tiles is one task's cell.
    """
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") * 8 / TILE_BYTES)).cast("int")
    tiles = written(rows.groupBy("bucket").agg(tiles.alias("tiles")), "tiles")
    placed = rows.join(tiles, "bucket").withColumn("mine", F.pmod(F.xxhash64("rep", "bucket"), F.col("tiles")).cast("int"))
    placed = placed.join(held, placed.rep == held.node).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = placed.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "component", "held")

    def compare(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        first = group.column("mine").to_numpy() == i
        order = np.argsort(~first, kind="stable")
        rep, component = (group.column(c).to_numpy()[order] for c in ("rep", "component"))
        sets = [np.frombuffer(group.column("held")[k].as_py(), np.uint64) for k in order.tolist()]
        found = list(joins(sets, component, similarity, None if i == j else int(first.sum())))
        a, b = (rep[np.array([x[k] for x in found], dtype=np.int64)] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links) of every document."""
    own = written(sketches(docs), "sketches")
    classes = written(own.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")), "classes")
    rows = classes.where("rep IS NOT NULL").select("rep", "size", F.explode("bands").alias("bucket"))
    large = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    rows = written(rows.join(large, "bucket"), "rows")
    weights = written(rows.groupBy("rep").agg(F.sum("n").alias("weight")), "weights")
    held = written(sets(docs.join(weights, docs["doc_id"].cast("long") == weights["rep"], "left_semi")).distinct(), "sets")
    close = lambda x, y: F.least(x, y) >= F.lit(SIMILARITY) * F.greatest(x, y)
    leaders = rows.join(weights, "rep").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("rep"), "size")).alias("l"))
    leaders = written(leaders.select("bucket", (-F.col("l.col2")).alias("b"), F.col("l.size").alias("other")), "leaders")
    pairs = rows.join(leaders, "bucket").where((F.col("rep") != F.col("b")) & close(F.col("size"), F.col("other")))
    pairs = written(pairs.select(F.col("rep").alias("a"), "b").distinct(), "pairs")
    first = written(verified(pairs, held), "first")
    dropped(large, weights, leaders, pairs)
    found = written(components(first), "found")
    # members of a bucket that are still in different components meet in cells
    labelled = written(rows.join(found, rows.rep == found.node, "left").select("bucket", "rep", "size", F.coalesce("component", "rep").alias("component")), "labelled")
    mixed = written(labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket"), "mixed")
    rest = written(labelled.join(mixed, "bucket"), "rest")
    dropped(rows, found, labelled, mixed)
    links = written(first.union(across(rest, held)), "links")
    dropped(first, rest, held)
    found = components(links)
    classes = classes.join(found, classes.rep == found.node, "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return own.select("doc_id", "key").join(classes, "key").select("doc_id", "component_id")


def merged(*found: DataFrame) -> DataFrame:
    """(node, component) of the groups that all links of the tables ``found(doc_id, component_id)`` make together."""
    edges = [f.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")) for f in found]
    return components(written(reduce(DataFrame.union, edges), "links"))


def one_of_each(docs: DataFrame, *other: DataFrame) -> DataFrame:
    """The documents with all their columns: of each group the smallest id, and every row without id.

    ``other``: groups (doc_id, component_id) of other links, which count beside those of this module.  Repeated
    rows of one id stay once, rows of one id with different texts all (null counts as empty).
    """
    if other:
        gone = merged(groups(docs), *other).where("node <> component").select(F.col("node").alias("_gone"))
        return once_each(docs.where("doc_id IS NOT NULL").join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")).unionByName(docs.where("doc_id IS NULL"))
    found = groups(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return once_each(docs.join(found, docs["doc_id"].cast("long") == found["_kept"], "left_semi")).unionByName(docs.where("doc_id IS NULL"))
