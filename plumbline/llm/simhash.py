"""SimHash fingerprints, and links between those that differ in few bits.

Fingerprints are compared exactly, in tiles, by numpy exclusive-or and bit counts; tiles are sorted by
population count, and a pair of tiles whose counts differ beyond the radius is skipped unread.  Which
fingerprints share a tile task is decided by pigeonhole: 64 bits are cut into radius + 2 parts, so two
fingerprints within the radius agree on at least two whole parts, and each pair of parts with its
values keys a bucket.  No link is lost and the work does not grow with the square of the table.  A
bucket over ``tile`` fingerprints is dealt as pairs of tiles to separate tasks.  A task returns only a
spanning forest of its links.

Defined results: texts without words have fingerprint zero and link like any other; fewer words than
a shingle give one shingle; equal fingerprints are one class, whose members are never paired; repeated
rows repeat; rows with a null id have a fingerprint and the component of their class (null if the class
has only null ids); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, slim, texts, written

BITS = 64
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if more than half of the shingles' hashes have it set."""
    import xxhash

    words = WORDS.findall(text.translate(LOWER))
    if not words:
        return 0
    encoded = [w.encode() for w in words]
    joined = b" ".join(encoded)
    ends = np.cumsum([len(w) + 1 for w in encoded]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    total = np.zeros(BITS, dtype=np.int64)
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 4096):
        total += np.unpackbits(packed[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width, seed) for t in texts(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return slim(docs).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union-find over positions; ``join`` says whether it joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def tiled_links(fps: np.ndarray, radius: int, tile: int = 512, between: int | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest, as positions, of all pairs within ``radius``.

    ``between``: only pairs of a position below it with one from it on.
    """
    counts = np.bitwise_count(fps)
    sides = [np.arange(len(fps))] if between is None else [np.arange(between), np.arange(between, len(fps))]
    tiles = [[s[i : i + tile] for i in range(0, len(s), tile)] for s in (side[np.argsort(counts[side], kind="stable")] for side in sides)]
    forest = Forest(len(fps))
    for i, left in enumerate(tiles[0]):
        low, high = int(counts[left[0]]), int(counts[left[-1]])
        for right in tiles[-1][i if between is None else 0 :]:
            if int(counts[right[0]]) - high > radius or low - int(counts[right[-1]]) > radius:
                continue
            near = np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= radius
            for a, b in zip(*(x.tolist() for x in np.nonzero(near))):
                x, y = int(left[a]), int(right[b])
                if x != y and forest.join(x, y):
                    yield x, y


def _keys(radius: int):
    """Masks of the bits that two parts cover, for every pair of the radius + 2 parts."""
    parts = np.array_split(np.arange(BITS), radius + 2)
    return [sum(1 << int(b) for p in pair for b in p) for pair in combinations(parts, 2)]


def links(classes: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """Edges (a, b) between representatives ``rep`` of distinct ``fp`` that join all within ``radius``."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("value")) for k, m in enumerate(_keys(radius))])
    rows = classes.select("rep", "fp", F.explode(slots).alias("k")).select("rep", "fp", F.xxhash64("k.slot", "k.value").alias("bucket"))
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    rows = rows.join(sizes, "bucket")
    # a large bucket's fingerprints are spread over tiles, and every pair of tiles is a task
    rows = rows.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("mine", F.pmod(F.xxhash64("fp", "bucket"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("rep", "fp", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")

    def compare(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        first = group.column("mine").to_numpy() == i
        order = np.argsort(~first, kind="stable")
        rep, fps = group.column("rep").to_numpy()[order], group.column("fp").to_numpy().astype(np.int64).view(np.uint64)[order]
        found = list(tiled_links(fps, radius, between=None if i == j else int(first.sum())))
        a, b = (np.array([x[k] for x in found], dtype=np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(rep[a], pa.int64()), "b": pa.array(rep[b], pa.int64())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def groups(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every document."""
    fps = written(fingerprints(docs, width, seed), "fps")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(classes.where("rep IS NOT NULL"), radius))
    classes = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def once_each(docs: DataFrame) -> DataFrame:
    """One row for each id and text, so that no text goes because another has its id."""
    held = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    return docs.withColumn(held, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", held]).drop(held)


def one_of_each(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The documents with all their columns: of each group the smallest id, and every row without id.

    Repeated rows of one id stay once, rows of one id with different texts all (null counts as empty).
    """
    found = groups(docs, width, radius).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return once_each(docs.join(found, docs["doc_id"].cast("long") == found["_kept"], "left_semi")).unionByName(docs.where("doc_id IS NULL"))
