"""Removal of repeated passages, by Rabin-Karp hashes of every window of 50 words.

A window is judged by its word sequence: its words go if the same sequence also starts in a document
with a smaller id.  Two passes keep the shuffle small:

1. A sieve.  Rabin-Karp hashes of all 25-word grams; of the 26 grams of every window the smallest hash
   is its anchor (winnowing).  Equal windows have equal anchors, so only windows whose anchor occurs in
   two documents can repeat.  About one gram in thirteen is an anchor; they are counted in Spark.
2. The windows with shared anchors are hashed whole (128 bits) and counted: the smallest document of
   each decides.  Marked windows of a document merge into maximal intervals of words.

Exact copies of a text are set aside first: they keep nothing if they hold a window at all, and need
no counting.  Defined results: null and empty texts have no words; fewer words than a window are kept;
rows with a null id neither remove nor lose words; rows that repeat an id are one document for the
comparison and each get its own result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slim, texts, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 50
#: Bases of the polynomial hashes modulo 2^64; odd, so they have inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words, remembered while they fit."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class RabinKarp:
    """Hashes of all grams of a fixed width, from one prefix sum of hash times power of the base."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray, width: int) -> np.ndarray:
        n = len(words)
        if n < width:
            return np.zeros(0, np.uint64)
        if len(self.powers) < n:
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)])) for b in (np.uint64(self.base), np.uint64(self.inverse)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.powers[:n], dtype=np.uint64)])
        h = (sums[width:] - sums[:-width]) * self.inverses[: n - width + 1]
        h ^= h >> np.uint64(32)  # the low bits of a sum of odd multiples say little
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def word_hashes(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` grams the smallest hash (a sliding minimum by doubling)."""
    least, width = grams, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        width += step
    return least


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals [a, b) covered by windows at the sorted ``starts``."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > width)
    first = starts[np.concatenate([[0], breaks + 1])]
    last = starts[np.concatenate([breaks, [len(starts) - 1]])] + width
    return list(zip(first.tolist(), last.tolist()))


def keep_words(words: list[str], copy: bool, starts: pa.Scalar, window: int) -> tuple[list[str] | None, list[tuple[int, int]]]:
    """The words left (None: all of them) and the intervals removed."""
    if copy:
        gone = [(0, len(words))] if len(words) >= window else []
    else:
        gone = intervals(np.asarray(starts.values), window) if starts.is_valid else []
    kept, at = [], 0
    for a, b in gone:
        kept += words[at:a]
        at = b
    return (kept + words[at:] if gone else None), gone


def repeated(docs: DataFrame, window: int = WINDOW, carried: bool = False) -> DataFrame:
    """doc_id, text, starts, copy: the documents with the starts of their windows to remove.

    ``carried``: ``docs`` is (doc_id, text, row) already, and ``row`` comes along.

    ``copy``: the whole text is that of a document with a smaller id; ``starts`` is then null.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    gram, span = (window + 1) // 2, window - (window + 1) // 2 + 1
    # a row is known by its id and its text's hash, so that rows which share an id don't mix
    docs = (docs if carried else slim(docs)).withColumn("tk", F.xxhash64("text"))
    # exact copies: the smallest id of each text stands for all
    keys = docs.where("doc_id IS NOT NULL").select("doc_id", "tk", F.hash("text").alias("g"))
    first = keys.groupBy("tk", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = written(first, "first")
    copies = written(keys.join(first, ["tk", "g"]).where("first < doc_id").select("doc_id", "tk", F.lit(True).alias("copy")).distinct(), "copies")
    work = docs.select("doc_id", "tk", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").join(copies, ["doc_id", "tk"], "left_anti")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, roll = WordHashes(), RabinKarp(BASES[0])
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
                words = WORDS.findall(text)
                if len(words) >= window:
                    found.append(np.unique(anchors(roll(word_hashes(words, known), gram), span)))
                    ids.append(np.full(len(found[-1]), doc, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))], names=["anchor", "doc_id"])

    marks = written(work.mapInArrow(anchored, "anchor long, doc_id long"), "anchors")
    shared = marks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    # written first: between two exchanges a join can be split where one anchor holds very many rows
    shared = written(shared, "shared_anchors")
    per_doc = marks.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    per_doc = written(per_doc, "shared")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, one, two = WordHashes(), *map(RabinKarp, BASES)
        for batch in batches:
            for doc, key, text, mine in zip(batch.column("doc_id").to_pylist(), batch.column("tk").to_pylist(), texts(batch), batch.column("anchors")):
                hashes = word_hashes(WORDS.findall(text), known)
                wanted = np.asarray(mine.values).astype(np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(anchors(one(hashes, gram), span), wanted))
                if len(at):
                    h, g = one(hashes, window)[at], two(hashes, window)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(np.full(len(at), doc, np.int64)), pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32))], names=["h", "g", "doc_id", "tk", "at"])

    candidates = work.join(per_doc, "doc_id").select("doc_id", "tk", "text", "anchors").mapInArrow(windows, "h long, g long, doc_id long, tk long, at int")
    candidates = written(candidates, "windows")
    least = candidates.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "g", "lo")
    least = written(least, "shared_windows")
    starts = candidates.join(least, ["h", "g"]).where("lo < doc_id").groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    starts = written(starts, "starts")
    return docs.join(starts, ["doc_id", "tk"], "left").join(copies, ["doc_id", "tk"], "left").withColumn("copy", F.coalesce("copy", F.lit(False))).drop("tk")


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text and the removal intervals."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string, removed array<struct<first:long,last:long>>" if with_text else "")
    marked = repeated(docs, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            rows = []
            for doc, text, starts, copy in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("starts"), batch.column("copy").to_pylist()):
                words = WORDS.findall(text)
                kept, gone = keep_words(words, copy, starts, window)
                kept = words if kept is None else kept
                joined = " ".join(kept)
                row = (doc, len(words), len(words) - len(kept), hashlib.sha256(joined.encode()).hexdigest())
                rows.append((*row, joined, [{"first": a, "last": b} for a, b in gone]) if with_text else row)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [span]
            columns = list(zip(*rows)) or [[]] * (6 if with_text else 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return marked.mapInArrow(cut, schema)


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows with all their columns; ``text`` is what is left (as it was where nothing goes), ``n_chars`` follows."""
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"))
    marked = repeated(carried, window, carried=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, copy in zip(batch.column("text").to_pylist(), batch.column("starts"), batch.column("copy").to_pylist()):
                if copy or starts.is_valid:
                    kept = keep_words(WORDS.findall(text), copy, starts, window)[0]
                    out.append(" ".join(kept) if kept is not None else text)
                else:
                    out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    row = next(f for f in marked.schema if f.name == "row")
    done = marked.select("row", "text", "starts", "copy").mapInArrow(cut, f"row {row.dataType.simpleString()}, text string")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[changed[c].alias(c) if c in changed else F.col(f"row.{c}") for c in docs.columns])
