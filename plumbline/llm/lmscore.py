"""Cross-entropy difference between a target and a background bigram model.

Both models share one vocabulary, all words of the corpus, and one smoothing; the target model is counted
over documents whose label says good quality, the background model over all documents.  A document's
score is the mean over its tokens of background loss minus target loss: higher means closer to the target.

Nothing is cut off.  With counts c, a prior M (``PRIOR``), N tokens and V words,

    P(w | u) = (c(u, w) + M P(w)) / (c(u) + M),    P(w) = (c(w) + 1) / (N + V),

so the probabilities of all words after any u, seen or not, add up to one; the start of a document is a u like
any other, and c(u) counts how often u is followed.

1. Documents meet their mark by id.  Tasks gather blocks of documents and write them as sequences of word numbers
   with the hashes of the block's words.
2. Each block sends its words and its pairs of words, each once with its counts in the block, to buckets by
   hash, sorted and packed, a row a block and bucket.  A bucket adds up all blocks and answers each in its order.
3. The answers go back to the blocks, which score their documents.

Buckets are even whatever words are frequent: a word or pair comes once a block.  Words and pairs are told apart by
64-bit hashes.  Written blocks are never computed again, so block numbers hold whatever executor is lost.

Defined results: words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null and empty
texts have no tokens and score 0 with null losses; with no target documents both models are the background;
repeated rows count and score each; rows with a null id are never target documents; very long texts are
whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, bounded_batches, pack, slim, texts, unpack, written

PRIOR = 20.0
#: Bytes of text in a block.
BLOCK_BYTES = 24_000_000
BLOCKS_SQL = "block long, payload binary, size long, n_all long, n_target long"
PARTS_SQL = "block long, bucket int, payload binary, size long"
ANSWERS_SQL = "block long, bucket int, payload binary, size long, words long"
SCORED_SQL = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _batch(schema: str, *columns) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Numbering(dict):
    """Numbers words from 1 in the order they first come; 0 is the start of a document."""

    def __missing__(self, key):
        self[key] = n = len(self) + 1
        return n


class Block:
    """Documents of a block on the way to being written."""

    def __init__(self):
        self.bytes, self.numbers = 0, Numbering()
        self.docs: list[int | None] = []
        self.seqs: list[np.ndarray] = []
        self.good: list[bool] = []

    def add(self, doc: int | None, text: bytes, good: bool) -> None:
        words = words_of(text)
        self.docs.append(doc)
        self.seqs.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.good.append(good)
        self.bytes += len(text)

    def row(self, number: int) -> pa.RecordBatch:
        import xxhash

        lengths, seq = np.array([len(s) for s in self.seqs], np.int64), np.concatenate(self.seqs)
        size = len(self.numbers) + 1
        hashes = np.zeros(size, np.uint64)  # of the start: 0
        hashes[1:] = np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), np.uint64, size - 1)
        # frequent words get small numbers, which pack well
        order = np.append(0, 1 + np.argsort(-np.bincount(seq, minlength=size)[1:], kind="stable"))
        number_of = np.empty(size, np.int32)
        number_of[order] = np.arange(size)
        payload, packed = pack(np.array([d or 0 for d in self.docs], np.int64), np.array([d is None for d in self.docs], np.int8), lengths, np.array(self.good, np.int8), number_of[seq], hashes[order])
        return _batch(BLOCKS_SQL, [number], [payload], [packed], [len(seq)], [int(lengths[np.array(self.good, bool)].sum())])


@dataclass
class Counted:
    """A block as read back: its documents, and its words and pairs with their counts in all and in target documents."""

    docs: np.ndarray
    nulls: np.ndarray
    lengths: np.ndarray
    place: np.ndarray  # of each token: the number of its pair
    u: np.ndarray
    w: np.ndarray
    pair_keys: np.ndarray
    pairs: list[np.ndarray]
    word_keys: np.ndarray
    words: list[np.ndarray]  # occurrences, then how often followed

    @classmethod
    def read(cls, payload: bytes, size: int) -> Counted:
        docs, nulls, lengths, good, seq, hashes = unpack(payload, size, "<i8", "i1", "<i8", "i1", "<i4", "<u8")
        before = np.concatenate([[0], seq[:-1]])[: len(seq)].astype(np.int64)
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
        codes, place = np.unique(before << 32 | seq, return_inverse=True)
        u, w = codes >> 32, codes & 0xFFFFFFFF
        marked = np.repeat(good.astype(bool), lengths)
        counts = lambda at, n: [np.bincount(x, minlength=n).astype("<u4") for x in (at, at[marked])]
        return cls(docs, nulls, lengths, place, u, w, mixed(hashes[u], hashes[w]), counts(place, len(codes)), hashes, counts(seq, len(hashes)) + counts(before, len(hashes)))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for _ in range(2):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys; buckets are even ranges of the hash."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def blocks_of(docs: DataFrame, target: DataFrame) -> DataFrame:
    """A row a block.  ``target`` has the doc_id of every target document, of any number."""
    marks = target.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("good")).where("doc_id IS NOT NULL").distinct()

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pa.compress(t, "zstd", asbytes=True) if t else b"" for t in raw], pa.binary()), pa.array(list(map(len, raw)), pa.int64())], names=["doc_id", "packed", "size"])

    # a hash join keeps texts unsorted; adaptive execution may cut a partition of texts that is too large
    small = slim(docs).mapInArrow(shrink, "doc_id long, packed binary, size long")
    marked = small.join(marks.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "packed", "size", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for doc, packed, size, good in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                block.add(doc, pa.decompress(packed.as_py(), size, "zstd", asbytes=True) if size else b"", good)
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(number)
                    number, block = number + 1, Block()
        if block.docs:
            yield block.row(number)

    return written(marked.mapInArrow(run, BLOCKS_SQL), "blocks")


def parts_of(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each block sends to each bucket: sorted keys and counts of pairs, then of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, size in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                held, rows = Counted.read(payload, size), []
                sides = []
                for keys, counts in ((held.pair_keys, held.pairs), (held.word_keys, held.words)):
                    order = np.argsort(keys)
                    sides.append((keys[order], [c[order] for c in counts], cuts(keys[order], buckets)))
                for b in range(buckets):
                    arrays = []
                    for keys, counts, at in sides:
                        arrays += [x[at[b] : at[b + 1]] for x in (keys, *counts)]
                    if len(arrays[0]) or len(arrays[3]):
                        for k in (0, 3):
                            arrays[k] = np.diff(arrays[k], prepend=np.uint64(0))
                        rows.append((block, b, *pack(*arrays)))
                if rows:
                    yield _batch(PARTS_SQL, *zip(*rows))

    return blocks.select("block", "payload", "size").mapInArrow(run, PARTS_SQL)


PART = ("<u8", "<u4", "<u4", "<u8", "<u4", "<u4", "<u4", "<u4")


def answered(parts: DataFrame) -> DataFrame:
    """The counts of all blocks together, for each block in the order it sent; ``words`` adds up to the vocabulary."""

    def run(group: pa.Table) -> pa.Table:
        blocks, sizes = group.column("block").to_pylist(), group.column("size").to_pylist()
        held = [unpack(p.as_py(), n, *PART) for p, n in zip(group.column("payload"), sizes)]
        answers: list[list[np.ndarray]] = [[] for _ in held]
        for first, width in ((0, 2), (3, 4)):
            keys, back = np.unique(np.concatenate([np.cumsum(h[first], dtype=np.uint64) for h in held]), return_inverse=True)
            ends = np.cumsum([0, *(len(h[first]) for h in held)])
            for c in range(width):
                sums = np.bincount(back, np.concatenate([h[first + 1 + c] for h in held]), len(keys)).astype("<i8")
                if first and not c:
                    words = int((sums > 0).sum())
                for k, a in enumerate(answers):
                    a.append(sums[back[ends[k] : ends[k + 1]]])
        packed = [pack(*a) for a in answers]
        rows = [(b, group.column("bucket")[0].as_py(), *p, words if k == 0 else 0) for k, (b, p) in enumerate(zip(blocks, packed))]
        return pa.Table.from_batches([_batch(ANSWERS_SQL, *zip(*rows))])

    return written(parts.groupBy("bucket").applyInArrow(run, ANSWERS_SQL), "answers")


def losses(pair: np.ndarray, word: np.ndarray, follow: np.ndarray, held: Counted, total: int, size: int) -> np.ndarray:
    """-log P(w | u) of each pair of a block."""
    back = (word[held.w] + 1) / (total + size)
    return -np.log((pair + PRIOR * back) / (follow[held.u] + PRIOR))


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = blocks_of(docs, target)
    answers = answered(parts_of(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    n_all, n_target = (int(x or 0) for x in blocks.agg(F.sum("n_all"), F.sum("n_target")).first())
    size = int(answers.agg(F.sum("words")).first()[0] or 0)

    def run(mine: pa.Table, given: pa.Table) -> pa.Table:
        held = Counted.read(mine.column("payload")[0].as_py(), mine.column("size")[0].as_py())
        order = np.argsort(given.column("bucket").to_numpy())
        got = [unpack(given.column("payload")[int(k)].as_py(), given.column("size")[int(k)].as_py(), *["<i8"] * 6) for k in order]
        sums = [np.concatenate(x) for x in zip(*got)]
        if len(sums[0]) != len(held.pair_keys) or len(sums[2]) != len(held.word_keys):
            raise ValueError("a block lacks answers")
        for keys, columns in ((held.pair_keys, sums[:2]), (held.word_keys, sums[2:])):
            at = np.argsort(keys)
            for c in columns:
                c[at] = c.copy()
        every = losses(sums[0], sums[2], sums[4], held, n_all, size)
        good = losses(sums[1], sums[3], sums[5], held, n_target, size) if n_target else every
        some, none = np.flatnonzero(held.lengths), held.lengths == 0
        starts = (np.cumsum(held.lengths) - held.lengths)[some]
        means = []
        for loss in (good, every):
            mean = np.zeros(len(held.lengths))
            if len(some):
                mean[some] = np.add.reduceat(loss[held.place], starts) / held.lengths[some]
            means.append(mean)
        columns = [pa.array(held.docs, mask=held.nulls.astype(bool)), pa.array(held.lengths), *(pa.array(m, mask=none) for m in means), pa.array(means[1] - means[0])]
        return pa.table(columns, names=[c.split()[0] for c in SCORED_SQL.split(", ")])

    return blocks.select("block", "payload", "size").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORED_SQL)
