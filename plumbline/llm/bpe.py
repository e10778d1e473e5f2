"""Byte-level BPE over a global shuffle of distinct words.

1. Every partition splits its texts into pre-tokens and numbers the distinct words of a block of
   documents; a document becomes the sequence of its word numbers, a position for each pre-token.
2. The blocks' words are dealt to buckets by hash, so all copies of a word in the corpus meet in one task,
   once per block however often it occurs there; that task merges each distinct word once.  Words travel
   packed, a row a block and bucket: a row a block and word took more than the disk allows (see the README).
3. The ids go back to the blocks, and documents are reassembled by position.  Decoding joins the ids
   with the token-byte table, which the vocabulary bounds (about 50,000 rows, under 1 MB).

A block's key hashes its place and content, so a block that a recomputed task cut differently can't meet the
ids of another one: it raises instead.

Defined results: null texts are empty, an empty text has no ids and the hash of no bytes; repeated
rows give repeated results; very long texts and very long single words are whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pack, slim, texts, unpack

#: Characters of text in a block, and distinct words a merging worker remembers.
BLOCK_CHARS, MEMO_WORDS = 24_000_000, 1_000_000
ROUTED = "block long, part long, kind int, payload binary, size long"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """Byte pair merges by rank: always the lowest ranked adjacent pair, the leftmost on a tie."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __call__(self, word: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if stop[i] else n
            if j >= n or stop[j] != end:  # one of the two was merged meanwhile
                continue
            k = after[j]
            after[i], stop[i], stop[j] = k, end, 0
            if k < n:
                before[k] = i
                if (r := ranks.get(word[i : stop[k]])) is not None:
                    heapq.heappush(heap, (r, i, stop[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(word[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : stop[i]]])
            i = after[i]
        return out


class Numbering(dict):
    """Numbers keys in the order they first come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _split_blocks(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        find = regex.compile(pattern).findall

        def block() -> Iterator[pa.RecordBatch]:
            key = seal.intdigest() - (1 << 63)
            # frequent words get small numbers
            seq, words = np.concatenate(seqs), [w.encode() for w in numbers]
            often = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
            number = np.empty(len(words), "<i4")
            number[often] = np.arange(len(words))
            words = [words[i] for i in often.tolist()]
            payload, size = pack(np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "u1"), np.array([len(s) for s in seqs], "<i8"), number[seq])
            yield _rows([(key, key, 0, payload, size)], ROUTED)
            part = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=buckets))
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                mine = [words[i] for i in order[a:b].tolist()]
                payload, size = pack(np.diff(order[a:b], prepend=0).astype("<i4"), np.array([len(w) for w in mine], "<i4"), np.frombuffer(b"".join(mine), "u1"))
                rows.append((key, int(part[order[a]]), 1, payload, size))
            if rows:
                yield _rows(rows, ROUTED)

        task = TaskContext.get()
        mark, nr = f"{task.partitionId() if task else 0}", 0  # equal blocks of different places stay apart
        docs, seqs, numbers, chars, seal = [], [], Numbering(), 0, xxhash.xxh64(f"{mark}/{nr}")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
                found = find(text)
                docs.append(doc)
                seqs.append(np.fromiter(map(numbers.__getitem__, found), "<i4", len(found)))
                seal.update(f"{doc}\0{len(text)}\0".encode())
                seal.update(text.encode())
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield from block()
                    nr += 1
                    docs, seqs, numbers, chars, seal = [], [], Numbering(), 0, xxhash.xxh64(f"{mark}/{nr}")
        if docs:
            yield from block()

    return run


def _merge_words(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, known = Merger(load_ranks(ranks_path)), {}
        for batch in batches:
            for block, part, kind, payload, size in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    yield _rows([(block, part, 0, payload, size)], ROUTED)
                    continue
                where, lengths, joined = unpack(payload, size, "<i4", "<i4", "u1")
                joined, at, ids, counts = joined.tobytes(), 0, [], []
                for n in lengths.tolist():
                    word = joined[at : at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        if len(known) >= MEMO_WORDS:
                            known.clear()
                        got = known[word] = merge(word)
                    ids += got
                    counts.append(len(got))
                # word numbers go back as they came, as steps from one to the next
                yield _rows([(block, part, 1, *pack(where, np.array(counts, "<i4"), np.array(ids, "<u4")))], ROUTED)

    return run


def decode_ids(ids: list[int], token_bytes: list[bytes]) -> bytes:
    """The bytes of an id sequence, by a join with the token-byte table."""
    return b"".join(map(token_bytes.__getitem__, ids))


def _reassemble(ranks_path: str, with_ids: bool):
    tables: dict[str, list[bytes]] = {}

    def run(group: pa.Table) -> pa.Table:
        if not tables:  # once per worker
            ranks = load_ranks(ranks_path)
            table = [b""] * (max(ranks.values(), default=0) + 1)
            for token, rank in ranks.items():
                table[rank] = token
            tables["bytes"] = table
        token_bytes = tables["bytes"]
        kinds, payloads, sizes = (group.column(c).to_pylist() for c in ("kind", "payload", "size"))
        parts = [unpack(p, s, "<i4", "<i4", "<u4") for k, p, s in zip(kinds, payloads, sizes) if k == 1]
        n_words = sum(len(p[0]) for p in parts)
        by_word: list[list[int] | None] = [None] * n_words
        for where, counts, ids in parts:
            ends, ids = np.cumsum(counts).tolist(), ids.tolist()
            begin = 0
            for w, end in zip(np.cumsum(where).tolist(), ends):
                if w >= n_words:
                    raise ValueError("a block met the words of another one; the task must run again")
                by_word[w] = ids[begin:end]
                begin = end
        said = [",".join(map(str, x)) for x in by_word]
        rows = []
        for kind, payload, size in zip(kinds, payloads, sizes):
            if kind:
                continue
            docs, nulls, lengths, seq = unpack(payload, size, "<i8", "u1", "<i8", "<i4")
            if len(seq) and int(seq.max()) >= n_words:
                raise ValueError("a block lacks words; the task must run again")
            at, seq = 0, seq.tolist()
            for doc, null, n in zip(docs.tolist(), nulls.tolist(), lengths.tolist()):
                mine = seq[at : at + n]
                at += n
                ids: list[int] = []
                for w in mine:
                    ids += by_word[w]
                row = (None if null else doc, len(ids), hashlib.sha256(",".join([said[w] for w in mine]).encode()).hexdigest(), hashlib.sha256(decode_ids(ids, token_bytes)).hexdigest(), n)
                rows.append((*row, np.array(ids, "<u4").tobytes()) if with_ids else row)
        return pa.Table.from_batches([_rows(rows, RESULT + (", ids binary" if with_ids else ""))])

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token count and digests of ids and decoded bytes per document; ``with_ids`` adds the ids (uint32, little-endian)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = slim(docs).mapInArrow(_split_blocks(pattern, buckets), ROUTED)
    # documents of a block travel with its key, words with their bucket: one exchange serves both
    merged = blocks.repartition(buckets, F.col("part")).mapInArrow(_merge_words(ranks_path), ROUTED)
    return merged.groupBy("block").applyInArrow(_reassemble(ranks_path, with_ids), RESULT + (", ids binary" if with_ids else ""))
