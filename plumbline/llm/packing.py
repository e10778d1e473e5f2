"""Sum-of-squares online packing of token pieces into windows.

A window holds ``capacity`` tokens.  N[h] counts the open windows filled to level h.  A piece of s
tokens goes to the level whose choice makes the sum of N[h]^2 smallest: moving a window from h to
h + s changes it by 2 (N[h+s] - N[h]) + 2, a new window by 2 N[s] + 1, filling one up by 1 - 2 N[h].
Ties go to the fullest level.  Each partition packs its own documents, so nothing is shuffled and a
lost task repeats alone.  When a partition ends, the fuller of its open windows stay as the method filled them,
and the emptiest give up their pieces, cut where needed, to fill these; what is left of the last one goes to
windows of a power of two, so nothing is padded.  ``relaid`` marks the pieces that were given up.

Defined results: a null or empty text is the single end id; long documents are cut at ``capacity``;
repeated rows are packed as separate documents; an empty table gives no pieces; other columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches, slim, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, relaid boolean"
#: Chunks whose ids a task remembers before it starts anew; texts encoded together.
CACHE_WORDS, GROUP = 600_000, 2_000
PUNCTUATION = ".,;:!?|%*&#$"


class LevelArray:
    """The open windows by fill level, and the rule that picks one."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def choose(self, size: int) -> int:
        """The level (0: a new window) at which a piece of ``size`` tokens costs least."""
        n, top = self.counts, self.capacity - size
        cost = 2 * (n[size : size + top + 1] - n[: top + 1]) + 2
        cost[0] = 2 * n[size] + 1
        cost[top] = 1 - 2 * n[top] if top else 0
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Put a piece (doc, start, ids, doc_tokens) into a window; the window if that filled it."""
        size = len(piece[2])
        level = self.choose(size)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.counts[level + size] += 1
        self.open[level + size].append(window)
        return None

    def drain(self) -> Iterator[list]:
        """The open windows without padding: the emptiest give their pieces to fill the fuller ones.

        Pieces that moved carry a fifth field, true.
        """
        held = deque(w for level in range(self.capacity, 0, -1) for w in self.open[level])
        loose: deque[tuple] = deque()  # pieces of the window that is being given up

        def taken(room: int) -> Iterator[tuple]:
            """Pieces of ``room`` tokens, or all there are."""
            while room:
                if not loose:
                    if not held:
                        return
                    loose.extend(held.pop())
                doc, start, ids, total, *_ = loose.popleft()
                if len(ids) > room:
                    loose.appendleft((doc, start + room, ids[room:], total))
                yield doc, start, ids[:room], total, True
                room -= min(room, len(ids))

        while held:
            window = held.popleft()
            window += taken(self.capacity - sum(len(p[2]) for p in window))
            left = sum(len(p[2]) for p in window)
            if left == self.capacity:
                yield window
            else:
                loose.extend(window)
        left = sum(len(p[2]) for p in loose)
        while left:
            room = 1 << (left.bit_length() - 1)
            yield list(taken(room))
            left -= room


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple:
    """The tokenizer of a file, loaded once a process, and which of its ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return tokenizer, ends


class WordTokenizer:
    """Token ids of whole texts from a tokenizer that never joins across white space.

    A text's ids are those of its chunks between spaces and line ends, one after the other, so each
    chunk is encoded once per task and then looked up; a worker keeps nothing of it for other tasks.
    Most chunks are letters with punctuation behind; their lower-cased words are encoded together, as
    one text, and told apart by the tokens that end a word.  All others go to the tokenizer one by one.
    """

    def __init__(self, path: str):
        self.tokenizer, self.ends = _loaded(path)
        # ids as bytes: joining them is one copy, and Python's collector never walks over them
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        raw = self._encode(" ".join(words))
        cuts = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
        if len(cuts) == len(words):
            begin = 0
            for word, end in zip(words, (cuts * 4).tolist()):
                self.words[word] = raw[begin:end]
                begin = end
        else:  # some word is more than one to the tokenizer
            self.words.update((w, self._encode(w)) for w in words)

    def _learn(self, new: set[str]) -> None:
        given = pa.array(list(new), pa.string())
        word = pc.utf8_rtrim(given, PUNCTUATION)
        low = pc.utf8_lower(word)
        # letters only and in the normal form; the dotted capital I becomes two characters elsewhere
        normal = pc.string_is_ascii(word).to_numpy(zero_copy_only=False).copy()
        other = np.flatnonzero(~normal)
        normal[other] = [is_normalized("NFC", w) for w in word.take(pa.array(other)).to_pylist()]
        plain = pc.and_(pc.and_(pc.utf8_is_alpha(word), pc.utf8_is_alpha(low)), pa.array(normal))
        plain = pc.and_not(plain, pc.match_substring(word, "\u0130"))
        chunks, lows = given.filter(plain).to_pylist(), low.filter(plain).to_pylist()
        for c in given.filter(pc.invert(plain)).to_pylist():
            self.chunks[c] = self._encode(c)
        if fresh := set(lows) - self.words.keys():
            self._learn_words(list(fresh))
        tails = [c[len(w) :] for c, w in zip(chunks, lows)]
        for tail in set(tails) - self.tails.keys():
            self.tails[tail] = self._encode(tail)
        words, ends = self.words, self.tails
        self.chunks.update(zip(chunks, [words[w] + ends[t] for w, t in zip(lows, tails)]))

    def many(self, batch: list[str]) -> list[np.ndarray]:
        cut = [t.replace("\n", " ").split(" ") for t in batch]
        if len(self.chunks) > CACHE_WORDS:
            for held in (self.chunks, self.words):
                held.clear()
            self.tails = {"": b""}
        if new := set().union(*cut) - self.chunks.keys():
            self._learn(new)
        known = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(known, chunks)), "<u4") for chunks in cut]

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


def pack_partition(docs: Iterator[tuple[int | None, np.ndarray]], capacity: int) -> Iterator[list]:
    """Windows of pieces (doc, start, ids, doc_tokens) for documents given with their ids."""
    levels = LevelArray(capacity)
    for doc, ids in docs:
        for start in range(0, len(ids), capacity):
            if full := levels.place((doc, start, ids[start : start + capacity], len(ids))):
                yield full
    yield from levels.drain()


def pack(docs: DataFrame, tokenizer: Callable[[], WordTokenizer], end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Pack whole texts.  ``tokenizer`` makes, on the worker, an object whose ``many`` gives the ids of some texts.

    ``sequence_id`` is the partition's number times 2^40 plus a running number.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = tokenizer(), TaskContext.get().partitionId() << 40

        def encoded():
            for batch in batches:
                ids, held = batch.column(0).to_pylist(), list(texts(batch))
                for at in range(0, len(held), GROUP):
                    for doc, tokens in zip(ids[at : at + GROUP], encode.many(held[at : at + GROUP])):
                        yield doc, np.concatenate([tokens, end])

        rows: list[tuple] = []
        for k, window in enumerate(pack_partition(encoded(), capacity)):
            at = 0
            for doc, start, ids, total, *moved in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + k, at, bool(moved)))
                at += len(ids)
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return slim(docs).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def word_bpe(path: str) -> Callable[[], WordTokenizer]:
    return lambda: WordTokenizer(path)
