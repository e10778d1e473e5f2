"""Detection of periodic runs of words on a harmonic grid.

A run of period p holds two words at least of every residue, so one of the grid points 0, p, 2p, .. and the
word p after it lie in the run; over all periods that makes n log n pairs.  For all (period, grid point) pairs at
once NumPy compares prefix hashes: of a run's stretch of equal words half lies before or behind the grid point,
which sieves the pairs; the longest common extensions of the rest, forwards and backwards, are found by binary search
over all of them together.  Equal (start, end) are one run, whose least period counts.  Every run is verified on the words
themselves; should hashes have lied, that period is searched again word by word.

Texts are worked on in groups of about ``GROUP`` words laid end to end, so that short texts share NumPy calls, and a
period's pairs come in slices of ``SLICE``; a task holds one group and one slice.

Defined results: null and empty texts have no words and no run; a null id leaves the text as it is (there is nothing
to hash); repeated rows each get their result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slim, texts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12
GROUP, SLICE = 60_000, 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c0, c1, ..: the owner of each of their items, and the item's number within it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Prefixes:
    """Prefix sums of word values times powers of an odd base, modulo 2^64."""

    def __init__(self, ids: np.ndarray, seed: int = 42):
        values = np.random.default_rng(seed).integers(1, 1 << 63, size=int(ids.max(initial=0)) + 1, dtype=np.uint64)
        self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(ids), BASE)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[ids] * self.powers[:-1], dtype=np.uint64)])

    def equal(self, i: np.ndarray, j: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Whether ``width`` words from i on are those from j > i on."""
        s = self.sums
        return (s[i + width] - s[i]) * self.powers[j - i] == s[j + width] - s[j]

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Longest common extension from (back: before) i and j, at most ``most``, by binary search for all pairs."""
        long = np.zeros(len(i), np.int64)
        for b in reversed(range(int(most.max(initial=0)).bit_length())):
            at = np.flatnonzero(long + (1 << b) <= most)
            width = long[at] + (1 << b)
            same = self.equal(i[at] - width, j[at] - width, width) if back else self.equal(i[at], j[at], width)
            long[at[same]] += 1 << b
        return long


def wanted(p):
    """Words that equal the one p later, at least, in a run of period p."""
    return np.maximum(p, LEAST - p)


def exact(ids: np.ndarray, p: int) -> list[tuple[int, int]]:
    """The stretches [start, end) of one text with period p, word by word."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids[:-p] == ids[p:]).view(np.int8), [0]])))
    return [(s, e + p) for s, e in edges.reshape(-1, 2).tolist() if e - s >= wanted(p)]


def find(ids: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each of the texts laid end to end in ``ids`` its runs as (start, end, period), in order."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    prefix = Prefixes(ids)
    text, period = spans(sizes // 2)
    period = period + 1
    points = np.maximum(0, (sizes[text] - 1) // np.maximum(period, 1))
    marks, found, at = np.cumsum(points), [], 0
    while at < len(points):
        to = max(at + 1, int(np.searchsorted(marks, (marks[at - 1] if at else 0) + SLICE, "right")))
        owner, k = spans(points[at:to])
        p, t = period[at:to][owner], text[at:to][owner]
        at = to
        i = starts[t] + k * p
        same = np.flatnonzero(ids[i] == ids[i + p])
        i, p, t = i[same], p[same], t[same]
        low, high = i - starts[t], ends[t] - i - p  # words before i, words from i + p on
        need = wanted(p)
        ahead = (need + 1) // 2
        behind = need - ahead + 1
        here = ahead <= high
        here[here] = prefix.equal(i[here], i[here] + p[here], ahead[here])
        there = ~here & (behind <= low)
        there[there] = prefix.equal(i[there] - behind[there], i[there] - behind[there] + p[there], behind[there])
        some = np.flatnonzero(here | there)
        i, p, t, low, high = i[some], p[some], t[some], low[some], high[some]
        f, b = prefix.common(i, i + p, high, False), prefix.common(i, i + p, low, True)
        held = f + b >= wanted(p)
        found.append(np.stack([t, i - b - starts[t], i + f + p - starts[t], p])[:, held])
    rows = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    rows = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)])[: rows.shape[1]]]
    out: list[dict[tuple[int, int], int]] = [{} for _ in sizes]
    again = set()
    for t, s, e, p in rows.T.tolist():
        if (s, e) in out[t]:
            continue  # in order: its least period came first and holds
        a = starts[t]
        mine = ids[a : a + sizes[t]]
        true = np.array_equal(mine[s : e - p], mine[s + p : e]) and (s == 0 or mine[s - 1] != mine[s + p - 1]) and (e == len(mine) or mine[e] != mine[e - p])
        if true:
            out[t][s, e] = p
        else:
            again.add((t, p))
    for t, p in sorted(again):
        for s, e in exact(ids[starts[t] : ends[t]], p):
            out[t][s, e] = min(p, out[t].get((s, e), p))
    return [sorted((s, e, p) for (s, e), p in mine.items()) for mine in out]


def order_of(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place once the text is damaged; None: all as they were."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def longest(found: list[tuple[int, int, int]]) -> tuple:
    """Start, length and period of the longest run; ties go to the smallest start, then period."""
    if not found:
        return None, None, None
    s, e, p = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]))
    return s, e - s, p


def described(doc_id: int | None, words: list[str], found: list[tuple[int, int, int]]) -> tuple:
    """The row of one text."""
    start, length, period = longest(found)
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in sorted(found, key=lambda r: (r[0], r[2])))
    kept = words
    if found:
        turns = np.zeros(len(words) + 1, np.int64)
        for s, e, p in found:
            turns[s + p] += 1
            turns[e] -= 1
        kept = [words[k] for k in np.flatnonzero(np.cumsum(turns[:-1]) == 0).tolist()]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if length is None else 1000 * length // period
    return doc_id, len(found), start, length, period, milli, digest(listed), digest(" ".join(kept)), len(words), len(words) - len(kept)


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def periodic_runs(docs: DataFrame, damage: bool = True) -> DataFrame:
    """The runs of every text: their number, the longest, digests of all of them and of the text without repeats.

    ``damage``: first repeat words of a tenth of the documents, as the contract says.
    """
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2

    def group(held: list[tuple[int | None, list[str], np.ndarray]]) -> pa.RecordBatch:
        all_runs = find(np.concatenate([ids for _, _, ids in held]), np.array([len(ids) for _, _, ids in held]))
        rows = [described(doc, words, found) for (doc, words, _), found in zip(held, all_runs)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, known = [], 0, {}
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
                words = WORDS.findall(text)
                order = order_of(doc, len(words)) if damage else None
                if order is not None:
                    words = [words[k] for k in order.tolist()]
                held.append((doc, words, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))))
                size += len(words)
                if size >= GROUP:
                    yield group(held)
                    held, size, known = [], 0, {}
            if held:
                yield group(held)

    return slim(docs).mapInArrow(run, SCHEMA)
