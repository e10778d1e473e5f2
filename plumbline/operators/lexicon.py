"""Tokens counted, and few queries scored, in the tasks that read the texts: no token of a text is shuffled.

Tokens are those of ``tokens.occurrences``, found in some hundred texts at a time.  What rankings ask of the texts (the queries'
tokens in each, its size, the passages it holds) is read from them once and cached; frequencies and scores come from that.
Rows whose keys repeat are one candidate together, so those alone take the way of ``retrieval``, over a table of tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from . import passages as ps
from . import retrieval as rt
from .topk import Heaps

_IDENTIFIER, _CAMEL = re.compile(rf"[A-Za-z_][A-Za-z0-9_]{{{tokens.MIN_LENGTH - 1},}}"), re.compile(tokens.CAMEL)
_STOP, _STOP_ARRAY = frozenset(tokens.STOPWORDS), pa.array(tokens.STOPWORDS)
#: Bytes that stand in identifiers, and bytes of texts that are cut into tokens together (one text at least).
_WORD, CUT_BYTES = np.array([chr(c).isalnum() or c == 95 for c in range(128)] + [False] * 128), 1 << 20
#: Tokens a task holds before it hands on their counts; rows of queries' tokens that go to every task; cells (text, query) and texts scored together.
HELD, FEW_ROWS, CELLS, TOGETHER = 500_000, 50_000, 4_000_000, 256


@lru_cache(1 << 18)
def pieces(identifier: str) -> tuple[str, ...]:
    """The distinct tokens of one identifier."""
    parts = dict.fromkeys(p.strip("_").lower() for p in (identifier, *_CAMEL.split(identifier), *identifier.split("_")))
    return tuple(p for p in parts if len(p) >= tokens.MIN_LENGTH and not (p.isascii() and p.isdigit()) and p not in _STOP)


def counted(text: str | None) -> dict[str, int]:
    """The tokens of a text with their counts."""
    out: dict[str, int] = {}
    for identifier, n in Counter(_IDENTIFIER.findall(text or "")).items():
        if "_" not in identifier and identifier[1:].islower():  # a plain word is one token
            if (token := identifier.lower()) not in _STOP:
                out[token] = out.get(token, 0) + n
        else:
            for token in pieces(identifier):
                out[token] = out.get(token, 0) + n
    return out


class Tally(NamedTuple):
    """The tokens of some texts: ``n[k]`` times ``tokens[token[k]]`` stands in text ``text[k]``, ordered by text; ``sizes`` are their distinct tokens."""

    tokens: pa.Array
    text: np.ndarray
    token: np.ndarray
    n: np.ndarray
    sizes: np.ndarray


def ranges(starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``times[k]`` numbers from ``starts[k]`` on, for each k."""
    return np.repeat(starts - (np.cumsum(times) - times), times) + np.arange(times.sum())


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The stretches of letters, digits and underscores of some texts, and the text in which each stands; those too short for a token are left out."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, ends = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = ends[(ends > 0) & (ends < len(data))]  # no word goes on from text to text
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    begin, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= begin
    long = size >= tokens.MIN_LENGTH
    begin, size = begin[long], size[long]
    mark = np.zeros(len(data) + 1, np.int8)
    mark[begin] += 1
    mark[begin + size] -= 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)])])
    return words, np.searchsorted(ends[1:], begin, "right")


def tallied(texts: pa.Array) -> Tally:
    words, text = words_of(texts)
    coded = words.dictionary_encode()
    run, names = np.asarray(coded.indices), pc.ascii_ltrim(coded.dictionary, characters="0123456789")  # no identifier begins with a digit
    cut = np.asarray(pc.match_substring_regex(names, pattern="_|[a-z0-9][A-Z]"))
    plain = np.flatnonzero(~cut & (np.asarray(pc.binary_length(names)) >= tokens.MIN_LENGTH))
    lower = pc.ascii_lower(names.take(pa.array(plain)))
    kept = np.asarray(pc.invert(pc.is_in(lower, value_set=_STOP_ARRAY.cast(lower.type))))
    cut = np.flatnonzero(cut)
    parts = [pieces(name) if len(name) >= tokens.MIN_LENGTH else () for name in names.take(pa.array(cut)).to_pylist()]
    all_tokens = pa.concat_arrays([lower.filter(pa.array(kept)), pa.array([t for some in parts for t in some], lower.type)]).dictionary_encode()
    owner = np.concatenate([plain[kept], np.repeat(cut, np.array([len(some) for some in parts], np.int64))])
    order, times = np.argsort(owner, kind="stable"), np.bincount(owner, minlength=len(names))
    token = np.asarray(all_tokens.indices)[order][ranges((np.cumsum(times) - times)[run], times[run])]
    many = max(len(all_tokens.dictionary), 1)
    key, n = np.unique(np.repeat(text, times[run]) * many + token, return_counts=True)
    return Tally(all_tokens.dictionary.cast(pa.string()), key // many, key % many, n, np.bincount(key // many, minlength=len(texts)))


def cuts(batch: pa.RecordBatch, text: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``CUT_BYTES`` of its texts or ``rows`` rows, whichever is less."""
    sizes, start = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0), np.int64)), 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + CUT_BYTES, "right")))
        stop = min(stop, batch.num_rows, start + (rows or batch.num_rows))
        yield batch.slice(start, stop - start)
        start = stop


class Parts(NamedTuple):
    """Rows whose keys stand once and rows whose keys repeat (None if there are none); what ``vocabulary``'s queries ask of the former, cached, and of the latter."""

    single: DataFrame
    again: DataFrame | None
    found: DataFrame | None = None
    vocabulary: list[str] | None = None
    holders: DataFrame | None = None


def once(docs: DataFrame, *keys: str, queries: DataFrame | None = None, passages: DataFrame | None = None) -> Parts:
    """``docs`` whose keys stand in one row only, and those whose keys repeat (None if there are none).

    With ``queries(tok)`` of no more than ``FEW_ROWS`` tokens, the texts (tree, path, text) of single rows are read once for what is asked of them:
    (tree, path, size, toks, tfs, holds), the number of distinct tokens, those of the queries (places in the vocabulary) and their counts, and the
    ids of those of few ``passages(query_id, text)`` that stand there.  ``holders`` are then (query_id, path) of all rows.
    """
    again = docs.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys]).cache()
    parts = Parts(docs, None)
    if again.limit(1).count():
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        parts = Parts(docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi"))
    if queries is None:
        return parts
    vocabulary = [r["tok"] for r in queries.select("tok").distinct().limit(FEW_ROWS + 1).collect()]
    if len(vocabulary) > FEW_ROWS:
        return parts
    found = asked_of(parts.single, vocabulary, passages).cache()
    holders = None
    if passages is not None:
        holders = found.select(F.explode("holds").alias("query_id"), "path")
        if parts.again is not None:
            holders = holders.unionByName(ps.holders(passages, parts.again))
    return Parts(*parts[:2], found, vocabulary, holders)


def asked_of(docs: DataFrame, vocabulary: list[str], passages: DataFrame | None = None) -> DataFrame:
    """(tree, path, size, toks, tfs, holds) of ``docs(tree, path, text)``: see ``once``; texts without any of it have no row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = "long" if passages is None else passages.schema["query_id"].dataType.simpleString()
    id_type = pa.int64() if passages is None else to_arrow_type(passages.schema["query_id"].dataType)
    sought = None if passages is None else ps.Sought(ps.collected(passages), {t: k for k, t in enumerate(vocabulary)}, counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.string())
        find = None if sought is None else sought.finder()
        for batch in batches:
            for part in cuts(batch, 2):
                tally = tallied(part.column(2))
                place = np.asarray(pc.index_in(tally.tokens, value_set=wanted).fill_null(-1))[tally.token]
                some = np.flatnonzero(place >= 0)
                text, place, rows = tally.text[some], place[some], part.num_rows
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=rows))]), pa.int32())
                hits, ids = ([], []) if find is None else find(part.column(2), text, place)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(np.array(hits, np.int64), minlength=rows))]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(place, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tally.n[some], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(ids, id_type))]
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tally.sizes, pa.int32()), *lists], names=["tree", "path", "size", "toks", "tfs", "holds"])
                yield out.filter(pc.or_(pc.greater(pc.list_value_length(lists[0]), 0), pc.greater(pc.list_value_length(lists[2]), 0)))

    return docs.select("tree", "path", "text").mapInArrow(run, f"tree string, path string, size int, toks array<int>, tfs array<int>, holds array<{kind}>")


def counts(docs: DataFrame, *keys: str, parts: Parts | None = None) -> DataFrame:
    """(tree, tok, n, df) of ``docs(tree, keys, text)``: how often a token stands in a tree's texts, and in how many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[Counter, Counter]] = {}  # by tree: texts that hold a token, and its repeats in them

        def out() -> Iterator[pa.RecordBatch]:
            for tree, (df, more) in found.items():
                held = list(df)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(held), pa.string()), pa.array(held, pa.string()), pa.array([df[t] + more.get(t, 0) for t in held], pa.int64()), pa.array(list(df.values()), pa.int64())], names=["tree", "tok", "n", "df"])
            found.clear()

        for batch in batches:
            for tree, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                df, more = found.setdefault(tree, (Counter(), Counter()))
                here = counted(text.as_py())
                df.update(iter(here))
                for token, k in here.items():
                    if k > 1:
                        more[token] += k - 1
                if len(df) > HELD:
                    yield from out()
        yield from out()

    single, again = (parts or once(docs, *dict.fromkeys(["tree", *keys])))[:2]
    found = single.select("tree", "text").mapInArrow(run, "tree string, tok string, n long, df long")
    if again is not None:
        table = rt.token_table(again, tokens.occurrences(F.col("text")), *dict.fromkeys(["tree", *keys]))
        found = found.unionByName(table.groupBy("tree", "tok").agg(F.sum("tf").alias("n"), F.count("*").alias("df")))
    return found.groupBy("tree", "tok").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def frequencies(docs: DataFrame, queries: DataFrame, *keys: str, parts: Parts | None = None) -> DataFrame:
    """(tree, tok, df) of the tokens of ``queries(tree, tok)`` alone, of which tasks hand on one row each; more than ``FEW_ROWS`` are picked from all."""
    names, asked = list(dict.fromkeys(["tree", *keys])), queries.select("tree", "tok").distinct()
    parts = parts or once(docs, *names)
    vocabulary, found = parts.vocabulary, parts.found
    if found is None:
        vocabulary = [r["tok"] for r in asked.select("tok").distinct().limit(FEW_ROWS + 1).collect()]
        if len(vocabulary) > FEW_ROWS:
            return counts(docs, *keys, parts=parts).drop("n").join(asked, ["tree", "tok"], "left_semi")
        found = asked_of(parts.single.withColumn("path", F.lit("")), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[str | None, np.ndarray] = {}
        for batch in batches:
            trees = batch.column(0).dictionary_encode("encode")
            of_row = np.repeat(np.asarray(trees.indices), np.diff(np.asarray(batch.column(1).offsets)))
            toks = np.asarray(batch.column(1).flatten())
            for k, tree in enumerate(trees.dictionary.to_pylist()):
                if tree is not None:
                    df[tree] = df.get(tree, 0) + np.bincount(toks[of_row == k], minlength=len(vocabulary))
        for tree, n in df.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([tree] * len(some), pa.string()), pa.array(vocabulary, pa.string()).take(pa.array(some)), pa.array(n[some], pa.int64())], names=["tree", "tok", "df"])

    # a tree's tokens are those of its own queries
    here = found.select("tree", "toks").mapInArrow(run, "tree string, tok string, df long").join(rt.small(asked), ["tree", "tok"], "left_semi")
    if parts.again is not None:
        table = rt.token_table(parts.again, tokens.occurrences(F.col("text")), *names).join(asked, ["tree", "tok"], "left_semi")
        here = here.unionByName(table.groupBy("tree", "tok").agg(F.count("*").alias("df")))
    return here.groupBy("tree", "tok").agg(F.sum("df").alias("df"))


def idf(docs: DataFrame, queries: DataFrame | None = None, parts: Parts | None = None) -> DataFrame:
    """``retrieval.idf`` of ``docs(tree, path, text)``; with ``queries`` of their tokens alone."""
    n = docs.groupBy("tree").agg(F.count("*").alias("n"))
    df = counts(docs, "path", parts=parts).drop("n") if queries is None else frequencies(docs, queries, "path", parts=parts)
    return df.join(rt.small(n, 10_000), "tree").select("tree", "tok", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def arm(k1: float | None = None, idf: Column | None = None) -> tuple[Column, float | None]:
    """An arm: a query's weight of a token (null: left out), and the k1 of tf / (tf + k1)."""
    if k1 is not None and k1 < 0:
        raise ValueError("k1 must not be negative")
    return (F.col("idf") if idf is None else idf), k1


class Fold(Protocol):
    """What a task makes of the scores that pass: rows that can't be kept come back at once, the others at the end."""

    def add(self, batch: pa.RecordBatch) -> pa.Table | None: ...

    def rest(self) -> pa.Table | None: ...


def folded(fold: Callable[[], Fold], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = fold()
    for batch in batches:
        if (early := held.add(batch)) is not None:
            yield from early.combine_chunks().to_batches()
    if (last := held.rest()) is not None:
        yield from last.combine_chunks().to_batches()


class _First(Heaps):
    def rest(self) -> pa.Table | None:
        return self.cut()[0] if self.held else None


def score_arms(
    queries: DataFrame, docs: DataFrame, weights: DataFrame, arms: dict[str, tuple[Column, float | None]], k: int | None = None,
    parts: Parts | None = None, fold: tuple[Callable[[], Fold], str] | None = None,
) -> DataFrame:
    """``retrieval.score_arms`` of ``docs(tree, path, text)``: (query_id, tree, path, one column an arm).

    Queries of few tokens go to every task, which adds their weights up by lists of the queries that hold a token; more are joined
    over a table of tokens.  With ``k`` and one arm named score, tasks leave out what can't be among a query's first k; with ``fold``
    and the schema of its rows, tasks hand on what it makes of the scores.
    """
    wanted = queries.join(weights, ["tree", "tok"])
    kind = queries.schema["query_id"].dataType
    schema = f"query_id {kind.simpleString()}, tree string, path string, " + ", ".join(f"`{a}` double" for a in arms)
    if fold is None and k:
        fold = (lambda: _First(["query_id"], k)), schema

    def joined(some: DataFrame) -> DataFrame:
        plain = {a: w if k1 is None else w * F.col("tf") / (F.col("tf") + F.lit(k1)) for a, (w, k1) in arms.items()}
        out = rt.score_arms(queries, rt.token_table(some, tokens.occurrences(F.col("text")), "tree", "path"), weights, plain)
        if fold is None:
            return out
        make, rows = fold
        return out.mapInArrow(lambda batches: folded(make, batches), rows)

    held = wanted.select("query_id", "tree", "tok", *[w.cast("double").alias(a) for a, (w, _) in arms.items()]).limit(FEW_ROWS + 1).collect()
    asked: dict[str, dict] = {}
    posted: dict[str, dict[str, list]] = {}  # by tree and token: the queries that hold it, and their weights
    for row in held:
        place = (ids := asked.setdefault(row["tree"], {})).setdefault(row["query_id"], len(ids))
        posted.setdefault(row["tree"], {}).setdefault(row["tok"], []).append((place, *[row[a] or 0.0 for a in arms]))
    if len(held) > FEW_ROWS or max(map(len, asked.values()), default=0) * len(arms) * TOGETHER > CELLS:
        return joined(docs)
    from pyspark.sql.pandas.types import to_arrow_type

    parts = parts or once(docs.select("tree", "path", "text"), "tree", "path")
    found, vocabulary = parts.found, parts.vocabulary
    if found is None or {t for by_token in posted.values() for t in by_token} - set(vocabulary):
        vocabulary = sorted({t for by_token in posted.values() for t in by_token})
        found = asked_of(parts.single, vocabulary)
    place_of = {t: k for k, t in enumerate(vocabulary)}
    id_type, kinds, names = to_arrow_type(kind), [k1 for _, k1 in arms.values()], list(arms)
    lists = {}
    for tree, by_token in posted.items():
        sizes = np.zeros(len(vocabulary), np.int64)
        sizes[[place_of[t] for t in by_token]] = [len(rows) for rows in by_token.values()]
        flat = np.array([row for t in sorted(by_token, key=place_of.get) for row in by_token[t]], np.float64)
        lists[tree] = (np.cumsum(sizes) - sizes, sizes, flat[:, 0].astype(np.int64), np.ascontiguousarray(flat[:, 1:].T))

    def scored(tree: str, rows: pa.RecordBatch) -> pa.RecordBatch:
        starts, sizes, owners, weight = lists[tree]
        n, toks = len(asked[tree]), rows.column("toks")
        at, token, tf = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(toks.offsets))), np.asarray(toks.flatten()), np.asarray(rows.column("tfs").flatten())
        times = sizes[token]
        entry = ranges(starts[token], times)
        cell, tf = np.repeat(at, times) * n + owners[entry], np.repeat(tf, times)
        some = np.flatnonzero(np.bincount(cell, minlength=1))
        row, query = some // n, some % n
        root = np.sqrt(np.asarray(rows.column("size"), np.float64))[row]
        scores = []
        for k1, w in zip(kinds, weight):
            v = np.bincount(cell, w[entry] if k1 is None else w[entry] * tf / (tf + k1), 1)[some]
            scores.append(pa.array(np.floor(v / root * 1e9 + 0.5) / 1e9, mask=v <= 0))
        ids = pa.array(list(asked[tree]), id_type).take(pa.array(query))
        paths = rows.column("path").take(pa.array(row))
        return pa.RecordBatch.from_arrays([ids, pa.array([tree] * len(row), pa.string()), paths, *scores], names=["query_id", "tree", "path", *names])

    def all_scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in lists:
                mine = batch.filter(pc.equal(batch.column("tree"), tree))
                for start in range(0, mine.num_rows, TOGETHER):
                    yield scored(tree, mine.slice(start, TOGETHER))

    found = found.select("tree", "path", "size", "toks", "tfs")
    if fold is None:
        out = found.mapInArrow(all_scored, schema)
    else:
        make, rows = fold
        out = found.mapInArrow(lambda batches: folded(make, all_scored(batches)), rows)
    return out if parts.again is None else out.unionByName(joined(parts.again))
