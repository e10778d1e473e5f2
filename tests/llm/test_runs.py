"""Periodic runs against a search of every period, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import runs

SCHEMA = "doc_id long, text string"


def runs_by_hand(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        x = 0
        while x < len(words) - p:
            y = x
            while y < len(words) - p and words[y] == words[y + p]:
                y += 1
            if y + p - x >= max(12, 2 * p):
                found.setdefault((x, y + p), p)
            x = y + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def row_by_hand(doc, text, damage=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    if damage and doc is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_by_hand(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *top, None if top[1] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts_with_runs(seed, count):
    rng = random.Random(seed)
    for k in range(count):
        words = []
        while len(words) < rng.choice([0, 5, 11, 40, 120]):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words += (unit * rng.randint(1, 8))[: rng.randint(1, 40)]
        yield " ".join(words)


def test_runs_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rows = [(k, t) for k, t in enumerate(texts_with_runs(1, 400))]
    rows += [(None, "a " * 30), (None, None), (400, None), (401, ""), (402, " \n\t"), (403, "x" * 50_000), (404, "same " * 12), (405, "same " * 11), (406, "one two " * 6), (406, "one two " * 6), (-7, "a b c " * 40), (407, "ab c   d " * 20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("start", "length", "n_words", "period", "words")})
    got = [tuple(r)[:8] for r in runs.periodic_runs(df).collect()]
    assert sorted(map(repr, got)) == sorted(repr(row_by_hand(*r)) for r in rows)
    plain = [tuple(r)[:8] for r in runs.periodic_runs(df, damage=False).collect()]
    assert sorted(map(repr, plain)) == sorted(repr(row_by_hand(*r, damage=False)) for r in rows)


@pytest.mark.parametrize("slice_", [1, 50, 1_000_000])
def test_slices_give_the_same(monkeypatch, slice_):
    monkeypatch.setattr(runs, "SLICE", slice_)
    known, ids, sizes, wanted = {}, [], [], []
    for text in texts_with_runs(2, 60):
        words = text.split()
        ids += [known.setdefault(w, len(known)) for w in words]
        sizes.append(len(words))
        wanted.append([(s, s + n, p) for s, n, p in runs_by_hand(words)])
    assert runs.find(np.array(ids), np.array(sizes)) == wanted


def test_lying_hashes_are_found_out(monkeypatch):
    """A base of zero makes prefix sums blind; the words then decide alone."""
    monkeypatch.setattr(runs, "BASE", np.uint64(0))
    for text in texts_with_runs(3, 40):
        words = text.split()
        known = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        assert runs.find(ids, np.array([len(ids)]))[0] == [(s, s + n, p) for s, n, p in runs_by_hand(words)]


def test_long_monotonous_text_ends_soon():
    found = runs.find(np.zeros(200_000, np.int64), np.array([200_000]))
    assert found == [[(0, 200_000, 1)]]


def test_query_and_empty_table(spark):
    from plumbline.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [tuple(r)[:8] for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(map(repr, got)) == sorted(repr(row_by_hand(*r)) for r in docs.collect())
    assert any(r[1] for r in got)
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
