"""The pipeline and its stages against a brute-force version on a small corpus."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import nearcopies, quality, toxicity
from test_operators import components_of, measured, prose, removed

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows, labels = random.Random(11), [], []
    shared = prose(77, 70)
    for i in range(260):
        text = prose(5000 + i, rng.randint(25, 120))
        if i % 5 == 0:
            text = "Such a grumblewort person. " + text
        if i % 7 == 0:
            text += " " + shared
        rows.append((i, text))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(310, rows[4][1].replace(" ", " extra ", 1)), (311, rows[8][1] + " one more end")]  # near copies, not exact ones
    rows += [(300, rows[3][1]), (301, rows[3][1].upper()), (302, "# $ % & " * 60), (303, "same again\n" * 60), (304, "short"), (305, None), (306, "")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def rejected(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base = measured(text)
    n_lines = len([x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")])
    values = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "n_lines": n_lines}
    mask = quality.POLICIES[quality.DEFAULT_POLICY]
    return base or any(eval(rule.replace("AND", "and"), {}, values) for bit, (_, rule) in quality.RULES.items() if mask >> bit & 1)


def five_words(text):
    """The five-word shingles of the stage of near copies (fewer words: all of them)."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(low))
    return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}


def test_pipeline_equals_brute_force(spark, corpus):
    path, rows = corpus
    docs = [(i, t or "") for i, t in rows if not rejected(t or "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    model = toxicity.train(frame, spark.read.parquet(f"{path}/labels.parquet"))
    docs = [(i, t) for i, t in docs if model.score(t) < toxicity.THRESHOLD]
    sets = {i: five_words(t) for i, t in docs}
    groups = components_of(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = [(i, t) for i, t in docs if groups[i] == i]
    gone = {k[0]: k for k in removed(docs, 50)}
    own = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted({r["doc_id"] for r in got}) == sorted(i for i, _ in docs)
    assert not {300, 301, 302, 303, 304, 305, 306, 310, 311} & {r["doc_id"] for r in got}
    assert any(k[2] for k in gone.values()), "some passage is removed"
    from plumbline.llm import substring

    kept = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True).collect()}
    for i, t in docs:
        ids = np.array(own.encode(kept[i] if gone[i][2] else t, add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert sum(n for _, n, _ in pieces) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in pieces)


def test_stages_on_empty_and_odd_tables(spark, corpus):
    path, _ = corpus
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (None, "a b", "x", "y", 3), (1, "", "", "", 0)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd.where("false"), odd):
            out = stage(spark, df, path)
            rows = out.collect()
            if name == "packing":
                rows = [r for r in rows if r["start"] == 0]  # the last windows of a partition may cut a document
            else:
                assert out.columns == df.columns
            assert len(rows) == (0 if df is not odd else {"quality_rules": 0, "near_dedup": 3}.get(name, 4)), name


def test_clean_documents_stay(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, path).collect()}
    assert {i for i in range(260)} <= kept
    calm = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, path).collect()}
    assert calm == {i for i, t in rows if "grumblewort" not in (t or "")}
    assert Counter(r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, docs, path).collect())[3] == 1


def test_near_copies_at_similarity_of_four_fifths(spark):
    rng, docs = random.Random(12), []
    for i in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        docs.append((10 * i, " ".join(words)))
        for k in range(1, 4):  # one to three words replaced: the last stay under the threshold with each other
            for _ in range(k):
                words[rng.randrange(150)] = f"v{rng.randrange(5000)}"
            docs.append((10 * i + k, " ".join(words)))
    rows = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    held = {i: rows(t) for i, t in docs}
    similar = lambda a, b: len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.8
    truth = components_of(list(held), similar)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, frame, "").collect()}
    assert kept == {i for i in held if truth[i] == i} and 12 <= len(kept) < 24


def near_sets(seed, n):
    """Sets of shingle hashes, some an edited form of an earlier one."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        if k and rng.random() < 0.7:
            old = out[rng.integers(k)]
            out.append(np.unique(np.concatenate([old[rng.random(len(old)) < 0.93], rng.integers(0, 1 << 63, rng.integers(0, 5), dtype=np.uint64), old[:1]])))
        else:
            out.append(np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80), dtype=np.uint64)))
    return out


def linked(held, parts):
    """Components over all similar pairs and over the members of each part."""
    near = lambda a, b: parts[a] == parts[b] or nearcopies.jaccard(held[a], held[b]) >= 0.8
    return components_of(list(range(len(held))), near)


@pytest.mark.parametrize("seed", range(4))
def test_cells_join_all_similar_members(seed):
    held, rng = near_sets(seed, 70), np.random.default_rng(seed)
    parts = np.where(rng.random(70) < 0.3, 0, np.arange(70)) if seed else np.arange(70)
    edges = list(nearcopies.joins(held, parts))
    assert all(parts[a] != parts[b] and nearcopies.jaccard(held[a], held[b]) >= 0.8 for a, b in edges)
    assert len(edges) < len(set(parts.tolist())), "a forest, not all pairs"
    want = linked(held, parts)
    assert components_of(list(range(70)), lambda a, b: parts[a] == parts[b] or (a, b) in edges or (b, a) in edges) == want
    crossing = list(nearcopies.joins(held, np.arange(70), between=30))
    assert crossing and all((a < 30) != (b < 30) for a, b in crossing)


@pytest.mark.parametrize("limit", [{"TILE": 7}, {"TILE_BYTES": 2000}, {}])
def test_large_buckets_are_cut_into_tiles(spark, monkeypatch, limit):
    for name, value in limit.items():
        monkeypatch.setattr(nearcopies, name, value)
    held = near_sets(9, 60)
    parts = [0 if k < 12 else k for k in range(60)]
    rows = spark.createDataFrame([(b, k, len(held[k]), parts[k]) for b in (1, 2) for k in range(60)], "bucket long, rep long, size long, component long")
    stored = spark.createDataFrame([(k, bytearray(h.tobytes())) for k, h in enumerate(held)], "node long, held binary")
    edges = {(r["a"], r["b"]) for r in nearcopies.across(rows, stored).collect()}
    assert edges and all(nearcopies.jaccard(held[a], held[b]) >= 0.8 for a, b in edges)
    got = components_of(list(range(60)), lambda a, b: parts[a] == parts[b] or (a, b) in edges or (b, a) in edges)
    assert got == linked(held, parts)


def test_near_copies_of_very_long_texts_ties_and_unlike_rows_that_share_keys(spark, monkeypatch):
    # every text in one bucket, whatever it says: only the exact comparison decides
    monkeypatch.setattr(nearcopies, "band_keys", lambda hashes: np.arange(nearcopies.BANDS, dtype=np.uint64))
    rng = random.Random(5)
    long = [f"w{rng.randrange(9000)}" for _ in range(60_000)]
    edited = list(long)
    for k in range(0, 60_000, 600):
        edited[k] = "other"
    texts = {7: " ".join(long), 3: " ".join(edited), 5: "same words here again now", 6: "same words here again now", 8: "one", 9: "two", 10: "", 11: None}
    texts |= {20 + k: prose(900 + k, 40) for k in range(30)}
    docs = spark.createDataFrame(list(texts.items()) + [(7, texts[7])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(docs).collect()}
    assert got == {i: {7: 3, 6: 5, 11: 10}.get(i, i) for i in texts}


def test_fingerprints_of_operator_10_link_too(spark):
    from plumbline.llm import simhash

    # one long word, repeated, outweighs all others: the fingerprints agree, few five-word shingles do
    docs = [(k, f"{prose(700 + k, 12)} " + "again " * 60) for k in (4, 5)] + [(9, prose(800, 60)), (None, "x")]
    a, b = (five_words(t) for _, t in docs[:2])
    assert len(a & b) < 0.8 * len(a | b) and simhash.fingerprint(docs[0][1]) == simhash.fingerprint(docs[1][1])
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, frame, "").collect()} == {4, 9, None}
    # a chain over links of both kinds is one group
    near = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "doc_id long, component_id long")
    far = spark.createDataFrame([(2, 2), (3, 2)], "doc_id long, component_id long")
    assert {(r["node"], r["component"]) for r in nearcopies.merged(near, far).collect()} == {(k, 1) for k in (1, 2, 3, 4)}
