"""Stores, heaps, pair scores and blocks of vectors against plain versions; models are injected stand-ins."""

import glob
import os
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from plumbline.operators import dense, pairs, topk
from plumbline.operators import retrieval as rt
from plumbline.sources.sheets import Refusal
from plumbline.sources.stores import Store, default_root

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
KEYS, VALUE = {"q": "string", "p": "string"}, ("score", "double")


def fresh(tmp_path, name="store"):
    return str(tmp_path / name)


def opened(spark, root, stamp="m|800:100", buckets=4):
    return Store.open(spark, root, KEYS, VALUE, stamp, buckets)


def rows(spark, data):
    return spark.createDataFrame(data, "q string, p string, score double")


def held(store):
    return sorted(map(tuple, store.read().select("q", "p", "score").collect()))


def test_a_second_run_computes_nothing(spark, tmp_path):
    store, asked = opened(spark, fresh(tmp_path)), []

    def compute(missing):
        asked.append(sorted(map(tuple, missing.collect())))
        return missing.selectExpr("q", "p", "length(q) * 10.0 + length(p) AS score")

    wanted = rows(spark, [("ab", "c", 0.0), ("ab", "c", 0.0), ("a", "bc", 0.0), ("c", "ab", 0.0)])
    assert store.fill(wanted, compute) == (0, 3)
    assert opened(spark, store.root).fill(wanted, compute) == (3, 0)
    assert opened(spark, store.root).fill(wanted.union(rows(spark, [("x", "y", 0.0)])), compute) == (3, 1)
    assert asked == [[("a", "bc"), ("ab", "c"), ("c", "ab")], [("x", "y")]]
    assert held(store) == [("a", "bc", 12.0), ("ab", "c", 21.0), ("c", "ab", 12.0), ("x", "y", 11.0)]


def test_half_written_parts_are_not_seen(spark, tmp_path):
    store = opened(spark, fresh(tmp_path))
    store.append(rows(spark, [("a", "b", 1.0)]))
    store.append(rows(spark, [("c", "d", 2.0)]))
    assert len(store.live()) == 2
    last = store.live()[-1]
    (mark,) = glob.glob(f"{store.root}/part={last}/_SUCCESS")
    os.remove(mark)  # as if the job had been lost before its commit
    kept = [("a", "b", 1.0), ("c", "d", 2.0)]
    kept = [r for r in kept if r in held(store)]
    assert len(kept) == 1 and store.fill(rows(spark, [("a", "b", 0.0), ("c", "d", 0.0)]), lambda m: m.selectExpr("q", "p", "9.0 AS score")) == (1, 1)
    os.makedirs(f"{store.root}/part=000000-abc")  # an empty folder of a run that has just begun
    assert len(held(store)) == 2


def test_compaction_keeps_rows_and_late_parts_of_the_old_generation_stay_unread(spark, tmp_path):
    store = opened(spark, fresh(tmp_path))
    for k in range(3):
        store.append(rows(spark, [(f"q{k}", "p", float(k)), ("both", "p", float(k))]))
    before = held(store)
    assert len(before) == 4
    store.compact()
    assert held(store) == before and len(store.parts()) == 1
    store.append(rows(spark, [("late", "p", 5.0)]), generation=0)
    assert held(store) == before
    store.append(rows(spark, [("new", "p", 6.0)]))
    assert len(held(store)) == 5


def test_another_stamp_is_refused_and_gets_a_root_of_its_own(spark, tmp_path):
    root = fresh(tmp_path)
    opened(spark, root)
    for stamp, buckets in (("other|800:100", 4), ("m|400:100", 4), ("m|800:100", 8)):
        with pytest.raises(Refusal, match="stamp|buckets"):
            opened(spark, root, stamp, buckets)
    assert len({default_root("r", m, s, o) for m in ("a/b", "c") for s, o in ((800, 100), (400, 100))}) == 4


def test_the_store_is_not_shuffled(spark, tmp_path):
    """Only the wanted side moves: the store's buckets already lie by the hash of their keys."""
    store = opened(spark, fresh(tmp_path))
    store.append(rows(spark, [(f"q{k}", "p", 1.0) for k in range(50)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = rows(spark, [("q1", "p", 0.0)]).select("q", "p").join(store.read(), ["q", "p"], "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


# ------------------------------------------------------------------ heaps


@pytest.mark.parametrize("hold", [7, 100_000])
def test_top_k_equals_the_full_ranking(spark, monkeypatch, hold):
    monkeypatch.setattr(topk, "HELD", hold)
    rng = random.Random(4)
    data = [(rng.randint(0, 20), f"p{rng.randint(0, 400):03d}{n}", rng.choice([None, round(rng.random(), 1), -1.0])) for n in range(3_000)] + [(99, "only", 0.5), (None, "x", 1.0), (None, "y", 2.0)]
    df = spark.createDataFrame(data, "query_id long, path string, score double").repartition(5)
    for k in (1, 3, 50):
        want = []
        for q in {r[0] for r in data}:
            mine = sorted(((-(s or 0.0), p) for i, p, s in data if i == q))[:k]
            want += [(q, p, -s, n + 1) for n, (s, p) in enumerate(mine)]
        assert sorted(map(repr, map(tuple, topk.top_k(df, k).collect()))) == sorted(map(repr, ((q, p, s + 0.0, r) for q, p, s, r in want)))


def test_top_k_of_several_keys_and_plan(spark):
    data = [("x", q, f"p{n}", float(n % 7)) for q in range(3) for n in range(40)] + [("y", 1, "p", 1.0)]
    df = spark.createDataFrame(data, "arm string, query_id long, path string, score double")
    out = topk.top_k(df, 2, "arm", "query_id")
    assert sorted(map(tuple, out.select("arm", "query_id", "path", "rank").collect())) == sorted([("x", q, p, r) for q in range(3) for p, r in (("p13", 1), ("p20", 2))] + [("y", 1, "p", 1)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
    assert topk.top_k(df.where("false"), 2, "arm").count() == 0
    with pytest.raises(ValueError):
        topk.top_k(df, 0)


# ------------------------------------------------------------------ pairs


class Overlap:
    """Shared words less ten; calls and pairs are told by files, since workers are other processes."""

    def __init__(self, folder):
        self.folder = folder
        open(f"{folder}/built-{os.getpid()}-{random.random()}", "w").close()

    def score(self, batch):
        for a, b in batch:
            assert os.path.isdir(self.folder)
            with open(f"{self.folder}/pairs-{os.getpid()}", "a") as f:
                f.write(repr((a, b)) + "\n")
        return [len(set(a.split()) & set(b.split())) - 10.0 for a, b in batch]


def seen(folder):
    return sorted(line for f in glob.glob(f"{folder}/pairs-*") for line in open(f))


def heads(spark, texts, query_text="the transport layer", order=None):
    names = order or sorted(texts)
    base = spark.createDataFrame([("q", p, 0.0, n + 1) for n, p in enumerate(names)], "query_id string, path string, score double, rank int")
    queries = spark.createDataFrame([("q", "t", query_text)], "query_id string, tree string, text string")
    code = spark.createDataFrame([("t", p, t) for p, t in texts.items()], "tree string, path string, text string")
    return base, queries, code


def ordered(df):
    return [r["path"] for r in df.orderBy("rank").collect()]


@pytest.fixture
def scorer(tmp_path):
    folder = str(tmp_path / "seen")
    os.makedirs(folder)
    return folder, lambda: Overlap(folder)


def test_only_the_head_moves_and_each_pair_is_scored_once(spark, tmp_path, scorer):
    folder, make = scorer
    texts = {f"src/m{n:02d}.py": "helper" for n in range(30)} | {"src/m07.py": "transport layer of it", "src/m25.py": "the transport layer"}
    store = pairs.pair_store(spark, fresh(tmp_path), f"overlap-{folder}")
    base = heads(spark, texts)
    out, counts = pairs.rerank_heads(*base, store, f"overlap-{folder}", make, top_n=10, batch=2)
    order = ordered(out)
    assert order[0] == "src/m07.py" and set(order[:10]) == {f"src/m{n:02d}.py" for n in range(10)} and order[10:] == [f"src/m{n:02d}.py" for n in range(10, 30)]
    assert counts == (0, 2) and len(seen(folder)) == 2  # nine files are one text
    again, counts = pairs.rerank_heads(*base, store, f"overlap-{folder}", make, top_n=10)
    assert counts == (2, 0) and ordered(again) == order and len(seen(folder)) == 2
    workers = {f.split("-")[1] for f in map(os.path.basename, glob.glob(f"{folder}/built-*"))}
    assert len(workers) == len(glob.glob(f"{folder}/built-*"))  # one a worker


def test_awkward_heads(spark, tmp_path, scorer):
    folder, make = scorer
    store = pairs.pair_store(spark, fresh(tmp_path), f"overlap-{folder}")
    texts = {f"m{n}": "x" for n in range(5)} | {"m0": "  \n ", "m4": "transport"}
    order = ordered(pairs.rerank_heads(*heads(spark, texts), store, f"overlap-{folder}", make, top_n=5)[0])
    assert order[0] == "m4" and order[-1] == "m0"  # without a window: last, though scores are below zero
    mixed = ["m3", "m1", "m4", "m0", "m2"]
    assert ordered(pairs.rerank_heads(*heads(spark, texts, "  ", mixed), store, f"overlap-{folder}", make, top_n=5)[0]) == mixed
    evidence = spark.createDataFrame([("q", "transport")], "query_id string, tok string")
    order = ordered(pairs.rerank_heads(*heads(spark, texts, "Transport"), store, f"overlap-{folder}", make, top_n=5, evidence=evidence)[0])
    assert order == sorted(texts) and not any("Transport" in s for s in seen(folder))
    with pytest.raises(ValueError, match="top_n"):
        pairs.rerank_heads(*heads(spark, texts), store, "m", make, top_n=1)
    long = {"a": "filler " * 300 + "transport layer", "b": "the layer"}
    assert ordered(pairs.rerank_heads(*heads(spark, long, "transport layer " + "z" * 900), store, f"overlap-{folder}", make)[0])[0] == "a"


# ------------------------------------------------------------------ vectors


class Letters:
    """A text's counts of letters, at unit length."""

    def __init__(self, folder=None):
        self.folder = folder

    def encode(self, texts):
        if self.folder:
            with open(f"{self.folder}/pairs-{os.getpid()}", "a") as f:
                f.writelines(repr(t) + "\n" for t in texts)
        m = np.array([[t.count(c) for c in "abcdefgh"] for t in texts], np.float64) + 1e-3
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_texts_are_encoded_once_and_blocks_equal_plain_products(spark, tmp_path, scorer):
    folder, _ = scorer
    rng = random.Random(2)
    code = [("t" if n % 3 else "u", f"p{n}", "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 40, 100])))) for n in range(60)]
    code += [("t", "blank", " \n"), ("t", "null", None), ("t", "copy", code[1][2])]
    docs = [("t", n, "".join(rng.choice("abcdefgh ") for _ in range(50))) for n in range(7)] + [("t", 8, ""), ("u", 9, "abc")]
    store = dense.vector_store(spark, fresh(tmp_path), f"letters-{folder}", 30, 10)
    make, model = (lambda: Letters(folder)), f"letters-{folder}"
    c, counts = dense.text_vectors(spark.createDataFrame(code, "tree string, path string, text string"), store, model, make, 30, 10)
    distinct = {t or "" for _, _, t in code}
    assert counts == (0, len(distinct))
    q, _ = dense.text_vectors(spark.createDataFrame(docs, "tree string, query_id int, text string"), store, model, make, 30, 10)
    plain = {}
    cut = lambda t: [t[i : i + 30] for i in range(0, max(1, len(t)), 20) if i == 0 or i + 10 < len(t)] if t and t.strip() else []
    for tree, i, d in docs:
        for other, path, t in code:
            a, b = cut(d), cut(t or "")
            if tree == other and a and b:
                plain[i, path] = float(np.max(Letters().encode(a).astype(np.float32).astype(float) @ Letters().encode(b).astype(np.float32).astype(float).T))
    for per_block in (3, 512):
        got = {(r["query_id"], r["path"]): r["score"] for r in dense.maxsim(q, c, per_block=per_block).collect()}
        assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-5 for k in plain)
    best = topk.top_k(dense.maxsim(q, c, k=4, per_block=5), 4)
    full = rt.rank(dense.maxsim(q, c)).where("rank <= 4")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, full.select(*best.columns).collect()))
    encoded = len(seen(folder))
    again, counts = dense.text_vectors(spark.createDataFrame(code, "tree string, path string, text string"), store, model, make, 30, 10)
    assert counts == (len(distinct), 0) and again.count() == c.count() and len(seen(folder)) == encoded
    assert encoded == sum(len(cut(t)) for t in distinct | {d for _, _, d in docs})


# ------------------------------------------------------------------ tokens


def test_hot_tokens_are_sliced_and_scores_stay(spark):
    """Joined in slices or whole, in one pass or an arm at a time: equal scores, and no slice above its size."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    cand = [("t", f"p{n}", tok, rng.randint(1, 5)) for n in range(300) for tok in {"hot", *rng.sample("abcdefghij", 3)}]
    queries = [(q, "t", tok) for q in range(6) for tok in {"hot", *rng.sample("abcdefghijkl", 4)}]
    cand, queries = spark.createDataFrame(cand, "tree string, path string, tok string, tf int"), spark.createDataFrame(queries, "query_id int, tree string, tok string")
    weights = rt.idf(cand, cand.select("tree", "path").distinct())
    evidence = spark.createDataFrame([(q, "a") for q in range(6)], "query_id int, tok string")
    arms = {"lexical": rt.lexical_part(), "ablated": F.when(~F.col("evidence"), rt.lexical_part()), "tf": rt.tf_part(1.2)}
    got = {}
    for name, options in (("sent", {}), ("sliced", {"broadcast": 0, "rows": 16})):
        scores = rt.score_arms(rt.marked(queries, evidence), cand, weights, arms, **options)
        got[name] = sorted(map(tuple, rt.long(scores, list(arms)).collect()))
    assert got["sent"] == got["sliced"]
    for arm, alone in (("lexical", rt.score_tokens(queries, cand, weights)), ("ablated", rt.score_tokens(rt.ablate(queries, evidence), cand, weights)), ("tf", rt.score_tokens(queries, cand, weights, 1.2))):
        assert sorted((arm, r["query_id"], r["path"], r["score"]) for r in alone.collect()) == [r for r in got["sent"] if r[0] == arm]
    wanted, salted = rt.sliced(queries.join(weights, ["tree", "tok"]), cand, 16)
    asked = salted.join(wanted.select("tree", "tok").distinct(), ["tree", "tok"], "left_semi")
    sizes = asked.groupBy("tree", "tok", "slice").count().agg(F.max("count")).first()[0]
    assert sizes <= 2.5 * 16 and wanted.where("tok = 'hot'").count() == 6 * 19


def test_evaluation_equals_plain_rankings(spark, tmp_path, scorer):
    """All arms over small trees against full rankings by hand, the models' arms among them."""
    from plumbline.plans import retrieval_eval as run

    folder, make = scorer
    rng = random.Random(12)
    words = ["transport", "setting", "timeout", "connection", "handler", "response", "request", "session"]
    blobs = [("r", "s1", "docs/guide.md", "The transport and the timeout of a session."), ("r", "s1", "docs/handler_page.md", "About handlerThing response."), ("r", "s2", "docs/guide.md", "Request and session.")]
    for sha, n in (("s1", 25), ("s2", 4)):
        blobs += [("r", sha, f"src/m{k:02d}.py", " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for k in range(n)]
    blobs += [("r", "s1", "src/handler_page.py", "nothing")]
    df = spark.createDataFrame(blobs, "repo string, sha string, path string, text string")
    queries = spark.createDataFrame([
        ("q1", "r", "r@s1", "docs/guide.md", ["src/m03.py", "src/m20.py", "src/gone.py"], ["transport"]), ("q2", "r", "r@s1", "docs/handler_page.md", ["src/handler_page.py"], []), ("q3", "r", "r@s2", "docs/guide.md", ["src/m01.py"], ["request", "session"]),
    ], "query_id string, repo string, tree string, doc_path string, relevant array<string>, evidence array<string>")
    enc = run.Encoding(dense.vector_store(spark, fresh(tmp_path, "v"), "letters"), "letters", Letters)
    rr = run.Reranking(pairs.pair_store(spark, fresh(tmp_path, "p"), f"overlap-{folder}"), f"overlap-{folder}", make, 5)
    got = {r["arm"]: r for r in run.evaluate(queries, df, (1, 3), 1.2, 3, enc, rr).collect()}
    assert set(got) == {"lexical", "lexical-ablated", "lexical-tf", "path", "dense", "dense-ablated", "rerank(lexical@5)", "rerank(lexical@5)-ablated", "shuffle"}
    assert {r["n"] for r in got.values()} == {3} and {r["lost"] for r in got.values()} == {1}
    # by hand: lexical, ablated, rerank, dense
    held, pool, cand = rt.tree_tokens(df)
    toks = {}
    for r in cand.collect():
        toks.setdefault((r["tree"], r["path"]), set()).add(r["tok"])
    files = {}
    for r in pool.collect():
        files.setdefault(r["tree"], []).append(r["path"])
    text = {(f"{a}@{b}", p): t for a, b, p, t in blobs}
    from pyspark.sql import functions as F

    from plumbline.functions import tokens

    own = {r["query_id"]: set(r["t"]) for r in queries.join(held.withColumnRenamed("path", "doc_path"), ["tree", "doc_path"]).select("query_id", tokens.extract(F.col("text"), with_versions=False).alias("t")).collect()}

    def lexical(q, cut):
        n = len(files[q["tree"]])
        score = {}
        for p in files[q["tree"]]:
            mine = toks.get((q["tree"], p), set())
            df_ = lambda t: sum(t in toks.get((q["tree"], o), ()) for o in files[q["tree"]])
            if mine:
                score[p] = round(sum(np.log(1 + (n - df_(t) + 0.5) / (df_(t) + 0.5)) for t in (own[q["query_id"]] - cut) & mine) / len(mine) ** 0.5, 9)
        return sorted(files[q["tree"]], key=lambda p: (-score.get(p, 0.0), p))

    def strip(t, cut):
        import re

        return re.sub("|".join(sorted(cut, key=len, reverse=True)), " ", t, flags=re.I) if cut else t

    def reranked(q, cut):
        order, doc = lexical(q, cut), strip(text[q["tree"], q["doc_path"]], cut)
        head = {p: len(set(doc.split()) & set(text[q["tree"], p].split())) - 10 if text[q["tree"], p].strip() else -99 for p in order[:5]}
        return sorted(head, key=lambda p: (-head[p], p)) + order[5:]

    def by_vectors(q, cut):
        one = lambda t: Letters().encode([t]).astype(np.float32).astype(float)[0]
        doc = one(strip(text[q["tree"], q["doc_path"]], cut))
        score = {p: round(float(doc @ one(text[q["tree"], p])), 5) for p in files[q["tree"]] if text[q["tree"], p].strip()}
        return sorted(files[q["tree"]], key=lambda p: (-score.get(p, -9), p))

    for arm, how in (("lexical", lexical), ("rerank(lexical@5)", reranked), ("dense", by_vectors)):
        for name, ablated in ((arm, False), (arm + "-ablated", True)):
            rr_, r1, r3 = [], [], []
            for q in queries.collect():
                order = how(q, set(q["evidence"]) if ablated else set())
                places = [order.index(p) + 1 for p in q["relevant"] if p in order]
                rr_.append(1 / min(places))
                r1.append(sum(p <= 1 for p in places) / len(places))
                r3.append(sum(p <= 3 for p in places) / len(places))
            assert (got[name]["mrr"], got[name]["recall_1"], got[name]["recall_3"]) == tuple(round(sum(x) / 3, 6) for x in (rr_, r1, r3)), name


def test_ranks_of_scored_and_unscored_candidates(spark):
    """Equal to a full ranking where a missing score is 0, with scores below and at 0."""
    rng = random.Random(3)
    pool = [(t, f"p{n:02d}") for t, k in (("t", 30), ("u", 3)) for n in range(k)]
    scores, relevant, want = [], [], {}
    for q in range(12):
        tree = "u" if q % 5 == 4 else "t"
        files = [p for t, p in pool if t == tree]
        for arm in ("a", "b"):
            mine = {p: rng.choice([-0.5, -0.25, 0.0, 0.25, 0.25, 0.7]) for p in files if rng.random() < 0.5}
            scores += [(arm, q, p, s) for p, s in mine.items()]
            order = sorted(files, key=lambda p: (-mine.get(p, 0.0), p))
            for p in rng.sample(files, 3):
                relevant.append((arm, q, tree, p))
                want[arm, q, p] = order.index(p) + 1
    got = rt.ranks_with_tail(spark.createDataFrame(scores, "arm string, query_id int, path string, score double"), spark.createDataFrame(relevant, "arm string, query_id int, tree string, path string"), spark.createDataFrame(pool, "tree string, path string"))
    assert {(r["arm"], r["query_id"], r["path"]): r["rank"] for r in got.collect()} == want


def test_heads_are_ranked_once(spark, tmp_path):
    """The ranking behind the heads is computed once, however often the heads are read."""
    seen = str(tmp_path)

    def dear(batches):
        import uuid

        open(f"{seen}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    base = spark.createDataFrame([(1, "p", 1), (2, "r", 1), (2, "p", 30)], "query_id long, path string, rank long").coalesce(1).mapInArrow(dear, "query_id long, path string, rank long")
    queries = spark.createDataFrame([(1, "t", "one"), (2, "t", "two")], "query_id long, tree string, text string")
    code = spark.createDataFrame([("t", p, p * 3) for p in "pqrs"], "tree string, path string, text string")
    found, _, p = pairs.head_pairs(base, queries, code)
    assert sorted((r["query_id"], r["path"]) for r in found.collect()) == [(1, "p"), (2, "r")]
    assert sorted(r["path"] for r in p.collect()) == ["p", "r"]
    assert len(os.listdir(seen)) == 1
