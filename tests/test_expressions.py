"""Small literal cases for the Column expressions, and laws that need no gold data."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import paths, stats, texts, tokens
from plumbline.functions.windowing import select_relevant
from plumbline.operators import evaluation as ev
from plumbline.operators import mining, scoring
from plumbline.operators import retrieval as rt


def one(spark, expr, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in columns.items()])
    return df.select(expr).first()[0]


C = F.col


@pytest.mark.parametrize(
    "text, expected",
    [
        ("release v2.31.0 works", ["ver:2.31.0"]), ("py3.7 no", []), ("on 3.14 and 3.14", ["ver:3.14"]), ("1.0.0rc1.", ["ver:1.0.0rc1"]),
        ("host 10.20.30.40 up", []), ("2023.11.0", ["ver:2023.11.0"]), ("12345.1", []), ("just 42", []), ("V1.0.0 vs v2.0.0", ["ver:1.0.0", "ver:2.0.0"]),
    ],
)
def test_versions(spark, text, expected):
    assert one(spark, tokens.versions(C("t"), unicode=True), t=text) == expected


def test_numbers_leave_versions_alone(spark):
    assert one(spark, tokens.numbers(C("t")), t="from 30 to 3.8, x9 and 200") == ["num:30", "num:200"]


def test_identifier_pieces(spark):
    assert sorted(one(spark, tokens.extract(C("t"), with_versions=False), t="fetchRetries in _private_pool__ a b2 1234")) == ["fetch", "fetchretries", "pool", "private_pool", "retries"]


def test_counts_agree_with_set(spark):
    text = "maxWindow maxWindow window_size sizeWindow"
    assert set(one(spark, tokens.occurrences(C("t")), t=text)) == set(one(spark, tokens.extract(C("t"), with_versions=False), t=text))


@pytest.mark.parametrize(
    "added, removed, gone",
    [
        ("the fetchAll call", "the fetchAll call", []),
        ("uses poolSize", "uses poolLimit", ["poollimit", "limit"]),
        ("supports 3.9", "supports 3.8", ["ver:3.8"]),
        ("brand newOption", "", []),
        ("see https://a.b/deadname", "see https://c.d/othername", []),
    ],
)
def test_delta(spark, added, removed, gone):
    assert one(spark, tokens.delta(C("a"), C("r"))["removed_only"], a=added, r=removed) == gone


def test_literal_delta_keeps_keywords_and_numbers(spark):
    d = tokens.delta(C("a"), C("r"), literals_only=True)
    assert one(spark, d["removed_only"], a="`limit=40` now", r="`limit=30` and `None` before") == ["num:30", "none"]


def test_comments_and_urls(spark):
    assert one(spark, tokens.strip_comment_lines(C("t")), t="a = 1\n  # gone\n// gone\nb") == "a = 1\nb"
    assert one(spark, tokens.strip_urls(C("t")), t="x HTTP://a.b/c y www.d e") == "x   y   e"


def test_diff_sides(spark):
    diff = "diff --git a b\n--- a\n+++ b\n@@ -1 +1 @@\n-old line\n+new line\n+more\n context"
    assert one(spark, tokens.changed_text(C("d"), "+"), d=diff) == "new line\nmore"
    assert one(spark, tokens.changed_text(C("d"), "-"), d=diff) == "old line"


@pytest.mark.parametrize(
    "path, kind",
    [("README.md", "doc"), ("docs/CHANGELOG.rst", "other"), ("src/a.py", "code"), ("tests/a.py", "other"), ("src/test_a.py", "other"), ("build/x.py", "other"), ("docs/api/x.md", "other"), ("a/b.PY", "code"), (".md", "other"), ("noext", "other"), ("x.test.ts", "other")],
)
def test_kinds(spark, path, kind):
    assert one(spark, paths.kind(C("p")), p=path) == kind


def test_related(spark):
    rel = lambda a, b: one(spark, paths.related(C("a"), C("b")), a=a, b=b)
    assert rel("docs/api.rst", "src/x/api.py") and rel("docs/cookies.md", "lib/cookies/jar.py") and not rel("docs/guide.md", "src/docs.py")


@pytest.mark.parametrize("size, overlap", [(10, 0), (10, 3), (7, 6)])
def test_chunks_cover_the_text(spark, size, overlap):
    text = "abcdefghijklmnopqrstuvwxyz" * 3
    got = one(spark, texts.chunks(C("t"), size, overlap), t=text)
    assert got[0] + "".join(c[overlap:] for c in got[1:]) == text and all(len(c) > overlap for c in got)
    assert one(spark, texts.chunks(C("t"), size, overlap), t=" \n ") == []
    with pytest.raises(ValueError):
        texts.chunks(C("t"), 5, 5)


def test_redact_is_longest_first(spark):
    assert one(spark, texts.redact(C("t"), C("w")), t="FooBar foo a.b", w=["foo", "foobar", "a.b"]) == "     "


def test_batches_and_locates(spark):
    assert one(spark, texts.batches(C("w"), 2), w=["a", "b", "c"]) == [["a", "b"], ["c"]]
    assert one(spark, texts.batches(C("w"), 2), w=[]) == []
    assert one(spark, texts.locates(C("t"), C("w")), t="call run(x)", w=["run"]) and not one(spark, texts.locates(C("t"), C("w")), t="obj.run runs", w=["run"])


def test_defines(spark):
    for text in ("def run(a):", "class run:", "  run = 3", "async def run():", "run: int = 3"):
        assert one(spark, texts.defines(C("t"), C("n")), t=text, n="run"), text
    assert not one(spark, texts.defines(C("t"), C("n")), t="x == run", n="run")


@pytest.mark.parametrize("reply, answer", [('so {"verdict": "false"} end', True), ('{"verdict": "not-false"}', False), ("none", None), ('{"verdict": ', None), ('{"verdict": "?"}', None)])
def test_replies(spark, reply, answer):
    assert one(spark, texts.reply_verdict(C("t")), t=reply) is answer


def test_intervals(spark):
    lo, hi = stats.wilson(C("h"), C("n"))
    got = spark.createDataFrame([(6, 20), (0, 0), (0, 10), (10, 10)], "h long, n long").select(F.round(lo, 4), F.round(hi, 4)).collect()
    assert tuple(got[0]) == (0.1455, 0.519) and tuple(got[1]) == (0.0, 1.0) and got[2][0] == 0.0 and got[3][1] == 1.0
    assert one(spark, F.round(stats.zero_success_bound(C("n")), 4), n=10) == 0.2589


def test_order_statistics(spark):
    v = F.array(*map(F.lit, (4, 1, 3, 2)))
    assert spark.range(1).select(stats.upper_median(v), stats.at_floor(v, 0.9)).first() == (3, 3)


def cut_by_hand(text, budget, wanted):
    """The lines that stay, by the rules: head first, then neighbourhoods by falling score while they fit."""
    rows = text.splitlines(keepends=True)
    named = lambda x: {w.lower() for w in re.findall(r"[A-Za-z_]\w*", x)} & wanted
    score = [len(named(x)) * (10 if re.match(r"\s*(def|class)\s", x) else 0 if re.match(r"\s*(from|import)\s", x) else 1) for x in rows]
    at, spent = set(range(12)), sum(map(len, rows[:12]))
    for i in sorted((i for i in range(len(rows)) if score[i]), key=lambda i: (-score[i], i)):
        owner = [d for d in range(max(i - 59, 0), i + 1) if re.match(r"\s*(def|class)\s", rows[d])][-1:]
        new = {*range(max(i - 5, 0), min(i + 6, len(rows))), *owner} - at
        if spent + sum(len(rows[k]) for k in new) <= budget:
            at |= new
            spent += sum(len(rows[k]) for k in new)
    return "".join(rows[k] for k in sorted(at)), len(at)


def test_select_relevant_equals_the_rules(spark):
    import random

    rng = random.Random(3)
    words = ["alphaword", "bravoword", "charlieword", "deltaword", "filler", "x"]
    cases = []
    for _ in range(25):
        lines = [rng.choice(["def {}():", "    call({})", "import {}", "{} = 1", ""]).format(rng.choice(words)) for _ in range(rng.randrange(40, 160))]
        cases.append(("\n".join(lines) + rng.choice(["", "\n"]), {"alphaword", rng.choice(words[1:4])}))
    df = spark.createDataFrame([(i, t, sorted(w)) for i, (t, w) in enumerate(cases)], "id long, t string, w array<string>")
    got = {r["id"]: r["r"] for r in df.select("id", select_relevant(C("t"), 600, C("w")).alias("r")).collect()}
    shown = 0
    for i, (text, wanted) in enumerate(cases):
        kept, n = cut_by_hand(text, 600, wanted)
        if not got[i]["cut"]:
            assert got[i]["text"] == text
        elif "[truncated: " in got[i]["text"]:
            assert got[i]["text"].startswith(text[:600]) and len(re.findall("|".join(wanted), text[:600])) > 0
        else:
            body = re.sub(r"\n\[This file is .*\]\n$", "", got[i]["text"])
            assert re.sub(r"\n\.\.\. \[\d+ line\(s\) elided\] \.\.\.\n\n?", "", body) == kept and f"The {n} line(s) shown" in got[i]["text"]
            shown += 1
    assert shown > 5
    odd = spark.createDataFrame([(None, None), ("short", ["alphaword"]), ("y" * 900, [])], "t string, w array<string>")
    got = [r["r"] for r in odd.select(select_relevant(C("t"), 600, C("w")).alias("r")).collect()]
    assert got == [("", False), ("short", False), ("y" * 900, False)]  # a head of one long line is all there is


@pytest.fixture(scope="module")
def pool(spark):
    docs = spark.createDataFrame([("t", "a.py", "alpha_one bravo_two bravo_two"), ("t", "b.py", "bravo_two charlie"), ("t", "c.py", ""), ("t", "d.py", "alpha_one bravo_two")], "tree string, path string, text string")
    cand = rt.token_table(docs, tokens.occurrences(C("text")), "tree", "path")
    queries = spark.createDataFrame([(1, "t", "alpha_one"), (1, "t", "bravo_two"), (2, "t", "nothing")], "query_id long, tree string, tok string")
    return docs.select("tree", "path"), cand, queries, rt.idf(cand, docs)


def test_ranks_by_buckets_equal_a_sort(spark):
    import random

    rng = random.Random(9)
    rows = [(q, f"p{k:03}", rng.choice([0.0, 0.0005, 0.5, 0.5001, round(rng.random() * 3, 4), -0.25])) for q in range(4) for k in range(80)]
    scores = spark.createDataFrame(rows, "query_id long, path string, score double")
    rel = [(q, f"p{rng.randrange(80):03}") for q in range(4) for _ in range(15)]
    got = {(r["query_id"], r["path"]): r["rank"] for r in rt.ranks_of(scores, spark.createDataFrame(rel, "query_id long, path string")).collect()}
    for q, p in set(rel):
        order = [x[1] for x in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))]
        assert got[q, p] == order.index(p) + 1


def test_k1_zero_is_the_plain_score(pool):
    _, cand, queries, weights = pool
    a, b = (sorted(map(tuple, rt.score_tokens(queries, cand, weights, k).collect())) for k in (None, 0.0))
    assert a == b
    with pytest.raises(ValueError):
        rt.score_tokens(queries, cand, weights, -1.0)


def test_ranking_is_total_and_ties_go_by_path(pool):
    paths_, cand, queries, weights = pool
    pairs = queries.select("query_id", "tree").distinct().join(paths_, "tree")
    got = rt.rank(rt.score_tokens(queries, cand, weights), pairs).orderBy("query_id", "rank").collect()
    assert [r["path"] for r in got if r["query_id"] == 2] == ["a.py", "b.py", "c.py", "d.py"]
    assert [r["rank"] for r in got if r["query_id"] == 1] == [1, 2, 3, 4]


def test_rerank_keeps_recall_at_n(spark):
    base = spark.createDataFrame([(1, f"p{i}", 1.0 / i, i) for i in range(1, 7)], "query_id long, path string, score double, rank int")
    pairs = spark.createDataFrame([(1, "p1", -5.0), (1, "p2", -1.0), (1, "p6", 9.0)], "query_id long, path string, score double")
    got = {r["path"]: r["rank"] for r in rt.rerank(base, pairs, 3).collect()}
    assert got == {"p2": 1, "p1": 2, "p3": 3, "p4": 4, "p5": 5, "p6": 6}
    with pytest.raises(ValueError):
        rt.rerank(base, pairs, 1)


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)], "query_id long, path string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q")], "query_id long, path string")
    got = {r["query_id"]: r for r in ev.per_query(ranking, rel, (1, 3)).collect()}
    assert (got[1]["rr"], got[1]["recall_1"], got[1]["recall_3"], got[2]["rr"]) == (0.5, 0.0, 0.5, 0.0)


def test_confusion_by_hand(spark):
    rows = [(True, True), (True, False), (True, None), (False, False), (False, True), (None, True)]
    r = ev.rates(ev.confusion(spark.createDataFrame([("j", *x) for x in rows], "judge string, target boolean, answer boolean"), "judge")).first()
    assert (r["n"], r["answered"], r["tp"], r["fp"], r["fn"], r["tn"], r["accuracy_all"], r["f1"]) == (5, 4, 1, 1, 1, 1, 0.4, 0.5)


def test_stability(spark):
    rows = [("j", c, t, a) for c, answers in {"s": (True, True), "c": (True, False), "f": (None, True), "n": (None, None)}.items() for t, a in enumerate(answers)]
    got = {r["case_id"]: r["state"] for r in ev.stability(spark.createDataFrame(rows, "judge string, case_id string, trial int, answer boolean")).collect()}
    assert got == {"s": "stable", "c": "contradiction", "f": "abstention_flip", "n": "stable"}


def test_gate_passes_the_perfect_and_fails_ties(spark):
    floors = spark.createDataFrame([("always-false", 0.5, 0.3), ("always-not-false", 0.0, 0.7)], "judge string, f1 double, accuracy_all double")
    subs = spark.createDataFrame([("perfect", 10, 10, 1.0, 1.0), ("tie", 10, 10, 0.6, 0.7), ("silent", 10, 9, 1.0, 1.0)], "name string, n long, answered long, f1 double, accuracy_all double")
    got = {r["name"]: r["reasons"] for r in ev.gate(subs, floors, 0.1, 0.4).collect()}
    assert got == {"perfect": [], "tie": ["within_noise_of_best_floor", "no_better_than_constant"], "silent": ["unanswered"]}


def test_larger_sample_holds_the_smaller(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k"))
    small, large = ({r["id"] for r in scoring.sample(rows, "id", "k", n, "s").collect()} for n in (4, 9))
    assert small < large and len(small) == 12


def test_mining_guards(spark):
    files = "repo string, sha string, parent_sha string, n_parents int, committed_at long, subject string, path string, old_path string, status string"
    make = lambda sha, subject="change", n=1, **f: [("r", sha, "p" + sha, n, 0, subject, p, None, s) for p, s in f.items()]
    rows = make("1", **{"docs/a.md": "M"}) + make("2", "fix typo", **{"docs/a.md": "M"}) + make("3", n=2, **{"docs/a.md": "M"}) + make("4", **{"docs/a.md": "M", "src/pool.py": "M"}) + make("5", **{"docs/a.md": "A"})
    diff = "--- a\n+++ b\n-uses poolLimit here\n-and more\n+uses poolSize here"
    diffs = spark.createDataFrame([("r", r[1], r[6], diff) for r in rows], "repo string, sha string, path string, diff string")
    got = mining.mine(spark.createDataFrame(rows, files), diffs).collect()
    assert sorted((r["shape"], r["fix_sha"], r["label"]) for r in got) == [("A", "4", "drift"), ("B", "1", "drift"), ("negative", "1", "clean"), ("negative", "4", "clean")]
    assert {r["code_path"] for r in got if r["shape"] == "A"} == {"src/pool.py"}


def test_counted_ranks_equal_sorted_ranks(spark):
    scores = spark.createDataFrame([(q, f"p{i}", float((i * 7 + q) % 5)) for q in range(3) for i in range(20)], "query_id long, path string, score double")
    rel = scores.where("path IN ('p3', 'p11')").select("query_id", "path")
    ranked = {(r["query_id"], r["path"]): r["rank"] for r in rt.rank(scores).collect() if r["path"] in ("p3", "p11")}
    assert {(r["query_id"], r["path"]): r["rank"] for r in rt.ranks_of(scores, rel).collect()} == ranked


def test_blocks_give_every_pair(spark):
    q = spark.createDataFrame([(i, "t") for i in range(7)], "query_id long, tree string")
    c = spark.createDataFrame([(f"p{i}", "t") for i in range(9)], "path string, tree string")
    for rows in (100, 2):
        assert rt.in_blocks(q, c, rows).distinct().count() == 63 == rt.in_blocks(q, c, rows).count()
