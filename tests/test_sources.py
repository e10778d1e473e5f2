import json
import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.operators import caching
from plumbline.sources import digests, reports, sheets
from plumbline.sources.git import GitSource
from plumbline.streaming import counters

A, B = "0123456789abcdef", "fedcba9876543210"


def put(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.md").write_text("one\ntwo\n")
    (tmp_path / "b.py").write_text("x = 1\n" * 20)
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "a.md").write_bytes(b"one\nthree \xff\n")
    run("mv", "b.py", "c.py")
    (tmp_path / "é.md").write_text("accents\n")
    run("add", ".")
    run("commit", "-qam", "second | odd")
    run("update-index", "--add", "--cacheinfo", f"160000,{'1' * 40},module")  # a submodule's entry: no file of this repository
    run("commit", "-qm", "third")
    return tmp_path


def test_git_source(spark, repo):
    spark.dataSource.register(GitSource)
    read = lambda **o: spark.read.format("plumb_git").options(repos=f"r={repo}", **o).load()
    commits = read().orderBy(F.desc("committed_at"), F.size("parents").desc()).collect()
    assert {c["subject"] for c in commits} == {"first", "second | odd", "third"}
    second = next(c for c in commits if c["subject"].startswith("second"))
    assert {(f["status"], f["path"], f["old_path"]) for f in second["files"]} == {("M", "a.md", None), ("R", "c.py", "b.py"), ("A", "é.md", None)}
    assert {r["path"] for r in read(table="tree").collect()} == {"a.md", "c.py", "é.md", "module"}
    held = {r["path"]: r["text"] for r in read(table="blobs").collect()}
    assert held == {"a.md": "one\nthree �\n", "c.py": "x = 1\n" * 20, "é.md": "accents\n"}
    changes = {(r["sha"], r["path"]): r["diff"] for r in read(table="diffs").collect()}
    assert {p for s, p in changes if s == second["sha"]} == {"a.md", "c.py", "é.md"} and "-two" in changes[second["sha"], "a.md"]
    assert {r["path"] for r in read(table="tree", revs=f"r={second['sha']}").collect()} == {"a.md", "c.py", "é.md"}
    assert read(limit="1").count() == 1


def test_changed_lines_that_look_like_headers(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "doc.md").write_text("one\n-- a/old.md\n")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "doc.md").write_text("one\n++ b/other.md\nrename to x.md\n")
    (tmp_path / "v\x0bt.md").write_text("odd name\n")
    run("add", ".")
    run("commit", "-qm", "second")
    spark.dataSource.register(GitSource)
    read = lambda **o: spark.read.format("plumb_git").options(repos=f"r={tmp_path}", **o).load()
    found = {r["path"]: r["diff"] for r in read(table="diffs", limit="1").collect()}
    assert "doc.md" in found and "+++ b/other.md" in found["doc.md"] and len(found) == 2 and "other.md" not in found


LEGEND = "# Review (seed 11)\n\nFor each case, replace `VERDICT: ?` with one of:\n\n- `drift` — the doc said something untrue\n- `new` — documented something new\n\n---\n\n"


def case(n, example, verdict):
    return f"## Case {n} — `{example}`\n\n- **repo** `a/b` · **shape** A\n- **shared identifiers** `building`, `open`\n\n**VERDICT: {verdict}**\n\n<details><summary>doc diff</summary>\n\n```diff\n-old\n+new\n```\n\n</details>\n\n"


def test_sheets(spark, tmp_path):
    more = [f"{k:016x}" for k in range(5)]
    put(tmp_path / "s1.md", LEGEND + case(1, A, "`drift`") + case(2, B, "?") + "".join(case(k + 3, x, f"`{v}`") for k, (x, v) in enumerate(zip(more, ("new", "cosmetic", "unrelated", "unclear", "perhaps")))))
    put(tmp_path / "s2.md", LEGEND + case(1, A, "`new`") + case(2, B, "`unclear`"))
    rows = sheets.scoped(sheets.sheets(spark, str(tmp_path)))
    got = {r["example_id"]: r for r in sheets.first_verdicts(rows).collect()}
    assert (got[A]["verdict"], got[A]["target"], got[A]["n_seen"]) == ("drift", True, 2)
    assert (got[B]["verdict"], got[B]["target"]) == ("unclear", None)
    assert {x: (got[x]["verdict"], got[x]["target"]) for x in more[:4]} == {more[0]: ("new", False), more[1]: ("cosmetic", False), more[2]: ("unrelated", False), more[3]: ("unclear", None)} and more[4] not in got
    only = sheets.sheets(spark, str(tmp_path / "s2.md"))
    assert [(r["pos"], r["example_id"], r["verdict"]) for r in sheets.positional(only).orderBy("pos").collect()] == [(0, A, "new"), (1, B, "unclear")]
    odd = spark.createDataFrame([("x", LEGEND + case(1, A, "`drift`") + f"## Case 2 — `{B}`\n\nno verdict\n")], "sheet string, content string")
    empty = spark.createDataFrame([("x", LEGEND)], "sheet string, content string")
    for wrong in (odd, empty):
        with pytest.raises(Exception, match="headings"):
            sheets.positional(wrong).collect()
    with pytest.raises(Exception, match="no case"):
        sheets.scoped(empty).collect()
    for style in ("drift", "`drift`", "DRIFT"):
        one = spark.createDataFrame([("x", case(1, A, style))], "sheet string, content string")
        assert [r["verdict"] for r in sheets.positional(one).collect()] == ["drift"]


def test_a_written_sheet_is_read_back(spark):
    row = {"example_id": A, "repo": "a/b", "label": "drift", "label_basis": "x", "shape": "A", "doc_path": "d.md", "code_path": "c.py", "at_sha": "1", "fix_sha": "2", "parent_sha": "1", "committed_at": 3, "subject": "s", "doc_lines_added": 1, "doc_lines_removed": 1, "files_in_commit": 2, "shared_identifiers": ["tok"]}
    examples = spark.createDataFrame([tuple(row.values()), tuple((row | {"example_id": B}).values())], sheets.EXAMPLE)
    diffs = spark.createDataFrame([(A, "-a\n+b", "-c\n+d")], "example_id string, doc_diff string, code_diff string")
    text = "\n".join(r["block"] for r in sheets.review_sheet(examples, diffs).orderBy("nr").collect())
    assert "-c\n+d" in text and "shared identifiers** `tok`" in text
    filled = text.replace("**VERDICT: ?**", "**VERDICT: `cosmetic`**")
    got = sheets.scoped(spark.createDataFrame([("x", filled)], "sheet string, content string")).collect()
    assert {(r["example_id"], r["verdict"]) for r in got} == {(A, "cosmetic"), (B, "cosmetic")}
    assert sheets.scoped(spark.createDataFrame([("x", text)], "sheet string, content string")).collect() == []


def test_checklist(spark, tmp_path):
    head = lambda n, doc: f"## Case {n} — `a/b` · `{doc}`\n\n- **read** `x/{doc}` (900 chars)\n- **tree** `0123456789ab`\n\n"
    path = put(tmp_path / "c.md", "Legend\n\n" + head(1, "docs/a.md") + "- [x] src/one.py\n- [ ] src/two.py\n\n**NONE:** [ ]\n\n**EXTRA:** `lib/three.py`, lib/four.py\n\n**NOTES:** - [x] no\n\n---\n\n" + head(2, "docs/b.md") + "- [ ] src/one.py\n\n**NONE:** [X]\n\n**EXTRA:**\n\n" + head(3, "docs/c.md") + "- [ ] src/one.py\n\n**NONE:** [ ]\n\n**EXTRA:**\n")
    got = {r["doc_path"]: r for r in sheets.checklist(sheets.sheets(spark, path)).collect()}
    a = got["docs/a.md"]
    assert (a["repo"], a["sha_prefix"], a["marked"], a["extra"], a["none"], a["answered"]) == ("a/b", "0123456789ab", ["src/one.py"], ["lib/three.py", "lib/four.py"], False, True)
    assert got["docs/b.md"]["none"] and got["docs/b.md"]["answered"] and got["docs/b.md"]["marked"] == []
    assert not got["docs/c.md"]["answered"]


def test_predictions(spark, tmp_path):
    answers = {"a": "true", "b": "false", "c": "null", "d": '"false"', "e": '"Stale "', "f": '"not-false"', "g": '"fresh"', "h": '"abstain"', "i": '""', "j": '"true"'}
    good = put(tmp_path / "p.jsonl", "# note\n\n" + "".join(f'{{"example_id": "{k}", "answer": {v}}}\n' for k, v in answers.items()) + '{"example_id": "k"}\n')
    got = {r["example_id"]: r["answer"] for r in sheets.predictions(spark, good).collect()}
    assert got == {"a": True, "b": False, "c": None, "d": True, "e": True, "f": False, "g": False, "h": None, "i": None, "j": True, "k": None}
    wrong = {"no json": "nope", "no object": "[1]", "no id": '{"answer": true}', "empty id": '{"example_id": "", "answer": true}', "word": '{"example_id": "x", "answer": "perhaps"}', "drift": '{"example_id": "x", "answer": "drift"}', "number": '{"example_id": "x", "answer": 1}', "twice": '{"example_id": "x", "answer": true}\n' * 2, "empty": "# nothing"}
    for name, text in wrong.items():
        with pytest.raises(sheets.Refusal):
            sheets.predictions(spark, put(tmp_path / f"{name}.jsonl", text))


CORPUS = {"verdicts": 9, "scoreable": 7, "with_code_path": 5}
FLOORS = {"provenance": {"corpus": CORPUS | {"sheets": 2}}, "generated_at": "x", "arms": {"seeded": {"judges": {"always-not-false": {"f1": 0.0, "accuracy_all": 0.6, "n": 5}, "lexical-absence(>=3)": {"f1": 0.4, "accuracy_all": 0.5, "confusion": {"tp": 1}}, "always-false": {"f1": 0.4, "accuracy_all": 0.3}, "model:x": {"f1": 0.9, "accuracy_all": 0.9}}}}}
WIDTH = {"provenance": {"corpus": CORPUS}, "judges": {"model:x": {"minimum_detectable_effect_f1": 0.11, "chance_range": {"f1": [0.1, 0.2, 0.33]}, "n": 5}}}


def test_bars_from_two_reports(spark, tmp_path):
    place = lambda name, report: put(tmp_path / f"{name}.json", json.dumps(report, indent=1))
    read = lambda f=FLOORS, w=WIDTH, c=CORPUS, **o: sheets.bars(spark, place("f", f), place("w", w), c, **o)
    assert read() == {"best_free_name": "always-false", "best_free_f1": 0.4, "constant_accuracy": 0.6, "chance_f1_p95": 0.33, "width_f1": 0.11}
    for key in CORPUS:
        with pytest.raises(sheets.Refusal, match=f"CORPUS_MISMATCH.*floors.*{key} was {CORPUS[key]} and is now 99"):
            read(c=CORPUS | {key: 99})
    with pytest.raises(sheets.Refusal, match="CORPUS_MISMATCH.*width"):
        read(w=WIDTH | {"provenance": {"corpus": CORPUS | {"scoreable": 1}}})
    judges = FLOORS["arms"]["seeded"]["judges"]
    only = lambda *names: FLOORS | {"arms": {"seeded": {"judges": {k: v for k, v in judges.items() if k in names}}}}
    for wrong, why in (({"f": {"arms": {}}}, "names no corpus"), ({"arm": "oracle"}, "has no arm"), ({"f": only("model:x", "always-not-false") | {}}, None), ({"f": only("model:x")}, "free floors"), ({"f": only("always-false")}, "always-not-false"),
                       ({"w": WIDTH | {"judges": {}}}, "records no judges"), ({"w": WIDTH | {"judges": {"x": {"chance_range": {"f1": [1, 2, 3]}}}}}, "minimum_detectable"), ({"w": WIDTH | {"judges": {"x": {"minimum_detectable_effect_f1": 0.1}}}}, "chance range")):
        if why is None:
            assert read(**wrong)["best_free_name"] == "always-not-false"
            continue
        with pytest.raises(sheets.Refusal, match=why):
            read(**wrong)


def test_labels_writer_refuses_and_digests(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k:03d}", "r", "drift" if k % 2 else "clean", "A") for k in range(50)] + [("dup", "r", "clean", "A")] * 3, "example_id string, repo string, label string, shape string")
    m = sheets.write_labels(rows.repartition(1), str(tmp_path / "out"), {"k": 1}, {"r": "abc"}, ["mine"])
    again = sheets.write_labels(rows.repartition(40), str(tmp_path / "many"), {"k": 1}, {"r": "abc"}, ["mine"])
    assert m["counts"] == {"r/drift/A": 25, "r/clean/A": 28} and m["output"]["digest"] == again["output"]["digest"] and m["repos"] == {"r": "abc"}
    assert set(m["code"]) == {"files", "commit", "dirty"} and len(m["code"]["files"]) == 64
    with pytest.raises(Exception, match="(?i)exists"):
        sheets.write_labels(rows, str(tmp_path / "out"), {})
    assert sheets.labels(spark, str(tmp_path / "out")).count() == 53
    assert digests.check_manifest(spark, str(tmp_path / "many"), str(tmp_path / "out.manifest"))["output"]["examples"] == 53
    for change in (lambda t: t.replace("drift", "drifT", 1), lambda t: t + t.splitlines()[0] + "\n", lambda t: "\n".join(t.splitlines()[1:]) + "\n"):
        (part,) = (tmp_path / "out").glob("part-*")
        was = part.read_text()
        part.write_text(change(was))
        (tmp_path / "out" / f".{part.name}.crc").unlink(missing_ok=True)
        with pytest.raises(sheets.Refusal, match="digest"):
            digests.check_manifest(spark, str(tmp_path / "out"), str(tmp_path / "out.manifest"))
        part.write_text(was)
    assert digests.tree_digest(spark.createDataFrame([], "value string")) != digests.tree_digest(spark.createDataFrame([(None,)], "value string"))


def test_bundles_are_linked_by_the_sheet(spark, tmp_path):
    import re

    held = [("a/b", f"src/{n} x.py" if n == 3 else f"src/m{n}.py", f"text {n}\nline") for n in range(5)] + [("a/b", "src/m_1.py", "other"), ("a/b", "docs/p.md", "page"), ("c", "x.py", None), ("c", "d.md", "doc"), ("z", "unasked.py", "no")]
    held = spark.createDataFrame(held, "repo string, path string, text string")
    cases = spark.createDataFrame([("a/b", "docs/p.md"), ("c", "d.md")], "repo string, doc_path string")
    pool = held.where("path LIKE '%.py'").withColumn("sha", F.lit("f" * 40))
    root = str(tmp_path / "bundle")
    reports.bundle(cases, held, root)
    sheet = reports.checklist(cases, pool, root).orderBy("nr", "pos").collect()
    text = "\n".join(r["block"] for r in sheet)
    links = re.findall(r"\[text\]\((.*?)\)", text)
    assert len(links) == len(set(links)) == 9
    said = {spark.read.text(link, wholetext=True).first()[0].rstrip("\n") for link in links}
    assert said == {*(f"text {n}\nline" for n in range(5)), "other", "page", "", "doc"}
    (tmp_path / "s").mkdir()
    put(tmp_path / "s/s.md", text.replace("- [ ] src/m2.py", "- [x] src/m2.py"))
    got = {r["doc_path"]: r for r in sheets.checklist(sheets.sheets(spark, str(tmp_path / "s"))).collect()}
    assert got["docs/p.md"]["marked"] == ["src/m2.py"] and got["docs/p.md"]["sha_prefix"] == "f" * 12 and not got["d.md"]["answered"]
    with pytest.raises(Exception, match="(?i)exists"):
        reports.bundle(cases, held, root)


def test_case_selection(spark, tmp_path):
    cases = spark.createDataFrame([(A,), (B,)], "example_id string")
    ids = sheets.id_list(spark, ["@" + put(tmp_path / "ids", f"{A} # known\n\n")])
    assert [r[0] for r in sheets.select_cases(cases, ids).collect()] == [A]
    with pytest.raises(sheets.Refusal):
        sheets.select_cases(cases, sheets.id_list(spark, ["zzz"]))


def test_cache_computes_once(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "aa"), ("k1", "aa"), ("k2", "b")], "key string, text string")
    asked = []

    def compute(missing):
        asked.append(missing.count())
        return missing.withColumn("n", F.length("text"))

    for _ in range(2):
        got = caching.with_cache(rows, compute, str(tmp_path / "cache"), "model:1", "n", "int")
        assert sorted(r["n"] for r in got.collect()) == [1, 2, 2]
    assert asked == [2, 0]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = counters.tallies(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tallies").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM tallies").collect())) == sorted(map(tuple, counters.tallies(events).collect()))
