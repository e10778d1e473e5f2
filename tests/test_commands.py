"""The batch commands, end to end on a small repository."""

import json
import subprocess

import pytest

from plumbline.__main__ import COMMANDS, main, parser


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y", *a], cwd=path, check=True, capture_output=True)
    (path / "docs").mkdir()
    (path / "src").mkdir()
    doc = "The poolLimit setting holds connections.\nMore about poolLimit here.\n" + "Filler words stand here for length.\n" * 15

    def put(text, code, message):
        (path / "docs/pool.md").write_text(text)
        (path / "src/pool.py").write_text(code)
        (path / "src/other.py").write_text("unrelated_name = 1\n")
        run("add", ".")
        run("commit", "-qm", message)

    run("init", "-q")
    put(doc, "poolLimit = 3\n", "start")
    put(doc.replace("poolLimit", "poolSize"), "poolSize = 3\n", "rename the setting")
    put(doc.replace("poolLimit", "poolBound"), "poolSize = 3\n", "correct the page")
    (path / "src/lonely.py").write_text("nothing = 0\n")
    run("add", ".")
    run("commit", "-qm", "code alone")
    return path


@pytest.fixture(scope="module")
def mined(spark, repo, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "labels")
    assert main(["mine", "--repos", f"r={repo}", "--out", out, "--easy", "4"], spark) == 0
    return out


def test_mined_labels(spark, mined, repo):
    rows = spark.read.json(mined).collect()
    assert {(r["shape"], r["label"]) for r in rows} >= {("A", "drift"), ("B", "drift"), ("negative", "clean")}
    assert [r["code_path"] for r in rows if r["shape"] == "A"] == ["src/pool.py"]
    fields = {"subject", "parent_sha", "committed_at", "doc_lines_added", "doc_lines_removed", "files_in_commit"}
    fix = next(r for r in rows if r["shape"] == "A")
    assert fields <= set(fix.asDict()) and (fix["subject"], fix["doc_lines_added"], fix["doc_lines_removed"], fix["files_in_commit"]) == ("rename the setting", 2, 2, 2)
    head = subprocess.run(["git", "rev-parse", "HEAD"], cwd=repo, capture_output=True, text=True).stdout.strip()
    easy = [r for r in rows if r["shape"] == "negative_easy"]
    assert easy and all(r["at_sha"] == head and r["fix_sha"] == "" and r["code_path"] == "src/lonely.py" for r in easy)


def test_commands_run(spark, mined, repo, tmp_path, capsys):
    ids = [r["example_id"] for r in spark.read.json(mined).where("label = 'drift'").orderBy("example_id").collect()]
    (tmp_path / "sheets").mkdir()
    (tmp_path / "sheets/s.md").write_text("".join(f"## Case {n} — `{i}`\n\n**VERDICT: `{v}`**\n\n" for n, (i, v) in enumerate(zip(ids, ("drift", "cosmetic")), 1)))
    base = ["--labels", mined, "--sheets", str(tmp_path / "sheets")]
    for command in (["stats", "--labels", mined], ["score", *base], ["retention", "--old", mined, *base], ["judge-cases", *base], ["judge-eval", *base], ["judge-null-run", *base], ["judge-freeze", *base, "--out", str(tmp_path / "frozen")], ["sample", "--labels", mined, "--repos", f"r={repo}", "--out", str(tmp_path / "sheet")], ["retrieve-eval", "--labels", mined, "--repos", f"r={repo}"], ["doc-sample", "--repos", f"r={repo}", "--out", str(tmp_path / "check")]):
        assert main(command, spark) == 0, command
    assert "lexical-ablated" in capsys.readouterr().out
    (tmp_path / "c").mkdir()
    (tmp_path / "c/c.md").write_text("## Case 1 — `r` · `docs/pool.md`\n\n- [x] src/pool.py\n")
    assert main(["doc-eval", "--sheets", str(tmp_path / "c"), "--repos", f"r={repo}"], spark) == 0
    assert "poolSize" in spark.read.text(str(tmp_path / "sheet"), wholetext=True).first()[0]
    held = {r["example_id"]: r["code_path"] for r in spark.read.json(mined).collect()}
    verdict = dict(zip(ids, (True, False)))
    n = sum(held[i] is not None for i in ids)
    (tmp_path / "p.jsonl").write_text("".join(json.dumps({"example_id": i, "answer": verdict[i]}) + "\n" for i in ids if held[i]))
    judges = {"always-false": {"f1": 0.1, "accuracy_all": 0.1}, "always-not-false": {"f1": 0.0, "accuracy_all": 0.2}, "lexical-absence": {"f1": 0.3, "accuracy_all": 0.9}, "paid": {"f1": 1.0, "accuracy_all": 1.0}}
    corpus = {"verdicts": 2, "scoreable": 2, "with_code_path": n}
    floors = {"provenance": {"corpus": corpus}, "arms": {"seeded": {"judges": judges}}}
    width = {"provenance": {"corpus": corpus}, "judges": {"paid": {"minimum_detectable_effect_f1": 0.1, "chance_range": {"f1": [0.1, 0.3, 0.5]}}}}
    bench = ["bench", *base, "--floors", str(tmp_path / "f.json"), "--width", str(tmp_path / "w.json"), "--predictions", str(tmp_path / "p.jsonl")]
    (tmp_path / "f.json").write_text(json.dumps(floors))
    (tmp_path / "w.json").write_text(json.dumps(width))
    assert main(bench, spark) == (0 if verdict[next(i for i in ids if held[i])] else 1)
    for key in corpus:
        (tmp_path / "w.json").write_text(json.dumps(width | {"provenance": {"corpus": corpus | {key: 7}}}))
        assert main(bench, spark) == 2
    matrix = ["judge-null-run", *base, "--store", str(tmp_path / "trials"), "--out", str(tmp_path / "matrix"), "--trials", "2"]
    assert main(matrix, spark) == 0 and "0 answers found, 4 asked for" in capsys.readouterr().out
    assert main([*matrix[:-3], str(tmp_path / "matrix3"), "--trials", "3"], spark) == 0 and "4 answers found, 2 asked for" in capsys.readouterr().out
    assert "not-false" in spark.read.text(str(tmp_path / "matrix3")).first()[0]
    assert main(["mine", "--repos", f"r={repo}", "--out", str(tmp_path / "again"), "--pin", "x=HEAD"], spark) == 2


def test_model_arms_from_the_command_line(spark, mined, repo, tmp_path, capsys):
    """A scorer given by module and name; a second run finds its pairs stored, and results are written with their making."""
    base = ["retrieve-eval", "--labels", mined, "--repos", f"r={repo}", "--scorer", "plumbline.plans.model_queries:Md5Scorer", "--pair-store", str(tmp_path / "pairs"), "--top-n", "2"]
    assert main([*base, "--out", str(tmp_path / "r.json")], spark) == 0 and "rerank(lexical@2)-ablated" in capsys.readouterr().out
    held = json.loads(spark.read.text(str(tmp_path / "r.json"), wholetext=True).first()[0])
    assert list(held)[0] == "provenance" and {r["arm"] for r in held["results"]} >= {"lexical", "shuffle", "rerank(lexical@2)"} and held["provenance"]["code"]["files"]
    assert main(base, spark) == 0
    assert main([*base[:-4], "--pair-store", str(tmp_path / "pairs"), "--scorer", "plumbline.plans.model_queries:Other"], spark) == 2


def test_pins_add_up():
    from plumbline.__main__ import _revs
    from plumbline.sources.sheets import Refusal

    read = lambda *pins: _revs(parser().parse_args(["mine", "--repos", "a=x,b=y,c=z", "--out", "o", *[w for p in pins for w in ("--pin", p)]]))
    assert read("a=1", "b=2,c=3") == "a=1,b=2,c=3" and read() == ""
    for wrong in (("a=1", "a=2"), ("d=1",)):
        with pytest.raises(Refusal):
            read(*wrong)


def test_every_command_parses():
    for name, (_, needed) in COMMANDS.items():
        assert parser().parse_args([name, *[x for o in needed for x in (f"--{o}", "v")]]).command == name


def test_judge_commands_over_trees(spark, mined, repo, tmp_path, capsys):
    ids = [r["example_id"] for r in spark.read.json(mined).where("shape = 'A' AND label = 'drift'").collect()]
    (tmp_path / "s.md").write_text("".join(f"## Case {n} — `{i}`\n\n**VERDICT: `drift`**\n\n" for n, i in enumerate(ids, 1)))
    base = ["--labels", mined, "--sheets", str(tmp_path / "s.md"), "--repos", f"r={repo}", "--arm", "oracle"]
    assert main(["judge-eval", *base, "--only", ids[0]], spark) == 0
    assert "lexical-absence(>=3)" in capsys.readouterr().out
    assert main(["judge-eval", *base, "--only", "nobody"], spark) == 2
    assert main(["judge-prompts", *base, "--out", str(tmp_path / "p"), "--max-tokens", "1"], spark) == 2
    assert not (tmp_path / "p").exists()
    assert main(["judge-prompts", *base, "--out", str(tmp_path / "p")], spark) == 0
    row = spark.read.json(str(tmp_path / "p")).first()
    assert "poolLimit" in row["prompt"] and "rename the setting" not in row["prompt"] and len(row["key"]) == 64
    # both kinds of paid judges: prompts out, stored replies back in, scored beside the floors that were asked for
    paid = [*base, "--claim-batch", "1", "--only", ids[0]]
    assert main(["judge-prompts", *paid, "--judges", "model:m1,per-claim", "--model", "m1", "--out", str(tmp_path / "both")], spark) == 0
    asked = spark.read.json(str(tmp_path / "both")).collect()
    pages, claims = ([r for r in asked if r["judge"] == j] for j in ("model:m1", "per-claim:m1"))
    assert len(pages) == 1 and [(r["first"], r["n"]) for r in claims] == [(k, 1) for k in range(len(claims))]
    said = [{"key": pages[0]["key"], "reply": '{"verdict": "false"}', "truncated": False}]
    said += [{"key": r["key"], "reply": '[{"n": 1, "verdict": "not-false"}]', "truncated": False} for r in claims]
    (tmp_path / "replies.json").write_text("\n".join(map(json.dumps, said)))
    capsys.readouterr()
    judges = ["judge-eval", *paid, "--judges", "always-false,model:m1,per-claim:m1"]
    assert main([*judges, "--replies", str(tmp_path / "replies.json"), "--out", str(tmp_path / "scores.json")], spark) == 0
    out = capsys.readouterr().out
    assert "model:m1: 1 of 1" in out and f"per-claim:m1: {min(len(claims), 1)} of 1" in out and "always-false" in out and "prior" not in out and "lexical" not in out
    held = json.loads(spark.read.text(str(tmp_path / "scores.json"), wholetext=True).first()[0])
    assert {r["judge"] for r in held["results"]} >= {"always-false", "model:m1"} and held["provenance"]["config"]["judges"].endswith("per-claim:m1")
    assert main(judges, spark) == 2
    for wrong in ("nobody", "model:", "model:a,model:b", "model:a,per-claim:b"):
        assert main(["judge-eval", *paid, "--judges", wrong, "--replies", "none"], spark) == 2
    assert main(["judge-prompts", *paid, "--judges", "floors", "--out", str(tmp_path / "none")], spark) == 2
