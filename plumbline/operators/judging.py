"""Judges over stored replies, prompts, claims against diffs, and spending limits.

No model is called here.  A model's replies are a table keyed by the content of the request; a judge is
a join with it, and requests without a reply are what is left to send.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts, tokens
from ..sources.sheets import Refusal
from .evaluation import page_answer

#: Columns that would tell a judge the answer; no prompt may be built from them.
LEAKING = ("subject", "shared_identifiers", "fix_sha", "diff", "verdict", "target", "label")
#: Judges that cost nothing, the kinds that call a model, and how many claims one request of them holds.
FREE, PAID, CLAIM_BATCH = ("always-false", "always-not-false", "abstain", "prior", "lexical-absence"), ("model", "per-claim"), 8


def render_page(doc: Column, files: Column) -> Column:
    """A prompt of the document and its code files (array of path, text, truncated); nothing else goes in."""
    shown = F.transform(files, lambda f: F.concat(F.lit("### "), f["path"], F.when(f["truncated"], " (excerpt)").otherwise(""), F.lit("\n"), f["text"]))
    return F.concat_ws("\n\n", F.lit("Document:"), doc, F.lit("Code:"), F.array_join(shown, "\n\n"), F.lit('Reply as JSON: {"verdict": "false" | "not-false" | "unclear"}'))


def render_claims(claims: Column, files: Column) -> Column:
    """A prompt of numbered claims, counted from 1."""
    numbered = F.transform(claims, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    return F.concat_ws("\n\n", F.lit("Claims:"), F.array_join(numbered, "\n"), F.lit("Code:"), F.array_join(F.transform(files, lambda f: F.concat(F.lit("### "), f["path"], F.lit("\n"), f["text"])), "\n\n"), F.lit('Reply as a JSON array: [{"n": 1, "verdict": "false" | "not-false" | "unclear"}]'))


def roster(names: list[str], model: str) -> tuple[list[str], dict[str, str]]:
    """The free judges that ``names`` ask for, in their order, and of each paid kind the name its results carry.

    A name is a free judge, the group ``floors`` of all free judges, or a paid kind alone or with the id of its model
    (``model:some-id``); alone it takes ``model``.  Unknown names, empty ids and two different models are refused.
    """
    free, asked = [], {}
    for name in names:
        kind, colon, given = name.partition(":")
        if name in FREE or name == "floors":
            free += FREE if name == "floors" else [name]
        elif kind not in PAID or (colon and not given):
            raise Refusal(f"no judge is called {name!r}; there are {', '.join(('floors', *FREE))}, and {' or '.join(f'{k}:<id>' for k in PAID)}")
        elif asked.setdefault(kind, given or model) != (given or model):
            raise Refusal(f"{kind} is asked for with two models")
    if len(set(asked.values())) > 1:
        raise Refusal(f"one result speaks of one model, not of {sorted(set(asked.values()))}")
    return list(dict.fromkeys(free)), {k: f"{k}:{m}" for k, m in asked.items()}


def page_requests(shown: DataFrame, model: str) -> DataFrame:
    """case_id, key, prompt of each context ``shown`` (example_id, arm, doc_text, files)."""
    prompt = render_page(F.col("doc_text"), F.col("files"))
    return shown.select(F.col("example_id").alias("case_id"), reply_key(model, "page", F.col("arm"), prompt).alias("key"), prompt.alias("prompt"))


def claim_requests(shown: DataFrame, model: str, size: int = CLAIM_BATCH) -> DataFrame:
    """case_id, key, prompt, first, n: a row for each ``size`` claims of a page, ``first`` being the number of the first from 0.

    A page without claims has no row.
    """
    cut = texts.batches(texts.claim_units(F.coalesce("doc_text", F.lit(""))), size)
    rows = shown.select("example_id", "arm", "files", F.posexplode(cut).alias("pos", "claims"))
    prompt = render_claims(F.col("claims"), F.col("files"))
    return rows.select(F.col("example_id").alias("case_id"), reply_key(model, "claims", F.col("arm"), prompt).alias("key"), prompt.alias("prompt"), (F.col("pos") * size).alias("first"), F.size("claims").alias("n"))


def paid_answers(shown: DataFrame, replies: DataFrame, names: dict[str, str], model: str, size: int = CLAIM_BATCH) -> DataFrame:
    """case_id, judge, answer of the paid kinds in ``names`` whose replies are stored; a case with a reply missing has no row."""
    out = []
    if "model" in names:
        out.append(judge_pages(page_requests(shown, model), replies).select("case_id", F.lit(names["model"]).alias("judge"), "answer"))
    if "per-claim" in names:
        asked = claim_requests(shown, model, size)
        short = missing_replies(asked, replies).select("key").join(asked, "key").select("case_id").distinct()
        claims = judge_claims(asked.join(short, "case_id", "left_anti"), replies)
        pages = claims.groupBy("case_id").agg(page_answer(F.col("answer")).alias("answer"))
        out.append(pages.select("case_id", F.lit(names["per-claim"]).alias("judge"), "answer"))
    return reduce(DataFrame.unionByName, out)


def check_leaks(columns: list[str]) -> None:
    if found := sorted(set(columns) & set(LEAKING)):
        raise Refusal(f"a prompt must not see {found}")


def reply_key(model: str, request: str, arm: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(model), F.lit(request), arm, prompt), 256)


def judge_pages(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """requests(case_id, key) with ``answer``; a reply that can't be read is ``unparsed`` and abstains, a missing one has no row."""
    j = requests.join(replies.select("key", "reply", "truncated").dropDuplicates(["key"]), "key")
    return j.select("case_id", "key", texts.reply_verdict(F.col("reply")).alias("answer"), texts.reply_word(F.col("reply")).isNull().alias("unparsed"), "truncated")


def missing_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    return requests.join(replies.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])


def judge_claims(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """requests(case_id, key, first, n) with one row a claim (case_id, idx, answer).

    A reply is a JSON array of {n, verdict}; numbers out of range and unknown words are dropped, the
    first of a number wins, claims without an answer abstain.
    """
    j = requests.join(replies.select("key", "reply").dropDuplicates(["key"]), "key")
    items = F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), "array<struct<n:int,verdict:string>>")
    said = j.select("case_id", "first", "n", F.posexplode(items).alias("pos", "item")).select("case_id", "first", "n", "pos", F.col("item.n").alias("nr"), F.lower("item.verdict").alias("v"))
    said = said.where(F.col("nr").between(1, F.col("n")) & F.col("v").isin("false", "not-false"))
    w = Window.partitionBy("case_id", "first", "nr").orderBy("pos")
    said = said.withColumn("k", F.row_number().over(w)).where("k = 1").select("case_id", (F.col("first") + F.col("nr") - 1).alias("idx"), (F.col("v") == "false").alias("answer"))
    every = requests.where("n > 0").select("case_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("idx"))
    return every.join(said, ["case_id", "idx"], "left")


def check_spend(prompts: DataFrame, cap_tokens: int, per_token: float = 2.7) -> int:
    """The estimated input tokens; refused before anything is sent if they exceed the cap."""
    need = round((prompts.agg(F.sum(F.length("prompt"))).first()[0] or 0) / per_token)
    if need > cap_tokens:
        raise Refusal(f"{need} tokens are over the cap of {cap_tokens}")
    return need


def measured_spend(replies: DataFrame, key: str) -> DataFrame:
    """Tokens that replies report; unknown ones are counted apart from zero."""
    return replies.groupBy(key).agg(F.count("*").alias("replies"), F.count_if(F.col("tokens").isNull()).alias("unknown"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def locate_claim(claim: Column, changed: Column, page: Column, least: int = 12, share: float = 0.5) -> Column:
    """in-changed, elsewhere or not-locatable: the exact text first, then half of the shingles; changed lines win."""
    c, d, p = normal(claim), normal(changed), normal(page)
    sc, sd, sp = (texts.shingles(x) for x in (claim, changed, page))
    near = lambda s: texts.containment(sc, s) >= share
    return (
        F.when(F.length(c) < least, "not-locatable").when(d.contains(c), "in-changed").when(p.contains(c) & ~near(sd), "elsewhere")
        .when(near(sd), "in-changed").when(near(sp), "elsewhere").otherwise("not-locatable")
    )


def claim_survives(claims: DataFrame, budgets: list[int]) -> DataFrame:
    """(claim_id, budget, survives): whether all shingles of a claim stand within the first ``budget`` characters."""
    rows = claims.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    head = texts.shingles(F.expr("substring(page, 1, budget)"))
    own = texts.shingles(F.col("claim"))
    return rows.select("claim_id", "budget", ((F.size(own) > 0) & (F.size(F.array_except(own, head)) == 0)).alias("survives"))


def coverage_rank(files: DataFrame) -> DataFrame:
    """files(case_id, path, is_oracle, marked, text): share of marked identifiers a file names (null for none marked),
    and for the known file 1 + the number of files that name strictly more."""
    have = F.size(F.array_intersect("marked", tokens.extract(F.col("text"), with_versions=False)))
    c = files.withColumn("coverage", F.when(F.size("marked") > 0, F.round(have / F.size("marked"), 6)))
    w = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("coverage"))
    return c.withColumn("place", F.rank().over(w)).select("case_id", "path", "is_oracle", "coverage", "place")


def case_tally(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sheets, verdicts, repeats, ids without a label, scoreable and with a code path."""
    first = verdicts.groupBy("example_id").agg(F.count("*").alias("seen"), F.min_by("target", F.struct("sheet", "pos")).alias("target"))
    j = first.join(labels.select("example_id", "code_path", F.lit(1).alias("known")), "example_id", "left")
    sheets = verdicts.agg(F.countDistinct("sheet").alias("sheets"))
    tally = j.agg(F.count("*").alias("cases"), F.sum(F.col("seen") - 1).alias("duplicates"), F.count_if(F.col("known").isNull()).alias("unresolvable"), F.count_if(F.col("target").isNotNull() & F.col("known").isNotNull()).alias("scoreable"), F.count_if(F.col("code_path").isNotNull()).alias("with_code_path"))
    return tally.crossJoin(sheets)  # one row each
