"""Queries over replies, prompts, claims and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import caching, judging
from ..sources import sheets
from .registry import query, table
from .text_queries import sql_extract

# Events stand for replies: a request is a user, its reply the first event of the user.
REPLY = "CASE event_type WHEN 'error' THEN '{\"verdict\": \"false\"}' WHEN 'click' THEN 'ok {\"verdict\": \"not-false\"}' WHEN 'view' THEN 'garbled' ELSE '{\"verdict\": \"unclear\"}' END"


@query("""WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM events),
r AS (SELECT doc_id AS case_id, event_type FROM documents JOIN f ON doc_id = user_id AND nr = 1)
SELECT CASE event_type WHEN 'error' THEN 'false' WHEN 'click' THEN 'not-false' ELSE 'abstain' END AS said, count(*)::BIGINT AS n, count_if(event_type = 'view')::BIGINT AS unparsed FROM r GROUP BY 1""")
def judge_replies(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("event_type"))
    replies = first.select(F.col("user_id").cast("string").alias("key"), F.expr(REPLY).alias("reply"), F.lit(False).alias("truncated"))
    requests = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.col("doc_id").cast("string").alias("key"))
    said = F.when(F.col("answer"), "false").when(~F.col("answer"), "not-false").otherwise("abstain")
    return judging.judge_pages(requests, replies).groupBy(said.alias("said")).agg(F.count("*").alias("n"), F.count_if("unparsed").alias("unparsed"))


@query("SELECT count(*)::BIGINT AS unanswered FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events)")
def missing_replies(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda t, c: table(spark, sf, t).select(F.col(c).cast("string").alias("key"))
    return judging.missing_replies(key("documents", "doc_id"), key("events", "user_id")).agg(F.count("*").alias("unanswered"))


@query("""WITH r AS (SELECT conv_id, list(struct_pack(n := ((turn * 3) % 7) + 0, v := CASE role WHEN 'user' THEN 'false' WHEN 'assistant' THEN 'not-false' ELSE 'x' END, pos := turn) ORDER BY turn) AS items FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, unnest(items, recursive := true) FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, n ORDER BY pos) AS nr FROM e WHERE n BETWEEN 1 AND 5 AND v <> 'x')
SELECT c.conv_id AS case_id, i::BIGINT AS idx, k.v = 'false' AS answer FROM (SELECT DISTINCT conv_id FROM conversations) c, unnest(range(1, 6)) AS u(i) LEFT JOIN k ON k.conv_id = c.conv_id AND k.n = i AND k.nr = 1""")
def judge_claim_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Five claims a conversation; its turns make up the reply array."""
    item = F.struct("turn", F.struct(((F.col("turn") * 3) % 7).cast("int").alias("n"), F.expr("CASE role WHEN 'user' THEN 'false' WHEN 'assistant' THEN 'not-false' ELSE 'x' END").alias("verdict")).alias("i"))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["i"]).alias("a"))
    replies = g.select(F.col("conv_id").cast("string").alias("key"), F.concat(F.lit("Sure: "), F.to_json("a"), F.lit(" done")).alias("reply"))
    requests = g.select(F.col("conv_id").alias("case_id"), F.col("conv_id").cast("string").alias("key"), F.lit(1).cast("long").alias("first"), F.lit(5).cast("long").alias("n"))
    return judging.judge_claims(requests, replies)


@query("SELECT event_type, count(*)::BIGINT AS replies, count_if(event_id % 9 = 0)::BIGINT AS unknown, coalesce(sum(CASE WHEN event_id % 9 <> 0 THEN event_id % 100 END), 0)::BIGINT AS tokens FROM events GROUP BY event_type")
def measured_spend(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 100).alias("tokens"))
    return judging.measured_spend(e, "event_type")


@query("""SELECT conv_id, turn, md5('Document:' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Code:' || chr(10) || chr(10) || '### ' || role || '.py' || CASE WHEN length(text) > 200 THEN ' (excerpt)' ELSE '' END || chr(10) || substr(text, 1, 200) || chr(10) || chr(10) || 'Reply as JSON: {"verdict": "false" | "not-false" | "unclear"}') AS prompt_md5 FROM conversations""")
def rendered_prompts(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    judging.check_leaks(t.columns)
    files = F.array(F.struct(F.concat("role", F.lit(".py")).alias("path"), F.substring("text", 1, 200).alias("text"), (F.length("text") > 200).alias("truncated")))
    return t.select("conv_id", "turn", F.md5(judging.render_page(F.col("text"), files)).alias("prompt_md5"))


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SH = "coalesce(list_distinct(list_transform(range(1, greatest(len({0}) - 2, 1)), lambda i: array_to_string({0}[i : i + 3], ' '))), [])"
_WS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT conv_id, turn, text, lead(text) OVER w AS page, lag(text) OVER w AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, turn, substr(text, 1, 60) AS claim, coalesce(CASE WHEN turn % 3 = 0 THEN text END, changed, '') AS changed, coalesce(CASE WHEN turn % 3 = 1 THEN text END, page, '') AS page FROM t),
n AS (SELECT *, {_NORM.format('claim')} AS c, {_NORM.format('changed')} AS d, {_NORM.format('page')} AS p, {_WS.format('claim')} AS wc, {_WS.format('changed')} AS wd, {_WS.format('page')} AS wp FROM c),
s AS (SELECT *, {_SH.format('wc')} AS sc, {_SH.format('wd')} AS sd, {_SH.format('wp')} AS sp FROM n),
o AS (SELECT *, CASE WHEN len(sc) = 0 THEN 0 ELSE len(list_intersect(sc, sd)) / len(sc) END AS od, CASE WHEN len(sc) = 0 THEN 0 ELSE len(list_intersect(sc, sp)) / len(sc) END AS op FROM s)
SELECT conv_id, turn, CASE WHEN length(c) < 12 THEN 'not-locatable' WHEN contains(d, c) THEN 'in-changed' WHEN contains(p, c) AND od < 0.5 THEN 'elsewhere' WHEN od >= 0.5 THEN 'in-changed' WHEN op >= 0.5 THEN 'elsewhere' ELSE 'not-locatable' END AS place FROM o""")
def claim_locate(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumns({"page": F.lead("text").over(w), "changed": F.lag("text").over(w)})
    own = lambda k: F.when(F.col("turn") % 3 == k, F.col("text"))
    t = t.select("conv_id", "turn", F.substring("text", 1, 60).alias("claim"), F.coalesce(own(0), "changed", F.lit("")).alias("changed"), F.coalesce(own(1), "page", F.lit("")).alias("page"))
    return t.select("conv_id", "turn", judging.locate_claim(F.col("claim"), F.col("changed"), F.col("page")).alias("place"))


@query(f"""WITH c AS (SELECT doc_id AS claim_id, text, {_WS.format("substr(text, 301, 80)")} AS wc FROM documents), b AS (SELECT c.*, budget, {_WS.format("substr(text, 1, budget)")} AS wp FROM c, (VALUES (200), (500), (2000)) AS v(budget)),
s AS (SELECT claim_id, budget, {_SH.format('wc')} AS sc, {_SH.format('wp')} AS sp FROM b)
SELECT claim_id, budget::INT AS budget, len(sc) > 0 AND len(list_filter(sc, lambda x: NOT list_contains(sp, x))) = 0 AS survives FROM s""")
def claim_survival(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.substring("text", 301, 80).alias("claim"), F.col("text").alias("page"))
    return judging.claim_survives(c, [200, 500, 2000])


@query(f"""WITH f AS (SELECT doc_id // 5 AS case_id, doc_id AS path, ['lich', 'tion', 'ment', 'andthe'] AS marked, {sql_extract('text', versions=False)} AS t FROM documents),
c AS (SELECT case_id, path, round(len(list_intersect(marked, t)) / len(marked), 6) AS coverage FROM f)
SELECT case_id::BIGINT AS case_id, path, path % 5 = 0 AS is_oracle, coverage, rank() OVER (PARTITION BY case_id ORDER BY coverage DESC)::INT AS place FROM c""")
def coverage_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 5).alias("case_id"), F.col("doc_id").alias("path"), (F.col("doc_id") % 5 == 0).alias("is_oracle"), F.array(*map(F.lit, ("lich", "tion", "ment", "andthe"))).alias("marked"), "text")
    return judging.coverage_rank(d)


@query("""WITH v AS (SELECT doc_id % 300 AS example_id, source AS sheet, doc_id AS pos, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS target FROM documents),
f AS (SELECT example_id, count(*) AS seen, min_by(target, (sheet, pos)) AS target FROM v GROUP BY example_id), s AS (SELECT * FROM (SELECT example_id, target, row_number() OVER (PARTITION BY example_id ORDER BY sheet, pos) AS nr, count(*) OVER (PARTITION BY example_id) AS seen FROM v) WHERE nr = 1)
SELECT (SELECT count(DISTINCT sheet) FROM v)::BIGINT AS sheets, count(*)::BIGINT AS cases, sum(seen - 1)::BIGINT AS duplicates, count_if(l.doc_id IS NULL)::BIGINT AS unresolvable, count_if(s.target IS NOT NULL AND l.doc_id IS NOT NULL)::BIGINT AS scoreable, count_if(l.toxic = 0)::BIGINT AS with_code_path FROM s LEFT JOIN labels l ON l.doc_id = s.example_id""")
def case_tally(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "documents").select((F.col("doc_id") % 300).alias("example_id"), F.col("source").alias("sheet"), F.col("doc_id").alias("pos"), F.expr("CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("target"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("example_id"), F.when(F.col("toxic") == 0, "x.py").alias("code_path"))
    return judging.case_tally(v, labels)


# Labels fill sheets of fifty ids: a verdict by the label's cells, some open, some in an unknown word.
WORD_SQL = "CASE doc_id % 7 WHEN 0 THEN '?' WHEN 1 THEN '`new`' WHEN 2 THEN '`cosmetic`' WHEN 3 THEN '`unrelated`' WHEN 4 THEN '`dunno`' WHEN 5 THEN '`unclear`' ELSE '`drift`' END"
CASES_SQL = f"""b AS (SELECT doc_id // 50 AS sheet, doc_id, '## Case ' || (doc_id % 50 + 1) || ' — `id' || doc_id || '`' || chr(10) || chr(10) || '- **basis** `drift`, see `VERDICT: ?`' || chr(10) || chr(10) || '**VERDICT: ' || {WORD_SQL} || '**' || chr(10) || chr(10) AS block FROM labels),
s AS (SELECT sheet, 'Replace `VERDICT: ?` with `drift` or `new`.' || chr(10) || string_agg(block, '' ORDER BY doc_id) AS content FROM b GROUP BY sheet)"""


def filled_sheets(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.lit("## Case "), (F.col("doc_id") % 50 + 1).cast("string"), F.lit(" — `id"), F.col("doc_id").cast("string"), F.lit("`\n\n- **basis** `drift`, see `VERDICT: ?`\n\n**VERDICT: "), F.expr(WORD_SQL), F.lit("**\n\n"))
    rows = table(spark, sf, "labels").select(F.floor(F.col("doc_id") / 50).alias("sheet"), F.struct("doc_id", head.alias("block")).alias("b"))
    sheet = rows.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "").alias("blocks"))  # fifty ids a sheet
    return sheet.select(F.lpad(F.col("sheet").cast("string"), 12, "0").alias("sheet"), F.concat(F.lit("Replace `VERDICT: ?` with `drift` or `new`.\n"), "blocks").alias("content"))


@query(f"""WITH {CASES_SQL}, p AS (SELECT unnest(string_split(content, '## Case ')[2:]) AS p FROM s), v AS (SELECT regexp_extract(p, '— `([^`]+)`', 1) AS example_id, regexp_extract(p, '[*][*]VERDICT: `([a-z]+)`[*][*]', 1) AS verdict FROM p)
SELECT DISTINCT example_id, verdict, CASE verdict WHEN 'drift' THEN true WHEN 'unclear' THEN NULL ELSE false END AS target FROM v WHERE verdict IN ('drift', 'new', 'cosmetic', 'unrelated', 'unclear')""")
def sheet_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets filled from the labels, read back case by case."""
    return sheets.first_verdicts(sheets.scoped(filled_sheets(spark, sf))).select("example_id", "verdict", "target")


TICKS_SQL = """t AS (SELECT conv_id, string_agg('- [' || CASE WHEN turn % 3 = 0 AND conv_id % 4 > 0 THEN 'x' ELSE ' ' END || '] src/' || role || turn || '.py' || chr(10), '' ORDER BY turn) AS ticks FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {TICKS_SQL}, l AS (SELECT conv_id, unnest(string_split(ticks, chr(10))) AS line FROM t)
SELECT 'r' || (conv_id % 5) AS repo, 'docs/' || conv_id || '.md' AS doc_path, coalesce(string_agg(substr(line, 7), ',' ORDER BY substr(line, 7)) FILTER (WHERE starts_with(line, '- [x] ')), '') AS marked, CASE WHEN conv_id % 9 = 1 THEN 'lib/a.py,lib/b.py' ELSE '' END AS extra,
 conv_id % 4 = 0 AS none, conv_id % 4 = 0 OR conv_id % 9 = 1 OR count_if(starts_with(line, '- [x] ')) > 0 AS answered FROM l GROUP BY conv_id""")
def sheet_checklist(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet a conversation: its turns are the files to tick."""
    tick = F.concat(F.lit("- ["), F.expr("IF(turn % 3 = 0 AND conv_id % 4 > 0, 'x', ' ')"), F.lit("] src/"), "role", F.col("turn").cast("string"), F.lit(".py\n"))
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", tick.alias("b")))), lambda b: b["b"]), "").alias("ticks"))
    content = F.concat(F.expr("concat('Legend\n\n## Case 1 — `r', conv_id % 5, '` · `docs/', conv_id, '.md`\n\n- **tree** `0a1b2c`\n\n')"), "ticks", F.expr("concat('\n**NONE:** [', IF(conv_id % 4 = 0, 'X', ' '), ']\n\n**EXTRA:** ', IF(conv_id % 9 = 1, '`lib/a.py`, lib/b.py', ''), '\n')"))
    c = sheets.checklist(t.select(F.col("conv_id").cast("string").alias("sheet"), content.alias("content")))
    return c.select("repo", "doc_path", F.array_join(F.array_sort("marked"), ",").alias("marked"), F.array_join("extra", ",").alias("extra"), "none", "answered")


@query("SELECT (SELECT count(DISTINCT text) FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0))::BIGINT AS hits, (SELECT count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0))::BIGINT AS misses")
def cache_reuse(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", caching.content_key("text").alias("key"))
    return caching.reuse(d.select("key"), d.where("doc_id % 2 = 0").select("key"))


@query("SELECT l.doc_id AS sha FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def sha_presence(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, sf, "labels").join(have, "doc_id", "left_anti").select(F.col("doc_id").alias("sha"))
