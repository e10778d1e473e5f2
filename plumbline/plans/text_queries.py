"""Queries over token, path, diff and claim expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, stats, texts, tokens
from ..operators import contexts, lexicon
from .registry import query, table

NL = "chr(10)"
STOP = "(" + ", ".join(f"'{w}'" for w in tokens.STOPWORDS) + ")"


def sql_pieces(r: str) -> str:
    return rf"list_transform(list_concat([{r}], string_split(regexp_replace({r}, '([a-z0-9])([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), string_split({r}, '_')), lambda p: lower(trim(p, '_')))"


def sql_keep(tokens_sql: str, stop: bool = True) -> str:
    return f"list_filter({tokens_sql}, lambda t: length(t) >= 4 AND NOT regexp_full_match(t, '[0-9]+')" + (f" AND t NOT IN {STOP})" if stop else ")")


def sql_raw(x: str) -> str:
    return f"regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*')"


def sql_runs(x: str, pattern: str, prefix: str, group: int) -> str:
    """Matches within maximal runs of letters, digits, dots and underscores (no look-around needed)."""
    runs = f"list_filter(regexp_extract_all({x}, '[A-Za-z0-9_.]+'), lambda w: regexp_matches(w, '{pattern}'))"
    return f"list_distinct(list_transform({runs}, lambda w: '{prefix}' || regexp_extract(w, '{pattern}', {group})))"


VERSION_SQL = r"^[vV]?([0-9]{1,4}(?:\.[0-9]{1,4}){1,2}(?:\.?(?:a|b|rc|dev|post)[0-9]*)?)(?:$|[A-Za-z_]|\.(?:$|[A-Za-z_.]))"


def sql_versions(x: str) -> str:
    return sql_runs(x, VERSION_SQL, "ver:", 1)


def sql_numbers(x: str) -> str:
    return sql_runs(x, "^[0-9]+$", "num:", 0)


def sql_extract(x: str, versions: bool = True, stop: bool = True) -> str:
    found = sql_keep(f"flatten(list_transform({sql_raw(x)}, lambda r: {sql_pieces('r')}))", stop)
    return f"list_distinct(list_concat({found}, {sql_versions(x)}))" if versions else f"list_distinct({found})"


def sql_occurrences(x: str) -> str:
    return f"flatten(list_transform({sql_raw(x)}, lambda r: list_distinct({sql_keep(sql_pieces('r'))})))"


def sql_urls(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)(?:https?://|www\.|mailto:)\S+', ' ', 'g')"


def sql_longest(x: str) -> str:
    return f"list_transform(list_sort(list_transform({x}, lambda t: {{'n': -length(t), 't': t}})), lambda s: s.t)"


def joined(c):
    return F.array_join(F.array_sort(c), " ")


# ---------------------------------------------------------------- tokens


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql_extract('text')} AS t FROM documents)")
def tok_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", tokens.extract(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(joined("t")).alias("tokens_md5"))


@query(f"SELECT tok, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({sql_occurrences('text')}) AS tok FROM documents) GROUP BY tok")
def tok_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("all").alias("tree"), "doc_id", "text")
    return lexicon.counts(docs, "doc_id").select("tok", "n", "df")


@query(f"SELECT doc_id, array_to_string(list_sort({sql_versions('text')}), ' ') AS versions FROM documents")
def tok_versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", joined(tokens.versions(F.col("text"))).alias("versions"))


@query(f"SELECT doc_id, array_to_string(list_sort({sql_numbers('text')}), ' ') AS numbers FROM documents")
def tok_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", joined(tokens.numbers(F.col("text"))).alias("numbers"))


@query(f"SELECT page_id, md5(s) AS text_md5, length(s)::BIGINT AS n FROM (SELECT page_id, regexp_replace({sql_urls('html')}, '<[^>\\n]+>', ' ', 'g') AS s FROM pages)")
def strip_html_urls(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "pages").select("page_id", tokens.strip_tags(tokens.strip_urls(F.col("html"))).alias("s"))
    return s.select("page_id", F.md5("s").alias("text_md5"), F.length("s").cast("long").alias("n"))


# Marks by rule, for the texts hold none: words of five letters between spaces in backticks, those of six in two; some lines open or close a fence.
MARK_SQL = [(" ([A-Za-z]{5}) ", r" `\1` "), (" ([A-Za-z]{6}) ", r" ``\1`` "), (r"\n([A-Z])", "\n```\n\\1")]


def marked(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    for pattern, into in MARK_SQL:
        text = F.regexp_replace(text, pattern, into.replace("\\1", "$1"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


def _marked_sql() -> str:
    text = "coalesce(text, '')"
    for pattern, into in MARK_SQL:
        into = "'" + into.replace("\n", "' || chr(10) || '") + "'"
        text = f"regexp_replace({text}, '{pattern}', {into}, 'g')"
    return text


#: Where a fence's state matters, DuckDB carries it by a running count of fence lines.
SPANS_SQL = rf"""
WITH v AS (SELECT doc_id, string_split(rtrim(replace(replace({_marked_sql()}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM v, unnest(range(1, len(ls) + 1)) AS u(i)),
f AS (SELECT *, regexp_matches(line, '^\s*(?:```|~~~)') AS fence, sum(regexp_matches(line, '^\s*(?:```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM l),
p AS (
  SELECT doc_id, i, 0 AS j, line AS part FROM f WHERE inside AND NOT fence AND NOT (line = '' AND i = (SELECT len(ls) FROM v WHERE v.doc_id = f.doc_id))
  UNION ALL
  SELECT doc_id, i, j, trim(regexp_extract_all(line, '``[^`\n]+``|`[^`\n]+`')[j], '`') FROM f, unnest(range(1, len(regexp_extract_all(line, '``[^`\n]+``|`[^`\n]+`')) + 1)) AS u(j) WHERE NOT inside AND NOT fence)
SELECT v.doc_id, md5(coalesce(string_agg(part, chr(10) ORDER BY i, j), '')) AS literals_md5, count(part)::BIGINT AS n FROM v LEFT JOIN p USING (doc_id) GROUP BY v.doc_id
"""


@query(SPANS_SQL)
def literal_spans(spark: SparkSession, sf: str) -> DataFrame:
    t = marked(spark, sf).select("doc_id", tokens.literal_spans(F.col("text")).alias("s"))
    return t.select("doc_id", F.md5("s").alias("literals_md5"), F.when(F.col("s") == "", 0).otherwise(F.size(F.split("s", "\n", -1))).cast("long").alias("n"))


_SPANS_OF = SPANS_SQL.rstrip()[: SPANS_SQL.rstrip().rindex("SELECT v.doc_id, md5(")]


@query(f"""{_SPANS_OF.rstrip()}, s AS (SELECT v.doc_id, coalesce(string_agg(part, chr(10) ORDER BY i, j), '') AS spans FROM v LEFT JOIN p USING (doc_id) GROUP BY v.doc_id),
m AS (SELECT s.doc_id, {sql_extract('spans', versions=False)} AS marked, coalesce(d.text, '') AS code FROM s LEFT JOIN documents d ON d.doc_id = s.doc_id + 1),
c AS (SELECT doc_id, marked, {sql_extract('code', versions=False)} AS present FROM m),
a AS (SELECT doc_id, list_sort(list_distinct(list_filter(marked, lambda x: NOT list_contains(present, x)))) AS lacks FROM c)
SELECT doc_id, 'lexical-absence(>=' || t || ')' AS judge, len(lacks) >= t AS answer, nullif(array_to_string(lacks[1:6], ', '), '') AS claim FROM a, (VALUES (1), (3), (6)) AS v(t)""")
def judge_absence_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that a document marks up and the next document, its stand-in for code, does not name."""
    docs, code = marked(spark, sf), table(spark, sf, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("code"))
    files = F.array_compact(F.array(F.when(F.col("code").isNotNull(), F.struct(F.col("code").alias("text")))))
    shown = docs.join(code, "doc_id", "left").select(F.col("doc_id").alias("example_id"), F.lit("seeded").alias("arm"), F.col("text").alias("doc_text"), files.alias("files"))
    return contexts.absence_judges(shown).select(F.col("example_id").alias("doc_id"), "judge", "answer", "claim")


@query()
def claim_units(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of every document, its marks made by rule; tests compare with a plain reading of hand-made texts."""
    found = marked(spark, sf).select("doc_id", texts.claim_units(F.col("text")).alias("c"))
    return found.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("claims_md5"))


# ---------------------------------------------------------------- paths

_DIRS = ["docs/", "src/core/", "tests/", "node_modules/x/", "lib/Http/", "", "docs/api/"]
_NAMES = ["README", "client_pool", "test_client", "CHANGELOG", "conftest", "urls", "RateLimit"]
_EXTS = [".md", ".py", ".rst", ".rs", ".txt", "", ".test.ts"]


def pick(items: list[str], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, items)), (n % len(items) + 1).cast("int"))


def made_path() -> F.Column:
    d = F.col("doc_id")
    return F.concat(pick(_DIRS, d), pick(_NAMES, F.floor(d / 7)), pick(_EXTS, F.floor(d / 49)))


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


PATH_SQL = f"({_sql_list(_DIRS)}[doc_id % 7 + 1] || {_sql_list(_NAMES)}[doc_id // 7 % 7 + 1] || {_sql_list(_EXTS)}[doc_id // 49 % 7 + 1])"
NAME_SQL = "string_split(path, '/')[-1]"


def sql_any(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def sql_in(items: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def sql_suffix(path: str) -> str:
    return rf"lower(regexp_extract(string_split({path}, '/')[-1], '^.+(\.[^.]+)$', 1))"


def sql_stem(path: str) -> str:
    return rf"lower(CASE WHEN regexp_matches(string_split({path}, '/')[-1], '^.+\.[^.]+$') THEN regexp_extract(string_split({path}, '/')[-1], '^(.+)\.[^.]+$', 1) ELSE string_split({path}, '/')[-1] END)"


def sql_kind(path: str) -> str:
    low = f"lower({path})"
    test = f"({sql_any(low, paths.TEST_DIRS)} OR {sql_any(f'string_split({low}, chr(47))[-1]', paths.TEST_NAMES)})"
    return f"""CASE WHEN {sql_any(low, paths.GENERATED)} THEN 'other'
      WHEN {sql_suffix(path)} IN {sql_in(paths.DOC_SUFFIXES)} THEN CASE WHEN {sql_stem(path)} IN {sql_in(paths.PROCESS_STEMS)} THEN 'other' ELSE 'doc' END
      WHEN {sql_suffix(path)} IN {sql_in(paths.CODE_SUFFIXES)} THEN CASE WHEN {test} THEN 'other' ELSE 'code' END ELSE 'other' END"""


def sql_words(path: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({path}), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN {sql_in(paths.GENERIC_WORDS)}))"


def sql_related(a: str, b: str) -> str:
    return f"({sql_stem(a)} = {sql_stem(b)} OR len(list_intersect({sql_words(a)}, {sql_words(b)})) > 0)"


@query(f"SELECT doc_id, path, {sql_kind('path')} AS kind, {sql_stem('path')} AS stem FROM (SELECT doc_id, {PATH_SQL} AS path FROM documents)")
def path_classify(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").select("doc_id", made_path().alias("path"))
    return p.select("doc_id", "path", paths.kind(F.col("path")).alias("kind"), paths.stem(F.col("path")).alias("stem"))


_OTHER_SQL = PATH_SQL.replace("doc_id", "(doc_id * 31 + 17)")


@query(f"SELECT doc_id, {sql_related('a', 'b')} AS related, array_to_string(list_sort({sql_words('a')}), ' ') AS words FROM (SELECT doc_id, {PATH_SQL} AS a, {_OTHER_SQL} AS b FROM documents)")
def path_related(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", made_path().alias("a"))
    d = docs.withColumnRenamed("doc_id", "own").withColumn("doc_id", F.col("own") * 31 + 17).withColumn("b", made_path())
    return d.select(F.col("own").alias("doc_id"), paths.related(F.col("a"), F.col("b")).alias("related"), joined(paths.words(F.col("a"))).alias("words"))


# ---------------------------------------------------------------- diffs: a turn against the one before it


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """conversations with ``diff``, a zero-context diff of each turn to the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("before", F.coalesce(F.lag("text").over(w), F.lit("")))
    old, new = (F.split(c, "\n", -1) for c in ("before", "text"))
    mark = lambda m, ls: F.transform(ls, lambda x: F.concat(F.lit(m), x))
    body = F.concat(F.array(*map(F.lit, ("--- a", "+++ b", "@@ -1 +1 @@"))), mark("-", F.array_except(old, new)), mark("+", F.array_except(new, old)))
    return t.select("conv_id", "turn", "role", "text", F.array_join(body, "\n").alias("diff"))


def _except_sql(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x, i: NOT list_contains({b}, x) AND list_position({a}, x) = i)"


TURNS_SQL = f"""
t0 AS (SELECT *, string_split(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), {NL}) AS old, string_split(text, {NL}) AS new FROM conversations),
turns AS (
  SELECT conv_id, turn, role, text, list_concat(list_transform({_except_sql('old', 'new')}, lambda x: '-' || x), list_transform({_except_sql('new', 'old')}, lambda x: '+' || x)) AS lines FROM t0),
sides AS (
  SELECT conv_id, turn, role, text,
    list_transform(list_filter(lines, lambda x: x[1] = '+' AND NOT starts_with(x, '+++')), lambda x: x[2:]) AS added,
    list_transform(list_filter(lines, lambda x: x[1] = '-' AND NOT starts_with(x, '---')), lambda x: x[2:]) AS removed,
    list_transform(list_filter(lines, lambda x: NOT starts_with(x, '+++') AND NOT starts_with(x, '---')), lambda x: x[2:]) AS all_lines
  FROM turns)
"""


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, len(added)::BIGINT AS n_added, len(removed)::BIGINT AS n_removed, md5(array_to_string(added, {NL})) AS added_md5, md5(array_to_string(all_lines, {NL})) AS both_md5 FROM sides")
def diff_sides(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("diff")
    return turns(spark, sf).select(
        "conv_id", "turn", F.size(tokens.changed(d, "+")).cast("long").alias("n_added"), F.size(tokens.changed(d, "-")).cast("long").alias("n_removed"),
        F.md5(tokens.changed_text(d, "+")).alias("added_md5"), F.md5(tokens.changed_text(d)).alias("both_md5"))


def _delta_sql(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


@query(f"""WITH {TURNS_SQL},
e AS (SELECT conv_id, turn, {sql_extract(sql_urls(f"array_to_string(added, {NL})"))} AS a, {sql_extract(sql_urls(f"array_to_string(removed, {NL})"))} AS r FROM sides)
SELECT conv_id, turn, array_to_string(list_slice({sql_longest(_delta_sql('a', 'r'))}, 1, 12), ' ') AS added_only, array_to_string(list_slice({sql_longest(_delta_sql('r', 'a'))}, 1, 12), ' ') AS removed_only FROM e""")
def token_delta(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).select("conv_id", "turn", tokens.changed_text(F.col("diff"), "+").alias("a"), tokens.changed_text(F.col("diff"), "-").alias("r"))
    t = t.withColumn("d", tokens.delta(F.col("a"), F.col("r")))
    top = lambda c: F.array_join(F.slice(c, 1, 12), " ")
    return t.select("conv_id", "turn", top("d.added_only").alias("added_only"), top("d.removed_only").alias("removed_only"))


@query(f"""WITH p AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations),
e AS (SELECT conv_id, turn, list_intersect({sql_extract(sql_urls('before'))}, {sql_extract(sql_urls('text'))}) AS both_have FROM p)
SELECT conv_id, turn, array_to_string({sql_longest('both_have')}, ' ') AS shared FROM e""")
def token_shared(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("before", F.coalesce(F.lag("text").over(w), F.lit("")))
    return t.select("conv_id", "turn", F.array_join(tokens.shared(F.col("before"), F.col("text")), " ").alias("shared"))


# ---------------------------------------------------------------- windows, ids, shingles


@query("SELECT doc_id, substr(sha256('repo' || chr(0) || doc_id::VARCHAR || chr(0) || source || chr(0) || '' || chr(0) || 'drift'), 1, 16) AS example_id FROM documents")
def example_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", texts.stable_id(F.lit("repo"), F.col("doc_id").cast("string"), F.col("source"), F.lit(None).cast("string"), F.lit("drift")).alias("example_id"))


@query("""SELECT example_id, min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, substr(sha256(source || chr(0) || lang || chr(0) || text), 1, 16) AS example_id FROM documents) GROUP BY example_id""")
def example_ids_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", texts.stable_id(F.col("source"), F.col("lang"), F.col("text")).alias("example_id"))
    return d.groupBy("example_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(r"""SELECT doc_id, count(*)::BIGINT AS n_chunks, md5(string_agg(substr(text, i + 1, 800), '|' ORDER BY i)) AS chunks_md5
FROM (SELECT doc_id, text, i FROM documents, unnest(range(0, greatest(length(text), 1), 700)) AS u(i) WHERE (i = 0 OR i + 100 < length(text)) AND regexp_matches(text, '\S')) GROUP BY doc_id""")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").select("doc_id", texts.chunks(F.col("text"), 800, 100).alias("c")).where(F.size("c") > 0)
    return c.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("chunks_md5"))


def sql_shingles(x: str) -> str:
    ws = f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"(SELECT list_distinct(list(array_to_string(ws[i : i + 3], ' '))) FROM (SELECT {ws} AS ws) q, unnest(range(1, len(ws) - 2)) AS u(i))"


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM conversations),
s AS (SELECT conv_id, turn, coalesce(list_distinct(list_transform(range(1, greatest(len(ws) - 2, 1)), lambda i: array_to_string(ws[i : i + 3], ' '))), []) AS s FROM w),
p AS (SELECT conv_id, turn, s, coalesce(lag(s) OVER (PARTITION BY conv_id ORDER BY turn), []) AS b FROM s)
SELECT conv_id, turn, len(s)::BIGINT AS n, round(CASE WHEN len(s) = 0 THEN 0 ELSE len(list_intersect(s, b)) / len(s) END, 6) AS overlap FROM p""")
def shingle_overlap(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").select("conv_id", "turn", texts.shingles(F.col("text")).alias("s"))
    t = t.withColumn("b", F.coalesce(F.lag("s").over(w), F.array().cast("array<string>")))
    return t.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.round(texts.containment(F.col("s"), F.col("b")), 6).alias("overlap"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || chr(10) || '... [truncated: ' || (length(text) - 500) || ' of ' || length(text) || ' characters not shown]' ELSE text END) AS cut_md5 FROM documents")
def truncate_budget(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(texts.truncate(F.col("text"), 500)).alias("cut_md5"))


@query("SELECT item_id, regexp_replace(text, '(?i)thandedble|tion|the', ' ', 'g') AS redacted FROM benchmark")
def redact_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", texts.redact(F.col("text"), F.array(*map(F.lit, ("the", "tion", "thandedble")))).alias("redacted"))


@query(r"SELECT item_id, regexp_matches(text, '(?:^|[^A-Za-z0-9_.])(?:the|and)(?:$|[^A-Za-z0-9_])') AS located FROM benchmark")
def claim_locates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", texts.locates(F.col("text"), F.array(F.lit("the"), F.lit("and"))).alias("located"))


@query("SELECT conv_id, len(t)::BIGINT AS n, ceil(len(t) / 3.0)::BIGINT AS n_batches, array_to_string(t[1:3], ' ') AS first_batch FROM (SELECT conv_id, list(role ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def claim_batches(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("t"))
    b = t.withColumn("b", texts.batches(F.col("t"), 3))
    return b.select("conv_id", F.size("t").cast("long").alias("n"), F.size("b").cast("long").alias("n_batches"), F.array_join(F.get("b", F.lit(0)), " ").alias("first_batch"))


REPLY = "CASE event_id % 5 WHEN 0 THEN 'Here: {\"verdict\": \"false\", \"n\": ' || event_id || '} done' WHEN 1 THEN '{\"verdict\": \"not-false\"}' WHEN 2 THEN 'no braces' WHEN 3 THEN '{\"verdict\": broken' ELSE '{\"verdict\": \"maybe\"}' END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS answer FROM events")
def json_reply_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", texts.reply_verdict(F.expr(REPLY.replace("\\", ""))).alias("answer"))


@query("""WITH r AS (SELECT user_id, (props::JSON ->> 'k')::INT AS n, event_type, event_id FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, n ORDER BY event_id) AS nr FROM r WHERE n BETWEEN 1 AND 8 AND event_type <> 'view')
SELECT user_id, n::BIGINT AS n, event_type AS verdict FROM k WHERE nr = 1""")
def claims_reply_align(spark: SparkSession, sf: str) -> DataFrame:
    """Replies aligned by their number: out of range and unknown words go, the first of a number wins."""
    r = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.from_json("props", "k long")["k"].alias("n"))
    w = Window.partitionBy("user_id", "n").orderBy("event_id")
    r = r.where(F.col("n").between(1, 8) & (F.col("event_type") != "view")).withColumn("nr", F.row_number().over(w))
    return r.where("nr = 1").select("user_id", "n", F.col("event_type").alias("verdict"))


@query("SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'truncated' WHEN contains(lower(text), 'cannot see') OR contains(lower(text), 'not shown') THEN 'not-shown' ELSE 'other' END AS reason FROM documents")
def reply_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", texts.reply_reason(F.col("text"), F.col("n_chars") > 3000).alias("reason"))


@query(f"SELECT doc_id, {sql_any('lower(text)', paths.COSMETIC)} AS cosmetic, CASE WHEN regexp_matches(text, 'licen') THEN true ELSE false END AS licensed FROM documents")
def cosmetic_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", paths.is_cosmetic(F.col("text")).alias("cosmetic"), F.col("text").contains("licen").alias("licensed"))
