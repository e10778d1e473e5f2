"""Queries over rankers, rank metrics and context assembly.

Benchmark passages are the queries, documents the candidates, and a document is relevant if it holds
the passage.  The fifteen rarest tokens of a passage are its evidence, which ablated arms leave out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, stats, texts, tokens
from ..operators import evaluation as ev
from ..operators import lexicon, passages, placing, rankings, topk
from ..operators import retrieval as rt
from .registry import query, table
from .text_queries import sql_extract, sql_occurrences

EVIDENCE, K1, TRIALS = 15, 1.2, 5
#: The last rank that recall looks at: of a query's relevant documents no more than so many can stand there.
DEEPEST = 10
PATH = "concat_ws('/', lang, source, concat(lpad(cast(doc_id as string), 8, '0'), '.md'))"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as candidates (tree, path, text)."""
    return table(spark, sf, "documents").select(F.lit("all").alias("tree"), F.expr(PATH).alias("path"), "text")


def query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("tree"), F.explode(tokens.extract(F.col("text"), with_versions=False)).alias("tok"))
    return q


def evidence_of(q: DataFrame, weights: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("idf", F.lit(99.0))), "tok")
    return q.join(weights, ["tree", "tok"], "left").withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= EVIDENCE).select("query_id", "tok")


def relevant(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, path): documents that hold the passage; many passages are found by their rarest whole word and then verified.

    The first and last word of a passage may be parts of longer ones, so a passage of one or two words has no whole
    word and is looked for in every text, a block of passages at a time.
    """
    docs = table(spark, sf, "documents").withColumn("path", F.expr(PATH))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    if passages.few(asked):
        return passages.holders(asked, docs)
    cut = F.split("text", r"\s+")
    items = table(spark, sf, "benchmark").withColumn("cut", cut)
    words = docs.select("doc_id", F.explode(F.array_distinct(cut)).alias("w"))
    inner = items.where(F.size("cut") > 2).select("item_id", F.explode(F.array_distinct(F.slice("cut", 2, F.size("cut") - 2))).alias("w"))
    wanted = rt.small(inner.select("w").distinct())
    hits = words.join(wanted, "w")
    df = hits.groupBy("w").agg(F.count("*").alias("df"))
    rare = inner.join(df, "w").groupBy("item_id").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    found = hits.join(rt.small(rare), "w").select("item_id", "doc_id")
    found = found.join(items.select("item_id", F.col("text").alias("passage")), "item_id").join(docs, "doc_id").where(F.expr("contains(text, passage)")).select(F.col("item_id").alias("query_id"), "path")
    short = items.where(F.size("cut") <= 2).select(F.col("item_id").alias("query_id"), F.lit("all").alias("tree"), F.col("text").alias("passage"))
    if short.limit(1).count():
        every = rt.in_blocks(short, docs.select(F.lit("all").alias("tree"), "path", "text"))
        found = found.unionByName(every.where(F.expr("contains(text, passage)")).select("query_id", "path"))
    return found


BASE_SQL = f"""
WITH docs AS (SELECT lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS path, text FROM documents),
occ AS (SELECT path, unnest({sql_occurrences('text')}) AS tok FROM docs),
cand AS (SELECT path, tok, count(*) AS tf FROM occ GROUP BY ALL),
sizes AS (SELECT path, count(*) AS size FROM cand GROUP BY path),
weights AS (SELECT tok, count(*) AS df, ln(1 + ((SELECT count(*) FROM docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM cand GROUP BY tok),
q AS (SELECT item_id AS query_id, unnest({sql_extract('text', versions=False)}) AS tok FROM benchmark),
evid AS (SELECT query_id, tok FROM (SELECT query_id, q.tok, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(idf, 99) DESC, q.tok) AS nr FROM q LEFT JOIN weights USING (tok)) WHERE nr <= {EVIDENCE}),
qa AS (SELECT * FROM q ANTI JOIN evid USING (query_id, tok)),
rel AS (SELECT item_id AS query_id, path FROM benchmark b, docs d WHERE contains(d.text, b.text))
"""


def sql_score(q: str, part: str = "idf") -> str:
    return f"(SELECT query_id, path, round(sum({part}) / sqrt(max(size)), 9) AS score FROM {q} AS qq JOIN weights USING (tok) JOIN cand USING (tok) JOIN sizes USING (path) GROUP BY query_id, path)"


def sql_rank(scores: str) -> str:
    return f"SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM {scores}"


LEX, LEX_ABLATED, TF = sql_score("q"), sql_score("qa"), sql_score("q", f"idf * tf / (tf + {K1})")


def read_once(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, lexicon.Parts, DataFrame]:
    """The candidates, the passages' tokens, and what these ask of the texts, which are read once for it; the relevant pairs come from the same reading."""
    docs, q = candidates(spark, sf), query_tokens(spark, sf).cache()
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    parts = lexicon.once(docs, "tree", "path", queries=q, passages=asked if passages.few(asked) else None)
    return docs, q, parts, relevant(spark, sf).cache() if parts.holders is None else parts.holders


def lexical(spark: SparkSession, sf: str, ablated: bool = False, k1: float | None = None, k: int | None = None, parts: lexicon.Parts | None = None) -> DataFrame:
    """The scores; with ``k`` at least the first k of each query."""
    docs, q = candidates(spark, sf), query_tokens(spark, sf).cache()
    parts = parts or lexicon.once(docs, "tree", "path", queries=q)
    weights = lexicon.idf(docs, q, parts).cache()
    if ablated:
        q = rt.ablate(q, evidence_of(q, weights))
    return lexicon.score_arms(q, docs, weights, {"score": lexicon.arm(k1)}, k, parts)


@query(BASE_SQL + "SELECT tok, df::BIGINT AS df, round(idf, 6) AS idf FROM weights")
def idf_table(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.idf(candidates(spark, sf)).select("tok", "df", F.round("idf", 6).alias("idf"))


@query(BASE_SQL + sql_rank(LEX))
def rank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return rt.rank(lexical(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query(BASE_SQL + sql_rank(LEX_ABLATED))
def rank_lexical_ablated(spark: SparkSession, sf: str) -> DataFrame:
    return rt.rank(lexical(spark, sf, ablated=True)).withColumn("rank", F.col("rank").cast("long"))


@query(BASE_SQL + sql_rank(TF))
def rank_tf(spark: SparkSession, sf: str) -> DataFrame:
    return rt.rank(lexical(spark, sf, k1=K1)).withColumn("rank", F.col("rank").cast("long"))


PATH_SQL = """
WITH p AS (SELECT page_id, url, CASE WHEN regexp_matches(url, '[^/]\\.[^./]+$') THEN regexp_extract(url, '^(.*[^/])\\.[^./]+$', 1) ELSE url END AS body, string_split(url, '/')[-1] AS name FROM pages),
t AS (
  SELECT page_id, url, list_distinct(list_filter(regexp_split_to_array(lower(body), '[-._/]+'), lambda w: length(w) >= 4)) AS a,
    list_distinct(list_filter(regexp_split_to_array(lower(CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^(.+)\\.[^.]+$', 1) ELSE name END), '[-._/]+'), lambda w: length(w) >= 4)) AS s
  FROM p),
sc AS (
  SELECT q.page_id AS query_id, c.url AS path, round(CASE WHEN len(c.a) > 0 THEN len(list_distinct(list_concat(list_intersect(q.a, c.s), list_intersect(q.s, c.a)))) / sqrt(len(c.a)) ELSE 0 END, 9) AS score
  FROM t q, t c WHERE q.page_id % 50 = 0)
SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM sc
"""


@query(PATH_SQL)
def rank_path(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the pages whose id is divisible by 50, against the urls of all pages."""
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"), F.lit("all").alias("tree"))
    q = p.where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), "tree", F.col("path").alias("doc_path"))
    return rankings.rank_paths(q, p)


UNIFORM_SQL = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"""WITH p AS (SELECT t.trial, b.item_id AS query_id, l.path, {UNIFORM_SQL.format("t.trial || ':' || b.item_id || ':' || l.path")} AS score FROM benchmark b, (SELECT DISTINCT lang || '/' || source AS path FROM documents) l, unnest(range(0, {TRIALS})) AS t(trial))
SELECT trial::BIGINT AS trial, query_id, path, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, path) AS rank FROM p""")
def rank_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Shuffled rankings of (lang, source) cells, a fixed number of trials."""
    cells = table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("path"), F.lit("all").alias("tree")).distinct()
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("tree"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TRIALS - 1).cast("long"))).alias("trial"))
    scored = rt.score_shuffle(rt.small(q).join(cells, "tree"), F.col("trial").cast("string"))
    w = Window.partitionBy("trial", "query_id").orderBy(F.desc("score"), "path")
    return scored.select("trial", "query_id", "path", F.row_number().over(w).cast("long").alias("rank"))


def _metrics_sql(arms: dict[str, str]) -> str:
    ranked = " UNION ALL ".join(f"SELECT '{a}' AS arm, * FROM ({sql_rank(s)})" for a, s in arms.items())
    return BASE_SQL + f""", rk AS ({ranked}),
h AS (SELECT arm, query_id, max(1.0 / rank) AS rr, {', '.join(f'sum((rank <= {k})::INT) AS h{k}' for k in (1, 3, 10))} FROM rk JOIN rel USING (query_id, path) GROUP BY ALL),
n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
a AS (SELECT DISTINCT arm, query_id FROM rk JOIN n USING (query_id))
SELECT arm, count(*)::BIGINT AS n, round(avg(coalesce(rr, 0)), 6) AS mrr, {', '.join(f'round(avg(coalesce(h{k}, 0) / n_rel), 6) AS recall_{k}' for k in (1, 3, 10))}
FROM a JOIN n USING (query_id) LEFT JOIN h USING (arm, query_id) GROUP BY arm"""


@query(_metrics_sql({"lexical": LEX, "lexical_ablated": LEX_ABLATED, "tf": TF}))
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """All arms from one reading of the texts: one count of ranks and one pair of aggregations serve every ranker."""
    docs, q, parts, rel = read_once(spark, sf)
    weights = lexicon.idf(docs, q, parts).cache()
    arms = {"lexical": lexicon.arm(), "lexical_ablated": lexicon.arm(idf=F.when(~F.col("evidence"), F.col("idf"))), "tf": lexicon.arm(K1)}
    ranks, shown = placing.first_ranks(rt.marked(q, evidence_of(q, weights)), docs, weights, arms, rel, DEEPEST, parts)
    return ev.macro(ev.per_query(ranks, rel, shown=shown), "arm")


@query(_metrics_sql({"lexical": LEX}))
def retrieval_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: tokens, idf, lexical score, rank, recall and reciprocal rank."""
    docs, q, parts, rel = read_once(spark, sf)
    ranks, shown = placing.first_ranks(q, docs, lexicon.idf(docs, q, parts).cache(), {"lexical": lexicon.arm()}, rel, DEEPEST, parts)
    return ev.macro(ev.per_query(ranks, rel, shown=shown), "arm")


@query(f"""WITH p AS (SELECT t.trial, b.item_id AS query_id, l.path, {UNIFORM_SQL.format("t.trial || ':' || b.item_id || ':' || l.path")} AS score FROM benchmark b, (SELECT DISTINCT lang || '/' || source AS path FROM documents) l, unnest(range(0, {TRIALS})) AS t(trial)),
r AS (SELECT trial, query_id, path, row_number() OVER (PARTITION BY trial, query_id ORDER BY score DESC, path) AS rank FROM p),
rel AS (SELECT DISTINCT b.item_id AS query_id, d.lang || '/' || d.source AS path FROM benchmark b, documents d WHERE contains(d.text, b.text)),
m AS (SELECT trial, query_id, max(1.0 / rank) AS rr FROM r JOIN rel USING (query_id, path) GROUP BY ALL),
t AS (SELECT trial, avg(rr) AS mrr FROM m GROUP BY trial)
SELECT 'shuffle' AS arm, round(avg(mrr), 6) AS mean, round(min(mrr), 6) AS lo, round(max(mrr), 6) AS hi, round(max(mrr) - min(mrr), 6) AS width FROM t""")
def noise_range(spark: SparkSession, sf: str) -> DataFrame:
    cells = relevant(spark, sf).select("query_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).distinct()
    per_trial = ev.macro_raw(ev.per_query(rank_shuffle(spark, sf), cells, ()), "trial")
    return ev.noise(per_trial.withColumn("arm", F.lit("shuffle")), "mrr", "arm")


@query("""WITH c AS (SELECT lang AS tree, source, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT tree, list_sort(list(n)) AS sizes, sum(n) AS total, max(n) AS busiest FROM c GROUP BY tree)
SELECT tree, sizes[1]::BIGINT AS smallest, sizes[len(sizes) // 2 + 1]::BIGINT AS upper_median, sizes[-1]::BIGINT AS largest, len(sizes)::BIGINT AS n_sources, round(busiest / total, 6) AS busiest_share FROM s""")
def pool_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").groupBy(F.col("lang").alias("tree"), "source").agg(F.count("*").alias("n"))
    return c.groupBy("tree").agg(F.min("n").alias("smallest"), stats.upper_median(F.collect_list("n")).alias("upper_median"), F.max("n").alias("largest"), F.count("*").alias("n_sources"), F.round(F.max("n") / F.sum("n"), 6).alias("busiest_share"))


# ---------------------------------------------------------------- vectors

MAXSIM_SQL = """(SELECT q.vec_id AS query_id, lpad(c.label::VARCHAR, 3, '0') || '/' || lpad((c.vec_id // 4)::VARCHAR, 6, '0') AS path, round(max(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])), 5) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 GROUP BY ALL)"""


def maxsim(spark: SparkSession, sf: str, first: int = 1, last: int | None = None) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("all").alias("tree"), F.col("embedding").alias("qv"))
    c = e.select(F.lit("all").alias("tree"), F.concat_ws("/", F.lpad(F.col("label").cast("string"), 3, "0"), F.lpad(F.floor(F.col("vec_id") / 4).cast("string"), 6, "0")).alias("path"), F.col("embedding").alias("cv"))
    return rankings.rank_maxsim(q, c, first, last)


@query(f"SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM {MAXSIM_SQL}")
def dense_maxsim(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, against all vectors."""
    return maxsim(spark, sf)


RERANK_SQL = f"""WITH b AS (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS r FROM {MAXSIM_SQL}),
p AS (SELECT *, CASE WHEN path[-1] <> '7' THEN -{UNIFORM_SQL.format("query_id || ':' || path")} END AS pair FROM b)
SELECT query_id, path, score, CASE WHEN r <= 20 THEN row_number() OVER (PARTITION BY query_id, r <= 20 ORDER BY coalesce(pair, '-inf'::DOUBLE) DESC, path) ELSE r END AS rank FROM p"""


@query(RERANK_SQL)
def rerank_head(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in pair scorer, negative and missing for some pairs, reorders the first twenty."""
    head = maxsim(spark, sf, last=20).cache()
    pairs = head.where("path NOT LIKE '%7'").select("query_id", "path", (-stats.uniform(F.col("query_id").cast("string"), F.col("path"))).alias("score"))
    return rt.rerank(head, pairs, 20).withColumn("rank", F.col("rank").cast("long")).unionByName(maxsim(spark, sf, first=21))


@query(BASE_SQL + f""", a AS ({sql_rank(LEX)}), b AS ({sql_rank(TF)}), f AS (
SELECT query_id, max((a.rank <= 10)::INT) AS x, (SELECT max((b.rank <= 10)::INT) FROM b JOIN rel r2 USING (query_id, path) WHERE b.query_id = r.query_id) AS y, max((a.rank <= 20)::INT) AS x2 FROM rel r JOIN a USING (query_id, path) GROUP BY query_id)
SELECT count_if(x = 1 AND y = 1)::BIGINT AS both_arms, count_if(x = 1 AND y = 0)::BIGINT AS lexical_only, count_if(x = 0 AND y = 1)::BIGINT AS tf_only, count_if(x = 0 AND y = 0)::BIGINT AS neither, count_if(x2 = 1)::BIGINT AS lexical_20, count_if(x = 1 OR y = 1)::BIGINT AS union_10 FROM f""")
def rank_fusion_cells(spark: SparkSession, sf: str) -> DataFrame:
    docs, q, parts, rel = read_once(spark, sf)
    ranks, _ = placing.first_ranks(q, docs, lexicon.idf(docs, q, parts).cache(), {"a": lexicon.arm(), "b": lexicon.arm(K1)}, rel, 1, parts)
    best = lambda arm: F.min(F.when(F.col("arm") == arm, F.col("rank"))).alias(arm)
    j = ranks.groupBy("query_id").agg(best("a"), best("b")).where("a IS NOT NULL AND b IS NOT NULL")
    x, y = F.col("a") <= 10, F.col("b") <= 10
    return j.agg(F.count_if(x & y).alias("both_arms"), F.count_if(x & ~y).alias("lexical_only"), F.count_if(~x & y).alias("tf_only"), F.count_if(~x & ~y).alias("neither"), F.count_if(F.col("a") <= 20).alias("lexical_20"), F.count_if(x | y).alias("union_10"))


# ---------------------------------------------------------------- context

CONTEXT_SQL = BASE_SQL + f""", r AS ({sql_rank(LEX)}), seed AS (SELECT query_id, min(path) AS path FROM rel GROUP BY query_id),
s AS (SELECT query_id, path, min(rank) AS rank FROM (SELECT query_id, path, 0 AS rank FROM seed UNION ALL SELECT query_id, path, rank FROM r) GROUP BY ALL),
k AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY rank, path) AS place FROM s JOIN docs USING (path) WHERE length(text) > 0)
SELECT query_id, path, rank::BIGINT AS rank, place FROM k WHERE place <= 5"""


@query(CONTEXT_SQL)
def context_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Five files a query: the known one first, then the best ranked (a top-k report)."""
    _, _, parts, rel = read_once(spark, sf)
    ranking = topk.top_k(lexical(spark, sf, k=6, parts=parts), 6).cache()  # one more than is shown, for the known file may be among them; only texts without tokens are empty
    seeds = rel.groupBy("query_id").agg(F.min("path").alias("path")).cache()
    named = rt.small(ranking.select("path").union(seeds.select("path")).distinct())
    held = table(spark, sf, "documents").where(F.length("text") > 0).select(F.expr(PATH).alias("path")).join(named, "path", "left_semi")
    out = rt.context_top_k(ranking, seeds, held, 5)
    return out.select("query_id", "path", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


@query(CONTEXT_SQL.replace("SELECT query_id, path, rank::BIGINT AS rank, place FROM k WHERE place <= 5", "") + """
, shown AS (SELECT DISTINCT k.query_id, cand.tok FROM k JOIN cand USING (path) WHERE place <= 5)
SELECT q.query_id, count(*)::BIGINT AS marked, count(shown.tok)::BIGINT AS present, round(count(shown.tok) / count(*), 6) AS coverage FROM q LEFT JOIN shown USING (query_id, tok) GROUP BY q.query_id""")
def context_coverage(spark: SparkSession, sf: str) -> DataFrame:
    context = context_topk(spark, sf).select("query_id", "path").cache()
    docs = candidates(spark, sf).join(rt.small(context.select("path").distinct()), "path", "left_semi")
    shown = rt.token_table(docs, tokens.occurrences(F.col("text")), "tree", "path").join(rt.small(context), "path").select("query_id", "tok").distinct().withColumn("hit", F.lit(1))
    j = query_tokens(spark, sf).join(shown, ["query_id", "tok"], "left")
    return j.groupBy("query_id").agg(F.count("*").alias("marked"), F.count("hit").alias("present"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"))


@query(BASE_SQL + f", r AS ({sql_rank(LEX_ABLATED)}), o AS (SELECT query_id, min(rank) AS rank FROM r JOIN rel USING (query_id, path) GROUP BY query_id) SELECT count(*)::BIGINT AS n, round(avg((rank <= 1)::INT), 6) AS hit_1, round(avg((rank <= 5)::INT), 6) AS hit_5, round(avg((rank <= 20)::INT), 6) AS hit_20, median(rank) AS median_rank FROM o")
def oracle_rank(spark: SparkSession, sf: str) -> DataFrame:
    docs, q, parts, rel = read_once(spark, sf)
    weights = lexicon.idf(docs, q, parts).cache()
    o, _ = placing.first_ranks(rt.ablate(q, evidence_of(q, weights)), docs, weights, {"ablated": lexicon.arm()}, rel, 1, parts)
    hit = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"hit_{k}")
    return o.agg(F.count("*").alias("n"), hit(1), hit(5), hit(20), F.percentile("rank", 0.5).alias("median_rank"))


@query()
def select_relevant(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut to a budget, lines that name words of its first sentence kept; greedy, so SQL has no equal."""
    from ..functions.windowing import select_relevant as cut

    docs = table(spark, sf, "documents")
    wanted = tokens.extract(F.substring_index("text", ".", 1), with_versions=False)
    w = docs.select("doc_id", "text", wanted.alias("wanted")).select("doc_id", cut(F.col("text"), 1500, F.col("wanted")).alias("w"))
    return w.select("doc_id", F.length("w.text").cast("long").alias("n"), F.md5("w.text").alias("text_md5"), F.col("w.cut").alias("cut"))


@query("SELECT md5(text) AS blob, count(*)::BIGINT AS copies, min(doc_id) AS first FROM documents GROUP BY 1")
def token_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs by content: each distinct text is tokenised once, however many trees hold it."""
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("blob")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
