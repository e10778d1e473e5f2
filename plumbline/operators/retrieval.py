"""Rankers over (query, candidate) pairs of a tree, and the total order they share.

Inputs are long tables: ``queries(query_id, tree, tok)``, ``pool(tree, path)`` and
``cand(tree, path, tok, tf)``, one row per distinct token of a candidate.  Scores come from equi joins
on (tree, tok); only candidates that share a token get a row, the others score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

#: Rows up to which a side may be sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a look at no more than ``rows`` + 1 rows shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_blocks(queries: DataFrame, cands: DataFrame, rows: int = 5_000) -> DataFrame:
    """Every query with every candidate of its tree, a block of queries at a time.

    Up to ``rows`` queries are sent to every executor.  More are cut into blocks of that size; queries go to
    every salt and candidates to every block, so that no tree meets in one task.
    """
    n = queries.count()
    if n <= rows:
        return F.broadcast(queries).join(cands, "tree")
    salts, blocks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows)
    q = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    c = cands.withColumn("_s", F.pmod(F.xxhash64(*cands.columns), F.lit(salts)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return q.join(c, ["tree", "_b", "_s"]).drop("_b", "_s")


def token_table(docs: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, tok, tf): tokens (with repeats) of each document, counted."""
    return docs.select(*keys, F.explode(tokens).alias("tok")).groupBy(*keys, "tok").agg(F.count("*").alias("tf"))


def tree_tokens(blobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held, pool, cand) of ``blobs(repo, sha, path, text)``: texts by tree, code files, and their tokens counted.

    Every distinct text is tokenised once, however many trees hold it.
    """
    from ..functions import paths, tokens

    held = blobs.select(F.concat_ws("@", "repo", "sha").alias("tree"), "path", "text", F.md5("text").alias("blob"))
    pool = held.where(paths.kind(F.col("path")) == "code").select("tree", "path", "blob")
    by_blob = token_table(held.join(pool.select("blob").distinct(), "blob", "left_semi").dropDuplicates(["blob"]), tokens.occurrences(F.col("text")), "blob")
    return held, pool, pool.join(by_blob, "blob").select("tree", "path", "tok", "tf").cache()


def idf(cand: DataFrame, pool: DataFrame) -> DataFrame:
    """(tree, tok, df, idf): ln(1 + (N - df + 0.5) / (df + 0.5)), N being the pool's files."""
    n = pool.groupBy("tree").agg(F.count("*").alias("n"))
    df = cand.groupBy("tree", "tok").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n) if n.limit(10_001).count() <= 10_000 else n, "tree").select("tree", "tok", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


#: Rows of candidates that hold a token in one tree, beyond which they are cut into slices of that size.
SLICE_ROWS = 100_000


def sliced(wanted: DataFrame, cand: DataFrame, rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``slice``: a token in more than ``rows`` candidates is dealt out by path, its queries go to every slice.

    ``wanted`` has ``df``, the candidates that hold a token, so how many slices it needs is known before the join; no
    task gets more than a slice of a token, however common it is.
    """
    hot = wanted.where(F.col("df") > rows).select("tree", "tok", F.ceil(F.col("df") / rows).cast("int").alias("slices")).distinct()
    mine = F.pmod(F.xxhash64("path"), F.coalesce("slices", F.lit(1))).cast("int")
    c = cand.join(small(hot), ["tree", "tok"], "left").withColumn("slice", mine).drop("slices")
    last = F.greatest(F.ceil(F.col("df") / rows).cast("int"), F.lit(1)) - 1
    return wanted.withColumn("slice", F.explode(F.sequence(F.lit(0), last))), c


def score_arms(queries: DataFrame, cand: DataFrame, weights: DataFrame, arms: dict[str, Column], broadcast: int = BROADCAST_ROWS, rows: int = SLICE_ROWS) -> DataFrame:
    """(query_id, tree, path, one column an arm): all arms' scores from one join of tokens.

    An arm is an expression over a shared token's ``idf``, ``tf`` and the columns of ``queries(query_id, tree, tok, ..)``; it is
    summed and divided by the root of the candidate's distinct tokens, null where every token of it is null.
    """
    sizes = cand.groupBy("tree", "path").agg(F.count("*").alias("size"))
    # only the queries' tokens matter: their rows of the candidates are a small part of all
    wanted = queries.join(weights, ["tree", "tok"])
    keys = ["tree", "tok"]
    if wanted.limit(broadcast + 1).count() <= broadcast:
        wanted = F.broadcast(wanted)
    else:
        wanted, cand = sliced(wanted, cand, rows)
        keys = [*keys, "slice"]
    summed = cand.join(wanted, keys).groupBy("query_id", "tree", "path").agg(*[F.sum(part).alias(arm) for arm, part in arms.items()])
    return summed.join(sizes, ["tree", "path"]).select("query_id", "tree", "path", *[F.round(F.col(arm) / F.sqrt("size"), 9).alias(arm) for arm in arms])


def long(scores: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, query_id, path, score) of ``score_arms``, a row for each arm that scores the candidate."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("score")) for a in arms]))
    return scores.select("query_id", "path", each.alias("s")).select("s.arm", "query_id", "path", "s.score").where("score IS NOT NULL")


def lexical_part() -> Column:
    return F.col("idf")


def tf_part(k1: float) -> Column:
    if k1 < 0:
        raise ValueError("k1 must not be negative")
    return F.col("idf") * F.col("tf") / (F.col("tf") + F.lit(k1))


def score_tokens(queries: DataFrame, cand: DataFrame, weights: DataFrame, k1: float | None = None) -> DataFrame:
    """(query_id, tree, path, score): idf of shared tokens over the root of the candidate's distinct tokens.

    With ``k1`` each idf is multiplied by tf / (tf + k1); k1 = 0 is the plain score.
    """
    return score_arms(queries, cand, weights, {"score": lexical_part() if k1 is None else tf_part(k1)})


def marked(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """The queries' tokens with ``evidence``, whether a token is among ``evidence(query_id, tok)``."""
    marks = evidence.select("query_id", "tok").distinct().withColumn("evidence", F.lit(True))
    return queries.join(marks, ["query_id", "tok"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(False)))


def ablate(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """The queries without the tokens of ``evidence(query_id, tok)``."""
    return queries.join(evidence, ["query_id", "tok"], "left_anti")


def score_paths(queries: DataFrame, pool: DataFrame, doc_path: str = "doc_path") -> DataFrame:
    """Tokens shared by stem and whole path, either way round, over the root of the candidate's tokens."""
    from ..functions import paths

    q = queries.select("query_id", "tree", paths.path_tokens(F.col(doc_path)).alias("qa"), paths.stem_tokens(F.col(doc_path)).alias("qs"))
    c = pool.select("tree", "path", paths.path_tokens(F.col("path")).alias("ca"), paths.stem_tokens(F.col("path")).alias("cs"))
    hits = F.array_union(F.array_intersect("qa", "cs"), F.array_intersect("qs", "ca"))
    return in_blocks(q, c).select("query_id", "tree", "path", F.round(F.when(F.size("ca") > 0, F.size(hits) / F.sqrt(F.size("ca"))).otherwise(0.0), 9).alias("score"))


def score_shuffle(pairs: DataFrame, seed: Column) -> DataFrame:
    """A score that orders candidates by the md5 of seed, query and path."""
    return pairs.withColumn("score", stats.uniform(seed, F.col("query_id"), F.col("path")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def score_maxsim(query_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, path, score): the best dot product of a chunk of the query with one of the candidate."""
    pairs = in_blocks(query_chunks, chunks)
    return pairs.groupBy("query_id", "tree", "path").agg(F.round(F.max(dot(F.col("qv"), F.col("cv"))), 5).alias("score"))


def rank(scores: DataFrame, pairs: DataFrame | None = None, arm: str | None = None) -> DataFrame:
    """(query_id, path, score, rank): score falling, then path; with ``pairs`` unscored candidates get 0."""
    if pairs is not None:
        scores = pairs.join(scores, [c for c in ("query_id", "tree", "path") if c in pairs.columns], "left")
    scores = scores.withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    out = scores.select("query_id", "path", "score", F.row_number().over(w).alias("rank"))
    return out.withColumn("arm", F.lit(arm)) if arm else out


def ranks_of(scores: DataFrame, relevant: DataFrame, step: float = 0.001) -> DataFrame:
    """The ranks of relevant candidates alone: 1 + the number that stand before each.

    Candidates are counted by query and bucket of scores; only those in a relevant candidate's own bucket are
    compared with it.  Nobody sorts a query's candidates or brings them to one task.  ``scores`` is read three
    times, so hand in a cached or written table.
    """
    keys = [c for c in ("arm", "trial", "query_id") if c in scores.columns]
    cut = scores.select(*keys, "path", "score", F.floor(F.col("score") / step).alias("bucket"))
    own = cut.join(relevant.select("query_id", "path").distinct(), ["query_id", "path"]).select(*keys, "bucket", F.col("path").alias("own"), F.col("score").alias("s"))
    upto = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    above = cut.groupBy(*keys, "bucket").agg(F.count("*").alias("n")).select(*keys, "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("above"))
    before = (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("path") < F.col("own")))
    inside = cut.join(small(own), [*keys, "bucket"]).groupBy(*keys, "bucket", "own").agg(F.count_if(before).alias("inside"))
    return inside.join(above, [*keys, "bucket"]).select(*keys, F.col("own").alias("path"), (F.col("above") + F.col("inside") + 1).alias("rank"))


def ranks_with_tail(scores: DataFrame, relevant: DataFrame, pool: DataFrame, step: float = 0.001) -> DataFrame:
    """Ranks of relevant candidates in whole rankings, in which a candidate without a score has 0 and ties go by path.

    ``scores([arm,] query_id, path, score)`` of the scored candidates, ``relevant([arm,] query_id, tree, path)`` with the arms
    to answer for, ``pool(tree, path)``.  Those without a score are counted, never listed.
    """
    keys = [*[c for c in ("arm",) if c in scores.columns], "query_id"]
    places = pool.withColumn("pos", F.row_number().over(Window.partitionBy("tree").orderBy("path"))).withColumn("n_pool", F.count("*").over(Window.partitionBy("tree")))
    own = relevant.select(*keys, "tree", "path").distinct().join(scores.select(*keys, "path", F.col("score").alias("s")), [*keys, "path"], "left")
    first = ranks_of(scores, relevant, step)
    rest = own.where("s IS NULL OR s <= 0").join(places, ["tree", "path"]).select(*keys, F.col("path").alias("own"), "s", "pos", "n_pool")
    s, score, earlier = F.col("s"), F.col("score"), F.col("path") < F.col("own")
    counted = rest.join(scores.select(*keys, "path", "score"), keys, "left").groupBy(*keys, "own", "s", "pos", "n_pool").agg(
        F.count("path").alias("scored"), F.count_if(earlier).alias("before"), F.count_if((score > 0) | ((score == 0) & earlier)).alias("above"), F.count_if((score > s) | ((score == s) & earlier)).alias("below"))
    rank_of = F.when(s < 0, F.col("below") + F.col("n_pool") - F.col("scored")).otherwise(F.col("above") + F.col("pos") - 1 - F.col("before")) + 1
    kept = first.join(own.where("s > 0").select(*keys, "path"), [*keys, "path"], "left_semi")
    return kept.select(*keys, "path", "rank").unionByName(counted.select(*keys, F.col("own").alias("path"), rank_of.alias("rank")))


def shuffled_ranks(queries: DataFrame, relevant: DataFrame, pool: DataFrame, trials: int) -> DataFrame:
    """(arm, query_id, path, rank) of relevant candidates in rankings by seeded hashes; candidates are counted as they pass."""
    seed = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    own = relevant.select("query_id", F.col("path").alias("own")).distinct()
    value = lambda path: stats.uniform(F.col("trial").cast("string"), F.col("query_id"), F.col(path))
    asked = own.join(queries.select("query_id", "tree"), "query_id").select("query_id", "tree", "own", seed).withColumn("s", value("own"))
    score = value("path")
    before = (score > F.col("s")) | ((score == F.col("s")) & (F.col("path") < F.col("own")))
    return asked.join(pool, "tree").groupBy("trial", "query_id", "own").agg((F.count_if(before) + 1).alias("rank")).select(F.concat(F.lit("shuffle-"), "trial").alias("arm"), "query_id", F.col("own").alias("path"), "rank")


def rerank(base: DataFrame, pair_scores: DataFrame, top_n: int = 20) -> DataFrame:
    """The first ``top_n`` of a ranking ordered anew by pair score; a missing score goes last, the tail stays.

    A query of which no pair is scored (a page with nothing left to read) keeps its order.
    """
    if top_n < 2:
        raise ValueError("top_n must be 2 or more")
    head = base.where(F.col("rank") <= top_n).join(pair_scores.select("query_id", "path", F.col("score").alias("pair")), ["query_id", "path"], "left")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("pair", F.lit(float("-inf")))), "path")
    few = Window.partitionBy("query_id")
    head = head.withColumn("new", F.when((F.count("*").over(few) < 2) | (F.count("pair").over(few) == 0), F.col("rank")).otherwise(F.row_number().over(w)))
    return head.select("query_id", "path", "score", F.col("new").alias("rank")).unionByName(base.where(F.col("rank") > top_n).select("query_id", "path", "score", "rank"))


def context_top_k(scores: DataFrame, seeds: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """The seed file first (rank 0), then the best scored others, k in all; files without text are passed over.

    Tasks cut a query's candidates down to k + 1 before they are shuffled.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    best = scores.join(texts, "path", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    seeded = seeds.join(texts, "path", "left_semi").select("query_id", "path", F.lit(0).alias("rank")).unionByName(best.select("query_id", "path", "rank"))
    first = seeded.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
    places = Window.partitionBy("query_id").orderBy("rank", "path")
    return first.withColumn("place", F.row_number().over(places)).where(F.col("place") <= k)
