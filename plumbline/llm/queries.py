"""The queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, htmltext, licenses, lmscore, packing, quality, repair, runs, simhash, substring, toxicity, vectors, webp
from .common import table


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), _tokenizer_file("byte_bpe_multi_50k.tiktoken"), _pattern())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.store_and_read(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_bpe(_tokenizer_file("word_bpe_49k.json")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strictest policy rejects, and what it alone rejects."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")), "strict")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), locate=True)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = lmscore.score(table(spark, sf_dir, "documents"), target)
    return found.select("doc_id", "n_tokens", *[F.round(c, 9).alias(c) for c in ("target_loss", "background_loss", "score")])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_byte_bpe, op2_license_scan, op3_media_webp, op4_packing, op5_quality_rules, op6_html_extraction, op7_toxicity, op8_lm_scoring, op9_substring_dedup, op10_simhash, op11_conversation_repair, op12_embedding_near_dedup, op13_periodic_runs, pipeline, quality_rule_ablation)
    return {f.__name__: f for f in own}


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
m AS (
  SELECT row, doc_id, words, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
w AS (SELECT row, i, array_to_string(words[i : i + 7], ' ') AS g FROM m, unnest(range(1, n_words - 6)) AS u(i)),
c AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM w),
h AS (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM c WHERE n > 1),
r AS (SELECT row, sum(least(8, coalesce(nxt - i, 8))) AS n FROM h GROUP BY row),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM m LEFT JOIN r USING (row)),
b AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
    + 4 * (10 * n_symbols > 3 * word_chars)::BIGINT + 8 * (2 * n_dup_lines > n_lines AND n_lines >= 4)::BIGINT
    + 16 * (word_chars > 40 * n_words)::BIGINT + 32 * (4 * n_symbols > n_words AND n_symbols > 20)::BIGINT
    + 64 * (word_chars < 2 * n_words)::BIGINT AS failed
  FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept, failed
FROM b
"""

_OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS g FROM d, unnest(range(1, len(words) - 48)) AS u(i)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM w) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM s, range(0, 50) AS u(j)),
kept AS (
  SELECT e.doc_id, array_to_string(list(e.word ORDER BY e.p), ' ') AS text, count(*) AS n
  FROM (SELECT doc_id, p, words[p] AS word FROM d, unnest(range(1, len(words) + 1)) AS u(p)) e
  ANTI JOIN gone ON e.doc_id = gone.doc_id AND e.p = gone.p GROUP BY e.doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_RULES = "(VALUES " + ", ".join(f"({b}, '{name}')" for b, (name, _) in quality.RULES.items()) + ") AS r(bit, rule)"
_ABLATION = _OP5[: _OP5.rindex("SELECT doc_id, n_words::BIGINT")] + f"""
SELECT 'strict' AS policy, bit, rule, count_if(failed & (1 << bit) <> 0)::BIGINT AS n_failed, count_if(failed = 1 << bit)::BIGINT AS n_only, count(*)::BIGINT AS n_docs
FROM b, {_RULES} GROUP BY bit, rule
"""

_OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT row, coalesce(good, false) AS good, CASE WHEN i > 1 THEN words[i - 1] ELSE '' END AS u, words[i] AS w FROM d, unnest(range(1, len(words) + 1)) AS x(i)),
c AS (SELECT u, w, count(*) AS a, count_if(good) AS t FROM p GROUP BY u, w),
f AS (SELECT u, sum(a) AS a, sum(t) AS t FROM c GROUP BY u),
g AS (SELECT w, sum(a) AS a, sum(t) AS t FROM c GROUP BY w),
n AS (SELECT sum(a) AS a, sum(t) AS t, count(*) AS v FROM g),
l AS (
  SELECT c.u, c.w, -ln((c.a + 20 * (g.a + 1) / (n.a + n.v)) / (f.a + 20)) AS la, -ln((c.t + 20 * (g.t + 1) / (n.t + n.v)) / (f.t + 20)) AS lt
  FROM c JOIN f USING (u) JOIN g USING (w), n),
s AS (SELECT row, avg(la) AS la, avg(lt) AS lt FROM p JOIN l USING (u, w) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_tokens, round(lt, 9) AS target_loss, round(la, 9) AS background_loss, coalesce(round(la - lt, 9), 0) AS score
FROM d LEFT JOIN s USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": _OP5, "quality_rule_ablation": _ABLATION, "op8_lm_scoring": _OP8, "op9_substring_dedup": _OP9}
