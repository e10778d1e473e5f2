"""Quality rules as a bitmask ledger, in SQL functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per failed
rule; a policy is a version name with a mask of the rules it enforces.  Policies and ablations read
bits, so trying another policy never touches a text again.

Defined results: null and empty texts have no words (all measurements 0, ``n_words < 20`` fails);
repeated rows are judged row by row; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slim

SPACE, SYMBOLS, WINDOW = "[\\x20\\x09-\\x0D]+", "[#*$%&|<>]", 8

#: bit -> (name, condition over the measurements that fails the rule)
RULES: dict[int, tuple[str, str]] = {
    0: ("too_few_words", "n_words < 20"),
    1: ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    2: ("symbol_heavy", "10 * n_symbols > 3 * word_chars"),
    3: ("duplicate_lines", "2 * n_dup_lines > n_lines AND n_lines >= 4"),
    4: ("long_words", "word_chars > 40 * n_words"),
    5: ("symbols_as_words", "4 * n_symbols > n_words AND n_symbols > 20"),
    6: ("short_words", "word_chars < 2 * n_words"),
}
BASE_MASK = 0b11
#: version -> mask of enforced rules.  v1 is the contract's base; v2 and v3 add rules that, among labelled
#: documents, only low quality breaks.
POLICIES: dict[str, int] = {"v1": 0b0000011, "v2": 0b0011111, "v3": 0b0111111, "strict": 0b1111111}
DEFAULT_POLICY = "v3"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often and wherever the body names it.

    An alias would not do: the optimizer may write its expression into a lambda, to be run per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_hashes(words: Column) -> Column:
    """Hashes of all windows of eight words, null if there is none."""
    per_window = lambda ids: F.when(
        F.size(ids) > WINDOW - 1,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids) - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(ids, i, WINDOW))),
    )
    return _let(F.transform(words, lambda w: F.xxhash64(w)), per_window)


def _repeat_words(windows: Column) -> Column:
    """Words that windows found twice or more cover."""

    def again(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        near = F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"]))
        return F.array_sort(F.filter(near, lambda i: i.isNotNull()))

    def covered(hits: Column) -> Column:
        # a hit covers the words up to the next hit, eight at most
        reach = F.transform(hits, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(hits, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    ordered = lambda w: F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    count = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _let(_let(ordered(w), again), covered)).otherwise(0)
    return F.coalesce(_let(windows, count), F.lit(0))


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id (``carry``: and ``row``, the whole row as a struct) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated windows are found per row: window hashes are compared by a hash set first and only
    documents that have a repeat sort their (hash, position) pairs.
    """
    text = F.coalesce("text", F.lit(""))
    words = lambda: F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_words = _let(words(), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(_window_hashes(w)).alias("n_repeat_words")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")) if carry else slim(docs)
    kept = ["doc_id", "row"] if carry else ["doc_id"]
    found = source.select(
        *kept, by_words.alias("w"), by_lines.alias("l"),
        (F.length(text) - F.regexp_count(text, F.lit("[\\x20\\x09-\\x0D]"))).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
    )
    columns = {"n_words": "w.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words"}
    return found.select(*kept, *[F.col(c).cast("long").alias(n) for n, c in columns.items()])


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The measurements and ``failed``: bit b is set when rule b fails."""
    bits = sum((F.expr(rule).cast("long") * F.lit(1 << bit) for bit, (_, rule) in RULES.items()), F.lit(0).cast("long"))
    return measure(docs, carry).withColumn("failed", bits)


def apply_policy(book: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """``base_failed`` and ``kept`` under a policy; the base rules bind whatever the policy says."""
    mask = POLICIES[policy] | BASE_MASK
    return book.withColumns({
        "base_failed": F.col("failed").bitwiseAND(F.lit(BASE_MASK)) != 0,
        "kept": F.col("failed").bitwiseAND(F.lit(mask)) == 0,
    })


def ablation(book: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each enforced rule: documents that fail it, and those that only it rejects.

    One aggregation by failure mask (at most two to the number of rules groups), then bit tests.
    """
    mask = POLICIES[policy] | BASE_MASK
    groups = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(name).alias("rule"), F.lit(1 << b).cast("long").alias("m")) for b, (name, _) in RULES.items() if mask >> b & 1])
    rows = groups.select("failed", "n", F.explode(rules).alias("r"))
    return rows.groupBy(F.lit(policy).alias("policy"), F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.m")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("r.m"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_docs"),
    )


def keep_good(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows, with all their columns, that the policy keeps; a filter within each row, without a join."""
    return apply_policy(ledger(docs, carry=True), policy).where("kept").select("row.*")
