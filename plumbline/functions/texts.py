"""Windows, redaction, claims and replies, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tokens
from .tokens import let


def stable_id(*parts: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of the parts, joined by NUL; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before.

    Blank texts have none, and a last window that lies whole in the one before is dropped.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i + overlap < F.length(text)))
    return F.when(F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def redact(text: Column, words: Column) -> Column:
    """Every occurrence of a word, the longest first and in any case, becomes a space."""
    literal = lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    quoted = F.transform(tokens.longest_first(words), literal)
    return F.when(F.size(words) > 0, F.regexp_replace(text, F.concat(F.lit("(?i)"), F.array_join(quoted, "|")), F.lit(" "))).otherwise(text)


def truncate(text: Column, budget: int) -> Column:
    """The head within the budget and a mark (fixed wording) that says how much is not shown."""
    hidden = (F.length(text) - budget).cast("string")
    cut = F.concat(F.substring(text, 1, budget), F.lit("\n\n... [truncated: "), hidden, F.lit(" of "), F.length(text).cast("string"), F.lit(" characters not shown]"))
    return F.when(F.length(text) > budget, cut).otherwise(text)


#: Fixed value: lines that are markup, not prose.
NOT_PROSE = r"^\s*(?:\.\.\s|```|~~~|\||[-=~^\"'+*#]{3,}\s*$|>>>|\$\s)|^\s{4,}\S"


def outside_fences(text: Column) -> Column:
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, line: Column) -> Column:
        fence = line.rlike(tokens.FENCE)
        shown = F.when(fence | state["inside"], F.lit("")).otherwise(line)
        return F.struct((state["inside"] != fence).alias("inside"), F.concat(state["kept"], F.array(shown)).alias("kept"))

    return F.aggregate(tokens.lines(text), start, step, lambda s: F.array_join(s["kept"], "\n"))


def prose_sentences(text: Column) -> Column:
    """Sentences of blocks between blank lines; fences, directives and indented lines set aside."""
    def block(b: Column) -> Column:
        said = F.filter(F.split(b, "\n"), lambda x: ~x.rlike(NOT_PROSE))
        return F.trim(F.array_join(F.transform(said, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), " "))

    blocks = F.transform(F.split(outside_fences(text), r"\n\s*\n"), block)
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[.!?])\s+")))
    return F.filter(F.transform(sentences, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def claim_units(text: Column) -> Column:
    """The prose sentences that mark up at least one identifier, in page order."""
    return F.filter(prose_sentences(text), lambda s: F.size(tokens.extract(tokens.literal_spans(s), with_versions=False)) > 0)


def batches(items: Column, size: int) -> Column:
    """Neighbouring groups of ``size`` items."""
    if size < 1:
        raise ValueError("size must be 1 or more")

    def cut(held: Column) -> Column:
        starts = F.when(F.size(held) > 0, F.sequence(F.lit(1), F.size(held), F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(held, i, size))

    return let(items, cut)


def locates(claim: Column, identifiers: Column) -> Column:
    """Whether the claim names one of the identifiers as a word that follows no dot."""
    return F.exists(identifiers, lambda i: F.regexp_like(claim, F.concat(F.lit(r"(?<![\w.])\Q"), i, F.lit(r"\E(?!\w)"))))


def shingles(text: Column, width: int = 4) -> Column:
    """Distinct runs of ``width`` normalised words."""

    def runs(ws: Column) -> Column:
        starts = F.when(F.size(ws) >= width, F.sequence(F.lit(1), F.size(ws) - (width - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(ws, i, width), " ")))

    return let(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), runs)


def containment(part: Column, whole: Column) -> Column:
    return F.when(F.size(part) == 0, 0.0).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def defines(text: Column, name: Column) -> Column:
    """Whether the text has a def, a class or an assignment of the name."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    return F.regexp_like(text, F.concat(F.lit(r"(?m)^\s*(?:async\s+def|def|class)\s+"), quoted, F.lit(r"\b|(?m)^\s*"), quoted, F.lit(r"\s*(?::[^=\n]+)?=(?!=)")))


#: Words of a reply that are verdicts; "unclear" is one and abstains.
REPLY_VERDICTS = ("false", "not-false", "unclear")


def reply_word(reply: Column) -> Column:
    """The verdict word of the JSON object in a reply (first brace to last); null if there is none that is known."""
    said = F.lower(F.trim(F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.verdict")))
    return F.when(said.isin(*REPLY_VERDICTS), said)


def reply_verdict(reply: Column) -> Column:
    """true (the document is false), false, or null: abstained or not to be read."""
    said = reply_word(reply)
    return F.when(said == "false", True).when(said == "not-false", False)


def reply_reason(reply: Column, truncated: Column) -> Column:
    """truncated, not-shown or other."""
    hidden = F.lower(reply).rlike(r"not (?:shown|visible|included|present|provided)|cannot (?:see|verify|confirm)|truncated")
    return F.when(truncated, "truncated").when(hidden, "not-shown").otherwise("other")
