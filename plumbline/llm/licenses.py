"""Licence scans: Aho-Corasick finds tags and notice phrases, a shunting-yard parser reads expressions.

One automaton runs over the normalised words of a text (joined by single spaces), so a phrase matches
wherever its words stand one after the other, whatever stood between them.  Where the words of an
identifier tag are found, the raw line behind the tag is parsed as a licence expression with the
operators AND, OR and WITH (WITH binds tightest, then AND, then OR) and evaluated: of OR, the side that
permissive terms suffice for is taken, so only its labels count; AND needs both.

Identifiers are looked up whole in a table of licences (a version, "-only" and the like aside), never by how they
begin: one that the table lacks is neither permissive nor restricted but unknown, and expressions are evaluated in
three values.  ``verdict`` is "restricted" if a licence that was found is, else "unknown" if one is unknown, else
"permissive"; "" where there is none.  An evaluated expression counts as one licence.  ``score`` says how sure it is
that the text carries licence terms.

Defined results: null and empty texts have no words, no labels, no verdict and score 0; unbalanced or unreadable
expressions yield the identifiers that can be read; repeated rows repeat; whole texts are scanned,
however long; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_BYTES, bounded_batches, slim, texts

#: Base phrases, fixed by the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of this operator's own; where several begin at one place the longest counts.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by sa": "cc-by-sa",
    "cc by": "cc-by",
    "cc0": "cc0",
    "creative commons": "cc",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAGS = ("spdx license identifier", "license expression")
TAG_RAW = re.compile(r"(?:spdx-license-identifier|license-expression)[ \t]*:[ \t]*([^\r\n]*)", re.ASCII)
#: Licences that may be changed and passed on under other terms, by identifier without version, and their labels.
FREE = {
    **{x: "mit" for x in ("mit", "mit-0", "expat", "x11")}, "apache": "apache", "isc": "isc", "zlib": "zlib", "postgresql": "postgresql", "ncsa": "ncsa",
    **{x: "bsd" for x in ("bsd", "bsd-1-clause", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "bsd-2-clause-patent", "bsd-3-clause-clear", "bsd-source-code")},
    "0bsd": "0bsd", "cc0": "cc0", "cc-by": "cc-by", "unlicense": "unlicense", "bsl": "bsl", "wtfpl": "wtfpl", "python": "python", "psf": "python", "blueoak": "blueoak",
    "public-domain": "public-domain", "boost": "bsl", "upl": "upl", "mulanpsl": "mulanpsl", "artistic": "artistic", "afl": "afl", "ms-pl": "ms-pl", "libpng": "zlib", "openssl": "openssl",
}
#: Licences that ask for the same terms, for no trade, for no changes or for more.
BOUND = {
    **{x: x for x in ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "osl", "cpl", "sspl", "gfdl", "cecill", "busl", "bsd-protection", "ms-rl", "odbl", "ofl")},
    **{x: x for x in ("cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "proprietary")}, "elastic": "elastic",
}
#: Whether a label's licence is permissive; what is not here is unknown.
PERMISSIVE = {label: True for label in FREE.values()} | {label: False for label in BOUND.values()}
#: All names, longer ones first.
NAMES = sorted((FREE | BOUND).items(), key=lambda n: -len(n[0]))
#: What may follow an identifier: a version, and which versions are meant.
VERSION = re.compile(r"(?:-?v?[0-9]+(?:\.[0-9]+)*)?(?:-(?:only|or-later|clause))?\+?")


@dataclass(frozen=True)
class Expression:
    """A parsed expression: its labels, whether permissive terms suffice (None: not known), and its canonical text."""

    labels: frozenset[str]
    permissive: bool | None
    text: str


def label_of(identifier: str) -> str | None:
    """The label of an identifier, which is a licence's name, alone or with a version ("gpl-2.0-only", "gplv3", "apache2")."""
    return next((label for name, label in NAMES if identifier.startswith(name) and VERSION.fullmatch(identifier[len(name) :])), None)


def either(a: bool | None, b: bool | None) -> bool | None:
    return True if a or b else None if a is None or b is None else False


def both(a: bool | None, b: bool | None) -> bool | None:
    return False if a is False or b is False else None if a is None or b is None else True


PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: infix tokens to postfix; stray brackets and operators are passed over."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # the last token could end an operand
    for t in tokens:
        if t == "(":
            if operand:
                break
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        elif t in PRECEDENCE:
            if not operand:
                continue
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[t]:
                out.append(held.pop())
            held.append(t)
            operand = False
        else:
            if operand:  # two identifiers in a row: the expression has ended
                break
            out.append(t)
            operand = True
    out += [t for t in reversed(held) if t != "("]
    return out


def evaluate(text: str) -> Expression | None:
    """The value of an expression, in three values: OR needs one permissive side, AND both, WITH its licence."""
    stack: list[Expression] = []
    for t in postfix(re.findall(r"[()]|[a-z0-9.+\-]+", text.lower())):
        if t not in PRECEDENCE:
            label = label_of(t)
            stack.append(Expression(frozenset([label] if label else []), PERMISSIVE.get(label), t))
        elif len(stack) >= 2:
            b, a = stack.pop(), stack.pop()
            if t == "with":
                stack.append(Expression(a.labels, a.permissive, f"{a.text} with {b.text}"))
            else:
                free = (either if t == "or" else both)(a.permissive, b.permissive)
                labels = a.labels | b.labels
                if t == "or" and free and a.permissive is not b.permissive:
                    labels = a.labels if a.permissive else b.labels
                first, second = sorted([a.text, b.text])
                stack.append(Expression(labels, free, f"({first} {t} {second})"))
    return stack[0] if stack else None


class Scanner:
    """The automaton and what its hits mean."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        phrases = {p: ("base", label) for p, label in BASE.items()}
        phrases |= {p: ("notice", label) for p, label in NOTICES.items()} | {p: ("tag", "") for p in TAGS}
        for phrase, (kind, label) in phrases.items():
            self.automaton.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, expression, verdict."""
        words = text.encode().translate(WORD_BYTES).split(b" ")
        words = [w for w in words if w]
        joined = f" {b' '.join(words).decode()} "
        starts: list[int] = []
        base: set[str] = set()
        longest: dict[int, tuple[int, str]] = {}  # of the notices that begin at a place
        tags = 0
        for end, (kind, label, size) in self.automaton.iter(joined):
            if kind == "base":
                starts.append(end - size + 1)
                base.add(label)
            elif kind == "notice":
                longest[end - size] = max((size, label), longest.get(end - size, (0, "")))
            else:
                tags += 1
        read = []
        if tags:
            lowered = text.translate(ASCII_LOWER)
            read = [e for m in TAG_RAW.finditer(lowered) if (e := evaluate(m[1]))]
        other = {label for _, label in longest.values()}
        labels = base | other | {x for e in read for x in e.labels}
        # each independent kind of evidence halves the doubt, an expression with a known licence twice
        evidence = 2 * sum(bool(e.labels) for e in read) + len(base) + len(other)
        found = [PERMISSIVE.get(x) for x in base | other] + [e.permissive for e in read]
        verdict = "" if not found else "restricted" if False in found else "unknown" if None in found else "permissive"
        first, last = (joined.count(" ", 0, f(starts)) if starts else None for f in (min, max))
        return (len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 0.5**evidence, " ; ".join(e.text for e in read), verdict)


ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, verdict string"


def scan(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.string()]
        for batch in batches:
            columns = list(zip(*(scanner(t) for t in texts(batch)))) or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return slim(docs).mapInArrow(run, SCHEMA)
