"""Texts that hold a passage word for word, found in the tasks that read the texts: no word of a text is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passages, and their characters, that go to every task as one automaton.
FEW_ROWS, FEW_CHARS = 50_000, 2_000_000


def few(passages: DataFrame) -> bool:
    """Whether ``passages(query_id, text)`` can go to every task."""
    n, chars = passages.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return n <= FEW_ROWS and chars <= FEW_CHARS


def collected(passages: DataFrame) -> dict[str, list]:
    """The ids of each text of ``passages(query_id, text)``."""
    asked: dict[str, list] = {}
    for row in passages.select("query_id", "text").where("text IS NOT NULL").collect():
        asked.setdefault(row["text"], []).append(row["query_id"])
    return asked


class Sought:
    """Passages by one token of theirs, where texts' tokens are at hand; those without such a token by an automaton over whole texts.

    A word strictly inside a passage stands whole in every text that holds the passage, so its tokens do, too; of them
    the longest is looked for, being rare as a rule.
    """

    def __init__(self, asked: dict[str, list], vocabulary: dict[str, int], tokens: Callable[[str], Iterable[str]]):
        self.by_token: dict[int, list[tuple[str, list]]] = {}
        self.others: dict[str, list] = {}
        for passage, ids in asked.items():
            inner = [m[0] for m in re.finditer("[A-Za-z0-9_]+", passage) if m.start() > 0 and m.end() < len(passage)]
            known = [t for word in inner for t in tokens(word) if t in vocabulary]
            if known:
                self.by_token.setdefault(vocabulary[max(known, key=lambda t: (len(t), t))], []).append((passage, ids))
            else:
                self.others[passage] = ids

    def finder(self) -> Callable[[pa.Array, np.ndarray, np.ndarray], tuple[list[int], list]]:
        """For a task: from texts and the (text, token) that stand there, ordered by text, the texts that hold passages and the ids of these."""
        always = self.others.get("", [])  # any text holds nothing
        some = {p: ids for p, ids in self.others.items() if p}
        by_token, automaton = self.by_token, automaton_of(some) if some else None
        anchors = np.array(sorted(by_token), np.int64)

        def find(texts: pa.Array, text: np.ndarray, token: np.ndarray) -> tuple[list[int], list]:
            found: dict[int, list] = {}
            hits = np.flatnonzero(np.isin(token, anchors))
            last, held = -1, ""
            for k, t in zip(text[hits].tolist(), token[hits].tolist()):
                if k != last:
                    last, held = k, texts[k].as_py()
                for passage, ids in by_token[t]:
                    if passage in held:
                        found.setdefault(k, []).extend(ids)
            if self.others:
                for k, value in enumerate(texts):
                    if value.is_valid and (mine := [*always, *(held_by(automaton, value.as_py()) if automaton else ())]):
                        found.setdefault(k, []).extend(mine)
            rows = sorted(found)
            return [k for k in rows for _ in found[k]], [i for k in rows for i in found[k]]

        return find


def automaton_of(asked: dict[str, list]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for passage, ids in asked.items():
        automaton.add_word(passage, (passage, ids))
    automaton.make_automaton()
    return automaton


def held_by(automaton, text: str) -> list:
    """The ids of the passages that a text holds."""
    return [i for ids in dict(held for _, held in automaton.iter(text)).values() for i in ids]


def holders(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, path) of each of ``passages(query_id, text)`` and each of ``docs(path, text)`` that holds it; see ``few``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = passages.schema["query_id"].dataType
    id_type = to_arrow_type(kind)
    asked = collected(passages)
    always = asked.pop("", [])  # any text holds nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(asked) if asked else None
        for batch in batches:
            at, ids = [], []
            for k, text in enumerate(batch.column(1)):
                if text.is_valid:
                    mine = [*always, *(held_by(automaton, text.as_py()) if automaton else ())]
                    ids += mine
                    at += [k] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), batch.column(0).take(pa.array(at, pa.int64()))], names=["query_id", "path"])

    return docs.select("path", "text").mapInArrow(run, f"query_id {kind.simpleString()}, path string")
