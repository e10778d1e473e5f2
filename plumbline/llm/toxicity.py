"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of the vocabulary words it holds; a document's is the
noisy-or of its sentences, 1 - prod(1 - p), where p counts from the probability that the bias alone
gives: a sentence without a known word, or with words of no weight, adds nothing, so no document is
toxic by its length.  Weights follow the gradient of the documents' log loss, so
labels of documents teach which sentences offend, and the same scores locate them.

The classifier is fitted on the first ``sample_docs`` labelled ids in the order of their hash, a documented
parameter; its words are all words of the sample that speak for toxicity beyond chance.  Word counts for the
choice are made in Spark; the driver gets the chosen words and, for each sampled document, the chosen words
of its sentences, which the sample bounds.  Every document is scored whole.

Defined results: null and empty texts score 0, as all texts without a known word; rows with null
labels are no training rows; an id with labels of both kinds is toxic; rows with a null id are never held
out; with no labelled documents of both kinds every score is 0 but for rounding; repeated rows are scored
alike; very long texts are whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slim, texts, written

SENTENCES, WORD = re.compile(r"[.!?\n]+"), re.compile(r"\w+")
SAMPLE_DOCS, THRESHOLD = 12_000, 0.3
#: Weight decay of the fit: what keeps a word seen a few times from condemning a document alone.
DECAY = 1e-3
#: The bias that the fit is drawn to, and how strongly.
QUIET, PULL = -4.0, 0.02
#: The least likelihood-ratio statistic of a chosen word (one in a thousand by chance).
MIN_GAIN = 10.8


def beyond(logit, bias: float):
    """-log(1 - p), less that of the bias alone."""
    return np.logaddexp(0, logit) - np.logaddexp(0, bias)


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    bias: float

    def sentences(self, text: str) -> list[float]:
        """The probability of each sentence, in order."""
        return [float(-np.expm1(-beyond(self._logit(s), self.bias))) for s in SENTENCES.split(text)]

    def offending(self, text: str, threshold: float) -> list[dict]:
        """The sentences that reach the threshold, or else the worst."""
        said = self.sentences(text)
        level = min(threshold, max(said))
        return [{"sentence": i, "text": s, "score": p} for i, (s, p) in enumerate(zip(SENTENCES.split(text), said)) if p >= level]

    def _logit(self, sentence: str) -> float:
        words, weights = self.words, self.weights
        return self.bias + sum(weights[i] for i in {words[w] for w in WORD.findall(sentence.lower()) if w in words})

    def score(self, text: str) -> float:
        """Noisy-or over the sentences with a known word; the others add nothing."""
        logits = []
        known = self.words.keys()
        for s in SENTENCES.split(text.lower()):
            if hit := known & set(WORD.findall(s)):
                logits.append(sum(self.weights[self.words[w]] for w in hit))
        return float(-np.expm1(-beyond(self.bias + np.array(logits), self.bias).sum()))


def held_out(doc_id: str = "doc_id"):
    """Rows that no fit may see: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def loss_of(weights: np.ndarray, bias: float, bags: list[list[list[int]]], toxic: np.ndarray, decay: float = DECAY) -> float:
    """Half the mean log loss of the toxic documents, half that of the others, the decay of the weights and the pull of the bias."""
    none = np.array([sum(beyond(bias + weights[s].sum(), bias) for s in b) for b in bags]) + 1e-9
    said = np.where(toxic == 1, -np.log(-np.expm1(-none)), none)
    return float(sum(said[toxic == k].mean() for k in (0, 1) if (toxic == k).any()) / 2 + decay / 2 * (weights**2).sum() + PULL / 2 * (bias - QUIET) ** 2)


def fit_noisy_or(bags: list[list[list[int]]], toxic: np.ndarray, size: int, rounds: int = 1000, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias from documents given as lists of sentences of word numbers (Adam on ``loss_of``).

    The words were chosen because they speak for toxicity, so no weight falls below zero.  Only sentences with a
    known word are listed, and a sentence counts by what its words add to the bias, which is fitted, too.
    """
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = [s for b in bags for s in b]
    sent = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    word = np.array([w for s in flat for w in s], dtype=np.int64)
    x = np.append(np.zeros(size), QUIET)  # the weights, then the bias
    best, least = x, np.inf
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    share = np.where(toxic == 1, 0.5 / max((toxic == 1).sum(), 1), 0.5 / max((toxic == 0).sum(), 1))
    for t in range(1, rounds + 1):
        w, bias = x[:-1], x[-1]
        z = bias + np.bincount(sent, w[word], len(flat))
        none = np.bincount(doc, beyond(z, bias), len(bags)) + 1e-9  # -log of no sentence offending
        now = (share * np.where(toxic == 1, -np.log(-np.expm1(-none)), none)).sum() + decay / 2 * (w * w).sum() + PULL / 2 * (bias - QUIET) ** 2
        if now < least:
            best, least = x, now
        # d loss / d none: 1 for clean documents, -e^-none / (1 - e^-none) for toxic ones
        slope = share * np.clip(np.where(toxic == 1, -1 / np.expm1(np.minimum(none, 50)), 1.0), -1e3, 1e3)
        p, quiet = 1 / (1 + np.exp(-np.clip(z, -50, 50))), 1 / (1 + np.exp(-bias))
        g = np.append(np.bincount(word, (slope[doc] * p)[sent], size) + decay * w, (slope[doc] * (p - quiet)).sum() + PULL * (bias - QUIET))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        x[:-1] = np.maximum(x[:-1], 0.0)
    return best[:-1], float(best[-1])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("toxic").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    # one row an id, the first in the order of a hash: what bounds them is what proves that they can be broadcast
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = F.broadcast(rows)
    sample = written(slim(docs).where("text IS NOT NULL").join(rows, "doc_id").select("text", "toxic"), "sample")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, label in zip(texts(batch), batch.column("toxic").to_pylist()):
                for w in set(WORD.findall(text.lower())):
                    seen.setdefault(w, [0, 0])[label] += 1
            clean, bad = zip(*seen.values()) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(clean, pa.int64()), pa.array(bad, pa.int64())], names=["word", "clean", "bad"])

    totals = dict.fromkeys((0, 1), 0) | {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals[0] or not totals[1]:
        return Model({}, np.zeros(0), -60.0)
    counts = sample.mapInArrow(distinct, "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    # the likelihood-ratio statistic of word against label; only words that speak for toxicity are chosen
    n_bad, n_clean = totals[1], totals[0]
    share = n_bad / (n_bad + n_clean)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    seen, bad = F.col("bad") + F.col("clean"), F.col("bad")
    cells = ((bad, seen * share), (F.col("clean"), seen * (1 - share)), (n_bad - bad, (n_bad + n_clean - seen) * share), (n_clean - F.col("clean"), (n_bad + n_clean - seen) * (1 - share)))
    gain = 2 * sum((term(o, e) for o, e in cells), F.lit(0.0))
    counts = counts.where((seen >= 3) & (bad > seen * share)).withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN)
    chosen = [r["word"] for r in counts.orderBy(F.desc("gain"), "word").select("word").collect()]
    index = {w: i for i, w in enumerate(chosen)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s for s in ([index[w] for w in index.keys() & set(WORD.findall(x))] for x in SENTENCES.split(t.lower())) if s] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.list_(pa.int32()))), batch.column("toxic")], names=["bag", "toxic"])

    got = sample.mapInArrow(bags, "bag array<array<int>>, toxic int").collect()
    got.sort(key=lambda r: (r["toxic"], str(r["bag"])))  # the fit does not depend on the order of tasks
    weights, bias = fit_noisy_or([r["bag"] for r in got], np.array([r["toxic"] for r in got]), len(chosen))
    return Model(index, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, locate: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; ``locate`` adds ``offending``: of predicted documents the sentences at the
    threshold or over it, or the worst one where only several together reach it (number, text, score)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = pa.list_(pa.struct([("sentence", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            scores = np.array([model.score(t) for t in texts(batch)])
            out = [batch.column(0), pa.array(scores, pa.float64())]
            if locate:
                spots = [model.offending(t, threshold) if s >= threshold else [] for t, s in zip(texts(batch), scores)]
                out.append(pa.array(spots, where))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "offending"][: len(out)])

    extra = ", offending array<struct<sentence:long,text:string,score:double>>" if locate else ""
    out = slim(docs).mapInArrow(run, "doc_id long, score double" + extra)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["offending"] if locate else []))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold; no join."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
