"""A corpus pipeline of five stages over ``documents``; each writes Parquet that the next one reads.

1. quality rules: documents that the default policy rejects go;
2. toxicity: documents predicted toxic go (the model learns from the labels of documents still here);
3. SimHash near-duplicates: the links of operator 10 (fingerprints that differ in two bits at most), and beside
   them those that lie too far apart for it (Jaccard of five-word shingles 0.8 or more, found by minimum hashes and
   verified); of each group that the links of both make, the document with the smallest id stays;
4. substring dedup: passages of 50 words and more that a smaller id has are cut from the text;
5. packing: what is left is packed into sequences of 2048 tokens.

A stage sees everything its predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import nearcopies, packing, quality, simhash, substring, toxicity
from plumbline.llm.common import table, written
from plumbline.llm.queries import _tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs).select(*COLUMNS)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.one_of_each(docs, simhash.groups(docs)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.word_bpe(_tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]
#: Tokenizers and a trained model have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
