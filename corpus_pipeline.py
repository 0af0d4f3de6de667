"""The corpus pipeline: documents -> packed training sequences.

Stages run in order; each is written as Parquet to the shared folder and read
again as the next one's documents.  All but the last return rows of ``documents``
with its columns; the last returns the pieces of the packed sequences.

* language_id: documents without a language go (no letter, or hardly an n-gram of any profile).
* exact_dedup: of equal texts the smallest id stays.
* ngram_join: of each group of linked near duplicates the smallest id stays.
* mixing: documents are drawn so that sources, languages and topics have their
  target shares of the words; three tenths of the words (``mixing.LEAST_SHARE``)
  are kept at least, even if sources, languages or topics that are too rare for
  their target then stay below it.
* packing: documents are cut into sequences of 128 to 1024 tokens.

Defined cases: null and empty texts have no language and go in the first stage.
Rows repeated whole are one document after the second.  A null id stays with its
row and is packed under the null id; of equal texts a row with an id is preferred.
Null sources and languages are values of their own in mixing.  Columns besides
doc_id, text, lang and source are carried along, whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, language_id, mixing, ngram_join, packing
from quillspark.llm.common import materialize, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs, keep="min")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.survivors(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.survivors(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Profiles, set similarity, raking and tokenising are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
