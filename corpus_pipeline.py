"""A training-data pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes what
each returns as Parquet in the shared folder and reads it again. What a stage itself stored, and the
output of the stage before, are deleted once its output is written.

Defined cases: a null text, or one without letters, has no language and goes in the first stage; an empty
text goes with it; texts of any length are read whole; of rows that repeat a doc_id and a text one stays;
rows with one doc_id and different texts are different documents; a null doc_id is less than any other in
exact dedup, its row is kept once per text by near dedup, and counts as the largest in substring dedup; a
text all of whose words go stays as an empty text, and packs as its end token; an empty table gives an empty
table; columns beyond doc_id and text are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import exact, langid, packing, resemblance, simhash, substrings
from pagequarry.llm.common import discard, scope, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without letters or with no clear language go."""
    return langid.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id."""
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, and then of verified near copies, the row with the smallest doc_id."""
    return resemblance.deduplicate(simhash.deduplicate(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that start in an earlier document too."""
    return substrings.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, with the ids, in sequences of 4096."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: The stages hold a trained network, fingerprints and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        keep: list[DataFrame] = []
        with scope(keep):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(docs)
        discard(last)
        last = docs
    return docs
