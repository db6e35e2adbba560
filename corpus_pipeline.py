"""A corpus pipeline: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next stage's documents.  All but the last return the columns of ``documents``.

``TARGETS`` is the mix that the corpus is meant to have, whatever the stages before leave: one token in a hundred of low
quality (of what the first stage lets pass) and three of toxic text, so that what learns from the corpus meets some.  Text
that a domain lacks is repeated, text that it has too much of is thinned out, by rates without bounds; ``mixing.solve``
reports the shares that are reached, and warns of those that can't be.

Results for odd input (each stage's operator states its own): null and empty texts are scored like empty ones, and if
they stay are one document of one end id; rows that repeat an id are rows like all others; of equal texts, and of near
ones, one row stays, ties to the smaller id, null ids last; very long texts are read whole by every stage; an empty table
gives no sequences; further columns go along, whatever their names, up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import exact_dedup, minhash_dedup, mixing, packing, quality
from codeloom.llm._common import cleaned, discard, shared_folder, table
from codeloom.llm.queries import tokenizer_path

TARGETS = {"high": 0.96, "low": 0.01, "toxic": 0.03}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, table(spark, sf_dir, "labels"), tokenizer_path("json"), TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("json"))


STAGES = [("quality classifier", good_quality), ("exact dedup", no_copies), ("MinHash near-dedup", no_near_copies), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the classifier nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what they save on the way is deleted as soon as the next one's documents are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        with cleaned(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
