"""Documents made ready for training, in five stages; each reads what the one before kept.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. run() writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, minhash, packing, pii, toxicity
from foliospark.llm.common import Workspace, release, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that operator 6 predicts to be toxic."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id: similarity of 0.8 over shingles of five words.

    Operator 1's fingerprints and vantage-point shards give the close pairs. At 0.8 fingerprints differ by 10 bits of 64 on
    average, where such a tree has nothing to prune; pairs that it leaves out are found by minima of the shingles' hash
    values and by rare shingles. Each link is verified (README).
    """
    return minhash.deduplicated(docs, shingle=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that repeat ten words of a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A trained classifier and token ids: SQL can't express them; tests hold the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        # What the stage kept for itself is not needed once its result is written.
        release(ws)
    return docs
