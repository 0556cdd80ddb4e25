"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes as Parquet and reads again as the next stage's docs. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import decontamination, near_copies, packing, secrets, toxicity
from tapeloom.llm.common import crc_fold, discard, materialize, scratch
from tapeloom.llm.registry import byte_bpe_path, prepare, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    prepare(spark)
    model = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"), crc_fold("doc_id", 5) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more) stays."""
    prepare(spark)
    return near_copies.one_per_copy_group(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced; every document stays."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows, with their ids."""
    prepare(spark)
    return packing.pack_documents(docs, byte_bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Trained scores, XXH64 fingerprints and byte-level BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that remain of ``documents`` after all stages."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch():  # what a stage wrote on its way goes once its result stands
            docs = materialize(stage(spark, before, sf_dir), f"pipeline-{name}", keep=True)
        if name != STAGES[0][0]:
            discard(before)
    return docs
