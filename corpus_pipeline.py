"""A training corpus from ``documents``: language, near duplicates, secrets, mix, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoanswers.llm import common, op1_minhash, op5_packing, op7_language, op8_secrets, op10_mixing

#: (name, function of (spark, docs, sf_dir)); each works on all that its predecessor kept.
STAGES = [
    ("language_id", op7_language.stage),
    ("minhash_near_dedup", op1_minhash.stage),
    ("secret_scans", op8_secrets.stage),
    ("source_mixing", op10_mixing.stage),
    ("best_fit_packing", op5_packing.stage),
]
#: No SQL expresses the string kernel, the sketches or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the shared folder and read again; returns the pieces of packed documents
    (where each piece stands in which sequence; ids are encoded again where sequences are written). What a stage has written on
    its way, and its predecessor's rows, go when its own rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.Scratch(spark) as own:
        for name, stage in STAGES:
            rows = stage(spark, docs, sf_dir)
            last = own.mark()
            docs = common.stored(rows, name)
            own.discard(last)
    return docs
