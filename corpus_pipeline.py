"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import benchmarks, languages, mixing, simhash, substrings
from spanloom.runtime import ensure_checkpoint_dir, remove_folder

STAGES = [
    ("language_id", languages.stage),
    ("simhash_near_dedup", simhash.stage),
    ("substring_dedup", substrings.stage),
    ("benchmark_decontamination", benchmarks.stage),
    ("source_mixing", mixing.stage),
]

#: SimHash components and recompression are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's rows are deleted once the next one's are written.

    Null texts and texts without a letter go in the first stage, so none reaches the others; of repeated rows one
    stays; documents with a null id are kept by near-dedup and left whole by substring dedup; ties go to the
    least id; empty tables give an empty result; only the columns of documents are read, whatever else is there.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove_folder(spark, f"{base}/{before}")
        before = name
    return docs
