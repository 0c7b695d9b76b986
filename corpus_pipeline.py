"""Corpus pipeline: documents through quality rules to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
result is written as Parquet into the shared checkpoint folder and read again. All
stages but the last return the columns of ``documents``. A stage's own intermediate
tables go when the next stage starts, its input when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewatt.llm import ngram_join, packing, quality_rules, secret_scan, suffix_dedup
from sitewatt.llm.common import documents, drop_table, materialize

STAGES = [
    ("quality_rules", quality_rules.stage),    # rejected documents go
    ("ngram_join", ngram_join.stage),          # one document of each group stays
    ("suffix_dedup", suffix_dedup.stage),      # repeated strings are cut out
    ("secret_scan", secret_scan.stage),          # secrets are masked
    ("packing", packing.stage),                # sequences of tokens
]

#: No SQL expresses suffix arrays, compression novelty and packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            if before is not None:  # the stage's result is written: nothing reads its input any more
                drop_table(before)
            before = docs
    return docs
