"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, sampled piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's result is written as Parquet and read
again as the next one's docs, so a lost executor repeats part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import decontamination, line_dedup, minhash_dedup, piece_sampling, quality_rules
from lodeworks.llm.common import materialize, read

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("minhash_dedup", minhash_dedup.stage),
    ("decontamination", decontamination.stage),
    ("piece_sampling", piece_sampling.stage),
]

#: Line chunks, minhashes and lattices aren't SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
