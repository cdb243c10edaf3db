"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, license_scan, line_dedup, lm_scoring, minhash_dedup, piece_sampling, quality_rules, suffix_dedup, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_warc": warc.op6_warc,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_piece_sampling": piece_sampling.op9_piece_sampling,
    "op10_license_scan": license_scan.op10_license_scan,
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_decontamination": decontamination.OP2_SQL,
    "op5_minhash_dedup": minhash_dedup.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_suffix_dedup": suffix_dedup.OP7_SQL,
    "op8_url_filters": url_filters.OP8_SQL,
}
