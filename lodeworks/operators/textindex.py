"""Persisted postings: term statistics, blocks of alike impact, and BM25 queries that read only their terms' postings.

Below a folder lie four tables. fields: records that have a field, and their mean length. postings: one row per record, field and term with frequency, length,
places, impact and block, range-partitioned and sorted by field, term and block, so that Parquet's statistics prune a query's scan to its terms. blocks: per field, term and
block how many postings there are and their greatest impact; these rows say a term's document frequency too. A block is a sixteenth of the range of impacts, not a number of rows, so
that no term's postings are ordered in one task.

A query for the best k first scores the records in its terms' best blocks. Their k-th score is a bound: a posting whose block's greatest impact, with
the greatest of all other terms, doesn't reach it can't belong to a hit, and its block isn't read. The hits and scores are those of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.definition import Invalid
from . import projection
from .projection import IDENTITY
from .search import K1, B, page_size, ranked, text_query

BLOCKS = 16


def write(records: DataFrame, fields: Sequence[str], path: str) -> None:
    """records: IDENTITY and token arrays."""
    spark = records.sparkSession
    length = lambda f: F.size(F.filter(f, lambda t: t != ""))
    row = records.agg(*(c for f in fields for c in (F.count_if(F.col(f).isNotNull()).alias(f"n_{f}"), F.coalesce(F.sum(length(f)), F.lit(0)).alias(f"l_{f}")))).first()
    stats = [(f, row[f"n_{f}"], max(row[f"l_{f}"] / max(row[f"n_{f}"], 1), 1.0)) for f in fields]
    spark.createDataFrame(stats, "field string, n long, mean double").write.parquet(f"{path}/fields")
    each = projection.postings(records, list(fields)).groupBy(*IDENTITY, "field", "term").agg(F.count("*").alias("frequency"), F.max("norm").alias("norm"), F.sort_array(F.collect_list("position")).alias("places"))
    mean = F.element_at(F.create_map(*(x for f, _, m in stats for x in (F.lit(f), F.lit(m)))), F.col("field"))
    tf = F.col("frequency").cast("double")
    each = each.withColumn("impact", tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("norm") / mean)))
    each = each.withColumn("block", F.least(F.lit(BLOCKS - 1), F.floor(F.col("impact") * BLOCKS / (K1 + 1))).cast("int"))
    keys = ["field", "term", "block"]
    each.repartitionByRange(*keys, "result_path").sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    blocks = written.groupBy(*keys).agg(F.count("*").alias("n"), F.max("impact").alias("top"))
    blocks.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/blocks")


class TextIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.fields = {r.field: (r.n, r.mean) for r in spark.read.parquet(f"{path}/fields").collect()}

    def _blocks(self, fields: Sequence[str], tokens: Sequence[str]) -> dict[tuple[str, str], dict[int, tuple[int, float]]]:
        """At most BLOCKS rows a field and token."""
        rows = self.spark.read.parquet(f"{self.path}/blocks").where(F.col("field").isin(*fields) & F.col("term").isin(*tokens)).collect()
        out: dict[tuple[str, str], dict[int, tuple[int, float]]] = {}
        for r in rows:
            out.setdefault((r.field, r.term), {})[r.block] = (r.n, r.top)
        return out

    def _scored(self, lists: dict[tuple[str, str], int], weights: dict[tuple[str, str], float], tokens: Sequence[str]) -> DataFrame:
        """IDENTITY and score of the records that have every token in some field, from postings of the given least block of each field and term."""
        p = self.spark.read.parquet(f"{self.path}/postings")
        keep, weight = F.lit(False), F.lit(None).cast("double")
        for (f, t), least in lists.items():
            mine = (F.col("field") == f) & (F.col("term") == t)
            keep, weight = keep | (mine & (F.col("block") >= least)), F.when(mine, weights[f, t]).otherwise(weight)
        # each token's terms are distinct rows; a repeated token weighs twice in its weight
        hit = p.where(keep).select(*IDENTITY, "term", (weight * F.col("impact")).alias("s"))
        return hit.groupBy(*IDENTITY).agg(F.sum("s").alias("score"), F.count_distinct("term").alias("_have")).where(F.col("_have") == len(set(tokens))).drop("_have")

    def search(self, fields: Sequence[str], text: str, limit: int = 0, prune: bool = True) -> DataFrame:
        """The best hits of all tokens, each in any field: IDENTITY and score, best first."""
        tokens, k = text_query(text), page_size(limit)
        if not set(fields) <= set(self.fields):
            raise Invalid("no such field in the index")
        blocks = self._blocks(fields, tokens)
        weights, tops = {}, {}
        for (f, t), levels in blocks.items():
            df, n = sum(c for c, _ in levels.values()), self.fields[f][0]
            weights[f, t] = math.log(1 + max(n - df + 0.5, 0.0) / (df + 0.5)) * sum(x == t for x in tokens)
            tops[f, t] = weights[f, t] * max(top for _, top in levels.values())
        least = dict.fromkeys(blocks, 0)
        if prune and blocks:
            least = self.needed(blocks, weights, tops, tokens, k)
        return ranked(self._scored(least, weights, tokens), limit)

    def needed(self, blocks: dict, weights: dict, tops: dict, tokens: Sequence[str], k: int) -> dict[tuple[str, str], int]:
        """The least block of each field and term that a hit among the best k can have."""
        best = {}
        for key, levels in blocks.items():
            seen = 0
            for level in sorted(levels, reverse=True):
                seen += levels[level][0]
                best[key] = level
                if seen >= 16 * k:
                    break
        found = self._scored(best, weights, tokens).orderBy(F.col("score").desc()).limit(k).select("score").collect()
        if len(found) < k:
            return dict.fromkeys(blocks, 0)
        bound = found[-1].score * (1 - 1e-6)  # scores are compared in single precision
        every = sum(tops.values())
        out = {}
        for key, levels in blocks.items():
            able = [level for level, (_, top) in levels.items() if every - tops[key] + weights[key] * top >= bound]
            out[key] = min(able, default=BLOCKS)
        return out

    def phrase(self, field: str, text: str) -> DataFrame:
        """IDENTITY of the records in which the tokens follow one another in the field."""
        tokens = text_query(text)
        p = self.spark.read.parquet(f"{self.path}/postings").where((F.col("field") == field) & F.col("term").isin(*tokens))
        place = [F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"p{i}") for i, t in enumerate(tokens)]
        rows = p.groupBy(*IDENTITY).agg(*place)
        back = lambda i: F.transform(f"p{i}", lambda x: x - i)
        starts = reduce(F.array_intersect, (back(i) for i in range(1, len(tokens))), F.col("p0"))
        return rows.where(F.size(F.coalesce(starts, F.array().cast("array<int>"))) > 0).select(*IDENTITY)
