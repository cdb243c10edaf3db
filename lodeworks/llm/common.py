"""Helpers that the operators of this folder share: scratch tables, hot-key joins and batch walking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import folder

#: Groups that hold more than one row in HOT_SHARE are hot. There are fewer than HOT_SHARE of them, whatever the input.
HOT_SHARE = 1000
#: So many rows meet one copy of their group in spread_join().
SPREAD_BLOCK = 20_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (see plans.lineage). Tables stay until the folder is cleared, for later reads of lazy results."""
    return folder(spark, name)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df to a scratch table and reads it: cuts lineage, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group. Hot groups are broadcast (fewer than HOT_SHARE rows, because each
    holds more than total / HOT_SHARE), so no task gets a hot group; the others are joined by shuffle.
    Keys mustn't be null."""
    hot = F.broadcast(groups.where(F.col(count) * HOT_SHARE > F.lit(total)))
    cold = groups.where(F.col(count) * HOT_SHARE <= F.lit(total))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def spread_join(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of rows (a written table: it is read three times) with any number of groups rows a key. A key of many rows is split into blocks of SPREAD_BLOCK
    rows, each of which meets a copy of the key's groups, so that no key is one task on the side of rows. Keys mustn't be null."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_parts", F.expr(f"cast(_n div {SPREAD_BLOCK} as int) + 1"))
    counts = materialize(counts, "counts")
    split = hot_join(rows, counts, [key], "_n", rows.count()).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int")).drop("_n", "_parts")
    copies = groups.join(counts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_n", "_parts")
    return split.join(copies, [key, "_part"]).drop("_part")


def neutral(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1, ... in place of all but those to keep, so that no name can clash with a working column; and the names to restore()."""
    return docs.toDF(*(c if c in keep else f"c{i}" for i, c in enumerate(docs.columns))), docs.columns


def restore(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of neutral() under their own names and in their order; working columns go."""
    return df.select(*(F.col(f"c{i}" if f"c{i}" in df.columns else n).alias(n) for i, n in enumerate(names)))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten when there are too many."""

    def __init__(self, most: int = 400_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str, at_once: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches, in slices so that few long texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)
