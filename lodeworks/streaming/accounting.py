"""Usage accounting: baselines, incremental deltas, traffic by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import ancestors
from ..plans.definition import Invalid


def by_prefix(rows: DataFrame, definitions: DataFrame, **sums: str) -> DataFrame:
    """(prefix, sums): rows (path, ...) summed up for every definition (prefix) that is an ancestor of the path. Ancestors are exploded and summed up first, with
    partial sums in each task, so the prefix of everything is no hot key; then definitions are an equi join."""
    every = rows.withColumn("prefix", F.explode(ancestors(F.col("path")))).groupBy("prefix").agg(*(F.sum(c).cast("long").alias(n) for n, c in sums.items()))
    return every.join(definitions.select("prefix").distinct(), "prefix")


def baseline(versions: DataFrame, definitions: DataFrame) -> DataFrame:
    """(prefix, object_count, logical_bytes): live paths, and the bytes of all retained versions. Paths are summed up first, so a hot prefix gets one row per path."""
    per_path = versions.groupBy("path").agg((~F.max_by("deleted", "version")).cast("int").alias("live"), F.sum(F.coalesce("length", F.lit(0))).alias("bytes"))
    met = by_prefix(per_path, definitions, object_count="live", logical_bytes="bytes")
    zero = F.lit(0).cast("long")
    return definitions.select("prefix").distinct().join(met, "prefix", "left").select("prefix", F.coalesce("object_count", zero).alias("object_count"), F.coalesce("logical_bytes", zero).alias("logical_bytes"))


def deltas(before: DataFrame, changes: DataFrame, definitions: DataFrame) -> DataFrame:
    """What changes add to (prefix, object_count, logical_bytes). before: heads (path, version, deleted) of what was counted; changes: new versions
    (path, version, deleted, length); removed versions carry minus their length and a null version."""
    now = changes.groupBy("path").agg(F.max("version").alias("v"), F.max_by("deleted", "version").alias("gone"), F.sum(F.coalesce("length", F.lit(0))).alias("bytes"))
    old = before.select("path", (~F.col("deleted")).cast("int").alias("was"), F.col("version").alias("_old"))
    moved = now.join(old, "path", "left")
    latest = F.when(F.col("v").isNull() | (F.col("_old") > F.col("v")), F.coalesce("was", F.lit(0))).otherwise((~F.col("gone")).cast("int"))
    signed = moved.select("path", (latest - F.coalesce("was", F.lit(0))).alias("objects"), "bytes")
    return by_prefix(signed, definitions, object_count="objects", logical_bytes="bytes")


def add(totals: DataFrame, more: DataFrame) -> DataFrame:
    return totals.unionByName(more).groupBy("prefix").agg(F.sum("object_count").alias("object_count"), F.sum("logical_bytes").alias("logical_bytes"))


def traffic(flushes: DataFrame, definitions: DataFrame) -> DataFrame:
    """flushes: node, flush_id, path, inbound, outbound. A flush that is sent again counts once."""
    once = flushes.dropDuplicates(["node", "flush_id", "path"])
    per_path = once.groupBy("path").agg(F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound"))
    return by_prefix(per_path, definitions, inbound="inbound", outbound="outbound")


def flush(stream: DataFrame, totals: str, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """The traffic buffer: stream (node, flush_id, path, inbound, outbound) summed up by path each second and written as one batch of totals.
    A batch that is run again replaces what it wrote, so nothing counts twice; what a client sends twice is for traffic() to drop, before or after. every: None
    takes what is there and ends."""

    def batch(df: DataFrame, number: int) -> None:
        once = df.dropDuplicates(["node", "flush_id", "path"])
        sums = once.groupBy("node", "path").agg(F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound")).withColumn("flush_id", F.lit(number).cast("long"))
        sums.write.mode("overwrite").parquet(f"{totals}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Definitions:
    """Enabled accounting, by prefix, with a generation for compare-and-set disabling; stored in a document if one is given."""

    def __init__(self, document=None) -> None:
        self.document, self.number = document, 0
        self.rows: dict[str, int] = {}

    def _load(self) -> None:
        if self.document is not None:
            self.number, value = self.document.read()
            self.rows = dict(value or {})

    def _save(self) -> None:
        if self.document is not None:
            self.number = self.document.write(self.rows, self.number)

    def enable(self, prefix: str) -> int:
        self._load()
        if prefix not in self.rows:
            self.rows[prefix] = 1 + max(self.rows.values(), default=0)
            self._save()
        return self.rows[prefix]

    def get(self, prefix: str) -> int | None:
        self._load()
        return self.rows.get(prefix)

    def disable(self, prefix: str, generation: int) -> None:
        self._load()
        if self.rows.get(prefix) != generation:
            raise Invalid("generation")
        del self.rows[prefix]
        self._save()
