"""Change feeds: journal pages, prefix watches, vector checkpoints, settled offsets; batch and Structured Streaming forms.

journal: source, offset, path, version, deleted. Offsets are ordered within a source; there is no order between sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import below, reserved
from ..plans.definition import Invalid

PAGE = 1024
SCHEMA = "source string, offset long, path string, version long, deleted boolean"


def invalidations(journal: DataFrame, prefix: str) -> DataFrame:
    """What a watcher of a prefix is told: address, least version, present or deleted."""
    seen = journal.where(below(F.col("path"), prefix) & ~reserved(F.col("path")))
    return seen.select("source", "offset", "path", F.col("version").alias("minimum_version"), F.when(F.col("deleted"), "deleted").otherwise("present").alias("hint"))


def settled(journal: DataFrame) -> DataFrame:
    """(source, settled): the end of the unbroken run of offsets from each source's first, which is the least offset without a successor. An anti join by
    source and offset, so a source spreads over all tasks."""
    held = journal.select("source", "offset").distinct()
    before = held.select("source", (F.col("offset") - 1).alias("offset"))
    return held.join(before, ["source", "offset"], "left_anti").groupBy("source").agg(F.min("offset").alias("settled"))


def start_checkpoint(journal: DataFrame, start: str, token: dict[str, int] | None = None) -> dict[str, int]:
    """Next offset per source. now: after what is settled; beginning: the first retained; resume: the token, unless retention passed it. One row per source."""
    state = {r.source: r for r in journal.groupBy("source").agg(F.min("offset").alias("first"), F.max("offset").alias("last")).join(settled(journal), "source").collect()}
    if start == "now":
        return {s: r.settled + 1 for s, r in state.items()}
    if start == "beginning":
        return {s: r.first for s, r in state.items()}
    if token is None or set(token) != set(state):
        raise Invalid("a checkpoint must name every source")
    if any(token[s] < r.first for s, r in state.items()):
        raise Invalid("resume expired")
    return dict(token)


def page(journal: DataFrame, checkpoint: DataFrame, size: int = PAGE) -> DataFrame:
    """The next size settled entries of each source after its checkpoint (source, next). Filters come later, so unrelated entries move the cursor too."""
    if not 1 <= size <= PAGE:
        raise Invalid(f"a page has 1 to {PAGE} entries")
    bounded = journal.join(F.broadcast(checkpoint), "source").join(F.broadcast(settled(journal)), "source")
    return bounded.where((F.col("offset") >= F.col("next")) & (F.col("offset") < F.col("next") + size) & (F.col("offset") <= F.col("settled"))).drop("next", "settled")


def advanced(page_: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(source, next) after a page."""
    ends = page_.groupBy("source").agg((F.max("offset") + 1).alias("_end"))
    return checkpoint.join(ends, "source", "left").select("source", F.coalesce("_end", "next").alias("next"))


def freshness(journal: DataFrame, indexed: DataFrame) -> DataFrame:
    """(source, indexed_next_offset, observed_tail, lag); indexed: source, next."""
    tails = journal.groupBy("source").agg((F.max("offset") + 1).alias("observed_tail"))
    told = tails.join(indexed, "source", "left").select("source", F.coalesce("next", F.lit(0)).alias("indexed_next_offset"), "observed_tail")
    return told.withColumn("lag", F.col("observed_tail") - F.col("indexed_next_offset"))


def watch(spark: SparkSession, path: str, prefix: str, sink, checkpoint: str, files: int = 1) -> StreamingQuery:
    """Follows a journal folder. The stream's offset log is the vector checkpoint; sink(df, batch) sees each batch's invalidations, at least once."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return invalidations(stream, prefix).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retention(journal: DataFrame, consumers: DataFrame, most: int) -> DataFrame:
    """consumers: source, next (of what must not be lost). (source, floor, blocked): the floor that would keep the newest most entries, lowered to the slowest consumer;
    blocked, if that keeps more than most, so writers have to wait."""
    tails = journal.groupBy("source").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    slow = consumers.groupBy("source").agg(F.min("next").alias("slow"))
    want = F.greatest("first", F.col("last") - most + 1)
    return tails.join(slow, "source", "left").select("source", F.least(want, F.coalesce("slow", want)).alias("floor"), F.coalesce(F.col("slow") < want, F.lit(False)).alias("blocked"))
