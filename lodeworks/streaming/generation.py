"""Index generations: a Parquet folder each, and numbered manifests of which the highest counts. Readers pin a generation.

A catch-up writes a new generation from the journal's next page; a rebuild from a snapshot at a barrier and the suffix after it. Both give the same records,
because the fold to the latest version doesn't depend on order: whatever comes late or twice, a path's greatest version counts, and two different
entries of one version are an error.

Each attempt writes a folder of its own, which its manifest names. One that breaks off before its manifest leaves a folder that nothing names, and the next
attempt isn't hindered by it; sweep() deletes such folders.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.definition import Definition, Invalid
from .journal import SCHEMA

#: From the folded changes (path, version, deleted, ...) to records with source_path.
Project = Callable[[DataFrame], DataFrame]
KEEP, KEEP_SECONDS, FAN_IN = 3, 24 * 3600, 4
STALE_SECONDS = 60


@dataclass
class Generation:
    number: int
    fingerprint: str
    offsets: dict[str, int]
    folders: list[str]
    created: float = field(default_factory=time.time)


class Index:
    """The generations of one definition below a folder. A manifest is published by creating the file of its number, which fails if another writer was
    first: on HDFS and local disks atomically; on an object store only where it refuses to create what is there (a conditional put), else
    there must be one writer. The manifest is one small write, and an unreadable one counts as not published."""

    def __init__(self, spark: SparkSession, root: str, definition: Definition) -> None:
        self.spark, self.root, self.definition = spark, root.rstrip("/"), definition
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[Generation]:
        for name in reversed(self._manifests()):
            stream = self.fs.open(self.path(name))
            try:
                return [Generation(**g) for g in json.loads(bytes(stream.readAllBytes()))]
            except ValueError:  # its writer broke off
                continue
            finally:
                stream.close()
        return []

    def _manifests(self) -> list[str]:
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.root))]
        return [f"{self.root}/{n}" for n in sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))]

    def publish(self, g: Generation, before: list[Generation]) -> Generation:
        kept = retained([*before, g], time.time())
        target = self.path(f"{self.root}/manifest-{g.number:012d}.json")
        body = bytearray(json.dumps([asdict(x) for x in kept]).encode())
        there = self.generations()
        if self.fs.exists(target) and (not there or there[-1].number < g.number) and time.time() - self.fs.getFileStatus(target).getModificationTime() / 1000 > STALE_SECONDS:
            self.fs.delete(target, False)  # unreadable, and its writer is gone
        try:
            out = self.fs.create(target, False)
        except Py4JJavaError as e:
            raise OSError(f"generation {g.number} was published by another writer") from e
        out.write(body)
        out.close()
        for old in self._manifests()[:-2]:
            self.fs.delete(self.path(old), False)
        named = {f for x in kept for f in x.folders}
        for x in before:
            for f in x.folders:
                if f not in named:
                    self.fs.delete(self.path(f), True)
        return g

    def current(self) -> Generation | None:
        """None if the definition changed since: a stale generation answers nothing."""
        g = self.generations()
        return g[-1] if g and g[-1].fingerprint == self.definition.fingerprint() else None

    def read(self, number: int | None = None) -> DataFrame:
        """The live records of a pinned generation. Later folders supersede earlier ones, path by path."""
        every = self.generations()
        g = next((x for x in every if x.number == number), None) if number is not None else self.current()
        if g is None:
            raise Invalid("no such generation")
        return live_records(self.spark, g.folders)

    def _folder(self, number: int) -> str:
        return f"{self.root}/g{number}-{uuid.uuid4().hex[:12]}"

    def sweep(self, seconds: float = KEEP_SECONDS) -> list[str]:
        """Deletes folders that no retained generation names and that are older than `seconds`, so that no running attempt is hit."""
        named = {f.rpartition("/")[2] for g in self.generations() for f in g.folders}
        gone = []
        for s in self.fs.listStatus(self.path(self.root)):
            name = s.getPath().getName()
            if name.startswith("g") and s.isDirectory() and name not in named and s.getModificationTime() / 1000 <= time.time() - seconds:
                self.fs.delete(s.getPath(), True)
                gone.append(name)
        return gone

    def rebuild(self, heads: DataFrame, offsets: dict[str, int], project: Project) -> Generation:
        before = self.generations()
        n = before[-1].number + 1 if before else 1
        folder = self._folder(n)
        _write(project(heads.where(~F.col("deleted"))), heads, folder)
        return self.publish(Generation(n, self.definition.fingerprint(), offsets, [folder]), before)

    def catch_up(self, page: DataFrame, offsets: dict[str, int], project: Project) -> Generation:
        """page: journal entries with what project() needs. Writes one folder of new records and of all paths that changed."""
        g = self.current()
        if g is None:
            raise Invalid("rebuild first")
        before = self.generations()
        latest = latest_of(page)
        folder = self._folder(g.number + 1)
        _write(project(latest.where(~F.col("deleted"))), latest, folder)
        new = Generation(g.number + 1, g.fingerprint, g.offsets | offsets, [*g.folders, folder])
        return self.publish(new, before)

    def compact(self) -> Generation:
        """Merges all folders into one, in the physical order, once there are FAN_IN."""
        g = self.current()
        if g is None or len(g.folders) < FAN_IN:
            raise Invalid("nothing to compact")
        before = self.generations()
        folder = self._folder(g.number + 1)
        rows = live_records(self.spark, g.folders)
        keys = [F.col(f"`{n}`.v").desc() if down else F.col(f"`{n}`.v").asc() for n, down in self.definition.physical_order]
        if keys:  # row groups with narrow ranges of the order's first key
            rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        seen = rows.select(F.col("source_path").alias("path"), F.col("source_version").alias("version")).distinct()
        _write(rows, seen, folder)
        return self.publish(Generation(g.number + 1, g.fingerprint, g.offsets, [folder]), before)

    def follow(self, journal: str, extra: str, project: Project, checkpoint: str) -> StreamingQuery:
        """Incremental catch-up over a journal folder; extra: more columns of its schema."""
        stream = self.spark.readStream.schema(SCHEMA + extra).parquet(journal)

        def batch(df: DataFrame, _: int) -> None:
            ends = {r.source: r.n for r in df.groupBy("source").agg((F.max("offset") + 1).alias("n")).collect()}
            if ends:
                self.catch_up(df, ends, project)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _write(records: DataFrame, changed: DataFrame, folder: str) -> None:
    records.write.option("compression", "zstd").parquet(f"{folder}/records")
    changed.select("path", "version").write.parquet(f"{folder}/changed")


def latest_of(page: DataFrame) -> DataFrame:
    """The entry of the greatest version of each path. Repeated entries are one; different ones of one version are an error, whichever is greatest."""
    rest = [c for c in page.columns if c not in ("path", "source", "offset")]
    print_ = F.xxhash64(*rest)
    one = page.groupBy("path", "version").agg(F.first(F.struct(*rest)).alias("r"), F.min(print_).alias("_a"), F.max(print_).alias("_b"))
    fault = F.raise_error(F.concat(F.lit("entries differ at one version of "), "path"))
    sound = one.select("path", F.when(F.col("_a") == F.col("_b"), F.col("r")).otherwise(fault).alias("r"))
    return sound.groupBy("path").agg(F.max_by("r", "r.version").alias("r")).select("path", "r.*")


def live_records(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The records of each path's greatest version over all folders, in whatever order these came; of a version in several folders, those of the last."""
    parts = [spark.read.parquet(f"{f}/records").withColumn("_n", F.lit(i)) for i, f in enumerate(folders)]
    if len(folders) == 1:
        return parts[0].drop("_n")
    changed = [spark.read.parquet(f"{f}/changed").select(F.col("path").alias("source_path"), F.col("version").alias("_v"), F.lit(i).alias("_c")) for i, f in enumerate(folders)]
    rows, seen = parts[0], changed[0]
    for p, c in zip(parts[1:], changed[1:], strict=True):
        rows, seen = rows.unionByName(p), seen.unionByName(c)
    last = seen.groupBy("source_path").agg(F.max(F.struct("_v", "_c")).alias("_l"))
    return rows.join(last, "source_path").where((F.col("source_version") == F.col("_l._v")) & (F.col("_n") == F.col("_l._c"))).drop("_n", "_l")


def retained(every: list[Generation], now: float) -> list[Generation]:
    """The newest KEEP, and older ones only while they are younger than KEEP_SECONDS and among twice as many."""
    return [g for i, g in enumerate(reversed(every)) if i < KEEP or (now - g.created < KEEP_SECONDS and i < 2 * KEEP)][::-1]
