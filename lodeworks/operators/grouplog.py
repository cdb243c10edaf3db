"""Hash-linked logs of groups: append by compare-and-set, chain checks, projections to other groups, catch-up.

entries: group, index (from 1), previous_hash, hash, payload. The hash of an entry is SHA-256 of its predecessor's hash, its index and payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.streams import batched, tuples
from . import authz

GENESIS = ""


def entry_hash(previous: str, index: int, payload: str) -> str:
    return hashlib.sha256(f"{previous}\0{index}\0{payload}".encode()).hexdigest()


def entry_hash_column(previous: Column, index: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("\0", previous, index.cast("string"), payload), 256)


def build_chains(items: DataFrame, group: str, order: str, payload: str) -> DataFrame:
    """Entries from ordered items. Each hash needs the one before, so a group is one fold over its sorted payloads, which stream through a task."""
    kind = items.schema[group].dataType
    schema = pa.schema([("group", to_arrow_type(kind)), ("index", pa.int64()), ("previous_hash", pa.string()), ("hash", pa.string()), ("payload", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g, rows in groupby(tuples(batches, group, payload), key=lambda r: r[0]):
            before = GENESIS
            for i, (_, p) in enumerate(rows, 1):
                now = entry_hash(before, i, p)
                yield g, i, before, now, p
                before = now

    ordered = items.select(group, order, payload).repartition(group).sortWithinPartitions(group, order, payload).select(group, F.col(payload).cast("string").alias(payload))
    return ordered.mapInArrow(lambda batches: batched(fold(batches), schema), f"group {kind.simpleString()}, index long, previous_hash string, hash string, payload string")


def append(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: group, expected_index, expected_hash, payload, one a group. outcome is appended or conflict, with the new entry's columns."""
    last = entries.groupBy("group").agg(F.max_by(F.struct("index", "hash"), "index").alias("t"))
    r = requests.join(last, "group", "left").select("*", F.coalesce("t.index", F.lit(0)).alias("_i"), F.coalesce("t.hash", F.lit(GENESIS)).alias("_h"))
    ok = (F.col("expected_index") == F.col("_i")) & (F.col("expected_hash") == F.col("_h"))
    index = F.col("_i") + 1
    return r.select("group", F.when(ok, "appended").otherwise("conflict").alias("outcome"), F.when(ok, index).alias("index"), F.when(ok, F.col("_h")).alias("previous_hash"), F.when(ok, entry_hash_column(F.col("_h"), index, F.col("payload"))).alias("hash"), F.when(ok, F.col("payload")).alias("payload"))


def chain_check(entries: DataFrame) -> DataFrame:
    """The entries whose link or hash is wrong."""
    w = Window.partitionBy("group").orderBy("index")
    linked = entries.withColumns({"_h": F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)), "_i": F.coalesce(F.lag("index").over(w), F.lit(0))})
    good = (F.col("previous_hash") == F.col("_h")) & (F.col("index") == F.col("_i") + 1) & (F.col("hash") == entry_hash_column(F.col("previous_hash"), F.col("index"), F.col("payload")))
    return linked.where(~good).drop("_h", "_i")


def project(entries: DataFrame, checkpoints: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """checkpoints: group, checkpoint. The next entries of each group, at most max_entries and max_bytes; a first one that is too large is an error."""
    w = Window.partitionBy("group").orderBy("index")
    fresh = entries.join(checkpoints, "group", "left").where(F.col("index") > F.coalesce("checkpoint", F.lit(0))).drop("checkpoint")
    cut = fresh.withColumns({"_n": F.row_number().over(w), "_b": F.sum(F.octet_length("payload")).over(w)})
    fail = F.raise_error(F.concat(F.lit("an entry is over the limit in group "), F.col("group").cast("string")))
    cut = cut.withColumn("_ok", F.when((F.col("_n") == 1) & (F.col("_b") > max_bytes), fail.cast("boolean")).otherwise((F.col("_n") <= max_entries) & (F.col("_b") <= max_bytes)))
    return cut.where("_ok").drop("_n", "_b", "_ok")


def catch_up(entries: DataFrame, group, index: int, hash_: str, max_bytes: int) -> DataFrame:
    """Frames after (index, hash) of one group; the hash must be that of the entry."""
    mine = entries.where(F.col("group") == group)
    if index:
        known = mine.where((F.col("index") == index) & (F.col("hash") == hash_)).take(1)
        if not known:
            from ..plans.definition import Invalid

            raise Invalid("unknown position")
    w = Window.partitionBy("group").orderBy("index")
    return mine.where(F.col("index") > index).withColumn("_b", F.sum(F.octet_length("payload")).over(w)).where(F.col("_b") <= max_bytes).drop("_b").orderBy("index")


def describe(entries: DataFrame, kinds: DataFrame) -> DataFrame:
    """kinds: group, kind (source, projection or standalone). Every group with its tail; groups without entries too."""
    tail = entries.groupBy("group").agg(F.count("*").alias("entries"), F.max_by(F.struct("index", "hash"), "index").alias("t"))
    return kinds.join(tail, "group", "left").select("group", "kind", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("t.index", F.lit(0)).alias("index"), F.coalesce("t.hash", F.lit(GENESIS)).alias("hash"))


def read_snapshot(snapshots: DataFrame, group, offset: int, length: int) -> DataFrame:
    """snapshots: group, index, body (binary). A piece of a group's newest snapshot; offsets count from 0."""
    mine = snapshots.where(F.col("group") == group)
    newest = mine.groupBy("group").agg(F.max_by(F.struct("index", "body"), "index").alias("s"))
    return newest.select("group", "s.index", F.substring("s.body", offset + 1, length).alias("piece"), F.octet_length("s.body").alias("size"))


ROLES = ("reader", "writer", "admin")


def change_roles(tuples: DataFrame, changes: DataFrame, revision: int) -> DataFrame:
    """changes: group, role, subject_namespace, subject_id, grant (false: revoke). The relationship tuples after one batch of grants and revocations, a revocation of
    what the same batch grants coming first; a role that isn't one is an error. Groups are objects of the namespace group_log."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("no role "), "role")))
    rows = changes.select(
        F.lit("group_log").alias("namespace"), F.col("group").cast("string").alias("id"), role.alias("relation"), "subject_namespace", "subject_id", F.lit(None).cast("string").alias("subject_relation"), "grant"
    )
    return authz.mutate(tuples, rows.where("grant").drop("grant"), rows.where("not grant").drop("grant"), revision)


def role_schema() -> authz.Schema:
    """Administrators write, writers read."""
    users = authz.Direct((authz.Selector("object", "principal"),))
    roles = {"reader": users, "writer": users, "admin": users, "administer": authz.Permission((authz.Inherit("admin"),))}
    roles |= {"write": authz.Permission((authz.Inherit("writer"), authz.Inherit("administer"))), "read": authz.Permission((authz.Inherit("reader"), authz.Inherit("write")))}
    return authz.Schema({"principal": {}, "group_log": roles}).compile()
