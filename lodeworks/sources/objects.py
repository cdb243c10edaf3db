"""The object log: versions, heads, reads, lists and mutations.

versions: path, version, deleted, content_type, length, hash (and body where it is inline). A head is the latest version of a path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import below, reserved
from ..functions.streams import batched, tuples
from ..plans.definition import Invalid

LIST_DEFAULT, LIST_MAX, BATCH_MAX = 100, 1000, 1000


def heads(versions: DataFrame) -> DataFrame:
    """The latest version of each path. One hash aggregation with partial results; no window."""
    return versions.groupBy("path").agg(F.max_by(F.struct(*(c for c in versions.columns if c != "path")), "version").alias("h")).select("path", "h.*")


def list_objects(heads_: DataFrame, prefix: str = "", start_after: str = "", limit: int = LIST_DEFAULT) -> DataFrame:
    """Live, visible paths in byte order, one more than limit at most: the extra one says that there is more."""
    if not 1 <= limit <= LIST_MAX:
        raise Invalid(f"limit is 1 to {LIST_MAX}")
    live = heads_.where(~F.col("deleted") & ~reserved(F.col("path")))
    if prefix:
        live = live.where(F.col("path").startswith(prefix))
    if start_after:
        live = live.where(F.col("path") > start_after)
    return live.orderBy("path").limit(limit + 1)


def merge_lists(pages: Sequence[DataFrame], limit: int) -> DataFrame:
    """Pages of disjoint owners as one; a path with two owners is an error."""
    every = pages[0]
    for p in pages[1:]:
        every = every.unionByName(p)
    one = every.groupBy("path").agg(F.count("*").alias("owners"))
    safe = F.when(F.col("owners") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("two owners of "), F.col("path"))))
    return one.select(safe.alias("path")).orderBy("path").limit(limit)


def head_state(keys: DataFrame, heads_: DataFrame) -> DataFrame:
    """keys (path): present, deleted or never_existed, and the head's version."""
    h = heads_.select("path", "version", "deleted")
    state = F.when(F.col("version").isNull(), "never_existed").when(F.col("deleted"), "deleted").otherwise("present")
    return keys.join(h, "path", "left").select("path", state.alias("state"), "version")


def get_object(versions: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """The current or an exact retained version; nothing if it is a tombstone."""
    mine = versions.where(F.col("path") == path)
    row = heads(mine) if version is None else mine.where(F.col("version") == version)
    return row.where(~F.col("deleted"))


def batch_get(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: ordinal, path, version (null: current). One outcome each, in order. More than BATCH_MAX are refused, all of them, before anything is
    read; so what is broadcast is bounded."""
    rows = requests.limit(BATCH_MAX + 1).collect()
    if len(rows) > BATCH_MAX:
        raise Invalid(f"a batch has at most {BATCH_MAX} requests")
    asked = F.broadcast(requests.sparkSession.createDataFrame(rows, requests.schema))
    mine = versions.join(F.broadcast(asked.select("path").distinct()), "path", "left_semi")
    current = heads(mine).select("path", F.col("version").alias("_now"), F.col("deleted").alias("_gone"))
    kept = mine.select("path", "version", F.col("deleted").alias("_tomb"), "length")
    r = asked.withColumnRenamed("version", "_want").join(current, "path", "left")
    r = r.withColumn("version", F.coalesce("_want", "_now")).join(kept, ["path", "version"], "left")
    outcome = F.when(F.col("_tomb").isNull(), "not_found").when(F.col("_tomb"), "deleted").otherwise("found")
    return r.select("ordinal", "path", F.when(outcome == "found", F.col("version")).alias("version"), outcome.alias("outcome"), F.when(outcome == "found", F.col("length")).alias("length")).orderBy("ordinal")


def list_versions(versions: DataFrame, path: str, versioned: bool = True) -> DataFrame:
    if not versioned:
        raise Invalid("the bucket isn't versioned")
    return versions.where(F.col("path") == path).orderBy("version")


def snapshot_scan(journal: DataFrame, prefix: str, barrier: int) -> DataFrame:
    """Current live heads of a scope as of an offset: what a rebuild reads."""
    now = journal.where((F.col("offset") <= barrier) & below(F.col("path"), prefix) & ~reserved(F.col("path")))
    return heads(now).where(~F.col("deleted"))


def retained_scan(versions: DataFrame) -> DataFrame:
    """Every version with its path's head beside it, sorted by path and version within partitions. The heads are an aggregation with partial results, and a join, which
    AQE splits where a path has very many versions."""
    h = heads(versions.select("path", "version", "deleted")).select("path", F.col("version").alias("head_version"), F.col("deleted").alias("head_deleted"))
    return versions.join(h, "path").sortWithinPartitions("path", "version")


# --- mutations -----------------------------------------------------------------------------------------------------------
OPS = ("put", "put_if_absent", "put_if_version", "put_immutable", "delete", "delete_if_version", "delete_version")
OUTCOME = "ordinal long, path string, command_id string, outcome string, version long, replayed boolean, writes_version long, deleted boolean, length long, hash string, removes_version long"
_OUTCOMES = pa.schema(
    [("ordinal", pa.int64()), ("path", pa.string()), ("command_id", pa.string()), ("outcome", pa.string()), ("version", pa.int64()), ("replayed", pa.bool_()), ("writes_version", pa.int64()), ("deleted", pa.bool_()), ("length", pa.int64()), ("hash", pa.string()), ("removes_version", pa.int64())]
)
_SEQUENCE = ["path", "_op", "ordinal", "op", "expected", "version", "deleted", "length", "hash", "command_id"]


def check_policy(immutable: Sequence[str], program_only: Sequence[str]) -> None:
    """At most 64 prefixes of a kind, sorted and disjoint."""
    for prefixes in (immutable, program_only):
        if len(prefixes) > 64 or list(prefixes) != sorted(set(prefixes)):
            raise Invalid("prefixes must be at most 64, sorted and different")
        if any(b == a or b.startswith(a + "/") for a, b in zip(prefixes, prefixes[1:], strict=False)):
            raise Invalid("prefixes overlap")


def _covered(path: str, prefixes: Sequence[str]) -> bool:
    return any(path == p or path.startswith(p + "/") for p in prefixes)


def fold_path(rows: Iterable[dict], state: list[dict], immutable: Sequence[str], program_only: Sequence[str], versioned: bool) -> Iterator[dict]:
    """Operations on one path, sorted by ordinal, later ones seeing earlier ones. state: retained versions, oldest first."""
    kept = {s["version"]: s for s in state}
    receipts: dict[str, tuple] = {}
    for r in rows:
        head = kept[max(kept)] if kept else None
        live = head is not None and not head["deleted"]
        out = dict(ordinal=r["ordinal"], path=r["path"], command_id=r["command_id"], outcome="ok", version=None, replayed=False, writes_version=None, deleted=None, length=None, hash=None, removes_version=None)
        same = (r["op"], r["expected"], r["hash"], r["length"])
        op, fail = r["op"], None
        if r["command_id"] is not None and r["command_id"] in receipts:
            old, before = receipts[r["command_id"]]
            yield out | ({"outcome": before["outcome"], "version": before["version"], "replayed": True} if old == same else {"outcome": "command_conflict"})
            continue
        if _covered(r["path"], program_only):
            fail = "program_only"
        elif _covered(r["path"], immutable) and op != "put_immutable":
            fail = "immutable"
        elif op == "put_immutable" and not _covered(r["path"], immutable):
            fail = "not_immutable_prefix"
        elif op == "put_if_absent" and live:
            fail = "exists"
        elif op in ("put_if_version", "delete_if_version") and (head["version"] if head else None) != r["expected"]:
            fail = "version_mismatch"
        elif op == "delete_version" and not versioned:
            fail = "not_versioned"
        elif op == "put_immutable" and live:
            if head["hash"] == r["hash"] and head["length"] == r["length"]:
                out |= {"version": head["version"], "replayed": True}
            else:
                fail = "immutable"
        elif op == "delete_version":
            target = kept.get(r["expected"])
            if target is None:
                out["outcome"] = "not_deleted"
            elif target is head and head["deleted"]:
                fail = "current_tombstone"
            else:
                out["removes_version"] = r["expected"]
                if target is head:
                    kept[r["version"]] = new = {"version": r["version"], "deleted": True, "hash": None, "length": None}
                    out |= {"version": r["version"], "writes_version": r["version"], "deleted": True}
                del kept[r["expected"]]
        elif op in OPS:
            gone = op.startswith("delete")
            kept[r["version"]] = new = {"version": r["version"], "deleted": gone, "hash": None if gone else r["hash"], "length": None if gone else r["length"]}
            out |= {"version": new["version"], "writes_version": new["version"], "deleted": gone, "length": new["length"], "hash": new["hash"]}
        else:
            fail = "unknown_operation"
        if fail:
            out |= {"outcome": fail, "version": head["version"] if head else None}
        elif r["command_id"] is not None:
            receipts[r["command_id"]] = (same, out)
        yield out


def bulk_write(ops: DataFrame, versions: DataFrame, immutable: Sequence[str] = (), program_only: Sequence[str] = (), versioned: bool = True) -> DataFrame:
    """ops: ordinal, path, op, expected, version (new, supplied by the log), length, hash, command_id. One outcome each. Operations meet only the versions of their own
    paths; a path's operations are one sequential fold, and paths are independent, so this spreads over paths. A task streams its paths one after the
    other and holds the retained versions of one. writes_version and removes_version say what to do to the log."""
    check_policy(immutable, program_only)
    names = [f.name for f in _OUTCOMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows in groupby((dict(zip(_SEQUENCE, r, strict=True)) for r in tuples(batches, *_SEQUENCE)), key=lambda r: r["path"]):
            state: list[dict] = []
            first = None
            for first in rows:
                if first["_op"]:
                    break
                state.append(first)
            if first["_op"]:
                for out in fold_path(chain([first], rows), state, immutable, program_only, versioned):
                    yield tuple(out[n] for n in names)

    none = lambda kind: F.lit(None).cast(kind)
    touched = versions.join(ops.select("path").distinct(), "path", "left_semi")
    before = touched.select("path", F.lit(False).alias("_op"), F.col("version").alias("ordinal"), none("string").alias("op"), none("long").alias("expected"), "version", "deleted", "length", "hash", none("string").alias("command_id"))
    now = ops.select("path", F.lit(True).alias("_op"), "ordinal", "op", "expected", "version", none("boolean").alias("deleted"), "length", "hash", "command_id")
    ordered = before.unionByName(now).repartition("path").sortWithinPartitions("path", "_op", "ordinal")
    return ordered.mapInArrow(lambda batches: batched(run(batches), _OUTCOMES), OUTCOME)


def apply_outcomes(versions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The log after a bulk write."""
    cols = ["path", "version", "deleted", "length", "hash"]
    new = outcomes.where("writes_version is not null").select("path", F.col("writes_version").alias("version"), "deleted", "length", "hash")
    gone = outcomes.where("removes_version is not null").select("path", F.col("removes_version").alias("version"))
    return versions.select(*cols).unionByName(new).join(gone, ["path", "version"], "left_anti")


# simple mutations over whole tables, without Python: each path has one operation
def put(ops: DataFrame) -> DataFrame:
    return ops.select("path", "version", F.lit(False).alias("deleted"), "length", "hash")


def put_if_absent(ops: DataFrame, heads_: DataFrame) -> DataFrame:
    return put(ops.join(heads_.where(~F.col("deleted")).select("path"), "path", "left_anti"))


def put_if_version(ops: DataFrame, heads_: DataFrame) -> DataFrame:
    """A tombstone's version counts too."""
    now = heads_.select("path", F.col("version").alias("expected"))
    return put(ops.join(now, ["path", "expected"], "left_semi"))


def delete(ops: DataFrame) -> DataFrame:
    none = F.lit(None)
    return ops.select("path", "version", F.lit(True).alias("deleted"), none.cast("long").alias("length"), none.cast("string").alias("hash"))


def replayed_once(ops: DataFrame) -> DataFrame:
    """(path, command_id, ordinal, conflict): the first of each command, and whether a later one differs from it."""
    print_ = F.sha2(F.concat_ws("\0", "op", F.coalesce(F.col("hash"), F.lit("")), F.coalesce(F.col("expected").cast("string"), F.lit(""))), 256)
    return ops.withColumn("_p", print_).groupBy("path", "command_id").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("sent"), (F.min("_p") != F.max("_p")).alias("conflict"))


def policy_class(path: Column, immutable: Sequence[str], program_only: Sequence[str]) -> Column:
    check_policy(immutable, program_only)
    hit = lambda ps: F.array_max(F.array(F.lit(False), *(below(path, p) for p in ps)))
    return F.when(hit(program_only), "program_only").when(hit(immutable), "immutable").otherwise("open")


#: The wire's failure codes, and which of them each refusal here is.
CODES = {
    0: "unspecified", 1: "condition_failed", 2: "immutable", 3: "idempotency_input_mismatch", 4: "invalid", 5: "internal", 6: "program_concurrency_violation", 7: "durability_unavailable", 8: "resource_limit", 9: "authorization_denied",
    10: "immutable_policy_required",
}
REFUSALS = {
    "exists": 1, "version_mismatch": 1, "immutable": 2, "command_conflict": 3, "unknown_operation": 4, "not_versioned": 4, "current_tombstone": 1, "program_only": 9, "not_immutable_prefix": 10,
}


def failure(outcome: Column, version: Column) -> Column:
    """struct(code, name, current_version) of a refused operation; null of one that was done, or that found nothing to delete."""
    code = reduce(lambda c, x: c.when(outcome == x[0], x[1]), REFUSALS.items(), F)
    name = F.element_at(F.array(*(F.lit(n) for n in CODES.values())), code + 1)
    return F.when(outcome.isin(*REFUSALS), F.struct(code.alias("code"), name.alias("name"), version.alias("current_version")))


def quorum_read(replicas: DataFrame, quorum: int) -> DataFrame:
    """replicas: replica, path, version, hash. The newest version of each path that a quorum holds alike."""
    alike = replicas.groupBy("path", "version", "hash").agg(F.count_distinct("replica").alias("held")).where(F.col("held") >= quorum)
    return alike.groupBy("path").agg(F.max_by(F.struct("version", "hash"), "version").alias("r")).select("path", "r.*")
