"""Relationship authorization: schemas, tuples with revisions, checks by set-based reachability.

tuples: namespace, id, relation, subject_namespace, subject_id, subject_relation (null: an object), added (revision), removed (revision or null).
A check asks whether a node (namespace, id, relation) reaches a subject. Nodes depend on nodes: a permission on what it inherits, and through a tuple's object on that
object's relations; a tuple with a userset on the userset. Cycles end by themselves, because a node is visited once per request.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.definition import Invalid
from ..plans.lineage import cut

MAX_DEPTH = 32
NODE = ["namespace", "id", "relation"]
TUPLE = "namespace string, id string, relation string, subject_namespace string, subject_id string, subject_relation string, added long, removed long"
ANONYMOUS, PUBLIC = ("principal", "anonymous"), ("principal", "public")


@dataclass(frozen=True)
class Selector:
    """Which subjects a relation takes: object, userset, exact, same_id (the object's own id), public."""

    kind: str
    namespace: str = ""
    relation: str = ""
    id: str = ""


@dataclass(frozen=True)
class Direct:
    allowed: tuple[Selector, ...]


@dataclass(frozen=True)
class Inherit:
    relation: str


@dataclass(frozen=True)
class Through:
    """The relation of the objects that a tuple relation names."""

    tupleset: str
    relation: str


@dataclass(frozen=True)
class Permission:
    rules: tuple[Inherit | Through, ...]


@dataclass
class Schema:
    namespaces: dict[str, dict[str, Direct | Permission]]

    def compile(self) -> Schema:
        for ns, relations in self.namespaces.items():
            for name, what in relations.items():
                if isinstance(what, Direct):
                    for s in what.allowed:
                        if s.kind not in ("object", "userset", "exact", "same_id", "public") or (s.kind != "public" and s.namespace not in self.namespaces):
                            raise Invalid(f"{ns}#{name}: selector {s}")
                        if s.kind == "userset" and s.relation not in self.namespaces[s.namespace]:
                            raise Invalid(f"{ns}#{name}: no relation {s.relation}")
                else:
                    if not what.rules:
                        raise Invalid(f"{ns}#{name} has no rule")
                    for r in what.rules:
                        if isinstance(r, Inherit) and r.relation not in relations:
                            raise Invalid(f"{ns}#{name}: no relation {r.relation}")
                        if isinstance(r, Through) and not isinstance(relations.get(r.tupleset), Direct):
                            raise Invalid(f"{ns}#{name}: {r.tupleset} is no direct relation")
        return self

    def stored(self) -> dict:
        kind = lambda what: ["direct", [asdict(x) for x in what.allowed]] if isinstance(what, Direct) else ["permission", [asdict(x) for x in what.rules]]
        return {ns: {name: kind(what) for name, what in rel.items()} for ns, rel in self.namespaces.items()}

    @staticmethod
    def restored(body: dict) -> Schema:
        rule = lambda x: Through(**x) if "tupleset" in x else Inherit(**x)
        made = lambda kind, xs: Direct(tuple(Selector(**x) for x in xs)) if kind == "direct" else Permission(tuple(map(rule, xs)))
        return Schema({ns: {name: made(*what) for name, what in rel.items()} for ns, rel in body.items()})

    def rules(self, spark: SparkSession) -> DataFrame:
        """(namespace, relation, tupleset or null, target)."""
        rows = [(ns, name, getattr(r, "tupleset", None), r.relation) for ns, rel in self.namespaces.items() for name, p in rel.items() if isinstance(p, Permission) for r in p.rules]
        return spark.createDataFrame(rows, "namespace string, relation string, tupleset string, target string")

    def selectors(self, spark: SparkSession) -> DataFrame:
        rows = [(ns, name, s.kind, s.namespace, s.relation, s.id) for ns, rel in self.namespaces.items() for name, d in rel.items() if isinstance(d, Direct) for s in d.allowed]
        return spark.createDataFrame(rows, "namespace string, relation string, kind string, s_namespace string, s_relation string, s_id string")


class Bindings:
    """Schemas and the schema of each realm, changed by compare-and-set on a generation; stored in a document if one is given."""

    def __init__(self, document=None) -> None:
        self.document, self.number = document, 0
        self.schemas: dict[str, Schema] = {}
        self.bound: dict[str, tuple[str, int]] = {}

    def _load(self) -> None:
        if self.document is not None:
            self.number, value = self.document.read()
            value = value or {"schemas": {}, "bound": {}}
            self.schemas = {n: Schema.restored(x) for n, x in value["schemas"].items()}
            self.bound = {r: (n, g) for r, (n, g) in value["bound"].items()}

    def _save(self) -> None:
        if self.document is not None:
            self.number = self.document.write({"schemas": {n: x.stored() for n, x in self.schemas.items()}, "bound": self.bound}, self.number)

    def put(self, name: str, schema: Schema) -> None:
        self._load()
        self.schemas[name] = schema.compile()
        self._save()

    def bind(self, realm: str, name: str, expected: int) -> int:
        self._load()
        if self.bound.get(realm, ("", 0))[1] != expected:
            raise Invalid("binding generation")
        if name not in self.schemas:
            raise Invalid("no such schema")
        self.bound[realm] = (name, expected + 1)
        self._save()
        return expected + 1

    def get(self, realm: str) -> tuple[Schema, int]:
        self._load()
        name, generation = self.bound[realm]
        return self.schemas[name], generation


def admitted(tuples: DataFrame, schema: Schema) -> DataFrame:
    """The tuples whose subject a selector of their relation takes."""
    s = F.broadcast(schema.selectors(tuples.sparkSession))  # as large as the schema
    obj = F.col("t.subject_relation").isNull()
    fits = (
        ((F.col("kind") == "object") & obj & (F.col("subject_namespace") == F.col("s_namespace")))
        | ((F.col("kind") == "userset") & (F.col("subject_namespace") == F.col("s_namespace")) & (F.col("subject_relation") == F.col("s_relation")))
        | ((F.col("kind") == "exact") & obj & (F.col("subject_namespace") == F.col("s_namespace")) & (F.col("subject_id") == F.col("s_id")))
        | ((F.col("kind") == "same_id") & obj & (F.col("subject_namespace") == F.col("s_namespace")) & (F.col("subject_id") == F.col("t.id")))
        | ((F.col("kind") == "public") & obj & (F.col("subject_namespace") == PUBLIC[0]) & (F.col("subject_id") == PUBLIC[1]))
    )
    t = tuples.alias("t")
    return t.join(s.alias("s"), (F.col("t.namespace") == F.col("s.namespace")) & (F.col("t.relation") == F.col("s.relation")) & fits, "left_semi")


def at_revision(tuples: DataFrame, revision: int | None = None) -> DataFrame:
    """The tuples of a revision; latest without one."""
    if revision is None:
        return tuples.where("removed is null")
    return tuples.where((F.col("added") <= revision) & (F.col("removed").isNull() | (F.col("removed") > revision)))


def consistent(tuples: DataFrame, at_least: int | None = None, exact: int | None = None) -> DataFrame:
    if exact is not None:
        return at_revision(tuples, exact)
    if at_least is not None:
        top = tuples.agg(F.greatest(F.max("added"), F.max("removed"))).first()[0] or 0
        if top < at_least:
            raise Invalid(f"revision {at_least} isn't there yet")
    return at_revision(tuples)


def mutate(tuples: DataFrame, add: DataFrame, remove: DataFrame, revision: int) -> DataFrame:
    """One atomic batch: what is there already stays as it is; revision is the batch's number."""
    keys = [*NODE, "subject_namespace", "subject_id", "subject_relation"]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    gone = remove.select(*keys).distinct().withColumn("_gone", F.lit(True))
    kept = tuples.alias("t").join(gone.alias("r"), same("t", "r"), "left").select("t.*", "_gone")
    kept = kept.withColumn("removed", F.when(F.col("removed").isNull() & F.col("_gone"), F.lit(revision)).otherwise(F.col("removed"))).drop("_gone")
    live = kept.where("removed is null")
    new = add.select(*keys).distinct().alias("a").join(live.alias("l"), same("a", "l"), "left_anti")
    return kept.unionByName(new.withColumns({"added": F.lit(revision).cast("long"), "removed": F.lit(None).cast("long")}))


def read_tuples(tuples: DataFrame, namespace: str | None = None, id_: str | None = None, relation: str | None = None, subject: tuple[str, str] | None = None, after: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
    rows = tuples
    for column, value in (("namespace", namespace), ("id", id_), ("relation", relation), *zip(("subject_namespace", "subject_id"), subject or (None, None), strict=True)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    keys = [*NODE, "subject_namespace", "subject_id"]
    order = [*(F.col(k) for k in keys), F.coalesce("subject_relation", F.lit(""))]
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(a) for a in after)))
    return rows.orderBy(*order).limit(limit)


def depends(nodes: DataFrame, tuples: DataFrame, rules: DataFrame) -> DataFrame:
    """nodes: NODE and other columns. The nodes that these depend on directly."""
    other = [c for c in nodes.columns if c not in NODE]
    r = nodes.join(F.broadcast(rules), ["namespace", "relation"])
    inherited = r.where("tupleset is null").select("namespace", "id", F.col("target").alias("relation"), *other)
    edge = tuples.select(*NODE, "subject_namespace", "subject_id", "subject_relation")
    via = r.where("tupleset is not null").drop("relation").withColumnRenamed("tupleset", "relation").join(edge.where("subject_relation is null"), NODE)
    via = via.select(F.col("subject_namespace").alias("namespace"), F.col("subject_id").alias("id"), F.col("target").alias("relation"), *other)
    sets = nodes.join(edge.where("subject_relation is not null"), NODE)
    sets = sets.select(F.col("subject_namespace").alias("namespace"), F.col("subject_id").alias("id"), F.col("subject_relation").alias("relation"), *other)
    return inherited.unionByName(via).unionByName(sets).distinct()


def check(requests: DataFrame, tuples: DataFrame, schema: Schema, max_depth: int = MAX_DEPTH) -> DataFrame:
    """requests: ordinal, namespace, id, permission, subject_namespace, subject_id. (ordinal, allowed). Each round adds the nodes one step further, without those
    visited; deeper than max_depth is an error."""
    rules = schema.rules(requests.sparkSession)
    seen = cut(requests.select("namespace", "id", F.col("permission").alias("relation"), "ordinal").distinct())
    frontier = seen
    for depth in range(max_depth + 1):
        new = cut(depends(frontier, tuples, rules).join(seen, [*NODE, "ordinal"], "left_anti"))
        if not new.take(1):
            break
        if depth == max_depth:
            raise Invalid(f"deeper than {max_depth}")
        seen, frontier = seen.unionByName(new), new
    direct = tuples.where("subject_relation is null").select(*NODE, "subject_namespace", "subject_id")
    ends = seen.join(requests.select("ordinal", F.col("subject_namespace").alias("_n"), F.col("subject_id").alias("_s")), "ordinal").join(direct, NODE)
    own = (F.col("subject_namespace") == F.col("_n")) & (F.col("subject_id") == F.col("_s"))
    public = (F.col("subject_namespace") == PUBLIC[0]) & (F.col("subject_id") == PUBLIC[1])
    hit = ends.where(own | public).select("ordinal").distinct().withColumn("allowed", F.lit(True))
    return requests.select("ordinal").join(hit, "ordinal", "left").select("ordinal", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def objects_of(subject: tuple[str, str], namespace: str, permission: str, tuples: DataFrame, schema: Schema, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id): the objects of a namespace for which the subject has the permission; the gate of queries. Goes the other way: from the subject's tuples up."""
    spark = tuples.sparkSession
    rules = F.broadcast(schema.rules(spark))
    is_subject = ((F.col("subject_namespace") == subject[0]) & (F.col("subject_id") == subject[1])) | ((F.col("subject_namespace") == PUBLIC[0]) & (F.col("subject_id") == PUBLIC[1]))
    seen = cut(tuples.where(F.col("subject_relation").isNull() & is_subject).select(*NODE).distinct())
    frontier = seen
    edge = tuples.select(*NODE, "subject_namespace", "subject_id", "subject_relation")
    for depth in range(max_depth + 1):
        up = frontier.select(F.col("namespace").alias("subject_namespace"), F.col("id").alias("subject_id"), F.col("relation").alias("_rel"))
        inherited = frontier.join(rules.where("tupleset is null").select("namespace", F.col("relation").alias("p"), F.col("target").alias("relation")), ["namespace", "relation"]).select("namespace", "id", F.col("p").alias("relation"))
        sets = edge.join(up.withColumnRenamed("_rel", "subject_relation"), ["subject_namespace", "subject_id", "subject_relation"]).select(*NODE)
        through = rules.where("tupleset is not null").select("namespace", F.col("relation").alias("p"), F.col("tupleset").alias("relation"), "target")
        via = edge.where("subject_relation is null").join(through, ["namespace", "relation"]).join(up.withColumnRenamed("_rel", "target"), ["subject_namespace", "subject_id", "target"]).select("namespace", "id", F.col("p").alias("relation"))
        new = cut(inherited.unionByName(sets).unionByName(via).distinct().join(seen, NODE, "left_anti"))
        if not new.take(1):
            break
        if depth == max_depth:
            raise Invalid(f"deeper than {max_depth}")
        seen, frontier = seen.unionByName(new), new
    return seen.where((F.col("namespace") == namespace) & (F.col("relation") == permission)).select("id").distinct()


def tuple_rows(rows: Iterable[tuple]) -> list[tuple]:
    return [(*r, None)[:6] + (1, None) for r in rows]


def object_schema() -> Schema:
    """The roles of stores: a system holds tenants, these buckets, these objects; each level's readers, writers and administrators count below it."""
    users = Direct((Selector("object", "principal"), Selector("userset", "group", "member"), Selector("public")))
    out: dict[str, dict[str, Direct | Permission]] = {"principal": {}, "group": {"member": Direct((Selector("object", "principal"), Selector("userset", "group", "member")))}}
    above = None
    for level in ("system", "tenant", "bucket", "object"):
        up = () if above is None else (above,)
        roles: dict[str, Direct | Permission] = {"reader": users, "writer": users, "admin": users}
        if up:
            roles["parent"] = Direct((Selector("object", above),))
        through = lambda p: tuple(Through("parent", p) for _ in up)  # noqa: B023, E731
        roles["administer"] = Permission((Inherit("admin"), *through("administer")))
        roles["write"] = Permission((Inherit("writer"), Inherit("administer"), *through("write")))
        roles["read"] = Permission((Inherit("reader"), Inherit("write"), *through("read")))
        out[level], above = roles, level
    return Schema(out).compile()
