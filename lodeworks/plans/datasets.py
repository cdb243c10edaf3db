"""The sample tables as objects, versions, journals, records, tuples and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projection import IDENTITY, native_cell
from .definition import Builder, Cap, Definition

E, P, R, O, C, A = Cap.EXACT, Cap.PREFIX, Cap.RANGE, Cap.ORDER, Cap.FACET, Cap.AGGREGATE


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs_definition() -> Definition:
    b = Builder(Definition("docs", path_prefix="docs"))
    return b.keyword("lang", E, P, R, O, C).keyword("source", E, P, R, O, C).signed("n_chars", E, R, O, C, A).signed("doc_id", E, R, O, A).build()


def _record(path, version) -> list:
    zero = F.lit(0).cast("long")
    return [path.alias("source_path"), version.alias("source_version"), zero.alias("source_record"), path.alias("result_path"), version.alias("result_version")]


def docs_index(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select(*_record(path, F.col("doc_id")), *(native_cell(F.col(c)).alias(c) for c in ("lang", "source", "n_chars", "doc_id")))


def parts_definition() -> Definition:
    b = Builder(Definition("parts"))
    return b.keyword("brand", E, P, R, O, C).signed("size", E, R, O, C, A).floating("price", E, R, O, A).boolean("large", E, C).unsigned("key", E, R, O, A).keyword("words", E, P, C, multi=True).signed("digits", E, R, C, A, multi=True).build()


def parts_index(spark: SparkSession, sf: str) -> DataFrame:
    """Missing, null and present cells: size is missing where it is 7 modulo 10 and null where it is 3; words and digits have several values."""
    p = table(spark, sf, "part")
    n, missing, null = F.col("p_size"), F.col("p_size") % 10 == 7, F.col("p_size") % 10 == 3
    size = F.struct((~missing).alias("present"), (null & ~missing).alias("has_null"), F.when(~missing & ~null, n.cast("long")).alias("v"))
    words = F.array_sort(F.array_distinct(F.split("p_type", " ")))
    digits = F.when(n % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n.cast("long"), (n % 7).cast("long"), n.cast("long")))
    return p.select(
        *_record(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")), F.col("p_partkey")),
        native_cell(F.col("p_brand")).alias("brand"),
        size.alias("size"),
        native_cell(F.col("p_retailprice")).alias("price"),
        native_cell(n > 25).alias("large"),
        native_cell(F.col("p_partkey").cast("decimal(20,0)")).alias("key"),
        native_cell(words, True).alias("words"),
        native_cell(digits, True).alias("digits"),
    )


PARTS_SQL = """parts as (
  select 'parts/' || p_partkey as path, p_partkey as version, p_brand as brand, p_size % 10 <> 7 as size_present, p_size % 10 = 3 as size_null,
    case when p_size % 10 not in (3, 7) then p_size::bigint end as size, p_retailprice as price, p_size > 25 as large, p_partkey as key,
    list_sort(list_distinct(string_split(p_type, ' '))) as words, case when p_size % 5 = 0 then []::bigint[] else [p_size::bigint, (p_size % 7)::bigint, p_size::bigint] end as digits
  from part)"""

DOCS_SQL = "docs as (select 'docs/' || source || '/' || doc_id as path, doc_id as version, doc_id, lang, source, n_chars, text from documents)"


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as versions of users' objects; an error is a tombstone."""
    e = table(spark, sf, "events")
    gone = F.col("event_type") == "error"
    length = F.when(~gone, F.floor(F.abs("value") * 100).cast("long"))
    return e.select(F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("version"), gone.alias("deleted"), length.alias("length"), F.when(~gone, F.md5("props")).alias("hash"))


VERSIONS_SQL = """versions as (
  select 'users/' || user_id as path, event_id as version, event_type = 'error' as deleted, case when event_type <> 'error' then floor(abs(value) * 100)::bigint end as length,
    case when event_type <> 'error' then md5(props) end as hash from events),
heads as (select * from versions qualify row_number() over (partition by path order by version desc) = 1)"""


def journal(spark: SparkSession, sf: str) -> DataFrame:
    """Events as journals of three sources, each with offsets of its own."""
    v = versions(spark, sf)
    return v.select(F.concat(F.lit("n"), (F.col("version") % 3).cast("string")).alias("source"), F.floor(F.col("version") / 3).cast("long").alias("offset"), "path", "version", "deleted", "length")


JOURNAL_SQL = VERSIONS_SQL + ",\njournal as (select 'n' || version % 3 as source, version // 3 as off, path, version, deleted, length from versions)"


def event_objects(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("events/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("version"), F.lit("application/json").alias("content_type"), F.col("props").alias("body"), F.unix_millis(F.col("ts").cast("timestamp")).alias("committed_at_unix_millis"))


def text_records(spark: SparkSession, sf: str, column: str = "text") -> DataFrame:
    from ..functions.scalar import analyze

    c = table(spark, sf, "conversations")
    path = F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return c.select(*_record(path, F.col("turn")), analyze(F.col("text")).alias(column), F.when(F.col("role") == "user", analyze(F.col("role"))).alias("role"))


TALK_SQL = r"""talk as (
  select 'talk/' || conv_id || '/' || turn as path, turn as version, list_transform(regexp_extract_all(text, '[\pL\pN\pM\p{Nl}]+'), lambda t: lower(t)) as w, case when role = 'user' then ['user'] end as role
  from conversations)"""


def tuples(spark: SparkSession, sf: str) -> DataFrame:
    """Regions hold nations, nations hold customers; a user of each segment views a nation, and a group of each nation edits its customers."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    text = lambda x: F.col(x).cast("string")
    none = F.lit(None).cast("string")
    parent = n.select(F.lit("nation").alias("namespace"), text("n_nationkey").alias("id"), F.lit("parent").alias("relation"), F.lit("region").alias("subject_namespace"), text("n_regionkey").alias("subject_id"), none.alias("subject_relation"))
    member = c.select(F.lit("customer").alias("namespace"), text("c_custkey").alias("id"), F.lit("parent").alias("relation"), F.lit("nation").alias("subject_namespace"), text("c_nationkey").alias("subject_id"), none.alias("subject_relation"))
    viewer = n.where("n_nationkey % 3 = 0").select(F.lit("nation").alias("namespace"), text("n_nationkey").alias("id"), F.lit("viewer").alias("relation"), F.lit("user").alias("subject_namespace"), F.concat(F.lit("u"), (F.col("n_nationkey") % 5).cast("string")).alias("subject_id"), none.alias("subject_relation"))
    region = n.select("n_regionkey").distinct().select(F.lit("region").alias("namespace"), text("n_regionkey").alias("id"), F.lit("viewer").alias("relation"), F.lit("team").alias("subject_namespace"), F.concat(F.lit("t"), text("n_regionkey")).alias("subject_id"), F.lit("member").alias("subject_relation"))
    team = n.select("n_regionkey").distinct().select(F.lit("team").alias("namespace"), F.concat(F.lit("t"), text("n_regionkey")).alias("id"), F.lit("member").alias("relation"), F.lit("user").alias("subject_namespace"), F.concat(F.lit("u"), text("n_regionkey")).alias("subject_id"), none.alias("subject_relation"))
    every = parent.unionByName(member).unionByName(viewer).unionByName(region).unionByName(team)
    return every.withColumns({"added": F.when(F.col("relation") == "viewer", 2).otherwise(1).cast("long"), "removed": F.lit(None).cast("long")})


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as advisories, their parts as affected packages."""
    o, l, p = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "part")
    eco = F.element_at(F.array(*(F.lit(x) for x in ("PyPI", "npm", "crates.io", "Go", "Maven:central", " "))), (F.col("l_partkey") % 6 + 1).cast("int"))
    item = F.struct(F.struct(eco.alias("ecosystem"), F.concat_ws("_", F.col("p_brand"), (F.col("l_partkey") % 4).cast("string")).alias("name")).alias("package"), F.col("l_linenumber").alias("n"))
    affected = l.join(p, l.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), item.alias("v")))).alias("a"))
    affected = affected.select("l_orderkey", F.transform("a", lambda x: x["v"]).alias("affected"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.join(affected, o.o_orderkey == affected.l_orderkey, "left").select(
        F.concat(F.lit("ADV-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(stamp).alias("modified"),
        stamp.alias("published"),
        F.when(F.col("o_orderstatus") == "F", stamp).alias("withdrawn"),
        F.array(F.concat(F.lit("A-"), (F.col("o_custkey") % 9).cast("string")), F.lit(" B "), F.lit("")).alias("aliases"),
        F.col("o_orderpriority").alias("summary"),
        F.lit(" ").alias("details"),
        F.coalesce("affected", F.array().cast(affected.schema["affected"].dataType)).alias("affected"),
    )


FEED_SQL = """aff as (
  select l_orderkey as k, l_linenumber as i,
    trim(['PyPI', 'npm', 'crates.io', 'Go', 'Maven:central', ' '][l_partkey % 6 + 1]) as e0, p_brand || '_' || l_partkey % 4 as name
  from lineitem join part on l_partkey = p_partkey),
scoped as (
  select k, i, case lower(e0) when 'cargo' then 'crates.io' else lower(e0) end as eco, name from aff),
canon as (
  select k, i, eco, case when eco = 'pypi' then array_to_string(list_filter(string_split_regex(lower(trim(name)), '[-_.]'), lambda x: x <> ''), '-') when eco = 'npm' then lower(trim(name)) else trim(name) end as pkg from scoped),
keyed as (
  select o_orderkey as k, i, case when coalesce(eco, '') <> '' then eco else '' end as ecosystem, case when coalesce(eco, '') <> '' then pkg else '' end as package
  from orders left join canon on o_orderkey = k),
split as (select 'ADV-' || k as id, k, ecosystem, package, count(i) as entries from keyed group by k, ecosystem, package)"""

__all__ = ["IDENTITY"]
