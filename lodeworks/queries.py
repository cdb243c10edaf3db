"""One query for each operator, with its SQL where SQL can express it. A query reads whole tables below sf."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import scalar as X
from .operators import advisories, authz, compute, grouplog, programs, projection, search, textindex
from .operators import predicate as Q
from .plans import datasets as D
from .plans.datasets import DOCS_SQL, FEED_SQL, JOURNAL_SQL, PARTS_SQL, TALK_SQL, VERSIONS_SQL, table
from .plans.lineage import folder
from .plans.catalog import Document
from .plans.definition import Builder, Cap, Definition, Invalid, Store, Type
from .sources import files, objects
from .streaming import accounting, generation, journal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DOCS, PARTS = D.docs_definition(), D.parts_definition()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


# --- flagship: the shape of the incident query --------------------------------------------------------------------------
FLAGSHIP = Q.both(Q.equal("lang", "en"), Q.compare("ge", "n_chars", 1000), Q.among("source", "src1", "src2", "src3"))
FLAGSHIP_ORDER = (("n_chars", True), ("source", False))


@query("flagship", f"with {DOCS_SQL} select path, n_chars, source from docs where lang = 'en' and n_chars >= 1000 and source in ('src1', 'src2', 'src3') order by n_chars desc, source, path, version limit 4")
def flagship(spark, sf):
    rows = search.select_page(D.docs_index(spark, sf), DOCS, FLAGSHIP, FLAGSHIP_ORDER, 4)
    return rows.select(F.col("result_path").alias("path"), F.col("n_chars.v").alias("n_chars"), F.col("source.v").alias("source"))


# --- object reads (S) ----------------------------------------------------------------------------------------------------
def _heads(spark, sf):
    return objects.heads(D.versions(spark, sf))


@query("s01_list_objects", f"with {VERSIONS_SQL} select path from heads where not deleted and starts_with(path, 'users/1') and path > 'users/10' order by path limit 51")
def _(spark, sf):
    return objects.list_objects(_heads(spark, sf), "users/1", "users/10", 50).select("path")


@query("s02_merge_lists", f"with {VERSIONS_SQL} select path from heads where not deleted order by path limit 40")
def _(spark, sf):
    live = _heads(spark, sf).where("not deleted").select("path")
    owner = F.pmod(F.xxhash64("path"), F.lit(2))
    return objects.merge_lists([live.where(owner == 0), live.where(owner == 1)], 40)


@query("s03_head_object", f"with {VERSIONS_SQL}, k as (select 'users/' || c_custkey as path from customer) select k.path, case when version is null then 'never_existed' when deleted then 'deleted' else 'present' end as state, version from k left join heads using (path)")
def _(spark, sf):
    keys = table(spark, sf, "customer").select(F.concat(F.lit("users/"), F.col("c_custkey").cast("string")).alias("path"))
    return objects.head_state(keys, _heads(spark, sf))


@query("s04_get_object", f"with {VERSIONS_SQL}, p as (select min(path) as p from heads where not deleted), f as (select version as v from versions, p where path = p and not deleted order by version limit 1) select path, version, length, hash, version = (select v from f) as first from versions, p where path = p and version in (select version from heads union all select v from f)")
def _(spark, sf):
    """The current and the first retained version of the least live path."""
    v = D.versions(spark, sf)
    path = _heads(spark, sf).where("not deleted").agg(F.min("path")).first()[0]
    first = v.where((F.col("path") == path) & ~F.col("deleted")).agg(F.min("version")).first()[0]
    both = objects.get_object(v, path).unionByName(objects.get_object(v, path, first)).distinct()
    return both.select("path", "version", "length", "hash", (F.col("version") == first).alias("first"))


_REQUESTS = [(i, f"users/{i * 7 % 60}", None if i % 3 else i * 11) for i in range(30)]


@query(
    "s05_batch_get",
    f"with {VERSIONS_SQL}, r(ordinal, path, want) as (values {', '.join(f'''({i}, '{p}', {'null' if v is None else v}::bigint)''' for i, p, v in _REQUESTS)}), "
    "j as (select r.ordinal, r.path, v.version, v.deleted, v.length from r left join heads h on h.path = r.path left join versions v on v.path = r.path and v.version = coalesce(r.want, h.version)) "
    "select ordinal::bigint as ordinal, path, case when not deleted then version end as version, case when deleted is null then 'not_found' when deleted then 'deleted' else 'found' end as outcome, case when not deleted then length end as length from j",
)
def _(spark, sf):
    return objects.batch_get(D.versions(spark, sf), spark.createDataFrame(_REQUESTS, "ordinal long, path string, version long"))


@query("s06_list_versions", f"with {VERSIONS_SQL} select version, deleted, length from versions where path = 'users/7'")
def _(spark, sf):
    return objects.list_versions(D.versions(spark, sf), "users/7").select("version", "deleted", "length")


@query("s07_snapshot_scan", f"with {VERSIONS_SQL} select path, version from (select * from versions where version <= 700 qualify row_number() over (partition by path order by version desc) = 1) where not deleted")
def _(spark, sf):
    j = D.versions(spark, sf).withColumn("offset", F.col("version"))
    return objects.snapshot_scan(j, "users", 700).select("path", "version")


@query("s08_retained_scan", f"with {VERSIONS_SQL} select v.path, v.version, h.version as head_version, h.deleted as head_deleted from versions v join heads h using (path)")
def _(spark, sf):
    return objects.retained_scan(D.versions(spark, sf)).select("path", "version", "head_version", "head_deleted")


@query("s09_segment_scan", "select doc_id, n_chars from documents where lang = 'de' and n_chars >= 500 and starts_with(source, 'src1')")
def _(spark, sf):
    assert files.pushdown("equal") == files.pushdown("prefix") == "exact"
    d = table(spark, sf, "documents")
    return d.where((F.col("lang") == "de") & (F.col("n_chars") >= 500) & F.col("source").startswith("src1")).select("doc_id", "n_chars")


@query("s10_component_read", "select lang, min(n_chars) as lo, max(n_chars) as hi from documents where n_chars between 100 and 2000 group by lang")
def _(spark, sf):
    return table(spark, sf, "documents").where(F.col("n_chars").between(100, 2000)).groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@query("s11_ndjson_shards", "select o_orderkey % 4 as part, o_orderkey as id from orders")
def _(spark, sf):
    """Written as gzip shards and as zstd shards; read back from both, which must agree."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("partition"), F.col("o_orderkey").alias("id"), F.to_json(F.struct((F.col("o_orderkey") % 4).alias("part"), F.col("o_orderkey").alias("id"))).alias("body"))
    path = folder(spark)
    cut, packed = files.shards(o, shard_bytes=50_000), folder(spark, "zstd")
    files.write_ndjson(cut, path)
    written = files.write_ndjson_zstd(cut, packed)
    plain = spark.read.schema("part long, id long").json(path).select("part", "id")
    parsed = files.read_ndjson_zstd(spark, packed).select(F.from_json("body", "part long, id long").alias("r")).select("r.part", "r.id")
    assert written.agg(F.sum("documents")).first()[0] == o.count()
    return plain.intersectAll(parsed)


@query("s12_zip_source", "select n_name || '.json' as name, '{\"k\": ' || n_nationkey || '}' as body from nation")
def _(spark, sf):
    rows = table(spark, sf, "nation").select("n_name", "n_nationkey").collect()
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("readme.txt", "no JSON")
        for r in rows:
            z.writestr(f"{r.n_name}.json", f'{{"k": {r.n_nationkey}}}')
    found = spark.createDataFrame([("a.zip", bytearray(raw.getvalue()))], "path string, content binary")
    return found.mapInArrow(files.unzip, "archive string, name string, state string, body string").where("state = 'ok'").select("name", "body")


@query("s13_put_stream", f"with {VERSIONS_SQL} select count(*) as n, sum(length)::bigint as bytes from versions")
def _(spark, sf):
    """Staged micro-batches, each published once by its batch's commit."""
    src, out, ck = folder(spark), folder(spark), folder(spark)
    D.versions(spark, sf).repartition(4).write.parquet(src)
    s = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 2).parquet(src)
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query("s17_artifact_sink", f"with {DOCS_SQL} select lang, count(*) as n from docs group by lang")
def _(spark, sf):
    ix = generation.Index(spark, folder(spark), DOCS)
    rows = D.docs_index(spark, sf)
    heads = rows.select(F.col("source_path").alias("path"), F.col("source_version").alias("version"), F.lit(False).alias("deleted"))
    ix.rebuild(heads, {"n0": 1}, lambda live: rows.join(live.select(F.col("path").alias("source_path")), "source_path", "left_semi"))
    return ix.read().groupBy(F.col("lang.v").alias("lang")).agg(F.count("*").alias("n"))


@query("s18_builder", "select * from (values ('a', 'keyword', 'exact'), ('b', 'signed', 'range')) t(name, type, capability)")
def _(spark, sf):
    d = Builder(Definition("x")).keyword("a", Cap.EXACT).signed("b", Cap.RANGE).build()
    return spark.createDataFrame([(f.name, str(f.type), sorted(f.capabilities)[0]) for f in d.fields], "name string, type string, capability string")


# --- projections (P) -----------------------------------------------------------------------------------------------------
@query("p01_scope", "select 'events/' || event_type || '/' || event_id as path from events where event_type = 'purchase'")
def _(spark, sf):
    return projection.scope(D.event_objects(spark, sf), Definition("x", path_prefix="events/purchase", content_type="application/json")).select("path")


@query("p02_path", "select 'events/' || event_type || '/' || event_id as path, event_id as version from events where starts_with(event_type, 's')")
def _(spark, sf):
    r = projection.paths(D.event_objects(spark, sf), Definition("x", kind="path")).where(F.col("path.v").startswith("events/s"))
    return r.select(F.col("path.v").alias("path"), F.col("result_version").alias("version"))


@query("p03_metadata", "select 'events/' || event_type || '/' || event_id as path, octet_length(encode(props)) as content_length, sha256(props) as content_hash, epoch_us(ts) // 1000 as millis from events")
def _(spark, sf):
    fields = [("path", Type.KEYWORD), ("content_length", Type.UNSIGNED), ("content_hash", Type.KEYWORD), ("committed_at_unix_millis", Type.UNSIGNED)]
    b = Builder(Definition("x", kind="metadata"))
    for n, t in fields:
        b.add(n, t, Cap.EXACT)
    r = projection.metadata(D.event_objects(spark, sf), b.build())
    return r.select(F.col("path.v").alias("path"), F.col("content_length.v").cast("long").alias("content_length"), F.col("content_hash.v").alias("content_hash"), F.col("committed_at_unix_millis.v").cast("long").alias("millis"))


_K = Builder(Definition("k")).signed("k", Cap.EXACT, Cap.RANGE, Cap.ORDER, Cap.FACET, Cap.AGGREGATE).signed("gone", Cap.EXACT, pointer="/no/such").build()


@query("p04_typed_json", "select event_id, json_extract(props, '$.k')::bigint as k, false as gone from events")
def _(spark, sf):
    r = projection.typed(D.event_objects(spark, sf), _K)
    return r.select(F.col("source_version").alias("event_id"), F.col("k.v").alias("k"), F.col("gone.present").alias("gone"))


@query("p05_normalisation", "select event_id, event_id % 5 in (1, 2) as rejected, case when event_id % 5 not in (1, 2) then json_extract(props, '$.k')::bigint end as k from events where event_id % 5 <> 4")
def _(spark, sf):
    """Of five documents one is right, one a text, one a fraction, one has a null beside it, and one doesn't parse."""
    e, n = D.event_objects(spark, sf), F.col("version") % 5
    body = F.when(n == 1, F.regexp_replace("body", r"(\d+)", '"$1"')).when(n == 2, F.regexp_replace("body", r"(\d+)", "$1.0")).when(n == 3, F.regexp_replace("body", r"\}$", ', "z": null}')).when(n == 4, F.concat("body", F.lit(" x"))).otherwise(F.col("body"))
    r = projection.typed(e.withColumn("body", body), _K, strict=False)
    return r.select(F.col("source_version").alias("event_id"), "rejected", F.col("k.v").alias("k"))


@query("p06_text_postings", f"with {TALK_SQL}, p as (select path, unnest(w) as term, len(w) as norm from talk) select path, term, count(*) as frequency, max(norm) as norm from p group by path, term")
def _(spark, sf):
    p = projection.postings(D.text_records(spark, sf), ["text"])
    return p.groupBy(F.col("result_path").alias("path"), "term").agg(F.count("*").alias("frequency"), F.max("norm").cast("long").alias("norm"))


@query("p07_multi_text", "select p_partkey, len(string_split(p_name, ' ')) as tokens, false as crosses from part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", projection.multi_text(F.split("p_name", " ")).alias("t"), F.split("p_name", " ").alias("w"))
    tokens = F.size(F.filter("t", lambda x: x != "")).cast("long")
    return p.select("p_partkey", tokens.alias("tokens"), F.array_join("t", " ").contains(F.array_join(F.transform("w", F.lower), " ")).alias("crosses"))


@query("p08_vector", "select vec_id, true as unit from embeddings")
def _(spark, sf):
    d = Definition("v", kind="vector", dimensions=64, normalize=True)
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("v/"), F.col("vec_id").cast("string")).alias("path"), F.col("vec_id").alias("version"), F.lit("x").alias("content_type"), F.col("embedding").alias("vector"))
    r = projection.vectors(e, d)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return r.select(F.col("source_version").alias("vec_id"), (F.abs(norm - 1) < 1e-5).alias("unit"))


def _hybrid_objects(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return d.select(F.concat(F.lit("h/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("version"), F.lit("x").alias("content_type"), "text", F.col("embedding").alias("vector"))


_HYBRID = Definition("h", kind="hybrid", dimensions=64)


@query("p09_hybrid", "select doc_id, len(regexp_extract_all(text, '[\\pL\\pN\\pM\\p{Nl}]+')) as tokens from documents join embeddings on doc_id = vec_id")
def _(spark, sf):
    r = projection.hybrid(_hybrid_objects(spark, sf), _HYBRID)
    return r.select(F.col("source_version").alias("doc_id"), F.size("text").cast("long").alias("tokens"))


def _tree_objects(spark, sf):
    """One manifest per order: its lines as tree entries."""
    l = table(spark, sf, "lineitem")
    r = F.struct(
        F.col("l_returnflag").alias("repository_id"), F.col("l_linestatus").alias("commit_id"), F.concat(F.lit("src/"), (F.col("l_partkey") % 10).cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("tree_path"),
        F.col("l_partkey").cast("string").alias("object_id"), F.concat(F.lit("packs/"), F.col("l_suppkey").cast("string")).alias("pack_path"), F.col("l_suppkey").alias("pack_version"), F.col("l_partkey").alias("offset"), F.lit(1).cast("long").alias("length"),
    )
    rows = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(r)).alias("rs"))
    return rows.select(F.concat(F.lit("m/"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_orderkey").alias("version"), F.lit("application/json").alias("content_type"), F.to_json("rs").alias("body"))


_TREE_SQL = """tree as (select l_orderkey as k, l_linestatus as commit_id, 'src/' || l_partkey % 10 || '/' || l_linenumber as tree_path, 'packs/' || l_suppkey as pack_path, l_suppkey as pack_version from lineitem where l_returnflag = 'R'),
trees as (select * from tree where k not in (select k from tree group by k, commit_id, tree_path having count(*) > 1))"""


@query("p10_tree_manifest", f"with {_TREE_SQL} select 'm/' || k as path, commit_id, tree_path, pack_path from trees")
def _(spark, sf):
    r = projection.tree_manifest(_tree_objects(spark, sf), Definition("g", kind="tree_manifest", selector=("R",)))
    return r.select(F.col("source_path").alias("path"), "commit_id", "tree_path", F.col("result_path").alias("pack_path"))


def _tensor_objects(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    r = F.struct(F.col("p_brand").alias("model_id"), F.col("p_name").alias("tensor_name"), F.concat(F.lit("w/"), key.cast("string")).alias("source_path"), key.alias("source_version"), F.lit(0).cast("long").alias("offset"), F.col("p_size").cast("long").alias("length"), F.lit("f32").alias("dtype"), F.array(F.col("p_size").cast("long")).alias("shape"))
    return p.select(F.concat(F.lit("t/"), key.cast("string")).alias("path"), key.alias("version"), F.lit("application/json").alias("content_type"), F.to_json(r).alias("body"))


@query("p11_tensor_manifest", "select 'w/' || p_partkey as path, p_brand as model_id, p_name as tensor_name, p_size::bigint as size from part")
def _(spark, sf):
    r = projection.tensor_manifest(_tensor_objects(spark, sf), Definition("n", kind="tensor_manifest"))
    return r.select(F.col("result_path").alias("path"), "model_id", "tensor_name", F.col("shape")[0].alias("size"))


@query("p12_one_or_many", "select event_id, case when event_id % 2 = 0 then 1 else 2 end::bigint as n, json_extract(props, '$.k')::bigint as k from events")
def _(spark, sf):
    e = D.event_objects(spark, sf)
    body = F.when(F.col("version") % 2 == 0, F.col("body")).otherwise(F.concat(F.lit(" ["), "body", F.lit(","), "body", F.lit("]")))
    many = projection.one_or_many(body, "struct<k: bigint>")
    return e.select(F.col("version").alias("event_id"), F.size(many).cast("long").alias("n"), many[0]["k"].alias("k"))


@query("p13_fold", f"with {VERSIONS_SQL} select path, version, deleted from heads")
def _(spark, sf):
    log = D.versions(spark, sf).withColumn("content", F.coalesce("hash", F.lit("")))
    again = log.where("version % 3 = 0")
    return projection.fold(again.unionByName(log)).select("path", "version", "deleted")


# --- predicates (F) ------------------------------------------------------------------------------------------------------
def _predicate(name: str, p: Q.Predicate, where: str) -> None:
    @query(name, f"with {PARTS_SQL} select path from parts where {where}")
    def _(spark, sf):
        return D.parts_index(spark, sf).where(Q.compile_(p, PARTS)).select(F.col("result_path").alias("path"))


_predicate("f01_equal", Q.equal("brand", "Brand#2"), "brand = 'Brand#2'")
_predicate("f01_equal_null", Q.equal("size", None), "size_present and size_null")
_predicate("f02_in", Q.among("size", 1, 5, 9, None), "coalesce(size in (1, 5, 9), false) or (size_present and size_null)")
_predicate("f03_prefix", Q.prefix("brand", "Brand#1"), "starts_with(brand, 'Brand#1')")
_predicate("f04_less", Q.compare("lt", "size", 10), "size < 10")
_predicate("f05_at_most", Q.compare("le", "size", 10), "size <= 10")
_predicate("f06_greater", Q.compare("gt", "price", 950.0), "price > 950")
_predicate("f07_at_least", Q.compare("ge", "key", 100), "key >= 100")
_predicate("f08_range", Q.between("size", 10, 20, (True, False)), "size >= 10 and size < 20")
_predicate("f09_exists", Q.exists("size"), "size_present")
_predicate("f09_exists_empty", Q.exists("digits"), "true")
_predicate("f12_and", Q.both(Q.equal("large", True), Q.compare("lt", "price", 1000.0), Q.exists("size")), "large and price < 1000 and size_present")
_predicate("f13_or", Q.either(Q.equal("brand", "Brand#3"), Q.compare("gt", "size", 45)), "brand = 'Brand#3' or coalesce(size > 45, false)")
_predicate("f14_not", Q.negate(Q.compare("lt", "size", 30)), "not coalesce(size < 30, false)")
_predicate("f15_all", Q.EVERY, "true")
_predicate("f16_decoded", Q.equal("size", Q.decode(PARTS.field("size"), "5")), "size = 5")
_predicate("f01_multi", Q.equal("digits", 3), "list_contains(digits, 3)")
_TOKENS = "([\\pL\\pN\\pM\\p{Nl}]+)"


@query("f10_full_text", f"with {TALK_SQL} select path from talk where list_contains(w, 'the') and list_contains(w, 'of')")
def _(spark, sf):
    d = Builder(Definition("t", kind="text")).text("text").build()
    return D.text_records(spark, sf).where(Q.compile_(Q.full_text("text", "of THE"), d)).select(F.col("result_path").alias("path"))


@query("f11_phrase", f"with {TALK_SQL} select path from talk where contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def _(spark, sf):
    d = Builder(Definition("t", kind="text")).text("text").build()
    return D.text_records(spark, sf).where(Q.compile_(Q.phrase("text", "of, the!"), d)).select(F.col("result_path").alias("path"))


def _user_records(spark, sf):
    v = D.versions(spark, sf)
    return v.select(F.col("path").alias("source_path"), F.col("version").alias("source_version"), F.lit(0).cast("long").alias("source_record"), F.col("path").alias("result_path"), F.col("version").alias("result_version"), "length")


@query("f17_live_mask", f"with {VERSIONS_SQL} select path, version from heads where not deleted")
def _(spark, sf):
    return Q.live(_user_records(spark, sf), _heads(spark, sf)).select(F.col("result_path").alias("path"), F.col("result_version").alias("version"))


@query("f18_candidate_gate", f"with {VERSIONS_SQL} select path, version from heads where not deleted and path in (select 'users/' || c_custkey from customer where c_mktsegment = 'MACHINERY')")
def _(spark, sf):
    allowed = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("users/"), F.col("c_custkey").cast("string")).alias("path"))
    return Q.visible(_user_records(spark, sf), _heads(spark, sf), allowed).select(F.col("result_path").alias("path"), F.col("result_version").alias("version"))


@query("f19_metadata_filter", f"with {VERSIONS_SQL} select path, length from heads where not deleted and length > 500")
def _(spark, sf):
    return _heads(spark, sf).where("not deleted and length > 500").select("path", "length")


@query("f20_path_query", f"with {DOCS_SQL} select path from docs where starts_with(path, 'docs/src1') and path > 'docs/src10/5' order by path limit 25")
def _(spark, sf):
    r = D.docs_index(spark, sf).where(F.col("source_path").startswith("docs/src1") & (F.col("source_path") > "docs/src10/5"))
    return r.orderBy("source_path").limit(25).select(F.col("source_path").alias("path"))


@query("f21_tree_query", f"with {_TREE_SQL} select tree_path, pack_path from trees where commit_id = 'F' and starts_with(tree_path, 'src/3')")
def _(spark, sf):
    r = projection.tree_manifest(_tree_objects(spark, sf), Definition("g", kind="tree_manifest", selector=("R",)))
    return r.where((F.col("commit_id") == "F") & F.col("tree_path").startswith("src/3")).orderBy("tree_path").select("tree_path", F.col("result_path").alias("pack_path"))


@query("f22_tensor_query", "select 'w/' || p_partkey as path from part where p_brand = 'Brand#2' and p_name = 'small ring'")
def _(spark, sf):
    r = projection.tensor_manifest(_tensor_objects(spark, sf), Definition("n", kind="tensor_manifest"))
    return r.where((F.col("model_id") == "Brand#2") & (F.col("tensor_name") == "small ring")).select(F.col("result_path").alias("path"))


@query("f23_admission", "select unnest(range(7)) as case_number, true as refused")
def _(spark, sf):
    """Each of these is refused before a job runs."""
    bad = [Q.equal("nothing", 1), Q.prefix("size", "1"), Q.prefix("brand", ""), Q.among("size"), Q.equal("size", "x"), Q.compare("lt", "large", True), Q.among("size", *range(65))]
    out = []
    for i, p in enumerate(bad):
        try:
            Q.compile_(p, PARTS)
        except Invalid as e:
            out.append((i, bool(str(e))))
    return spark.createDataFrame(out, "case_number long, refused boolean")


# --- implicit joins (J) --------------------------------------------------------------------------------------------------
@query("j01_current_heads", f"with {VERSIONS_SQL} select v.path, v.version from versions v join heads h on v.path = h.path and v.version = h.version where not h.deleted")
def _(spark, sf):
    h = _heads(spark, sf).where("not deleted").select("path", "version")
    return D.versions(spark, sf).join(h, ["path", "version"], "left_semi").select("path", "version")


@query("j02_authorised", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def _(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey")


def _term(spark, sf, t: str) -> DataFrame:
    return projection.postings(D.text_records(spark, sf), ["text"]).where(F.col("term") == t).select("result_path", "position")


@query("j03_postings_intersection", f"with {TALK_SQL} select path from talk where list_contains(w, 'de') and list_contains(w, 'que')")
def _(spark, sf):
    return _term(spark, sf, "de").select("result_path").distinct().join(_term(spark, sf, "que"), "result_path", "left_semi").select(F.col("result_path").alias("path"))


@query("j04_postings_difference", f"with {TALK_SQL} select path from talk where list_contains(w, 'de') and not list_contains(w, 'que')")
def _(spark, sf):
    return _term(spark, sf, "de").select("result_path").distinct().join(_term(spark, sf, "que"), "result_path", "left_anti").select(F.col("result_path").alias("path"))


@query("j05_phrase_positions", f"with {TALK_SQL} select path from talk where contains(' ' || array_to_string(w, ' ') || ' ', ' de la ')")
def _(spark, sf):
    after = _term(spark, sf, "la").withColumn("position", F.col("position") - 1)
    return _term(spark, sf, "de").join(after, ["result_path", "position"], "left_semi").select(F.col("result_path").alias("path")).distinct()


@query("j06_path_locator", f"with {DOCS_SQL}, c as (select distinct 'docs/src' || event_id % 25 || '/' || event_id as path from events) select c.path, docs.version from c left join docs using (path)")
def _(spark, sf):
    e = table(spark, sf, "events")
    c = e.select(F.concat(F.lit("docs/src"), (F.col("event_id") % 25).cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("path")).distinct()
    return c.join(D.docs_index(spark, sf).select(F.col("source_path").alias("path"), F.col("source_version").alias("version")), "path", "left")


def _prefixes(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat(F.lit("docs/"), "source").alias("prefix")).distinct().unionByName(spark.createDataFrame([("",), ("docs",), ("doc",)], "prefix string"))


@query("j07_ancestor_prefixes", f"with {DOCS_SQL}, p as (select distinct 'docs/' || source as prefix from documents union all values (''), ('docs'), ('doc')) select prefix, count(*) as n from docs join p on prefix = '' or path = prefix or starts_with(path, prefix || '/') group by prefix")
def _(spark, sf):
    rows = D.docs_index(spark, sf).select(F.col("source_path").alias("path"), F.lit(1).alias("one"))
    return accounting.by_prefix(rows, _prefixes(spark, sf), n="one")


_ACL = authz.Schema(
    {
        "user": {},
        "team": {"member": authz.Direct((authz.Selector("object", "user"),))},
        "region": {"viewer": authz.Direct((authz.Selector("object", "user"), authz.Selector("userset", "team", "member"))), "view": authz.Permission((authz.Inherit("viewer"),))},
        "nation": {
            "parent": authz.Direct((authz.Selector("object", "region"),)),
            "viewer": authz.Direct((authz.Selector("object", "user"),)),
            "view": authz.Permission((authz.Inherit("viewer"), authz.Through("parent", "view"))),
        },
        "customer": {"parent": authz.Direct((authz.Selector("object", "nation"),)), "view": authz.Permission((authz.Through("parent", "view"),))},
    }
).compile()
_SEES = "select n_nationkey from nation where n_regionkey = 1 or (n_nationkey % 3 = 0 and n_nationkey % 5 = 1)"


@query("j08_userset_traversal", f"select c_custkey::varchar as id from customer where c_nationkey in ({_SEES})")
def _(spark, sf):
    return authz.objects_of(("user", "u1"), "customer", "view", D.tuples(spark, sf), _ACL)


def _chains(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("payload"))
    return grouplog.build_chains(o, "o_custkey", "o_orderkey", "payload")


_CHAIN_SQL = """chain as (select o_custkey as grp, row_number() over (partition by o_custkey order by o_orderkey, o_orderpriority) as idx, o_orderkey || ':' || o_orderpriority as payload from orders)"""


@query("j09_continuation", f"with {_CHAIN_SQL} select grp as group_id, idx as index, payload from chain where idx > grp % 4")
def _(spark, sf):
    e = _chains(spark, sf)
    return e.where(F.col("index") > F.col("group") % 4).select(F.col("group").alias("group_id"), "index", "payload")


# --- order, pages, ranking (R) -------------------------------------------------------------------------------------------
_SORTED = "order by (case when not size_present then 2 when size is null then 0 else 1 end), size nulls first, path, version"
_SORTED_DOWN = "order by (case when not size_present then 2 when size is null then 0 else 1 end) desc, size desc nulls last, path, version"


def _parts_page(spark, sf, order, limit=0, cursor=None, p=Q.EVERY):
    return search.select_page(D.parts_index(spark, sf), PARTS, p, order, limit, cursor).select(F.col("result_path").alias("path"), F.col("size.v").alias("size"))


@query("r01_order_by", f"with {PARTS_SQL} select path, size from parts order by brand, price desc, path limit 60")
def _(spark, sf):
    return _parts_page(spark, sf, (("brand", False), ("price", True)), 60)


@query("r02_null_missing_ascending", f"with {PARTS_SQL} select path, size from parts {_SORTED} limit 150")
def _(spark, sf):
    return _parts_page(spark, sf, (("size", False),), 150)


@query("r02_null_missing_descending", f"with {PARTS_SQL} select path, size from parts {_SORTED_DOWN} limit 150")
def _(spark, sf):
    return _parts_page(spark, sf, (("size", True),), 150)


@query("r03_tie_break", f"with {DOCS_SQL} select path from docs order by lang desc, path, version limit 70")
def _(spark, sf):
    return search.select_page(D.docs_index(spark, sf), DOCS, Q.EVERY, (("lang", True),), 70).select(F.col("result_path").alias("path"))


@query("r04_top_k", f"with {DOCS_SQL} select path, n_chars from docs order by n_chars desc, path limit 10")
def _(spark, sf):
    return search.select_page(D.docs_index(spark, sf), DOCS, Q.EVERY, (("n_chars", True),), 10).select(F.col("result_path").alias("path"), F.col("n_chars.v").alias("n_chars"))


@query("r05_physical_order", f"with {DOCS_SQL} select path, n_chars from docs order by n_chars desc, path limit 20")
def _(spark, sf):
    """The same from a table kept in that order: row groups have narrow ranges."""
    path = folder(spark)
    D.docs_index(spark, sf).repartitionByRange(4, F.col("n_chars.v").desc()).sortWithinPartitions(F.col("n_chars.v").desc()).write.parquet(path)
    return search.select_page(spark.read.parquet(path), DOCS, Q.EVERY, (("n_chars", True),), 20).select(F.col("result_path").alias("path"), F.col("n_chars.v").alias("n_chars"))


@query("r06_keyset_page", f"with {PARTS_SQL}, o as (select *, row_number() over ({_SORTED}) as rn from parts) select path, size from o where rn > 120 and rn <= 170")
def _(spark, sf):
    """The page after the 120th record, by its sort values."""
    terms = search.order_terms(PARTS, (("size", False),))
    keyed = D.parts_index(spark, sf).select("*", F.array(*(c.cast("string") for c, _, _ in terms)).alias("_c"))
    last = keyed.orderBy(*search.ordering(terms)).limit(120).orderBy(*(c.desc_nulls_last() for c, _, _ in terms)).limit(1).collect()
    return _parts_page(spark, sf, (("size", False),), 50, last[0]["_c"] if last else None)


@query("r07_page_size", "select 100 as zero, 1000 as most")
def _(spark, sf):
    return spark.createDataFrame([(search.page_size(0), search.page_size(1000))], "zero int, most int")


@query("r08_next_token", "select count(*) // 50 + 1 as pages, count(*) as hits, true as last_is_short from part")
def _(spark, sf):
    """All pages of 50 by their tokens, counted; a full last page is followed by an empty one. The index is written once and read in one pass, ahead of the pages."""
    d, secret, token, pages, hits, n, ahead = PARTS, b"secret", None, 0, 0, 50, search.Ahead()
    path = folder(spark)
    bind = search.Binding("me", d.index_id, d.version, search.query_hash(Q.EVERY, ()), 1, 1)
    D.parts_index(spark, sf).write.parquet(path)
    index = spark.read.parquet(path)
    while True:
        rows, token = search.fetch(index, d, bind, secret, limit=n, token=token, ahead=ahead)
        pages, hits = pages + 1, hits + len(rows)
        if token is None:
            break
    return spark.createDataFrame([(pages, hits, len(rows) < n)], "pages long, hits long, last_is_short boolean")


@query("r09_analyzer", "select p_partkey, [lower(x) for x in regexp_extract_all(p_name || '-X1 Élan_b', '[\\pL\\pN]+')] as tokens from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.analyze(F.concat("p_name", F.lit("-X1 Élan_b"))).alias("tokens"))


@query("r10_full_text_any_field", f"with {TALK_SQL} select path from talk where (list_contains(w, 'user') or coalesce(list_contains(role, 'user'), false)) and list_contains(w, 'the')")
def _(spark, sf):
    return D.text_records(spark, sf).where(search.matches(["text", "role"], ["user", "the"])).select(F.col("result_path").alias("path"))


def _bm25_sql(select: str, tail: str) -> str:
    return f"""with {TALK_SQL},
st as (select count(*)::double as n, greatest(avg(len(w)), 1.0) as avgdl, count(*) filter (list_contains(w, 'the'))::double as df0, count(*) filter (list_contains(w, 'and'))::double as df1 from talk),
hit as (select path, len(w) as dl, len(list_filter(w, lambda t: t = 'the'))::double as f0, len(list_filter(w, lambda t: t = 'and'))::double as f1 from talk where list_contains(w, 'the') and list_contains(w, 'and')),
sc as (select path,
  ln(1 + greatest(n - df0 + 0.5, 0) / (df0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + greatest(n - df1 + 0.5, 0) / (df1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) as score from hit, st)
select {select} from sc {tail}"""


@query("r11_bm25", _bm25_sql("path, round(score, 3) as score", ""))
def _(spark, sf):
    r = D.text_records(spark, sf)
    tokens = search.text_query("the AND")
    rows = r.where(search.matches(["text"], tokens)).join(F.broadcast(search.statistics(r, ["text"], tokens)))
    return rows.select(F.col("result_path").alias("path"), F.round(search.bm25(["text"], tokens), 3).alias("score"))


@query("r12_statistics_scope", _bm25_sql("path, round(score, 3) as score", "where path like 'talk/1%'"))
def _(spark, sf):
    """Who may see what doesn't change the statistics."""
    r = D.text_records(spark, sf)
    seen = r.where(F.col("result_path").startswith("talk/1"))
    tokens = search.text_query("the and")
    rows = seen.where(search.matches(["text"], tokens)).join(F.broadcast(search.statistics(r, ["text"], tokens)))
    return rows.select(F.col("result_path").alias("path"), F.round(search.bm25(["text"], tokens), 3).alias("score"))


@query("r11_bm25_top", _bm25_sql("path", "order by score::float desc, path limit 5"))
def _(spark, sf):
    return search.search_text(D.text_records(spark, sf), ["text"], "the and", 5).select(F.col("result_path").alias("path"))


_QUERY = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_Q_SQL = "[" + ", ".join(repr(x) for x in _QUERY) + "]"


def _vector_records(spark, sf):
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("v/"), F.col("vec_id").cast("string")).alias("path"), F.col("vec_id").alias("version"), F.lit("x").alias("content_type"), F.col("embedding").alias("vector"))
    return projection.vectors(e, Definition("v", kind="vector", dimensions=64))


for _metric, _sql in (
    ("dot", f"list_dot_product(embedding::double[], {_Q_SQL}::double[])"),
    ("cosine", f"list_cosine_similarity(embedding::double[], {_Q_SQL}::double[])"),
    ("euclidean", f"-list_distance(embedding::double[], {_Q_SQL}::double[])"),
):

    @query(f"r13_vector_{_metric}", f"select 'v/' || vec_id as path, round({_sql}, 4) + 0.0 as score from embeddings")
    def _(spark, sf, metric=_metric):
        d = Definition("v", kind="vector", dimensions=64, metric=metric)
        return _vector_records(spark, sf).select(F.col("result_path").alias("path"), (F.round(search.similarity("vector", search.query_vector(d, _QUERY), metric), 4) + 0.0).alias("score"))  # + 0.0: no negative zero


@query("r13_vector_top", f"select 'v/' || vec_id as path from embeddings order by list_dot_product(embedding::double[], {_Q_SQL}::double[])::float desc, path limit 10")
def _(spark, sf):
    return search.search_vector(_vector_records(spark, sf), Definition("v", kind="vector", dimensions=64), _QUERY, 10).select(F.col("result_path").alias("path"))


@query("r14_query_normalisation", "select 1.0::double as norm")
def _(spark, sf):
    q = search.query_vector(Definition("v", kind="vector", dimensions=64, normalize=True), _QUERY)
    return spark.createDataFrame([(round(sum(x * x for x in q) ** 0.5, 5),)], "norm double")


@query("r15_dimension_check", "select true as refused")
def _(spark, sf):
    try:
        search.query_vector(Definition("v", kind="vector", dimensions=3), _QUERY)
    except Invalid:
        return spark.createDataFrame([(True,)], "refused boolean")
    raise AssertionError


@query(
    "r16_hybrid",
    f"""with t as (select doc_id, embedding, regexp_extract_all(text, '[\\pL\\pN\\pM\\p{{Nl}}]+') as w0 from documents join embeddings on doc_id = vec_id),
t2 as (select doc_id, embedding, list_transform(w0, lambda x: lower(x)) as w from t),
st as (select count(*)::double as n, greatest(avg(len(w)), 1.0) as avgdl, count(*) filter (list_contains(w, 'the'))::double as df from t2),
hit as (select *, len(list_filter(w, lambda x: x = 'the'))::double as f from t2 where list_contains(w, 'the'))
select 'h/' || doc_id as path, round(2.0 * (ln(1 + greatest(n - df + 0.5, 0) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / avgdl))) + 0.5 * list_dot_product(embedding::double[], {_Q_SQL}::double[]), 3) + 0.0 as score from hit, st""",
)
def _(spark, sf):
    d = replace(_HYBRID, text_weight=2.0, vector_weight=0.5)
    r = projection.hybrid(_hybrid_objects(spark, sf), d)
    wt, wv = d.weights()
    rows = r.where(search.matches(["text"], ["the"])).join(F.broadcast(search.statistics(r, ["text"], ["the"])))
    score = wt * search.bm25(["text"], ["the"]) + wv * search.similarity("vector", _QUERY, "dot")
    return rows.select(F.col("result_path").alias("path"), (F.round(score, 3) + 0.0).alias("score"))


@query("r17_hybrid_weights", "select 1.0::double as text_weight, 1.0::double as vector_weight, true as one_zero_refused")
def _(spark, sf):
    wt, wv = _HYBRID.weights()
    try:
        replace(_HYBRID, text_weight=1.0).validate()
        refused = False
    except Invalid:
        refused = True
    return spark.createDataFrame([(wt, wv, refused)], "text_weight double, vector_weight double, one_zero_refused boolean")


def _text_index(spark, sf) -> textindex.TextIndex:
    path = folder(spark, "text_index")
    textindex.write(D.text_records(spark, sf), ["text", "role"], path)
    return textindex.TextIndex(spark, path)


@query("r18_block_max", _bm25_sql("path, round(score::float, 2)::double as score", "order by score::float desc, path limit 8"))
def _(spark, sf):
    """From persisted postings, without the blocks that can't hold a hit."""
    r = _text_index(spark, sf).search(["text"], "the and", 8)
    return r.select(F.col("result_path").alias("path"), F.round(F.col("score"), 2).cast("double").alias("score"))


@query("r18_without_skipping", _bm25_sql("path, round(score, 3) as score", "order by score::float desc, path limit 1000"))
def _(spark, sf):
    r = _text_index(spark, sf).search(["text"], "and the", 1000, prune=False)
    return r.select(F.col("result_path").alias("path"), F.round(F.col("score").cast("double"), 3).alias("score"))


@query("r18_index_phrase", f"with {TALK_SQL} select path from talk where contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def _(spark, sf):
    return _text_index(spark, sf).phrase("text", "of, the!").select(F.col("result_path").alias("path"))


@query("r19_scores", _bm25_sql("path, round(score::float, 2)::double as score", "order by score::float desc, path limit 8"))
def _(spark, sf):
    return search.search_text(D.text_records(spark, sf), ["text"], "the and", 8).select(F.col("result_path").alias("path"), F.round(F.col("score"), 2).cast("double").alias("score"))


# --- facets and aggregates (A) -------------------------------------------------------------------------------------------
@query("a01_facet", f"with {PARTS_SQL}, v as (select unnest(words) as v from parts) select to_json(v)::varchar as value, count(*) as n from v group by v order by n desc, v limit 5")
def _(spark, sf):
    return compute.facet(D.parts_index(spark, sf), PARTS, "words", 5)


@query("a01_facet_null", f"with {PARTS_SQL} select coalesce(size::varchar, 'null') as value, count(*) as n from parts where size_present group by size order by n desc, size nulls first limit 12")
def _(spark, sf):
    return compute.facet(D.parts_index(spark, sf), PARTS, "size", 12)


@query("a02_facet_ties", f"with {DOCS_SQL} select to_json(source)::varchar as value, count(*) as n from docs where lang = 'en' group by source order by n desc, source limit 7")
def _(spark, sf):
    return compute.facet(D.docs_index(spark, sf).where(Q.compile_(Q.equal("lang", "en"), DOCS)), DOCS, "source", 7)


def _aggregate(name: str, op: str, field: str, sql: str) -> None:
    @query(name, f"with {PARTS_SQL}, v as (select unnest({'digits' if field == 'digits' else f'[{field}]'}) as v from parts) select count(v) as n, {sql} as x from v")
    def _(spark, sf):
        r = compute.aggregate(D.parts_index(spark, sf), PARTS, [(field, op)])
        x = F.round(f"{op}_{field}", 4) if op in ("average",) or field == "price" else F.col(f"{op}_{field}")
        return r.select(F.col(f"n_{field}").alias("n"), (x.cast("double") if field in ("key", "price") or op == "average" else x.cast("long")).alias("x"))


_aggregate("a03_count", "count", "digits", "count(v)")
_aggregate("a04_minimum", "minimum", "size", "min(v)")
_aggregate("a05_maximum", "maximum", "digits", "max(v)")
_aggregate("a06_sum", "sum", "digits", "sum(v)::bigint")
_aggregate("a06_sum_unsigned", "sum", "key", "sum(v)::double")
_aggregate("a06_sum_float", "sum", "price", "round(sum(v), 4)")
_aggregate("a07_average", "average", "size", "round(avg(v), 4)")


@query("a08_contributing", f"with {PARTS_SQL} select count(size) as n_size, coalesce(sum(len(digits)), 0)::bigint as n_digits from parts")
def _(spark, sf):
    return compute.aggregate(D.parts_index(spark, sf), PARTS, [("size", "sum"), ("digits", "count")]).select("n_size", "n_digits")


@query("a09_admission", "select true as refused")
def _(spark, sf):
    for f, a in (([("brand", 0)], []), ([], [("brand", "sum")]), ([], [("size", "sum"), ("size", "sum")])):
        try:
            compute.admit(PARTS, f, a)
        except Invalid:
            continue
        raise AssertionError
    return spark.createDataFrame([(True,)], "refused boolean")


@query("a10_empty", "select 0::bigint as n, null::bigint as total")
def _(spark, sf):
    r = compute.aggregate(D.parts_index(spark, sf).where(Q.compile_(Q.equal("brand", "none"), PARTS)), PARTS, [("size", "sum")])
    return r.select(F.col("n_size").alias("n"), F.col("sum_size").alias("total"))


@query("a11_segment_statistics", f"with {PARTS_SQL} select count(*) as records, count(*) filter (size_present) as present_size, count(*) filter (size_present and size_null) as null_size, count(size) as values_size, sum(len(words))::bigint as values_words from parts")
def _(spark, sf):
    return compute.segment_statistics(D.parts_index(spark, sf), PARTS).select("records", "present_size", "null_size", "values_size", "values_words")


_ACCOUNTS_SQL = "defs as (select distinct 'users/' || user_id as prefix from events where user_id < 20 union all values ('users'), (''), ('user'))"


def _accounts(spark, sf):
    e = table(spark, sf, "events").where("user_id < 20").select(F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("prefix")).distinct()
    return e.unionByName(spark.createDataFrame([("users",), ("",), ("user",)], "prefix string"))


_USAGE = "select d.prefix, count(distinct case when not h.deleted then h.path end) as object_count, coalesce(sum(v.length), 0)::bigint as logical_bytes from defs d left join versions v on d.prefix = '' or v.path = d.prefix or starts_with(v.path, d.prefix || '/') left join heads h on h.path = v.path group by d.prefix"


@query("a12_accounting_baseline", f"with {VERSIONS_SQL}, {_ACCOUNTS_SQL} {_USAGE}")
def _(spark, sf):
    return accounting.baseline(D.versions(spark, sf), _accounts(spark, sf))


@query("a13_accounting_incremental", f"with {VERSIONS_SQL}, {_ACCOUNTS_SQL} {_USAGE}")
def _(spark, sf):
    """A baseline of the first versions and the deltas of the others."""
    v, defs = D.versions(spark, sf), _accounts(spark, sf)
    first, rest = v.where("version < 600"), v.where("version >= 600")
    return accounting.add(accounting.baseline(first, defs), accounting.deltas(objects.heads(first), rest, defs))


@query("a14_traffic", f"with {VERSIONS_SQL}, {_ACCOUNTS_SQL} select prefix, sum(length)::bigint as inbound, sum(version)::bigint as outbound from versions v join defs d on d.prefix = '' or v.path = d.prefix or starts_with(v.path, d.prefix || '/') where not deleted group by prefix")
def _(spark, sf):
    v = D.versions(spark, sf).where("not deleted").select((F.col("version") % 3).alias("node"), F.col("version").alias("flush_id"), "path", F.col("length").alias("inbound"), F.col("version").alias("outbound"))
    return accounting.traffic(v.unionByName(v.where("version % 2 = 0")), _accounts(spark, sf))


@query("a16_percentiles", "select round(avg(value), 6) as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events")
def _(spark, sf):
    return compute.nearest_rank(table(spark, sf, "events"), "value", (50, 95, 99)).withColumn("mean", F.round("mean", 6))


# --- scalar functions (X) ------------------------------------------------------------------------------------------------
@query("x01_json_select", "select event_id, json_extract(props, '$.k')::bigint as k, json_extract(props, '$.k')::bigint as nested from events")
def _(spark, sf):
    projection.configure(spark)
    e = table(spark, sf, "events")
    v = F.try_parse_json("props")
    n = F.try_parse_json(F.concat(F.lit('{"a/b": [0, '), "props", F.lit(', {"1": 2}]}')))
    return e.select("event_id", F.try_variant_get(X.pointer_get(v, "/k"), "$", "long").alias("k"), F.try_variant_get(X.pointer_get(n, "/a~1b/1/k"), "$", "long").alias("nested"))


@query(
    "x02_x04_json_edit",
    """with d as (select event_id, json_extract(props, '$.k')::bigint as k from events)
select event_id, '{"a":[1,' || event_id || '],"k":' || k || '}' as set_element, '{"a":[' || k || '],"k":' || k || '}' as removed, '{"a":[1,' || k || '],"k":' || k || ',"b~/":' || event_id || '}' as added,
  null::varchar as beyond, null::varchar as leading_zero, '"é"' as whole from d""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    doc = F.concat(F.lit('{"a": [1, '), "k", F.lit('], "k":'), "k", F.lit("}"))
    own = F.col("event_id").cast("string")
    return e.select(
        "event_id", X.set_column(doc, "/a/1", own).alias("set_element"), X.remove_column(doc, "/a/0").alias("removed"), X.set_column(doc, "/b~0~1", own).alias("added"), X.remove_column(doc, "/a/2").alias("beyond"),
        X.set_column(doc, "/a/00", own).alias("leading_zero"), X.set_column(doc, "", F.lit('"é"')).alias("whole"),
    )


@query(
    "x05_x06_checked_arithmetic",
    """with d as (select l_orderkey, l_linenumber, l_partkey, 9223372036854775807::hugeint - l_partkey % 3 as a, l_linenumber % 4 as b, l_partkey - l_suppkey as c from lineitem)
select l_orderkey, l_linenumber, case when a + b <= 9223372036854775807 then (a + b)::varchar end as total, case when c between 0 and 100 then c end as bounded,
  case when l_partkey % 2 = 0 then '18446744073709551615' end as wide, b < 2 as less from d""",
)
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    top, n = F.lit(2**63 - 1) - F.col("l_partkey") % 3, (F.col("l_linenumber") % 4).cast("long")
    wide = X.add_column(F.lit(Decimal(2**64 - 1)).cast("decimal(20,0)"), F.col("l_partkey") % 2, unsigned=True)
    return l.select(
        "l_orderkey", "l_linenumber", X.add_column(top, n).cast("string").alias("total"), X.add_column(F.col("l_partkey"), -F.col("l_suppkey"), least=0, most=100).alias("bounded"), wide.cast("string").alias("wide"),
        X.compare_columns("lt", n, F.lit(2)).alias("less"),
    )


@query("x07_template", "select c_custkey, 'users/' || c_custkey || '/{' || c_mktsegment || '}' as path from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.expand_column("users/{id}/{{{segment}}}", {"id": F.col("c_custkey"), "segment": F.col("c_mktsegment")}).alias("path"))


@query("x09_order_keys", "select p_partkey, true as by_text, true as by_number, true as by_float, true as down from part")
def _(spark, sf):
    """Each part's place among those with the next text, number and fraction is the same by its key. lead() over ranges of a brand, so no task holds all parts."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 10 != 3, F.concat(F.lit("a\0"), "p_name")).alias("t"), (F.col("p_partkey") * 7 - 500 * F.col("p_size")).alias("n"), (F.col("p_retailprice") - 1000).alias("d"))

    def agrees(c: str, kind: str, down: bool = False):
        w = Window.partitionBy("p_brand", "t_").orderBy(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first(), "p_partkey")
        mine, after = X.order_key(F.col(c), kind, down), F.lead(X.order_key(F.col(c), kind, down)).over(w)
        same = F.lead(F.struct(c)).over(w) == F.struct(c)
        return F.coalesce(F.when(same, mine == after).otherwise(mine < after), F.lit(True))

    p = p.withColumn("t_", F.col("p_partkey") % 50)
    return p.select("p_partkey", agrees("t", "string").alias("by_text"), agrees("n", "long").alias("by_number"), agrees("d", "double").alias("by_float"), agrees("n", "long", True).alias("down"))


@query(
    "x15_placement",
    """with n(node, w) as (values (1, 1.0), (2, 2.0), (3, 1.0), (4, 0.5)), s as (select p_partkey, node, -log2((('0x' || substr(sha256('parts/' || p_partkey || chr(0) || node), 1, 13))::bigint + 0.5) / 4503599627370496.0) / w as d from part, n)
select p_partkey, string_agg(node, ',' order by d, node) as nodes from s group by p_partkey""",
)
def _(spark, sf):
    nodes = {1: 1.0, 2: 2.0, 3: 1.0, 4: 0.5}
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.rendezvous(F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")), nodes), ",").alias("nodes"))


@query("x08_canonical_scalars", "select p_partkey, to_json(p_name)::varchar as name, p_size::varchar as size from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.canonical_column(F.col("p_name"), "string").alias("name"), X.canonical_column(F.col("p_size"), "int").alias("size"))


@query(
    "x10_x13_normalisation",
    """with d as (select p_partkey, trim([' PyPI', 'npm', 'Cargo', 'crates.io', 'Maven:Central', 'GO '][p_partkey % 6 + 1]) as e, trim('_' || p_brand || '-_' || p_type || '. ') as n from part)
select p_partkey, case lower(e) when 'cargo' then 'crates.io' else lower(e) end as eco, case lower(e) when 'cargo' then 'cargo' when 'crates.io' then 'cargo' when 'npm' then 'npm' when 'pypi' then 'pypi' else 'other' end as part,
  case lower(e) when 'pypi' then array_to_string(list_filter(string_split_regex(lower(n), '[-_.]'), lambda x: x <> ''), '-') when 'npm' then lower(n) else n end as pkg, ['A', 'b'] as texts from d""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    eco = X.ecosystem(F.element_at(F.array(*(F.lit(x) for x in (" PyPI", "npm", "Cargo", "crates.io", "Maven:Central", "GO "))), (F.col("p_partkey") % 6 + 1).cast("int")))
    name = F.concat(F.lit("_"), "p_brand", F.lit("-_"), "p_type", F.lit(". "))
    return p.select("p_partkey", eco.alias("eco"), X.partition(eco).alias("part"), X.package(eco, name).alias("pkg"), X.sorted_distinct(F.array(F.lit(" b"), F.lit("A"), F.lit(""), F.lit("b"), F.lit(None))).alias("texts"))


@query("x11_identity", "select p_partkey, sha256(p_brand || chr(0) || p_name) as id from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.identity(F.col("p_brand"), F.col("p_name")).alias("id"))


@query("x12_day", "select o_orderkey, case o_orderkey % 7 when 0 then 'unknown' when 1 then '2024-13-32' else strftime(o_orderdate, '%Y-%m-%d') end as day from orders")
def _(spark, sf):
    """Digits and dashes count, not the calendar."""
    k = F.col("o_orderkey") % 7
    s = F.when(k == 0, "2024/01/01").when(k == 1, "2024-13-32T").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "orders").select("o_orderkey", X.day(s).alias("day"))


# --- mutations (M) -------------------------------------------------------------------------------------------------------
_OPS = ["put", "put_if_absent", "put_if_version", "delete", "delete_if_version", "delete_version", "put_immutable"]


def _ops(spark, sf) -> DataFrame:
    """The second half of the events as operations on what the first half left."""
    v = D.versions(spark, sf).where("version >= 500")
    op = F.element_at(F.array(*(F.lit(o) for o in _OPS)), (F.col("version") % len(_OPS) + 1).cast("int"))
    return v.select(F.col("version").alias("ordinal"), "path", op.alias("op"), (F.col("version") - 150).alias("expected"), "version", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("hash", F.lit("")).alias("hash"), F.when(F.col("version") % 5 == 0, F.concat(F.lit("c"), (F.col("version") % 20).cast("string"))).alias("command_id"))


def _base(spark, sf) -> DataFrame:
    return D.versions(spark, sf).where("version < 500")


@query("m01_put", f"with {VERSIONS_SQL} select path, max(version) as version from versions where not deleted group by path")
def _(spark, sf):
    live = D.versions(spark, sf).where("not deleted")
    log = live.where("version < 500").select("path", "version", "deleted", "length", "hash").unionByName(objects.put(live.where("version >= 500")))
    return objects.heads(log).select("path", "version")


@query("m02_put_if_absent", f"with {VERSIONS_SQL}, b as (select * from versions where version < 500 qualify row_number() over (partition by path order by version desc) = 1), o as (select path, min(version) as version from versions where version >= 500 group by path) select path, version from o where path not in (select path from b where not deleted)")
def _(spark, sf):
    ops = D.versions(spark, sf).where("version >= 500").groupBy("path").agg(F.min_by(F.struct("version", "length", "hash"), "version").alias("o")).select("path", "o.*")
    return objects.put_if_absent(ops, objects.heads(_base(spark, sf))).select("path", "version")


@query("m03_put_if_version", f"with {VERSIONS_SQL}, b as (select path, max(version) as expected from versions where version < 500 group by path) select path, 9000000 + expected as version from b where expected % 2 = 0")
def _(spark, sf):
    h = objects.heads(_base(spark, sf))
    ops = h.select("path", (F.col("version") + F.col("version") % 2).alias("expected"), (F.col("version") + 9000000).alias("version"), F.lit(1).cast("long").alias("length"), F.lit("h").alias("hash"))
    return objects.put_if_version(ops, h).select("path", "version")


@query("m05_delete", f"with {VERSIONS_SQL} select path, true as deleted from heads")
def _(spark, sf):
    v = D.versions(spark, sf)
    ops = v.groupBy("path").agg((F.max("version") + 1).alias("version"))
    cols = ["path", "version", "deleted", "length", "hash"]
    return objects.heads(v.select(*cols).unionByName(objects.delete(ops).select(*cols))).select("path", "deleted")


@query("m07_bulk_write")
def _(spark, sf):
    """Ordered operations of all kinds (M1 to M8), one outcome each."""
    return objects.bulk_write(_ops(spark, sf), _base(spark, sf), immutable=["users/1", "users/2"], program_only=["users/3"]).select("ordinal", "path", "outcome", "version", "replayed")


@query("m04_m06_log_after")
def _(spark, sf):
    """The log after immutable puts and version deletions."""
    base = _base(spark, sf)
    return objects.apply_outcomes(base, objects.bulk_write(_ops(spark, sf), base, immutable=["users/1"]))


@query("m08_replay", f"with {VERSIONS_SQL} select path, 'c' || version % 4 as command_id, min(version) as ordinal, count(*) as sent, count(distinct coalesce(hash, '')) > 1 as conflict from versions group by path, version % 4")
def _(spark, sf):
    v = D.versions(spark, sf)
    ops = v.select(F.col("version").alias("ordinal"), "path", F.lit("put").alias("op"), F.lit(None).cast("long").alias("expected"), "hash", F.concat(F.lit("c"), (F.col("version") % 4).cast("string")).alias("command_id"))
    return objects.replayed_once(ops)


@query("m09_policy", "select distinct 'users/' || user_id as path, case when user_id = 3 then 'program_only' when user_id in (1, 2) then 'immutable' else 'open' end as policy from events")
def _(spark, sf):
    p = D.versions(spark, sf).select("path").distinct()
    return p.select("path", objects.policy_class(F.col("path"), ["users/1", "users/2"], ["users/3"]).alias("policy"))


@query("m10_bucket_configuration", "select true as refused")
def _(spark, sf):
    try:
        objects.check_policy(["a", "a/b"], [])
    except Invalid:
        return spark.createDataFrame([(True,)], "refused boolean")
    raise AssertionError


@query(
    "m11_failure_codes",
    f"""with {VERSIONS_SQL}, b as (select path, max(version) as now from versions where version < 500 group by path),
o as (select version as ordinal, path, row_number() over (partition by path order by version) as k from versions where version >= 500)
select ordinal, case when path = 'users/3' then 9 when path in ('users/1', 'users/2') then 2 else 1 end as code, case when path = 'users/3' then 'authorization_denied' when path in ('users/1', 'users/2') then 'immutable' else 'condition_failed' end as name, now as current_version
from o left join b using (path)""",
)
def _(spark, sf):
    """A write that expects a version that never was: refused, with the current version, by policy or by its condition."""
    v = D.versions(spark, sf).where("version >= 500")
    ops = v.select(F.col("version").alias("ordinal"), "path", F.lit("put_if_version").alias("op"), F.lit(-1).cast("long").alias("expected"), "version", F.lit(1).cast("long").alias("length"), F.lit("h").alias("hash"), F.lit(None).cast("string").alias("command_id"))
    done = objects.bulk_write(ops, _base(spark, sf), immutable=["users/1", "users/2"], program_only=["users/3"])
    return done.select("ordinal", objects.failure(F.col("outcome"), F.col("version")).alias("f")).select("ordinal", "f.code", "f.name", "f.current_version")


# --- journals and generations (T) ----------------------------------------------------------------------------------------
@query("t01_watch_prefix", f"with {JOURNAL_SQL} select source, off as entry, path, version as minimum_version, case when deleted then 'deleted' else 'present' end as hint from journal where path = 'users/1' or starts_with(path, 'users/1/')")
def _(spark, sf):
    return journal.invalidations(D.journal(spark, sf), "users/1").withColumnRenamed("offset", "entry")


@query("t01_watch_stream", f"with {JOURNAL_SQL} select path, count(*) as n, max(version) as minimum_version from journal where path in ('users/4') group by path")
def _(spark, sf):
    src, out, ck = folder(spark), folder(spark), folder(spark)
    D.journal(spark, sf).drop("length").repartition(3).write.parquet(src)
    journal.watch(spark, src, "users/4", lambda df, i: df.write.mode("append").parquet(out), ck).awaitTermination()
    return spark.read.parquet(out).groupBy("path").agg(F.count("*").alias("n"), F.max("minimum_version").alias("minimum_version"))


@query("t02_start", f"with {JOURNAL_SQL} select source, max(off) + 1 as now, min(off) as beginning from journal group by source")
def _(spark, sf):
    j = D.journal(spark, sf)
    now, first = journal.start_checkpoint(j, "now"), journal.start_checkpoint(j, "beginning")
    return spark.createDataFrame([(s, now[s], first[s]) for s in sorted(now)], "source string, now long, beginning long")


@query("t03_page", f"with {JOURNAL_SQL} select source, off as entry, path from journal where off >= 20 and off < 60 and (path = 'users/7')")
def _(spark, sf):
    j = D.journal(spark, sf)
    p = journal.page(j, j.select("source").distinct().withColumn("next", F.lit(20).cast("long")), 40)
    return journal.invalidations(p, "users/7").select("source", F.col("offset").alias("entry"), "path")


@query("t04_vector_checkpoint", f"with {JOURNAL_SQL} select source, least(max(off) + 1, 60) as next from journal group by source")
def _(spark, sf):
    j = D.journal(spark, sf)
    at = j.select("source").distinct().withColumn("next", F.lit(20).cast("long"))
    return journal.advanced(journal.page(j, at, 40), at)


@query("t05_settled", f"with {JOURNAL_SQL} select source, case source when 'n0' then least(max(off), 9) when 'n1' then least(max(off), 19) else max(off) end as settled from journal group by source")
def _(spark, sf):
    j = D.journal(spark, sf).where("not (source = 'n0' and offset = 10) and not (source = 'n1' and offset in (20, 25))")
    return journal.settled(j)


def _user_project(changes: DataFrame) -> DataFrame:
    return changes.select(F.col("path").alias("source_path"), F.col("version").alias("source_version"), F.lit(0).cast("long").alias("source_record"), F.col("path").alias("result_path"), F.col("version").alias("result_version"), projection.native_cell(F.col("length")).alias("length"))


_USERS = Builder(Definition("users")).signed("length", Cap.RANGE, Cap.ORDER).build()


def _generations(spark, sf, steps: int) -> generation.Index:
    ix = generation.Index(spark, folder(spark), _USERS)
    v = D.versions(spark, sf)
    n = v.agg(F.max("version")).first()[0] + 1
    cuts = [n * i // (steps + 1) for i in range(steps + 2)]
    ix.rebuild(objects.heads(v.where(F.col("version") < cuts[1])), {"n": cuts[1]}, _user_project)
    for a, b in zip(cuts[1:], cuts[2:], strict=False):
        ix.catch_up(v.where((F.col("version") >= a) & (F.col("version") < b)), {"n": b}, _user_project)
    return ix


_LIVE = f"with {VERSIONS_SQL} select path, version, length from heads where not deleted"


def _live(df: DataFrame) -> DataFrame:
    return df.select(F.col("source_path").alias("path"), F.col("source_version").alias("version"), F.col("length.v").alias("length"))


@query("t07_catch_up", _LIVE)
def _(spark, sf):
    return _live(_generations(spark, sf, 2).read())


@query("t08_rebuild", _LIVE)
def _(spark, sf):
    return _live(_generations(spark, sf, 0).read())


@query("t07_catch_up_stream", _LIVE)
def _(spark, sf):
    """The same by Structured Streaming over a journal folder."""
    src = folder(spark)
    j = D.journal(spark, sf)
    j.where("version >= 300").repartition(2).write.parquet(src)
    ix = generation.Index(spark, folder(spark), _USERS)
    ix.rebuild(objects.heads(j.where("version < 300")), {}, _user_project)
    ix.follow(src, ", length long", _user_project, folder(spark)).awaitTermination()
    return _live(ix.read())


@query("t09_group_visibility", "select 2 as before, 3 as after")
def _(spark, sf):
    """A pinned reader sees a generation whole, before and after the next is published."""
    ix = _generations(spark, sf, 1)
    before = ix.current().number
    v = D.versions(spark, sf)
    ix.catch_up(v.where("version % 100 = 1").withColumn("version", F.col("version") + 10**6), {"n": 10**6}, _user_project)
    return spark.createDataFrame([(before, ix.current().number)], "before int, after int")


@query("t10_late_data", _LIVE)
def _(spark, sf):
    """Pages in the wrong order, and one twice: the highest version wins."""
    ix = generation.Index(spark, folder(spark), _USERS)
    v = D.versions(spark, sf)
    ix.rebuild(objects.heads(v.where("version < 300")), {}, _user_project)
    ix.catch_up(v.where("version >= 600"), {}, _user_project)
    late = v.where("version >= 300 and version < 600")  # of paths with newer versions too
    ix.catch_up(late, {}, _user_project)
    ix.catch_up(late.unionByName(late), {}, _user_project)
    return _live(ix.read())


@query("t11_incremental_accounting", f"with {VERSIONS_SQL}, {_ACCOUNTS_SQL} {_USAGE}")
def _(spark, sf):
    v, defs = D.versions(spark, sf), _accounts(spark, sf)
    total, cuts = accounting.baseline(v.where("version < 200"), defs), (200, 400, 10**12)
    for a, b in zip(cuts, cuts[1:], strict=False):
        total = accounting.add(total, accounting.deltas(objects.heads(v.where(F.col("version") < a)), v.where((F.col("version") >= a) & (F.col("version") < b)), defs))
    return total


@query("t12_compaction", _LIVE)
def _(spark, sf):
    ix = _generations(spark, sf, 3)
    ix.compact()
    return _live(ix.read())


@query("t13_retention", "select 4 as kept, 5 as newest")
def _(spark, sf):
    day = 86400.0
    every = [generation.Generation(i, "f", {}, [], created=(day * 2 if i >= 2 else 0.0) + i) for i in range(6)]
    kept = generation.retained(every, day * 2.5)
    return spark.createDataFrame([(len(kept), kept[-1].number)], "kept int, newest int")


@query("t14_freshness", f"with {JOURNAL_SQL} select source, 50 as indexed_next_offset, max(off) + 1 as observed_tail, max(off) + 1 - 50 as lag from journal group by source")
def _(spark, sf):
    j = D.journal(spark, sf)
    return journal.freshness(j, j.select("source").distinct().withColumn("next", F.lit(50)))


@query(
    "t15_traffic_buffer",
    f"with {VERSIONS_SQL}, {_ACCOUNTS_SQL} select prefix, sum(coalesce(length, 0))::bigint as inbound, count(*)::bigint as outbound from defs a join versions v on a.prefix = '' or v.path = a.prefix or starts_with(v.path, a.prefix || '/') group by prefix",
)
def _(spark, sf):
    """Buffered by second in a stream, some sent twice, then summed up by prefix."""
    src, out = folder(spark, "sent"), folder(spark, "totals")
    sent = D.versions(spark, sf).select(F.concat(F.lit("n"), (F.col("version") % 3).cast("string")).alias("node"), F.col("version").alias("flush_id"), "path", F.coalesce("length", F.lit(0)).alias("inbound"), F.lit(1).cast("long").alias("outbound"))
    sent.unionByName(sent.where("flush_id % 5 = 0")).repartition(3, "flush_id").write.parquet(src)
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(src)
    accounting.flush(stream, out, folder(spark, "checkpoint"), every=None).awaitTermination()
    return accounting.traffic(spark.read.parquet(out), _accounts(spark, sf))


# --- authorization (Z) ---------------------------------------------------------------------------------------------------
@query("z01_schema", "select 5 as rules, 7 as selectors")
def _(spark, sf):
    return spark.createDataFrame([(_ACL.rules(spark).count() + 1, _ACL.selectors(spark).count() + 1)], "rules int, selectors int")


@query("z02_bindings", "select 1 as first, true as stale_refused")
def _(spark, sf):
    b = authz.Bindings(Document(spark, folder(spark, "bindings")))
    b.put("acl", _ACL)
    first = b.bind("realm", "acl", 0)
    try:
        b.bind("realm", "acl", 0)
        refused = False
    except Invalid:
        refused = True
    return spark.createDataFrame([(first, refused)], "first int, stale_refused boolean")


@query("z03_mutate_tuples", "select count(*) filter (n_nationkey % 2 = 1) as live, count(*) filter (n_nationkey % 2 = 0) as removed from nation")
def _(spark, sf):
    t = D.tuples(spark, sf).where("namespace = 'nation' and relation = 'parent'")
    gone = t.where("cast(id as int) % 2 = 0")
    m = authz.mutate(t, t.where("cast(id as int) % 2 = 1"), gone, 9)
    return m.agg(F.count_if(F.col("removed").isNull()).alias("live"), F.count_if(F.col("removed") == 9).alias("removed"))


@query("z04_read_tuples", "select c_custkey::varchar as id from customer where c_nationkey = 3 order by id limit 20")
def _(spark, sf):
    return authz.read_tuples(D.tuples(spark, sf), "customer", None, "parent", ("nation", "3"), None, 20).select("id")


@query("z05_check", f"select true as allowed, count(*) as n from customer where c_nationkey in ({_SEES}) union all select false, count(*) from customer where c_nationkey not in ({_SEES})")
def _(spark, sf):
    c = table(spark, sf, "customer")
    r = c.select(F.col("c_custkey").alias("ordinal"), F.lit("customer").alias("namespace"), F.col("c_custkey").cast("string").alias("id"), F.lit("view").alias("permission"), F.lit("user").alias("subject_namespace"), F.lit("u1").alias("subject_id"))
    return authz.check(r, D.tuples(spark, sf), _ACL).groupBy("allowed").agg(F.count("*").alias("n"))


@query("z06_check_batch", "select c_custkey as ordinal, n_regionkey = c_custkey % 5 or (n_nationkey % 3 = 0 and n_nationkey % 5 = c_custkey % 5) as allowed from customer join nation on c_nationkey = n_nationkey")
def _(spark, sf):
    c = table(spark, sf, "customer")
    r = c.select(F.col("c_custkey").alias("ordinal"), F.lit("customer").alias("namespace"), F.col("c_custkey").cast("string").alias("id"), F.lit("view").alias("permission"), F.lit("user").alias("subject_namespace"), F.concat(F.lit("u"), (F.col("c_custkey") % 5).cast("string")).alias("subject_id"))
    return authz.check(r, D.tuples(spark, sf), _ACL)


@query("z07_admission", "select count(*) as kept from nation where n_nationkey % 3 = 0")
def _(spark, sf):
    t = D.tuples(spark, sf).where("namespace = 'nation' and relation = 'viewer'")
    wrong = t.withColumn("subject_namespace", F.lit("region"))
    return authz.admitted(t.unionByName(wrong), _ACL).agg(F.count("*").alias("kept"))


@query("z08_revisions", "select 0 as at_one, count(*) filter (n_nationkey % 3 = 0) as at_two from nation")
def _(spark, sf):
    t = D.tuples(spark, sf).where("namespace = 'nation' and relation = 'viewer'")
    return spark.createDataFrame([(authz.at_revision(t, 1).count(), authz.consistent(t, at_least=2).count())], "at_one int, at_two long")


@query("z10_public", "select count(*) as n from region")
def _(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"))
    none = F.lit(None).cast("string")
    t = r.select(F.lit("region").alias("namespace"), "id", F.lit("viewer").alias("relation"), F.lit("principal").alias("subject_namespace"), F.lit("public").alias("subject_id"), none.alias("subject_relation"))
    return authz.objects_of(("user", "anyone"), "region", "view", t, _ACL).agg(F.count("*").alias("n"))


# --- programs and logs (U, K) --------------------------------------------------------------------------------------------
_COUNTER = programs.Program(
    assertions=(programs.Assertion("exists", "c/{id}", "/n"), programs.Assertion("integer", "c/{id}", "/n", 3, "lt")),
    steps=(programs.Step("add", "c/{id}", "/n", 1), programs.Step("set", "c/{id}", "/last", {"$input": "order"})),
)


def _calls(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_custkey", F.col("o_orderkey").alias("ordinal"), F.to_json(F.struct(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("order"))).alias("inputs"))


_COUNTED = "select o_custkey, least(count(*), 3) as applied, greatest(count(*) - 3, 0) as failed from orders group by o_custkey"


@query("u02_assertions", _COUNTED)
def _(spark, sf):
    return programs.run_by_key(_calls(spark, sf), _COUNTER, "o_custkey", "c/{id}", {"n": 0}, ()).select("o_custkey", "applied", "failed")


@query("u03_operations", "select o_custkey, least(count(*), 3)::bigint as n, (list_sort(list(o_orderkey)))[least(count(*), 3)] as last from orders group by o_custkey")
def _(spark, sf):
    r = programs.run_by_key(_calls(spark, sf), _COUNTER, "o_custkey", "c/{id}", {"n": 0}, ())
    return r.select("o_custkey", F.get_json_object("document", "$.n").cast("long").alias("n"), F.get_json_object("document", "$.last").cast("long").alias("last"))


@query("u05_lock_order", "select o_orderkey, list_sort(['c/' || o_custkey, 'days/' || strftime(o_orderdate, '%Y-%m-%d')]) as paths, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as waits_for from orders")
def _(spark, sf):
    """The paths of each call in the order of their locks, and the call that it waits for on the customer's document."""
    p = programs.Program(steps=(programs.Step("add", "days/{day}", "/n", 1), programs.Step("add", "c/{id}", "/n", 1)), outputs=(("n", "c/{id}", "/n"),))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), programs.lock_order(p, {"id": F.col("o_custkey"), "day": F.date_format("o_orderdate", "yyyy-MM-dd")}).alias("paths"))
    waits = programs.conflicts(o).where(F.col("path").startswith("c/")).select("ordinal", "waits_for")
    return o.join(waits, "ordinal").select(F.col("ordinal").alias("o_orderkey"), "paths", "waits_for")


@query("u04_bundle", "select 'a,b' as writes, 7 as total, true as all_or_nothing")
def _(spark, sf):
    p = programs.Program(
        steps=(programs.Step("add", "a", "/n", 2), programs.Step("copy", "b", "/m", source="a", source_pointer="/n")),
        outputs=(("total", "b", "/m"),),
    )
    ok = programs.evaluate(p, {}, {"a": (1, {"n": 5}), "b": (2, {})})
    bad = programs.evaluate(replace(p, steps=(*p.steps, programs.Step("remove", "c"))), {}, {"a": (1, {"n": 5}), "b": (2, {})})
    return spark.createDataFrame([(",".join(ok.writes), ok.outputs["total"], not bad.ok and not bad.writes)], "writes string, total int, all_or_nothing boolean")


@query("k02_append", f"with {_CHAIN_SQL}, t as (select grp, max(idx) as n from chain group by grp) select grp as group_id, case when grp % 2 = 0 then 'appended' else 'conflict' end as outcome, case when grp % 2 = 0 then n + 1 end as index from t")
def _(spark, sf):
    e = _chains(spark, sf)
    r = e.groupBy("group").agg(F.max_by(F.struct("index", "hash"), "index").alias("t")).select("group", (F.col("t.index") + F.col("group") % 2).alias("expected_index"), F.col("t.hash").alias("expected_hash"), F.lit("new").alias("payload"))
    return grouplog.append(e, r).select(F.col("group").alias("group_id"), "outcome", "index")


@query("k03_projection", f"with {_CHAIN_SQL}, f as (select *, row_number() over w as n, sum(octet_length(encode(payload))) over w as b from chain where idx > grp % 3 window w as (partition by grp order by idx)) select grp as group_id, idx as index from f where n <= 4 and b <= 60")
def _(spark, sf):
    e = _chains(spark, sf)
    at = e.select("group").distinct().withColumn("checkpoint", F.col("group") % 3)
    return grouplog.project(e, at, 4, 60).select(F.col("group").alias("group_id"), "index")


@query("k04_chain_check", f"with {_CHAIN_SQL} select grp as group_id, idx as index from chain where idx = 2 and grp % 5 = 0")
def _(spark, sf):
    e = _chains(spark, sf).withColumn("payload", F.when((F.col("index") == 2) & (F.col("group") % 5 == 0), "forged").otherwise(F.col("payload")))
    return grouplog.chain_check(e).select(F.col("group").alias("group_id"), "index")


@query("k05_catch_up", f"with {_CHAIN_SQL}, g as (select min(grp) as g from chain), f as (select *, sum(octet_length(encode(payload))) over (order by idx) as b from chain where grp = (select g from g)) select idx as index, payload from f where b <= 50")
def _(spark, sf):
    e = _chains(spark, sf)
    return grouplog.catch_up(e, e.agg(F.min("group")).first()[0], 0, "", 50).select("index", "payload")


@query("k07_group_roles", "select c_custkey::varchar as id from customer where c_custkey % 3 = 0 or (c_custkey % 3 = 1 and c_custkey % 2 = 1)")
def _(spark, sf):
    """Administrators of every third group and readers of the next, whose grants are revoked again for even numbers; what the reader of groups may read."""
    c = table(spark, sf, "customer")
    role = F.element_at(F.array(F.lit("admin"), F.lit("reader"), F.lit("writer")), (F.col("c_custkey") % 3 + 1).cast("int"))
    who = F.when(F.col("c_custkey") % 3 == 2, "q").otherwise("p")
    grants = c.select(F.col("c_custkey").alias("group"), role.alias("role"), F.lit("principal").alias("subject_namespace"), who.alias("subject_id"), F.lit(True).alias("grant"))
    revoked = grants.where("group % 3 = 1 and group % 2 = 0").withColumn("grant", F.lit(False))
    t = grouplog.change_roles(spark.createDataFrame([], authz.TUPLE), grants, 1)
    t = grouplog.change_roles(t, revoked, 2)
    return authz.objects_of(("principal", "p"), "group_log", "read", authz.at_revision(t), grouplog.role_schema())


# --- advisories (O) ------------------------------------------------------------------------------------------------------
@query("o01_split", f"with {FEED_SQL} select id, ecosystem, package, entries from split")
def _(spark, sf):
    return advisories.split(D.feed(spark, sf)).select("id", "ecosystem", "package", "entries")


@query("o02_normalise", f"with {FEED_SQL} select id, package, case when o_orderstatus = 'F' then 'withdrawn' else 'active' end as state, case when o_orderkey % 11 = 0 then 'unknown' else strftime(o_orderdate, '%Y-%m-%d') end as day, sha256(id || chr(0) || ecosystem || chr(0) || package) as identity, case when ecosystem in ('cargo', 'crates.io') then 'cargo' when ecosystem in ('npm', 'pypi') then ecosystem else 'other' end as part from split join orders on o_orderkey = k")
def _(spark, sf):
    return advisories.normalise(D.feed(spark, sf)).select("id", "package", "state", "day", "identity", F.col("partition").alias("part"))


_SHARD_SQL = f"""with {FEED_SQL},
rec as (
  select s.id, ecosystem, package, sha256(s.id || chr(0) || ecosystem || chr(0) || package) as identity, case when ecosystem = 'crates.io' then 'cargo' when ecosystem in ('npm', 'pypi') then ecosystem else 'other' end as part,
    case when o_orderkey % 11 = 0 then 'unknown' else strftime(o_orderdate, '%Y-%m-%d') end as day,
    '{{"id":"' || s.id || '","ecosystem":"' || ecosystem || '","package":"' || package || '","entries":' || entries || ',"state":"' || case when o_orderstatus = 'F' then 'withdrawn' else 'active' end || '","aliases":["A-' || o_custkey % 9 || '","B"],"summary":"' || o_orderpriority
      || '","day":"' || case when o_orderkey % 11 = 0 then 'unknown' else strftime(o_orderdate, '%Y-%m-%d') end || '"}}' as body
  from split s join orders on o_orderkey = s.k),
shard as (select *, (coalesce(sum(octet_length(encode(body)) + 1) over (partition by part order by identity rows between unbounded preceding and 1 preceding), 0) // 200000)::int as shard from rec)"""


def _sharded(spark, sf):
    """Lines in order of identity; the fields but those of the manifest are in the body."""
    r = advisories.normalise(D.feed(spark, sf)).select("partition", F.col("identity").alias("id"), "ecosystem", "day", "body", "content_hash")
    return advisories.sharded(r, 200_000)


@query("o03_shards", f"{_SHARD_SQL} select part, shard, sum(octet_length(encode(body)) + 1)::bigint as bytes from shard group by part, shard")
def _(spark, sf):
    return _sharded(spark, sf).groupBy(F.col("partition").alias("part"), "shard").agg(F.sum("bytes").alias("bytes"))


@query(
    "o04_manifest",
    f"{_SHARD_SQL} select part, shard, count(*) as documents, sum(octet_length(encode(body)) + 1)::bigint as bytes, array_to_string(list_sort(list_distinct(list(ecosystem))), ',') as ecosystems, min(day) as first_day, max(day) as last_day, "
    "sha256(string_agg(sha256(body), chr(10) order by sha256(body))) as digest from shard group by part, shard",
)
def _(spark, sf):
    return advisories.manifest(_sharded(spark, sf)).select(F.col("partition").alias("part"), "shard", "documents", "bytes", F.array_join("ecosystems", ",").alias("ecosystems"), "first_day", "last_day", "digest")


@query("a15_shard_manifest", f"with {FEED_SQL} select case when ecosystem in ('cargo', 'crates.io') then 'cargo' when ecosystem in ('npm', 'pypi') then ecosystem else 'other' end as part, count(*) as documents, list_sort(list_distinct(list(ecosystem))) as ecosystems from split group by part")
def _(spark, sf):
    r = advisories.normalise(D.feed(spark, sf)).withColumn("shard", F.lit(0))
    return files.shard_manifest(r).select(F.col("partition").alias("part"), "documents", "ecosystems")


@query("o05_verify", f"with {FEED_SQL} select count(*) as missing from split where k % 10 = 0")
def _(spark, sf):
    """The records are written once: both sides come from them, and the join's filters, pushed below the split, would work its names out again."""
    path = folder(spark)
    advisories.normalise(D.feed(spark, sf)).select("id", "partition", "identity", "content_hash").write.parquet(path)
    r = spark.read.parquet(path)
    there = r.where("cast(substring(id, 5) as long) % 10 <> 0").select(F.concat(F.lit("advisories/"), "partition", F.lit("/"), "identity", F.lit(".json")).alias("path"), F.col("content_hash").alias("hash"), F.lit(False).alias("deleted"))
    return advisories.verify(r, there).agg(F.count("*").alias("missing"))


@query("o06_counters", f"with {FEED_SQL} select 3::bigint as entries, 1::bigint as malformed, 1::bigint as oversized, count(*) as records, count(*) filter (package = '') as unscoped, count(*) filter (k in (select o_orderkey from orders where o_orderstatus = 'F')) as withdrawn from split")
def _(spark, sf):
    entries = spark.createDataFrame([("ok",), ("malformed",), ("oversized",)], "state string")
    return advisories.counters(entries, advisories.normalise(D.feed(spark, sf)))


# --- definitions (D) -----------------------------------------------------------------------------------------------------
@query("d01_d05_definitions", "select * from (values ('replay', true), ('updated', true), ('listed', true), ('hourly', true), ('deleted', true), ('one_of_two_writers', true)) t(step, ok)")
def _(spark, sf):
    """Create, replay, update, list, rebuild and delete."""
    root, out = folder(spark, "definitions"), []
    s = Store(Document(spark, root))
    a = s.create(DOCS)
    out.append(("replay", s.create(DOCS) == a))
    s = Store(Document(spark, root))  # as another process would find it
    b = s.update(replace(DOCS, path_prefix="docs/x"), 1)
    out.append(("updated", b.version == 2 and b.index_id == a.index_id))
    s.create(replace(PARTS, name="aaa"))
    out.append(("listed", [d.name for d in s.list("t", "b")[0]] == ["aaa", "docs"]))
    s.rebuild(b, 0.0)
    try:
        s.rebuild(b, 10.0)
        out.append(("hourly", False))
    except Invalid:
        out.append(("hourly", True))
    s.delete("t", "b", "docs", 2)
    out.append(("deleted", s.list("t", "b")[0][0].name == "aaa"))
    one, two = Document(spark, root), Document(spark, root)
    at = one.read()
    one.write(at[1], at[0])
    try:
        two.write(at[1], at[0])
        out.append(("one_of_two_writers", False))
    except Invalid:
        out.append(("one_of_two_writers", True))
    assert all(ok for _, ok in out)
    return spark.createDataFrame(out, "step string, ok boolean")


@query("d06_d07_validation", "select 5 as refused, true as changes, true as keeps")
def _(spark, sf):
    bad = [replace(DOCS, kind="x"), replace(DOCS, name=""), replace(DOCS, fields=DOCS.fields * 2), replace(DOCS, physical_order=(("lang", False), ("lang", True))), replace(_HYBRID, text_weight=1.0)]
    refused = 0
    for d in bad:
        try:
            d.validate()
        except Invalid:
            refused += 1
    changes, keeps = DOCS.fingerprint() != replace(DOCS, path_prefix="y").fingerprint(), DOCS.fingerprint() == replace(DOCS, version=7).fingerprint()
    return spark.createDataFrame([(refused, changes, keeps)], "refused int, changes boolean, keeps boolean")


@query("d08_accounting_definitions", "select 2 as enabled, true as stale_refused")
def _(spark, sf):
    a = accounting.Definitions(Document(spark, folder(spark, "accounting")))
    first = a.enable("x")
    a.enable("y")
    try:
        a.disable("x", first + 5)
        refused = False
    except Invalid:
        refused = True
    return spark.createDataFrame([(sum(a.get(p) is not None for p in "xy"), refused)], "enabled int, stale_refused boolean")


@query("d10_ancestors", f"with {DOCS_SQL} select path, ['', 'docs', 'docs/' || source, path] as prefixes from docs")
def _(spark, sf):
    return D.docs_index(spark, sf).select(F.col("source_path").alias("path"), X.ancestors(F.col("source_path")).alias("prefixes"))


# --- what the survey leaves open -----------------------------------------------------------------------------------------
@query("j10_quorum_read", f"with {VERSIONS_SQL}, h as (select path, version, hash, 1 + version % 3 as held from versions where not deleted) select path, max(version) as version from h where held >= 2 group by path")
def _(spark, sf):
    """Each version is held by one to three replicas; two are a quorum."""
    v = D.versions(spark, sf).where("not deleted")
    held = v.withColumn("replica", F.explode(F.sequence(F.lit(0), (F.col("version") % 3).cast("int"))))
    return objects.quorum_read(held.select("replica", "path", "version", "hash"), 2).select("path", "version")


@query("t06_retention", f"with {JOURNAL_SQL} select source, case when source = 'n1' then least(greatest(min(off), max(off) - 49), 5) else greatest(min(off), max(off) - 49) end as floor, source = 'n1' and greatest(min(off), max(off) - 49) > 5 as blocked from journal group by source")
def _(spark, sf):
    j = D.journal(spark, sf)
    return journal.retention(j, j.where("source = 'n1'").select("source").distinct().withColumn("next", F.lit(5).cast("long")), 50)


@query("k01_groups", f"with {_CHAIN_SQL}, t as (select grp, count(*) as entries from chain group by grp) select c_custkey as group_id, case when c_custkey % 2 = 0 then 'source' else 'standalone' end as kind, coalesce(entries, 0) as entries from customer left join t on grp = c_custkey")
def _(spark, sf):
    kinds = table(spark, sf, "customer").select(F.col("c_custkey").alias("group"), F.when(F.col("c_custkey") % 2 == 0, "source").otherwise("standalone").alias("kind"))
    return grouplog.describe(_chains(spark, sf), kinds).select(F.col("group").alias("group_id"), "kind", "entries")


@query("k06_snapshots", "with s as (select string_agg(o_orderkey, ',' order by o_orderkey) as b from orders where o_custkey = (select min(o_custkey) from orders)) select substr(b, 4, 8) as piece, length(b)::int as size from s")
def _(spark, sf):
    o = table(spark, sf, "orders")
    s = o.groupBy(F.col("o_custkey").alias("group")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").cast("binary").alias("body"), F.count("*").alias("index"))
    r = grouplog.read_snapshot(s, s.agg(F.min("group")).first()[0], 3, 8)
    return r.select(F.col("piece").cast("string").alias("piece"), "size")


@query("z09_object_roles", "select doc_id::varchar as id from documents where source in ('src1', 'src2')")
def _(spark, sf):
    """A reader of one bucket and an administrator of another reads their objects."""
    none = F.lit(None).cast("string")
    d = table(spark, sf, "documents").select(F.lit("object").alias("namespace"), F.col("doc_id").cast("string").alias("id"), F.lit("parent").alias("relation"), F.lit("bucket").alias("subject_namespace"), F.col("source").alias("subject_id"), none.alias("subject_relation"))
    roles = spark.createDataFrame([("bucket", "src1", "reader", "principal", "p", None), ("bucket", "src2", "admin", "group", "g", "member"), ("group", "g", "member", "principal", "p", None)], "namespace string, id string, relation string, subject_namespace string, subject_id string, subject_relation string")
    return authz.objects_of(("principal", "p"), "object", "read", d.unionByName(roles), authz.object_schema())


@query("d09_query_statistics", f"with {PARTS_SQL} select count(*) as records, count(*) filter (large) as candidates, count(*) filter (large and key % 2 = 0) as visible, count(*) filter (large and key % 2 = 1) as rejected from parts")
def _(spark, sf):
    return search.counted(D.parts_index(spark, sf), PARTS, Q.equal("large", True), lambda rows: rows.where(F.col("source_version") % 2 == 0))
