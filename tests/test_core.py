"""Edge cases of the core library, in the shapes of the reference's own tests."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import scalar as X
from lodeworks.operators import advisories, authz, compute, grouplog, programs, projection, search, textindex
from lodeworks.operators import predicate as Q
from lodeworks.plans import lineage
from lodeworks.plans.catalog import Document
from lodeworks.plans.definition import Builder, Cap, Definition, Invalid, Type
from lodeworks.sources import files, objects
from lodeworks.streaming import generation

E, P, R, O, C, A = Cap.EXACT, Cap.PREFIX, Cap.RANGE, Cap.ORDER, Cap.FACET, Cap.AGGREGATE


def objects_of(spark, *bodies):
    return spark.createDataFrame([(f"d/{chr(97 + i)}", i + 1, "application/json", b) for i, b in enumerate(bodies)], "path string, version long, content_type string, body string")


@pytest.fixture(scope="module")
def base(spark):
    d = Builder(Definition("x")).keyword("state", E, P, R, O, C).signed("priority", E, R, O, C, A).build()
    return d, projection.typed(objects_of(spark, '{"state":"active","priority":1}', '{"state":"inactive","priority":5}', '{"state":"active","priority":3}'), d)


def names(df):
    return [r.result_path[-1] for r in df.collect()]


def test_executor_base(base):
    d, r = base
    assert names(search.select_page(r, d, Q.EVERY, (("priority", True), ("state", False)))) == ["b", "c", "a"]
    assert names(search.select_page(r, d, Q.equal("state", "active"), (("priority", False),))) == ["a", "c"]
    assert names(search.select_page(r, d, Q.negate(Q.equal("state", "active")))) == ["b"]
    assert [(x.value, x.n) for x in compute.facet(r, d, "state", 10).collect()] == [('"active"', 2), ('"inactive"', 1)]
    a = compute.aggregate(r, d, [("priority", op) for op in ("count", "minimum", "maximum", "sum", "average")]).first()
    assert (a.n_priority, a.count_priority, a.minimum_priority, a.maximum_priority, a.sum_priority, a.average_priority) == (3, 3, 1, 5, 9, 3.0)


def test_pages_by_token(base):
    d, r = base
    b = search.Binding("me", d.index_id, 1, "q", 1, 1)
    one, token = search.fetch(r, d, b, b"s", order=(("priority", True),), limit=2)
    two, end = search.fetch(r, d, b, b"s", order=(("priority", True),), limit=2, token=token)
    assert [x.result_path[-1] for x in one + two] == ["b", "c", "a"] and end is None
    with pytest.raises(Invalid):
        search.fetch(r, d, search.Binding("you", d.index_id, 1, "q", 1, 1), b"s", order=(("priority", True),), limit=2, token=token)
    with pytest.raises(Invalid):
        search.unseal(token, b, b"other")


def test_pages_read_ahead(base):
    """Pages and tokens are those of single queries, also after a jump back, to another order, and to a first page again."""
    d, r = base
    b, ahead = search.Binding("me", d.index_id, 1, "q", 1, 1), search.Ahead()

    def both(order, token):
        one, two = (search.fetch(r, d, b, b"s", order=order, limit=1, token=token, ahead=a) for a in (None, ahead))
        assert one == two
        return two[1]

    down, up = (("priority", True),), (("state", False), ("priority", False))
    first = both(down, None)
    second = both(down, first)
    assert both(down, first) == second and both(up, None) != first
    third = both(down, second)
    assert both(down, third) is None and both(down, None) == first


def test_json_edges(spark):
    d = Builder(Definition("x")).signed("i", E, pointer="/a~1b/0").unsigned("u", E).floating("f", E).keyword("k", E, multi=True).build()
    bodies = ['{"a/b":[7],"u":18446744073709551615,"f":-0.0,"k":["b","a","b",null]}', '{"u":-1}', '{"f":1,"k":"x"}', "{}", '{"u":null,"k":[]}', '{"i":1} x', "[" * 200 + "]" * 200, '{"f":2,"f":3}', "nonsense", '{"k":[["x"]]}', '{"u":1.0}', '{"f":"1"}']
    got = {r.source_path[-1]: r for r in projection.typed(objects_of(spark, *bodies), d, strict=False).collect()}
    assert set(got) == set("abcdehjkl")
    assert got["a"].i.v == 7 and int(got["a"].u.v) == 2**64 - 1 and str(got["a"].f.v) == "0.0" and got["a"].k.v == ["a", "b"] and got["a"].k.has_null
    assert got["b"].rejected and got["k"].rejected and got["l"].rejected and not got["b"].u.present
    assert got["c"].f.v == 1.0 and got["c"].k.v == ["x"] and not got["d"].f.present and not got["d"].rejected
    assert got["e"].u.present and got["e"].u.has_null and got["e"].u.v is None and got["e"].k.present and got["e"].k.v == []
    assert got["h"].f.v == 3.0 and not got["j"].k.present


def test_strict_projection_fails(spark):
    d = Builder(Definition("x")).signed("i", E).build()
    with pytest.raises(Exception, match="wrong type"):
        projection.typed(objects_of(spark, '{"i":[1]}'), d).collect()


def test_order_of_null_and_missing(spark):
    d = Builder(Definition("x")).signed("n", O).build()
    r = projection.typed(objects_of(spark, '{"n":2}', '{"n":null}', "{}", '{"n":1}'), d)
    assert names(search.select_page(r, d, order=(("n", False),))) == ["b", "d", "a", "c"]
    assert names(search.select_page(r, d, order=(("n", True),))) == ["c", "a", "d", "b"]
    terms = search.order_terms(d, (("n", False),))
    rows = r.select("*", F.array(*(c.cast("string") for c, _, _ in terms)).alias("c")).orderBy(*search.ordering(terms)).collect()
    for i, x in enumerate(rows):
        assert names(search.select_page(r, d, order=(("n", False),), cursor=x.c)) == [y.result_path[-1] for y in rows[i + 1 :]]


def test_definitions_are_checked():
    with pytest.raises(Invalid):
        Builder(Definition("x")).boolean("b", O).build()
    with pytest.raises(Invalid):
        Builder(Definition("x")).keyword("k", O, multi=True).build()
    with pytest.raises(Invalid):
        Builder(Definition("x", kind="hybrid", dimensions=2, text_weight=1.0)).text("t").build()
    f = Builder(Definition("x")).signed("n", E).build().field("n")
    for bad in ("1.0", "01", '"1"', "[1]", " 1", "9223372036854775808"):
        with pytest.raises(Invalid):
            Q.decode(f, bad)
    assert Q.decode(f, "-5") == -5


def test_sum_out_of_range(spark):
    d = Builder(Definition("x")).signed("n", A).build()
    r = projection.typed(objects_of(spark, '{"n":9223372036854775807}', '{"n":1}'), d)
    with pytest.raises(Exception, match="out of range"):
        compute.aggregate(r, d, [("n", "sum")]).collect()


def test_phrase_needs_places(spark):
    d = Builder(Definition("x", kind="text")).text("t").build()
    r = projection.texts(objects_of(spark, '{"t":"the quick brown fox"}', '{"t":"quick the fox"}', '{"t":["x"]}', '{"u":"x"}'), d)
    assert names(r.where(Q.compile_(Q.full_text("t", "THE fox"), d)).orderBy("result_path")) == ["a", "b"]
    assert names(r.where(Q.compile_(Q.phrase("t", "quick brown"), d))) == ["a"]
    assert r.count() == 2


def test_vectors(spark):
    d = Definition("v", kind="vector", dimensions=2, metric="cosine", normalize=True)
    o = spark.createDataFrame([("a", 1, "x", [3.0, 4.0]), ("b", 1, "x", [0.0, 0.0]), ("c", 1, "x", [1.0]), ("d", 1, "x", [float("nan"), 1.0])], "path string, version long, content_type string, vector array<double>")
    r = projection.vectors(o, d).collect()
    assert [x.source_path for x in r] == ["a"] and abs(r[0].vector[0] - 0.6) < 1e-6
    with pytest.raises(Invalid):
        search.query_vector(d, [0.0, 0.0])


def test_manifest_with_a_repeated_key_gives_nothing(spark):
    rec = {"repository_id": "r", "commit_id": "c", "tree_path": "p", "object_id": "o", "pack_path": "k", "pack_version": 3, "offset": 0, "length": 1}
    o = objects_of(spark, json.dumps([rec, rec]), json.dumps(rec), json.dumps([rec | {"repository_id": "z"}]))
    r = projection.tree_manifest(o, Definition("g", kind="tree_manifest", selector=("r",))).collect()
    assert [(x.source_path, x.result_path, x.result_version) for x in r] == [("d/b", "k", 3)]


def test_fold_refuses_two_contents(spark):
    log = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 2, "c")], "path string, version long, content string")
    with pytest.raises(Exception, match="two contents"):
        projection.fold(log).collect()


def test_bulk_write_outcomes(spark):
    ops = [
        (0, "a", "put_if_absent", None, 10, 1, "h", "c1"), (1, "a", "put_if_absent", None, 11, 1, "h", None), (2, "a", "put_if_version", 10, 12, 2, "i", None), (3, "a", "put_if_version", 10, 13, 2, "i", None),
        (4, "a", "put_if_absent", None, 14, 1, "h", "c1"), (5, "a", "put_if_absent", None, 15, 9, "other", "c1"), (6, "a", "delete", None, 16, None, None, None), (7, "a", "put_if_absent", None, 17, 3, "j", None),
        (8, "a", "delete_version", 17, 18, None, None, None), (9, "a", "delete_version", 18, 19, None, None, None), (10, "a", "delete_version", 999, 20, None, None, None),
        (11, "keep/x", "put_immutable", None, 21, 1, "h", None), (12, "keep/x", "put_immutable", None, 22, 1, "h", None), (13, "keep/x", "put_immutable", None, 23, 1, "z", None), (14, "keep/x", "delete", None, 24, None, None, None),
        (15, "prog", "put", None, 25, 1, "h", None), (16, "new", "delete", None, 26, None, None, None),
    ]
    o = spark.createDataFrame(ops, "ordinal long, path string, op string, expected long, version long, length long, hash string, command_id string")
    v = spark.createDataFrame([], "path string, version long, deleted boolean, length long, hash string")
    out = objects.bulk_write(o, v, ["keep"], ["prog"])
    got = {r.ordinal: (r.outcome, r.version, r.replayed) for r in out.collect()}
    assert got == {
        0: ("ok", 10, False), 1: ("exists", 10, False), 2: ("ok", 12, False), 3: ("version_mismatch", 12, False), 4: ("ok", 10, True), 5: ("command_conflict", None, False), 6: ("ok", 16, False), 7: ("ok", 17, False),
        8: ("ok", 18, False), 9: ("current_tombstone", 18, False), 10: ("not_deleted", None, False), 11: ("ok", 21, False), 12: ("ok", 21, True), 13: ("immutable", 21, False), 14: ("immutable", 21, False), 15: ("program_only", None, False), 16: ("ok", 26, False),
    }
    after = {r.path: (r.version, r.deleted) for r in objects.heads(objects.apply_outcomes(v, out)).collect()}
    assert after == {"a": (18, True), "keep/x": (21, False), "new": (26, True)}


def test_two_owners_of_a_path(spark):
    a = spark.createDataFrame([("p",)], "path string")
    with pytest.raises(Exception, match="two owners"):
        objects.merge_lists([a, a], 5).collect()


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in "x/y|/x|x/|x//y|x/../y|x/.system/y||x\x01".split("|")], "path string")
    assert [r[0] for r in rows.select(X.valid_path(F.col("path"))).collect()] == [True, False, False, False, False, True, False, False]
    assert rows.where(X.reserved(F.col("path"))).count() == 1
    assert spark.range(1).select(X.ancestors(F.lit("a/b/c"))).first()[0] == ["", "a", "a/b", "a/b/c"]


def test_cycles_and_depth(spark):
    s = authz.Schema({"user": {}, "group": {"member": authz.Direct((authz.Selector("object", "user"), authz.Selector("userset", "group", "member")))}}).compile()
    row = lambda g, *m: ("group", g, "member", *m, 1, None)
    t = spark.createDataFrame([row("a", "group", "b", "member"), row("b", "group", "a", "member"), row("b", "user", "u", None)], authz.TUPLE)
    req = spark.createDataFrame([(0, "group", "a", "member", "user", "u"), (1, "group", "a", "member", "user", "x")], "ordinal long, namespace string, id string, permission string, subject_namespace string, subject_id string")
    assert {r.ordinal: r.allowed for r in authz.check(req, t, s).collect()} == {0: True, 1: False}
    chain = spark.createDataFrame([row(f"g{i}", "group", f"g{i + 1}", "member") for i in range(6)], authz.TUPLE)
    deep = req.withColumn("id", F.lit("g0"))
    with pytest.raises(Invalid):
        authz.check(deep, chain, s, max_depth=3)
    with pytest.raises(Invalid):
        authz.Schema({"n": {"p": authz.Permission((authz.Inherit("q"),))}}).compile()


def test_programs_are_atomic():
    p = programs.Program((programs.Assertion("absent", "x", "/n"),), (programs.Step("replace", "x", value={"n": 2**63 - 1}), programs.Step("add", "x", "/n", 1)))
    assert not programs.evaluate(p, {}, {}).ok
    q = programs.Program((), (programs.Step("replace", "x", value=[1]), programs.Step("set", "x", "/0", 5), programs.Step("remove", "y")))
    b = programs.evaluate(q, {}, {"y": (3, 1)})
    assert b.ok and b.writes == {"x": [5], "y": None} and b.expected == {"x": None, "y": 3}


def test_pointers():
    assert X.tokens("/a~1b/~0") == ["a/b", "~"] and X.json_select({"a": [1, {"b": 2}]}, "/a/1/b") == 2
    with pytest.raises(KeyError):  # no leading zeros in places of arrays
        X.json_select({"a": [1, {"b": 2}]}, "/a/01/b")
    for bad in ("a", "/~2"):
        with pytest.raises(ValueError):
            X.tokens(bad)
    with pytest.raises(KeyError):
        X.json_remove({"a": 1}, "/b")


def test_chain_forgery(spark):
    rows, h = [], ""
    for i in range(1, 4):
        n = grouplog.entry_hash(h, i, f"p{i}")
        rows.append(("g", i, h, n, f"p{i}"))
        h = n
    e = spark.createDataFrame(rows, "group string, index long, previous_hash string, hash string, payload string")
    assert grouplog.chain_check(e).count() == 0
    assert [r["index"] for r in grouplog.chain_check(e.where("index <> 2")).collect()] == [3]
    with pytest.raises(Exception, match="over the limit"):
        grouplog.project(e, spark.createDataFrame([("g", 0)], "group string, checkpoint long"), 5, 1).collect()


def test_pushdown(spark, sf):
    plan = search.select_page(spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("p").alias("source_path"), F.col("doc_id").alias("source_version"), F.lit(0).alias("source_record"), F.lit("p").alias("result_path"), F.col("doc_id").alias("result_version"), F.struct(F.lit(True).alias("present"), F.lit(False).alias("has_null"), F.col("lang").alias("v")).alias("lang")), Builder(Definition("x")).keyword("lang", E).build(), Q.equal("lang", "en"), (), 4)
    text = plan._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in text and "TakeOrderedAndProject" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text
    assert files.pushdown("phrase") == "inexact" and files.pushdown("x") == "unsupported"
    assert Type.KEYWORD == "keyword"


def _records(changes):
    return changes.select(F.col("path").alias("source_path"), F.col("version").alias("source_version"), F.col("path").alias("result_path"))


def _changes(spark, *rows):
    return spark.createDataFrame([(p, v, gone) for p, v, gone in rows], "path string, version long, deleted boolean")


def test_generations_keep_the_greatest_version(spark, tmp_path):
    """Whatever comes late: an older version of a path, a tombstone, or a page twice."""
    ix = generation.Index(spark, str(tmp_path / "ix"), Builder(Definition("x")).keyword("a", E).build())
    live = lambda: {r.source_path: r.source_version for r in ix.read().collect()}
    ix.rebuild(_changes(spark, ("a", 5, False), ("b", 2, False), ("d", 4, True)), {}, _records)
    ix.catch_up(_changes(spark, ("a", 3, False), ("c", 1, False), ("d", 3, False)), {}, _records)
    assert live() == {"a": 5, "b": 2, "c": 1}
    ix.catch_up(_changes(spark, ("c", 7, True)), {}, _records)
    ix.catch_up(_changes(spark, ("c", 6, False), ("b", 9, False), ("b", 9, False)), {}, _records)
    assert live() == {"a": 5, "b": 9}
    ix.catch_up(_changes(spark, ("b", 9, False)), {}, _records)
    ix.compact()
    assert live() == {"a": 5, "b": 9}
    with pytest.raises(Exception, match="differ at one version"):
        ix.catch_up(_changes(spark, ("a", 8, False), ("a", 8, True)), {}, _records)


def test_a_failed_publish_doesnt_block_the_index(spark, tmp_path, monkeypatch):
    ix = generation.Index(spark, str(tmp_path / "ix"), Builder(Definition("x")).keyword("a", E).build())
    ix.rebuild(_changes(spark, ("a", 1, False)), {}, _records)
    publish = generation.Index.publish

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(generation.Index, "publish", broken)
    with pytest.raises(OSError):
        ix.catch_up(_changes(spark, ("a", 2, False)), {}, _records)
    monkeypatch.setattr(generation.Index, "publish", publish)
    (tmp_path / "ix" / "manifest-000000000002.json").write_text('[{"num')  # and one that broke off while it wrote
    assert ix.current().number == 1
    with pytest.raises(OSError, match="another writer"):  # it might be writing still
        ix.catch_up(_changes(spark, ("a", 3, False)), {}, _records)
    monkeypatch.setattr(generation, "STALE_SECONDS", -1)
    ix.catch_up(_changes(spark, ("a", 3, False)), {}, _records)
    assert [(r.source_path, r.source_version) for r in ix.read().collect()] == [("a", 3)] and ix.current().number == 2
    assert ix.sweep() == [] and len(ix.sweep(0)) == 2 and ix.read().count() == 1
    with pytest.raises(OSError, match="another writer"):
        ix.publish(generation.Generation(2, "f", {}, []), ix.generations())


def test_batches_over_the_limit_are_refused(spark):
    v = spark.createDataFrame([("p1", 1, False, 1, "h")], "path string, version long, deleted boolean, length long, hash string")
    asked = spark.range(1001).select(F.col("id").alias("ordinal"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit(None).cast("long").alias("version"))
    with pytest.raises(Invalid):
        objects.batch_get(v, asked)
    assert objects.batch_get(v, asked.where("ordinal > 0")).where("outcome = 'found'").count() == 1


def test_one_analyzer(spark):
    text = "हिन्दी वाक्य ΑΣ x_y İ"
    column = spark.createDataFrame([(text,)], "t string").select(X.analyze(F.col("t"))).first()[0]
    assert X.analyze_text(text) == column and column[:3] == ["हिन", "दी", "वाक"] and "ας" not in column


def test_stored_state_is_another_process_s_too(spark, tmp_path):
    doc = lambda: Document(spark, str(tmp_path / "d"))
    b = authz.Bindings(doc())
    b.put("acl", authz.object_schema())
    b.bind("realm", "acl", 0)
    schema, generation_ = authz.Bindings(doc()).get("realm")
    assert generation_ == 1 and schema.namespaces == authz.object_schema().namespaces
    d = Builder(Definition("x", physical_order=(("a", True),))).keyword("a", Cap.EXACT, Cap.ORDER).build()
    assert Definition.restored(d.stored()) == d


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: "")

        class sparkContext:
            master = "spark://x"

    with pytest.raises(RuntimeError):
        lineage.shared(Session)


def test_edits_of_columns(spark):
    d = spark.createDataFrame([('{"a": [1]}',), ("no json",), (None,), ('{"b": 1}',)], "d string")
    assert [r[0] for r in d.select(X.set_column(F.col("d"), "/a/0", F.lit("2"))).collect()] == ['{"a":[2]}', None, None, None]
    assert [r[0] for r in d.select(X.remove_column(F.col("d"), "/b")).collect()] == [None, None, None, "{}"]
    one = spark.range(1)
    assert one.select(X.add_column(F.lit(1), F.lit(-2), unsigned=True), X.add_column(F.lit(1), F.lit(2), most=2), X.add_column(F.lit(None).cast("long"), F.lit(2))).first()[:] == (None, None, None)
    with pytest.raises(KeyError):
        X.expand_column("{a}", {})


def test_percentiles_over_ranges(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 101).cast("double").alias("v")).unionByName(spark.createDataFrame([(None,)], "v double"))
    values = sorted(i * 7919 % 101 for i in range(1000))
    assert list(compute.nearest_rank(d, "v", (1, 50, 95, 100)).first()[1:]) == [values[-(-p * 1000 // 100) - 1] for p in (1, 50, 95, 100)]


def test_shards_over_ranges(spark):
    d = spark.range(300).select((F.col("id") % 2).cast("string").alias("partition"), F.col("id"), F.lit("x" * 9).alias("body"))
    got = {(r.partition, r.id): r["shard"] for r in files.shards(d, shard_bytes=100).collect()}
    assert got == {(str(i % 2), i): (i // 2) * 10 // 100 for i in range(300)}


def test_bulk_write_streams_the_paths_of_a_task(spark):
    """Many paths in few tasks, and a path without operations: each path as if alone."""
    ops = spark.range(400).select(F.col("id").alias("ordinal"), F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("path"), F.lit("put_if_version").alias("op"), F.when(F.col("id") < 50, F.lit(1)).otherwise(F.col("id") + 50).alias("expected"), (F.col("id") + 100).alias("version"), F.lit(1).cast("long").alias("length"), F.lit("h").alias("hash"), F.lit(None).cast("string").alias("command_id"))
    v = spark.range(60).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("length"), F.lit("h").alias("hash"))
    out = objects.bulk_write(ops, v).collect()
    assert len(out) == 400 and {r.outcome for r in out} == {"ok"}


def test_block_max_reads_less_and_finds_the_same(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(f"p{i}", [rng.choice(["a", "a", "b", "c", "d", "e", "f"]) for _ in range(rng.randint(2, 60))] + (["rare"] * (i % 50 == 0)), ["a"] if i % 3 == 0 else None) for i in range(1500)]
    d = spark.createDataFrame(rows, "p string, text array<string>, title array<string>")
    zero = F.lit(0).cast("long")
    r = d.select(F.col("p").alias("source_path"), zero.alias("source_version"), zero.alias("source_record"), F.col("p").alias("result_path"), zero.alias("result_version"), "text", "title")
    textindex.write(r, ["text", "title"], str(tmp_path / "ix"))
    ix = textindex.TextIndex(spark, str(tmp_path / "ix"))
    for fields, text in ((["text"], "a b"), (["text", "title"], "a rare"), (["text"], "a a f"), (["text"], "nowhere"), (["title"], "a")):
        want = [(x.result_path, round(x.score, 4)) for x in search.search_text(r, fields, text, 10).collect()]
        for prune in (True, False):
            assert [(x.result_path, round(x.score, 4)) for x in ix.search(fields, text, 10, prune).collect()] == want
    blocks = ix._blocks(["text"], ["b"])
    w = {("text", "b"): 1.0}
    assert ix.needed(blocks, w, {("text", "b"): max(t for _, t in blocks["text", "b"].values())}, ["b"], 5)["text", "b"] > min(blocks["text", "b"])
    assert {x.result_path for x in ix.phrase("text", "b a c").collect()} == {p for p, t, _ in rows if " b a c " in f" {' '.join(t)} "}
    with pytest.raises(Invalid):
        ix.search(["other"], "a")


def test_shards_without_bodies(spark):
    """Against running sums, with bodies that are null; what doesn't need the bodies reads and shuffles none."""
    made = [("abc"[i % 3], f"{i:04}", None if i % 97 == 5 else "x" * (i * 7 % 50)) for i in range(900)]
    got = files.shards(spark.createDataFrame(made, "partition string, id string, body string").repartition(5), shard_bytes=300)
    want, total = {}, {}
    for p, i, body in sorted(made, key=lambda r: r[1]):
        want[p, i] = total.get(p, 0) // 300
        total[p] = total.get(p, 0) + (0 if body is None else len(body) + 1)
    assert {(r.partition, r.id): r["shard"] for r in got.collect()} == want
    sums = got.groupBy("partition", "shard").agg(F.sum("bytes").alias("n"))
    assert sums.groupBy("partition").agg(F.sum("n")).rdd.collectAsMap() == total
    assert "body#" not in sums._jdf.queryExecution().executedPlan().toString()


def test_manifest_is_one_pass(spark):
    """Figures and digest of a shard come from one aggregation of its rows."""
    r = spark.createDataFrame([("a", 0, "npm", "2024-01-01", "xy", "h2"), ("a", 0, "go", "unknown", "z", "h1")], "partition string, shard int, ecosystem string, day string, body string, content_hash string")
    got = advisories.manifest(r)
    row = got.first()
    assert (row.documents, row.bytes, row.ecosystems, row.first_day, row.last_day) == (2, 5, ["go", "npm"], "2024-01-01", "unknown")
    assert row.digest == hashlib.sha256(b"h1\nh2").hexdigest() and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_column_edits_copy_nothing(spark):
    """A document nested deeper than copy.deepcopy() can follow is edited all the same."""
    deep = '{"b":1,"a":' + "[" * 600 + "]" * 600 + "}"
    got = spark.createDataFrame([(deep,)], "d string").select(X.set_column(F.col("d"), "/b", F.lit("2")).alias("s"), X.remove_column(F.col("d"), "/b").alias("r")).first()
    assert got.s == deep.replace('"b":1', '"b":2') and got.r == deep.replace('"b":1,', "")
