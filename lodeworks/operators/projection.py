"""Projections of stored documents to typed index records.

A record has an identity (source_path, source_version, source_record, result_path, result_version) and one cell per field: present, has_null and v,
because a missing value, an explicit null and a value are three different things. v is a value, or an array for fields of several values.
JSON is parsed once, as a variant; everything stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..plans.definition import SPARK, Definition, Field, Type

IDENTITY = ["source_path", "source_version", "source_record", "result_path", "result_version"]
MAX_DEPTH = 128


def configure(spark: SparkSession) -> None:
    """The last of duplicate keys wins."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def scope(objects: DataFrame, d: Definition) -> DataFrame:
    keep = X.in_scope(F.col("path"), d.path_prefix) & ~X.reserved(F.col("path"))
    return objects.where(keep if d.content_type is None else keep & (F.col("content_type") == d.content_type))


def parsed(body: Column) -> Column:
    """The document as the only element of a variant array, or null: bad syntax, more than one document, or nested too deep. The parser
    takes a document with something after it, but in brackets that is an error or a second element."""
    v = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    bare = F.regexp_replace(body, r'"([^"\\]|\\.)*"', "")
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    deepest = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda a, c: F.struct(
            (a["d"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("d"), F.greatest(a["m"], a["d"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("m")
        ),
        lambda a: a["m"],
    )
    opens = F.length(body) - F.length(F.translate(body, "[{", ""))
    flat = F.when(opens <= MAX_DEPTH, True).otherwise(deepest <= MAX_DEPTH)
    return F.when(F.variant_get(v, "$[1]", "variant").isNull() & F.variant_get(v, "$[0]", "variant").isNotNull() & flat, v)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _scalar(v: Column, t: Type) -> Column:
    """The typed value of a scalar variant, null where its type doesn't fit."""
    kind = _kind(v)
    decimal, whole = kind.startswith("DECIMAL"), kind.rlike(r"^DECIMAL\(\d+,0\)$")
    big = lambda low, high: whole & F.try_variant_get(v, "$", "decimal(38,0)").between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))
    number = F.try_variant_get(v, "$", "double")
    return {
        Type.BOOLEAN: F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")),
        Type.KEYWORD: F.when(kind == "STRING", F.try_variant_get(v, "$", "string")),
        Type.TEXT: F.when(kind == "STRING", F.try_variant_get(v, "$", "string")),
        # a whole number that fits a long is BIGINT; as DECIMAL it had a fraction
        Type.SIGNED: F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")),
        Type.UNSIGNED: F.when((kind == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= 0) | big(2**63, 2**64 - 1), F.try_variant_get(v, "$", "decimal(20,0)")),
        Type.FLOAT: F.when(
            (kind == "BIGINT") & (number.cast("decimal(38,0)") == F.try_variant_get(v, "$", "decimal(38,0)")) | decimal | kind.isin("DOUBLE", "FLOAT"),
            F.when(~F.isnan(number) & (F.abs(number) <= 1.7976931348623157e308), number + F.lit(0.0)),
        ),
    }[t]


def cell(v: Column, f: Field, strict: bool = True) -> Column:
    """struct(present, has_null, v, bad). strict: a value that doesn't fit fails the job; else it sets bad and the field is missing."""
    kind = F.coalesce(_kind(v), F.lit("MISSING"))
    array = kind.startswith("ARRAY")
    items = F.when(array, F.try_variant_get(v, "$", "array<variant>"))
    nested = F.exists(items, lambda x: _kind(x).startswith("ARRAY") | _kind(x).startswith("OBJECT"))
    missing = (kind == "MISSING") | kind.startswith("OBJECT") | F.coalesce(nested, F.lit(False))
    null = (kind == "VOID") | F.coalesce(F.exists(items, F.is_variant_null), F.lit(False))
    one = _scalar(v, f.type)
    values = F.when(array, F.transform(F.filter(items, lambda x: ~F.is_variant_null(x)), lambda x: _scalar(x, f.type))).otherwise(F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast(f"array<{SPARK[f.type]}>")))
    bad = ~missing & (F.exists(values, lambda x: x.isNull()) | (~array & (kind != "VOID") & one.isNull()))
    if not f.multi:
        bad = bad | (~missing & array)
    fail = F.raise_error(F.lit(f"field {f.name}: wrong type or cardinality"))
    present = F.when(bad, fail.cast("boolean") if strict else F.lit(False)).otherwise(~missing)
    if f.multi:
        shown = F.array_sort(F.array_distinct(values)) if f.type is Type.KEYWORD else values
        value = F.when(present, shown)
    else:
        value = F.when(present, F.get(values, F.lit(0)))
    return F.struct(present.alias("present"), (present & null).alias("has_null"), value.alias("v"), bad.alias("bad"))


def with_identity(objects: DataFrame) -> DataFrame:
    return objects.select(
        F.col("path").alias("source_path"), F.col("version").alias("source_version"), F.lit(0).cast("long").alias("source_record"), F.col("path").alias("result_path"), F.col("version").alias("result_version"), "*"
    )


def native_cell(value: Column, multi: bool = False) -> Column:
    """A cell of a column whose SQL null is an explicit null."""
    return F.struct(F.lit(True).alias("present"), value.isNull().alias("has_null"), value.alias("v"))


def typed(objects: DataFrame, d: Definition, strict: bool = True) -> DataFrame:
    """Typed records of JSON objects (path, version, content_type, body). A document that doesn't parse has no record; one without any field has."""
    configure(objects.sparkSession)
    docs = with_identity(scope(objects, d)).withColumn("_v", parsed(F.col("body"))).where("_v is not null")
    cells = [cell(X.pointer_get(F.col("_v"), f.pointer, "$[0]"), f, strict).alias(f"_{f.name}") for f in d.fields]
    docs = docs.select(*IDENTITY, *cells)
    bad = reduce(lambda a, b: a | b, (F.col(f"_{f.name}.bad") for f in d.fields), F.lit(False))
    return docs.select(*IDENTITY, *(F.struct(*(F.col(f"_{f.name}.{p}") for p in ("present", "has_null", "v"))).alias(f.name) for f in d.fields), *([] if strict else [bad.alias("rejected")]))


def paths(objects: DataFrame, d: Definition) -> DataFrame:
    return with_identity(scope(objects, d)).select(*IDENTITY, native_cell(F.col("path")).alias("path"))


def metadata(objects: DataFrame, d: Definition) -> DataFrame:
    """objects: path, version, content_type, body, committed_at_unix_millis."""
    made = {
        "path": F.col("path"),
        "version": F.col("version").cast("decimal(20,0)"),
        "content_type": F.col("content_type"),
        "content_length": F.octet_length("body").cast("decimal(20,0)"),
        "content_hash": F.sha2("body", 256),
        "committed_at_unix_millis": F.col("committed_at_unix_millis").cast("decimal(20,0)"),
    }
    return with_identity(scope(objects, d)).select(*IDENTITY, *(native_cell(made[f.name]).alias(f.name) for f in d.fields))


def texts(objects: DataFrame, d: Definition) -> DataFrame:
    """Records with token arrays: per text field the tokens in order, null where the field is no string. At least one field must be. Values of a
    field of several texts are a place apart, by an empty token, so that no phrase crosses them."""
    configure(objects.sparkSession)
    docs = with_identity(scope(objects, d)).withColumn("_v", parsed(F.col("body"))).where("_v is not null")
    fields = [f for f in d.fields if f.type is Type.TEXT]
    made = []
    for f in fields:
        v = X.pointer_get(F.col("_v"), f.pointer, "$[0]")
        one = F.when(_kind(v) == "STRING", X.analyze(F.try_variant_get(v, "$", "string")))
        if f.multi:
            every = F.try_variant_get(v, "$", "array<string>")
            strings = F.when(_kind(v) == "ARRAY<STRING>", every)
            one = F.coalesce(one, multi_text(strings))
        made.append(one.alias(f.name))
    docs = docs.select(*IDENTITY, *made)
    return docs.where(reduce(lambda a, b: a | b, (F.col(f.name).isNotNull() for f in fields)))


def multi_text(strings: Column) -> Column:
    """The tokens of several values, with a gap between them."""
    each = F.transform(strings, X.analyze)
    return F.aggregate(each, F.expr("cast(null as array<string>)"), lambda a, t: F.when(a.isNull(), t).otherwise(F.concat(a, F.array(F.lit("")), t)))


def postings(records: DataFrame, fields: list[str]) -> DataFrame:
    """(identity, field, term, position, norm): norm is the field's number of tokens."""
    each = [records.select(*IDENTITY, F.lit(f).alias("field"), F.size(F.filter(f, lambda t: t != "")).alias("norm"), F.posexplode(f).alias("position", "term")) for f in fields]
    return reduce(DataFrame.unionByName, each).where("term <> ''")


def l2(v: Column) -> Column:
    """A unit vector in single precision, null for a zero norm."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("float"), lambda a, x: (a + x * x).cast("float"))).cast("float")
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float")))


def vectors(objects: DataFrame, d: Definition, column: str = "vector") -> DataFrame:
    """Records of vectors with the definition's dimension and finite numbers; with normalize, unit vectors."""
    v = F.transform(column, lambda x: x.cast("float"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.4028234663852886e38))
    docs = with_identity(scope(objects, d)).where((F.size(column) == d.dimensions) & finite)
    return docs.select(*IDENTITY, (l2(v) if d.normalize else v).alias("vector")).where("vector is not null")


def hybrid(objects: DataFrame, d: Definition, text: str = "text", column: str = "vector") -> DataFrame:
    """Records with tokens and a vector; both must be there."""
    vs = vectors(objects, d, column).drop("source_record", "result_path", "result_version")
    ts = with_identity(scope(objects, d)).where(F.col(text).isNotNull()).select(*IDENTITY, X.analyze(F.col(text)).alias(text))
    return ts.join(vs, ["source_path", "source_version"]).select(*IDENTITY, text, "vector")


def one_or_many(body: Column, record: str) -> Column:
    """A JSON object or an array of them, as an array of structs."""
    return F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{record}>")).otherwise(F.array(F.from_json(body, record)))


TREE = "struct<repository_id: string, commit_id: string, tree_path: string, object_id: string, pack_path: string, pack_version: bigint, offset: bigint, length: bigint>"
TENSOR = "struct<model_id: string, tensor_name: string, source_path: string, source_version: bigint, offset: bigint, length: bigint, dtype: string, shape: array<bigint>>"


def _records(objects: DataFrame, record: str) -> DataFrame:
    return with_identity(objects).select("source_path", "source_version", F.posexplode(one_or_many(F.col("body"), record)).alias("source_record", "r")).where("r is not null")


def _unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A source with a repeated key gives no record at all."""
    many = rows.groupBy("source_path", "source_version", *keys).agg(F.count("*").alias("n")).where("n > 1").select("source_path", "source_version").distinct()
    return rows.join(many, ["source_path", "source_version"], "left_anti")


def tree_manifest(objects: DataFrame, d: Definition) -> DataFrame:
    """Records of version-control trees for one repository; the result is the pack."""
    rows = _records(scope(objects, d), TREE)
    rows = rows.where((F.col("r.repository_id") == d.selector[0]) & (F.col("r.commit_id") != "") & (F.col("r.tree_path") != "") & (F.col("r.pack_path") != "") & (F.col("r.length") >= 0))
    rows = rows.select("source_path", "source_version", F.col("source_record").cast("long").alias("source_record"), F.col("r.pack_path").alias("result_path"), F.col("r.pack_version").alias("result_version"), "r.repository_id", "r.commit_id", "r.tree_path", "r.object_id", "r.offset", "r.length")
    return _unique(rows, ["repository_id", "commit_id", "tree_path"])


def tensor_manifest(objects: DataFrame, d: Definition) -> DataFrame:
    """Records of tensors; the result is the file that holds the tensor."""
    rows = _records(scope(objects, d), TENSOR).where((F.col("r.model_id") != "") & (F.col("r.tensor_name") != "") & (F.col("r.source_path") != "") & (F.col("r.length") >= 0))
    rows = rows.select("source_path", "source_version", F.col("source_record").cast("long").alias("source_record"), F.col("r.source_path").alias("result_path"), F.col("r.source_version").alias("result_version"), "r.model_id", "r.tensor_name", "r.offset", "r.length", "r.dtype", "r.shape")
    return _unique(rows, ["model_id", "tensor_name"])


def fold(log: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """The latest version of each key, tombstones included, in whatever order rows came. Equal versions with different content are corruption."""
    top = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), "version").alias("r"))
    twice = log.groupBy(key, "version").agg((F.min(content) != F.max(content)).alias("torn"))
    torn = twice.where("torn").select(key)
    checked = top.join(torn.distinct().withColumn("_torn", F.lit(True)), key, "left")
    return checked.where(F.when(F.col("_torn"), F.raise_error(F.lit("one version has two contents")).cast("boolean")).otherwise(True)).select("r.*")
