"""Facets and aggregates over all visible matches, whatever page is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import canonical_column
from ..plans.lineage import folder
from ..plans.definition import SPARK, Cap, Definition, Field, Invalid, Type

MAX_COMPUTATIONS = 32
OPS = ("count", "minimum", "maximum", "sum", "average")


def admit(d: Definition, facets: Sequence[tuple[str, int]], aggregates: Sequence[tuple[str, str]]) -> None:
    wanted = [("facet", f) for f, _ in facets] + [(op, f) for f, op in aggregates]
    if len(wanted) > MAX_COMPUTATIONS or len(set(wanted)) != len(wanted):
        raise Invalid("at most 32 computations, all different")
    for f, limit in facets:
        d.field(f).needs(Cap.FACET)
        if not 1 <= limit <= 1000:
            raise Invalid("a facet has 1 to 1000 values")
    for f, op in aggregates:
        if op not in OPS:
            raise Invalid(op)
        d.field(f).needs(Cap.AGGREGATE)


def values(f: Field) -> Column:
    v = F.col(f"`{f.name}`.v")
    return F.coalesce(v if f.multi else F.when(v.isNotNull(), F.array(v)), F.array().cast(f"array<{SPARK[f.type]}>"))


def facet(rows: DataFrame, d: Definition, name: str, limit: int) -> DataFrame:
    """(value as canonical JSON, n): each distinct value once a record, an explicit null as a value of its own; the most frequent first, ties cut by value
    order (null first) and shown by JSON text."""
    f = d.field(name)
    null = F.when(F.col(f"`{name}`.has_null"), F.array(F.lit(None).cast(SPARK[f.type])))
    every = F.concat(F.array_distinct(values(f)), F.coalesce(null, F.array().cast(f"array<{SPARK[f.type]}>")))
    counted = rows.select(F.explode(every).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), F.col("v").asc_nulls_first()).limit(limit)
    return top.select(canonical_column(F.col("v"), SPARK[f.type]).alias("value"), "n").orderBy(F.desc("n"), "value")


def aggregate(rows: DataFrame, d: Definition, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """One row with <op>_<field> and n_<field>, the values that contribute. One pass; empty input gives counts of 0 and nulls."""
    admit(d, [], wanted)
    out: dict[str, Column] = {}
    for name, op in wanted:
        f = d.field(name)
        vs = values(f)
        n = F.coalesce(F.sum(F.size(vs)), F.lit(0)).cast("long")
        whole = f.type is not Type.FLOAT
        zero = F.lit(0).cast("decimal(38,0)") if whole else F.lit(0.0)
        total = F.sum(F.when(F.size(vs) > 0, F.aggregate(vs, zero, lambda a, x: (a + x).cast("decimal(38,0)") if whole else a + x)))
        if whole:
            low, high = (0, 2**64 - 1) if f.type is Type.UNSIGNED else (-(2**63), 2**63 - 1)
            inside = total.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))
        else:
            inside = F.abs(total) <= 1.7976931348623157e308
        fail = F.raise_error(F.lit(f"the sum of {name} is out of range"))
        safe = F.when(total.isNull() | inside, total.cast(SPARK[f.type])).otherwise(fail.cast(SPARK[f.type]))
        out[f"n_{name}"] = n
        out[f"{op}_{name}"] = {
            "count": n,
            "minimum": F.min(F.array_min(vs)),
            "maximum": F.max(F.array_max(vs)),
            "sum": safe,
            "average": F.when(n > 0, total.cast("double") / n),
        }[op]
    return rows.agg(*(c.alias(k) for k, c in out.items()))


def nearest_rank(rows: DataFrame, column: str, percents: Sequence[int]) -> DataFrame:
    """Mean and nearest-rank percentiles: the least value whose rank reaches the percentage of the count; nulls don't count. Frequencies of distinct values are
    written in ranges of values; the sizes of the ranges (one row each) say in which range a rank lies, and only those ranges are ranked, each in its task."""
    spark = rows.sparkSession
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    path = folder(spark, "frequencies")
    counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part")).write.parquet(path)
    written = spark.read.parquet(path)
    sizes = written.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    total, before, wanted = sum(r.n for r in sizes), 0, []
    for r in sizes:
        wanted += [(r.part, before, p, rank) for p in percents if before < (rank := max(1, -(-p * total // 100))) <= before + r.n]
        before += r.n
    w = Window.partitionBy("part").orderBy("v")
    targets = F.broadcast(spark.createDataFrame(wanted, "part int, before long, percent int, rank long"))  # a row for each percentage
    ranked = written.join(F.broadcast(targets.select("part").distinct()), "part", "left_semi").withColumn("_upto", F.sum("n").over(w))
    found = ranked.join(targets, "part").where(F.col("before") + F.col("_upto") >= F.col("rank")).groupBy("percent").agg(F.min("v").alias("v"))
    picked = found.agg(*(F.max(F.when(F.col("percent") == p, F.col("v"))).alias(f"p{p}") for p in percents))
    return rows.agg(F.avg(column).alias("mean")).join(F.broadcast(picked))


def segment_statistics(records: DataFrame, d: Definition) -> DataFrame:
    """One row: records, and per field how many are present, null, and how many values."""
    parts = [F.count("*").alias("records")]
    for f in d.fields:
        parts += [F.count_if(F.col(f"`{f.name}`.present")).alias(f"present_{f.name}"), F.count_if(F.col(f"`{f.name}`.has_null")).alias(f"null_{f.name}"), F.coalesce(F.sum(F.size(values(f))), F.lit(0)).cast("long").alias(f"values_{f.name}")]
    return records.agg(*parts)
