"""Predicates on index records. A field of several values matches by any of them. A predicate is a set of records: null counts as false, which filters do by
themselves, and negation does first; so plain comparisons stay plain and reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..plans.definition import SPARK, Cap, Definition, Field, Invalid, Type

MAX_VALUES = 64


@dataclass(frozen=True)
class Predicate:
    op: str  # equal, in, prefix, lt, le, gt, ge, range, exists, full_text, phrase, and, or, not, all
    field: str = ""
    values: tuple = ()
    inclusive: tuple[bool, bool] = (True, True)
    children: tuple[Predicate, ...] = ()


def equal(field: str, value: Any) -> Predicate:
    return Predicate("equal", field, (value,))


def among(field: str, *values: Any) -> Predicate:
    return Predicate("in", field, values)


def prefix(field: str, text: str) -> Predicate:
    return Predicate("prefix", field, (text,))


def compare(op: str, field: str, value: Any) -> Predicate:
    return Predicate(op, field, (value,))


def between(field: str, low: Any, high: Any, inclusive: tuple[bool, bool] = (True, True)) -> Predicate:
    return Predicate("range", field, (low, high), inclusive)


def exists(field: str) -> Predicate:
    return Predicate("exists", field)


def full_text(field: str, text: str) -> Predicate:
    return Predicate("full_text", field, (text,))


def phrase(field: str, text: str) -> Predicate:
    return Predicate("phrase", field, (text,))


def both(*children: Predicate) -> Predicate:
    return Predicate("and", children=children)


def either(*children: Predicate) -> Predicate:
    return Predicate("or", children=children)


def negate(child: Predicate) -> Predicate:
    return Predicate("not", children=(child,))


EVERY = Predicate("all")


def decode(field: Field, text: str) -> Any:
    """A value from its canonical JSON text, checked against the field's type."""
    try:
        value = X.parse_canonical(text)
    except ValueError as e:
        raise Invalid(str(e)) from e
    return checked(field, value)


def checked(field: Field, value: Any) -> Any:
    if value is None:
        return None
    ok = {
        Type.BOOLEAN: isinstance(value, bool),
        Type.KEYWORD: isinstance(value, str),
        Type.TEXT: isinstance(value, str),
        Type.SIGNED: isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63,
        Type.UNSIGNED: isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 2**64,
        Type.FLOAT: isinstance(value, (int, float)) and not isinstance(value, bool) and float(value) == value and abs(value) != float("inf"),
    }[field.type]
    if not ok:
        raise Invalid(f"{value!r} is no {field.type}")
    return Decimal(value) if field.type is Type.UNSIGNED else float(value) if field.type is Type.FLOAT else value


def literal(field: Field, value: Any) -> Column:
    return F.lit(checked(field, value)).cast(SPARK[field.type])


def _any(field: Field, test) -> Column:
    v = F.col(f"`{field.name}`.v")
    return F.exists(v, test) if field.multi else test(v)


def compile_(p: Predicate, d: Definition) -> Column:
    """A Column; Invalid where the definition doesn't allow the predicate."""
    if p.op == "all":
        return F.lit(True)
    if p.op in ("and", "or"):
        if not p.children:
            raise Invalid(f"empty {p.op}")
        parts = [compile_(c, d) for c in p.children]
        return reduce((lambda a, b: a & b) if p.op == "and" else (lambda a, b: a | b), parts)
    if p.op == "not":
        return ~F.coalesce(compile_(p.children[0], d), F.lit(False))
    f = d.field(p.field)
    if p.op == "exists":
        return F.col(f"`{f.name}`.present") if f.type is not Type.TEXT else F.col(f.name).isNotNull()
    if p.op == "equal":
        f.needs(Cap.EXACT)
        return F.col(f"`{f.name}`.has_null") if p.values[0] is None else _any(f, lambda v: v == literal(f, p.values[0]))
    if p.op == "in":
        f.needs(Cap.EXACT)
        if not 1 <= len(p.values) <= MAX_VALUES:
            raise Invalid(f"1 to {MAX_VALUES} values")
        known = [literal(f, v) for v in p.values if v is not None]
        hit = _any(f, lambda v: v.isin(*known)) if known else F.lit(False)
        return hit | F.col(f"`{f.name}`.has_null") if len(known) < len(p.values) else hit
    if p.op == "prefix":
        f.needs(Cap.PREFIX)
        if not p.values[0]:
            raise Invalid("empty prefix")
        return _any(f, lambda v: v.startswith(p.values[0]))
    if p.op in ("lt", "le", "gt", "ge"):
        f.needs(Cap.RANGE)
        bound = literal(f, p.values[0])
        return _any(f, lambda v: {"lt": v < bound, "le": v <= bound, "gt": v > bound, "ge": v >= bound}[p.op])
    if p.op == "range":
        f.needs(Cap.RANGE)
        low, high = (literal(f, v) for v in p.values)
        return _any(f, lambda v: (v >= low if p.inclusive[0] else v > low) & (v <= high if p.inclusive[1] else v < high))
    if p.op in ("full_text", "phrase"):
        f.needs(Cap.FULL_TEXT)
        tokens = X.analyze_text(p.values[0])
        if not tokens:
            raise Invalid("no token in the query")
        return holds_all(F.col(f.name), tokens) if p.op == "full_text" else holds_phrase(F.col(f.name), tokens)
    raise Invalid(f"operator {p.op}")


def holds_all(tokens: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, (F.array_contains(tokens, w) for w in dict.fromkeys(wanted))), F.lit(False))


def holds_phrase(tokens: Column, wanted: Sequence[str]) -> Column:
    """First all tokens, then places: the phrase stands in the tokens joined by a character that no token has."""
    joined = F.concat(F.lit("\x01"), F.array_join(tokens, "\x01"), F.lit("\x01"))
    return holds_all(tokens, wanted) & F.coalesce(joined.contains("\x01" + "\x01".join(wanted) + "\x01"), F.lit(False))


def live(records: DataFrame, heads: DataFrame) -> DataFrame:
    """Records whose source, and result where that is another object, are the current live versions."""
    now = heads.where(~F.col("deleted")).select("path", "version")
    source = records.join(now.select(F.col("path").alias("source_path"), F.col("version").alias("source_version")), ["source_path", "source_version"], "left_semi")
    return source.join(now.select(F.col("path").alias("result_path"), F.col("version").alias("result_version")), ["result_path", "result_version"], "left_semi")


def visible(records: DataFrame, heads: DataFrame, authorized: DataFrame | None) -> DataFrame:
    """The gate before ranking, facets and aggregates: current, and authorized (a table of paths)."""
    current = live(records, heads)
    return current if authorized is None else current.join(authorized.select(F.col("path").alias("result_path")), "result_path", "left_semi")
