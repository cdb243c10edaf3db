"""Scalar functions: JSON pointers, canonical scalars, templates, prefixes, the text analyzer, normalisations."""

from __future__ import annotations

import copy
import json
import math
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RESERVED = ".system"


# --- paths -------------------------------------------------------------------------------------------------------------
def valid_path(path: Column) -> Column:
    """Canonical object paths: no slash at an end, no empty, "." or ".." segment, no control character, at most 4096 bytes."""
    good = (path != "") & ~path.startswith("/") & ~path.endswith("/") & ~path.contains("//") & ~path.rlike(r"[\x00-\x1F\x7F]")
    return good & ~path.rlike(r"(^|/)\.{1,2}(/|$)") & (F.octet_length(path) <= 4096)


def reserved(path: Column) -> Column:
    return F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{RESERVED}/")


def in_scope(path: Column, prefix: str) -> Column:
    """Scope of a definition: equal or below; a prefix that ends in a slash is raw; an empty one is everything."""
    if prefix == "":
        return F.lit(True)
    return path.startswith(prefix) if prefix.endswith("/") else (path == prefix) | path.startswith(prefix + "/")


def below(path: Column, prefix: Column | str) -> Column:
    """Prefix of watches, policies and accounting: equal or a child after a slash."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def ancestors(path: Column) -> Column:
    """All prefixes of a path at slashes: "", each directory, the whole path."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


# --- JSON pointers -----------------------------------------------------------------------------------------------------
def tokens(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/") or re.search(r"~(?![01])", pointer):
        raise ValueError(f"pointer {pointer!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def variant_paths(pointer: str, root: str = "$") -> list[str]:
    """Variant paths of a pointer; a number is an object's key or an array's place, so it gives two."""
    out = [root]
    for t in tokens(pointer):
        key = "['" + t.replace("\\", "\\\\").replace("'", "\\'") + "']"
        out = [p + step for p in out for step in ([key, f"[{int(t)}]"] if re.fullmatch(r"0|[1-9][0-9]{0,8}", t) else [key])]
    return out


def pointer_get(value: Column, pointer: str, root: str = "$") -> Column:
    """The variant at the pointer; SQL null where there is none."""
    found = [F.expr("null").cast("variant")] and [F.variant_get(value, p, "variant") for p in variant_paths(pointer, root)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def array_place(token: str, size: int) -> int:
    """A number without leading zeros, below size."""
    if not re.fullmatch(r"0|[1-9][0-9]*", token) or int(token) >= size:
        raise KeyError(token)
    return int(token)


def json_select(doc: Any, pointer: str) -> Any:
    """KeyError where there is none."""
    for t in tokens(pointer):
        doc = doc[array_place(t, len(doc))] if isinstance(doc, list) else doc[t] if isinstance(doc, dict) else _missing(t)
    return doc


def _missing(token: str) -> Any:
    raise KeyError(token)


def json_set(doc: Any, pointer: str, value: Any) -> Any:
    """A copy with the value at the pointer: replaces or adds a key, replaces an element; the parent must exist."""
    path = tokens(pointer)
    return _set(copy.deepcopy(doc), path, value) if path else copy.deepcopy(value)


def json_remove(doc: Any, pointer: str) -> Any:
    """A copy without what is at the pointer, which must be there."""
    return _remove(copy.deepcopy(doc), tokens(pointer))


def _parent(doc: Any, path: list[str]) -> Any:
    for t in path[:-1]:
        doc = doc[array_place(t, len(doc))] if isinstance(doc, list) else doc[t] if isinstance(doc, dict) else _missing(t)
    return doc


def _set(doc: Any, path: list[str], value: Any) -> Any:
    """json_set() in place, of a pointer's tokens."""
    if not path:
        return value
    parent = _parent(doc, path)
    if isinstance(parent, list):
        parent[array_place(path[-1], len(parent))] = value
    elif isinstance(parent, dict):
        parent[path[-1]] = value
    else:
        raise KeyError(path[-1])
    return doc


def _remove(doc: Any, path: list[str]) -> Any:
    """json_remove() in place, of a pointer's tokens."""
    if not path:
        raise KeyError("")
    parent = _parent(doc, path)
    if isinstance(parent, list):
        del parent[array_place(path[-1], len(parent))]
    elif isinstance(parent, dict):
        del parent[path[-1]]
    else:
        raise KeyError(path[-1])
    return doc


def canonical(value: Any) -> str:
    """The canonical text of a JSON scalar."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("not finite")
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def parse_canonical(text: str) -> Any:
    value = json.loads(text)
    if isinstance(value, (dict, list)) or canonical(value) != text:
        raise ValueError(f"{text!r} is no canonical JSON scalar")
    return value


def canonical_column(value: Column, type_: str) -> Column:
    """Canonical JSON text of a typed column; null becomes the word null."""
    text = F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":', ""), r"\}$", "")) if type_ == "string" else value.cast("string")
    return F.coalesce(text, F.lit("null"))


def checked_integer(value: Any, unsigned: bool) -> int:
    low, high = (0, 2**64 - 1) if unsigned else (-(2**63), 2**63 - 1)
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise OverflowError(value)
    return value


def checked_add(a: int, b: int, unsigned: bool, least: int | None = None, most: int | None = None) -> int:
    total = checked_integer(checked_integer(a, unsigned) + b, unsigned)
    if (least is not None and total < least) or (most is not None and total > most):
        raise OverflowError(total)
    return total


COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}


def expand(template: str, values: dict[str, Any]) -> str:
    """{name} becomes the value's text; {{ and }} are braces."""
    out, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}|[{}]", template):
        out.append(template[at : m.start()])
        if m[1]:
            if m[1] not in values:
                raise KeyError(m[1])
            out.append(str(values[m[1]]))
        elif len(m[0]) == 2:
            out.append(m[0][0])
        else:
            raise ValueError(f"brace at {m.start()} in {template!r}")
        at = m.end()
    return "".join([*out, template[at:]])


# --- text --------------------------------------------------------------------------------------------------------------
def analyze(text: Column) -> Column:
    """Tokens in order: runs of letters and numbers, lower-cased one by one; a capital sigma is always a plain one."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), F.lit(1))
    return F.transform(found, lambda t: F.lower(F.translate(t, "Σ", "σ")))


def analyze_text(text: str) -> list[str]:
    """The tokens of a query's text, by the same expression; Catalyst folds it, so no job runs."""
    return SparkSession.active().sql("select 1").select(analyze(F.lit(text)).alias("t")).first()[0]


# --- feed normalisation --------------------------------------------------------------------------------------------------
def trimmed(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def sorted_distinct(texts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ecosystem(text: Column) -> Column:
    """Trimmed, A-Z lower-cased; cargo is crates.io. What follows a colon belongs to the name."""
    low = ascii_lower(F.trim(text))
    return F.when(low == "cargo", "crates.io").otherwise(low)


def package(eco: Column, name: Column) -> Column:
    """Trimmed. pypi: A-Z lower-cased, runs of dots, dashes and underscores one dash, none at an end; npm: lower-cased; others as they are."""
    name = F.trim(name)
    pypi = F.regexp_replace(F.regexp_replace(ascii_lower(name), r"[-_.]+", "-"), "^-|-$", "")
    return F.when(eco == "pypi", pypi).when(eco == "npm", ascii_lower(name)).otherwise(name)


def partition(eco: Column) -> Column:
    return F.when(eco.isin("cargo", "crates.io"), "cargo").when(eco.isin("npm", "pypi"), eco).otherwise("other")


def identity(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def day(stamp: Column) -> Column:
    """The first ten characters where they are digits and dashes of a date's form, whatever its month and day, else "unknown"."""
    return F.when(stamp.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(stamp, 1, 10)).otherwise("unknown")


# --- functions of columns for edits, arithmetic, comparison and templates --------------------------------------------------
def _edited(edit: Callable[..., Any]) -> Callable[..., Any]:
    """Of a JSON text: canonical text after the edit of what was parsed, which nobody else holds; null where a text doesn't parse or the edit isn't possible."""
    write = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode

    def one(doc: str | None, *rest: str | None) -> str | None:
        try:
            return None if doc is None else write(edit(json.loads(doc), *rest))
        except (KeyError, ValueError):
            return None

    return one


def set_column(doc: Column, pointer: str, value: Column) -> Column:
    """json_set() of a column; value: JSON text."""
    path = tokens(pointer)

    @F.pandas_udf("string")
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        one = _edited(lambda d, v: _set(d, path, json.loads(v)))
        return pd.Series([None if v is None else one(d, v) for d, v in zip(docs, values, strict=True)], dtype=object)

    return run(doc, value)


def remove_column(doc: Column, pointer: str) -> Column:
    """json_remove() of a column."""
    path = tokens(pointer)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        one = _edited(lambda d: _remove(d, path))
        return pd.Series([one(d) for d in docs], dtype=object)

    return run(doc)


def add_column(a: Column, b: Column, unsigned: bool = False, least: int | None = None, most: int | None = None) -> Column:
    """checked_add() of columns; null where an operand or the sum leaves its type or the bounds. Signed: long; unsigned: decimal(20, 0)."""
    total = a.cast("decimal(21,0)") + b.cast("decimal(21,0)")
    low, high = (0, 2**64 - 1) if unsigned else (-(2**63), 2**63 - 1)
    low, high = max(low, low if least is None else least), min(high, high if most is None else most)
    limit = lambda x: F.lit(Decimal(x)).cast("decimal(22,0)")
    return F.when((total >= limit(low)) & (total <= limit(high)), total.cast("decimal(20,0)" if unsigned else "long"))


def compare_columns(op: str, a: Column, b: Column) -> Column:
    return COMPARE[op](a, b)


def expand_column(template: str, values: dict[str, Column]) -> Column:
    """expand() with a column for each name; null where a value is."""
    parts, at = [], 0
    expand(template, dict.fromkeys(values, ""))  # refuses what expand() refuses
    for m in re.finditer(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(values[m[1]].cast("string") if m[1] else F.lit(m[0][0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


# --- placement -----------------------------------------------------------------------------------------------------------
def rendezvous(key: Column, nodes: dict[int, float]) -> Column:
    """The nodes by descending score weight / -log2(h), h in (0, 1) a hash of key and node: each node gets keys in proportion to its weight, and one that comes or
    goes moves only its own. Ties go to the lesser node."""

    def distance(node: int, weight: float) -> Column:
        h = F.conv(F.substring(F.sha2(F.concat(key, F.lit(f"\0{node}")), 256), 1, 13), 16, 10).cast("long")
        return -F.log2((h + 0.5) / float(2**52)) / weight

    return F.transform(F.array_sort(F.array(*(F.struct(distance(n, w).alias("d"), F.lit(n).alias("n")) for n, w in nodes.items()))), lambda x: x["n"])


# --- order-preserving keys -----------------------------------------------------------------------------------------------
def order_key(value: Column, type_: str, down: bool = False) -> Column:
    """Bytes that sort as the values do: nulls first, then by value; with down the reverse. Texts end by 00 00 and spell 00 as 00 FF, so that
    keys of several columns can stand one after the other."""
    if type_ == "string":
        body = F.concat(F.regexp_replace(F.hex(value.cast("binary")), "(..)", "$1,"), F.lit(""))
        body = F.concat(F.replace(F.regexp_replace(body, "00,", "00FF,"), F.lit(","), F.lit("")), F.lit("0000"))
    elif type_ == "long":
        body = F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    elif type_ == "double":
        bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + 0.0).cast("long")
        body = F.lpad(F.hex(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(2**63))))), 16, "0")
    else:
        raise ValueError(type_)
    text = F.coalesce(F.concat(F.lit("01"), body), F.lit("00"))
    return F.unhex(F.translate(text, "0123456789ABCDEF", "FEDCBA9876543210") if down else text)
