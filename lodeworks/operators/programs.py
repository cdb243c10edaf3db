"""Deterministic programs on JSON documents: assertions on what was before, then sequential operations, then one bundle of writes or none."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.scalar import COMPARE, checked_add, checked_integer, expand, expand_column, json_remove, json_select, json_set
from ..functions.streams import batched, tuples
from ..plans.definition import Invalid

MAX_PATHS, MAX_WRITES, MAX_STEPS, MAX_BYTES = 16, 16, 64, 1 << 20


@dataclass(frozen=True)
class Assertion:
    kind: str  # exists, absent, json_equal, integer
    path: str
    pointer: str = ""
    value: Any = None
    op: str = "eq"


@dataclass(frozen=True)
class Step:
    kind: str  # set, remove, add, copy, replace
    path: str
    pointer: str = ""
    value: Any = None
    source: str = ""
    source_pointer: str = ""
    least: int | None = None
    most: int | None = None
    unsigned: bool = False


@dataclass(frozen=True)
class Program:
    assertions: tuple[Assertion, ...] = ()
    steps: tuple[Step, ...] = ()
    outputs: tuple[tuple[str, str, str], ...] = ()  # name, path, pointer


@dataclass(frozen=True)
class Bundle:
    ok: bool
    why: str
    expected: dict[str, int | None]
    writes: dict[str, Any]
    outputs: dict[str, Any]


class _Failed(Exception):
    pass


def bind(value: Any, inputs: dict[str, Any]) -> Any:
    """{"$input": name} stands for an input, whole; strings are templates nowhere but in paths."""
    if isinstance(value, dict) and set(value) == {"$input"}:
        return inputs[value["$input"]]
    return value


def paths(program: Program, inputs: dict[str, Any]) -> list[str]:
    """The expanded paths in canonical order, which is the order of locks."""
    found = {expand(p, inputs) for x in (*program.assertions, *program.steps) for p in (x.path, getattr(x, "source", "")) if p}
    found |= {expand(p, inputs) for _, p, _ in program.outputs}
    return sorted(found, key=str.encode)


def evaluate(program: Program, inputs: dict[str, Any], before: dict[str, tuple[int | None, Any]]) -> Bundle:
    """before: (version, document) of each path; a document of None is absent. All or nothing."""
    names = paths(program, inputs)
    if len(names) > MAX_PATHS or len(program.steps) + len(program.assertions) > MAX_STEPS:
        raise Invalid("program too large")
    expected = {p: before.get(p, (None, None))[0] for p in names}
    old = {p: before.get(p, (None, None))[1] for p in names}
    work = dict(old)
    try:
        for a in program.assertions:
            doc = old[expand(a.path, inputs)]
            try:
                here = json_select(doc, a.pointer) if doc is not None else None
                there = doc is not None
            except KeyError:
                here, there = None, False
            value = bind(a.value, inputs)
            good = {
                "exists": lambda: there,
                "absent": lambda: not there,
                "json_equal": lambda: there and json.dumps(here, sort_keys=True) == json.dumps(value, sort_keys=True),
                "integer": lambda: there and isinstance(here, int) and not isinstance(here, bool) and COMPARE[a.op](here, value),
            }[a.kind]()
            if not good:
                raise _Failed(f"assertion {a.kind} {a.path}{a.pointer}")
        for s in program.steps:
            p = expand(s.path, inputs)
            value = bind(s.value, inputs)
            if s.kind == "replace":
                work[p] = value
            elif s.kind == "remove" and s.pointer == "":
                if work[p] is None:
                    raise _Failed(f"{p} is absent")
                work[p] = None
            elif s.kind == "set":
                work[p] = json_set(work[p], s.pointer, value)
            elif s.kind == "remove":
                work[p] = json_remove(work[p], s.pointer)
            elif s.kind == "copy":
                work[p] = json_set(work[p], s.pointer, json_select(work[expand(s.source, inputs)], s.source_pointer))
            elif s.kind == "add":
                work[p] = json_set(work[p], s.pointer, checked_add(json_select(work[p], s.pointer), checked_integer(value, False), s.unsigned, s.least, s.most))
            else:
                raise Invalid(s.kind)
        writes = {p: work[p] for p in names if work[p] != old[p]}
        if len(writes) > MAX_WRITES or len(json.dumps(writes)) > MAX_BYTES:
            raise _Failed("too much to write")
        outputs = {n: json_select(work[expand(p, inputs)], q) for n, p, q in program.outputs}
    except (_Failed, KeyError, OverflowError) as e:
        return Bundle(False, str(e), expected, {}, {})
    return Bundle(True, "", expected, writes, outputs)


def run_by_key(calls: DataFrame, program: Program, key: str, state_path: str, start: Any, outputs: Sequence[str]) -> DataFrame:
    """calls: key, ordinal, inputs (JSON). Runs a program once per call, in order, on the key's own document, whose path is state_path expanded with
    the inputs. (key, applied, failed, document): keys are independent, so this spreads; a key's calls are sequential by definition, and stream through
    its task in order, which holds one document."""
    kind = calls.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("applied", pa.int64()), ("failed", pa.int64()), ("document", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, rows in groupby(tuples(batches, key, "inputs"), key=lambda r: r[0]):
            doc, version, applied, failed = start, 0, 0, 0
            for inputs in (json.loads(r[1]) for r in rows):
                path = expand(state_path, inputs)
                b = evaluate(program, inputs, {path: (version, doc)})
                if b.ok:
                    doc, version, applied = b.writes.get(path, doc), version + bool(b.writes), applied + 1
                else:
                    failed += 1
            yield k, applied, failed, json.dumps(doc)

    ordered = calls.select(key, "ordinal", "inputs").repartition(key).sortWithinPartitions(key, "ordinal")
    return ordered.mapInArrow(lambda batches: batched(fold(batches), schema), f"`{key}` {kind.simpleString()}, applied long, failed long, document string")


def lock_order(program: Program, inputs: dict[str, Column]) -> Column:
    """paths() for a table of calls: the distinct expanded paths of each, in byte order, in which a committer takes its locks."""
    found = {p for x in (*program.assertions, *program.steps) for p in (x.path, getattr(x, "source", "")) if p} | {p for _, p, _ in program.outputs}
    return F.array_sort(F.array_distinct(F.array(*(expand_column(p, inputs) for p in sorted(found)))))


def conflicts(calls: DataFrame, paths_: str = "paths") -> DataFrame:
    """(path, ordinal, waits_for): for each path that a call locks, the call before it on that path. A call runs once all that it waits for are done, so
    calls without a common path run at once. One sort by path; a path's calls are one chain by definition."""
    locks = calls.select("ordinal", F.explode(paths_).alias("path"))
    return locks.withColumn("waits_for", F.lag("ordinal").over(Window.partitionBy("path").orderBy("ordinal")))
