"""Rows of sorted partitions in Arrow: for folds that are sequential by key, with the state of one key at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def tuples(batches: Iterator[pa.RecordBatch], *columns: str, at_once: int = 1024) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield batch()
            held.clear()
    if held:
        yield batch()
