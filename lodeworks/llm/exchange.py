"""Counting and asking over all documents by packed requests and replies.

A chunk (some megabytes of consecutive documents of one partition) asks about its entries, each routed by a 64-bit hash: one row per chunk and range of the hash, the
entries' columns packed. A range's task sees the entries of all chunks and answers each, in the order in which it asked. Shuffled rows are thus thousands of
entries long, a key that every document has is one entry a chunk, ranges are even because routes are hashes, and the number of ranges grows with the
input, so a task holds KEYS_A_RANGE entries or so at any size.

Chunks times ranges would be rows in proportion to the square of the input. So with more than DIRECT ranges entries travel in two hops: chunks ask in about the root of as many
slices, groups of as many chunks pool their entries of one slice, and the pool asks the fine ranges of its slice; replies go back the same way. A chunk then
costs twice the root of the ranges in rows (2000 rows of hundreds of entries at a million ranges, where it would be a million rows of less than one).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of

KEYS_A_RANGE = 1_500_000
#: Up to so many ranges chunks ask them directly.
DIRECT = 256
#: Bytes of text after which a chunk is closed; a longer text is a chunk alone.
CHUNK_BYTES = 8_000_000
ASKED = "asker string, range int, columns array<binary>"
ASKED_SCHEMA = pa.schema([("asker", pa.string()), ("range", pa.int32()), ("columns", pa.list_(pa.binary()))])


class small_batches:
    """Within this block Arrow batches to Python end at 16 MB, for tables of chunks, whose rows have megabytes each. The session's limit is restored."""

    NAME = "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession

    def __enter__(self) -> None:
        self.before = int(self.spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
        if self.before <= 0 or self.before > 16 << 20:
            self.spark.conf.set(self.NAME, "16m")

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.NAME, str(self.before))


def ranges_for(keys: float) -> int:
    return max(1, min(2**30, int(-(-keys // KEYS_A_RANGE))))


def squeeze(a: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, in zstd; the first byte is the item size."""
    size = a.dtype.itemsize
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, size).T) if len(a) else np.empty(0, np.uint8)
    return bytes([size]) + zstandard.ZstdCompressor(1).compress(planes.tobytes())


def expand(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(data[0], -1).T).reshape(-1).view(dtype) if len(raw) else np.empty(0, dtype)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def range_of(route: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash. Ranges of a multiple of as many are parts of these."""
    return ((route >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def sums(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of each, and where each key is among them."""
    order = np.argsort(keys)
    first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
    total = np.add.reduceat(numbers[:, order], first, axis=1) if len(keys) else numbers
    where = np.empty(len(keys), np.int64)
    where[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return keys[order][first], total, where


@dataclass(frozen=True)
class Wire:
    """How entries are packed: per column its dtype, and whether differences of neighbours are sent (for columns that rise)."""

    dtypes: tuple[type, ...]
    rising: tuple[bool, ...]

    def pack(self, columns: list[np.ndarray]) -> list[bytes]:
        return [squeeze(np.diff(c, prepend=c.dtype.type(0)) if up else np.ascontiguousarray(c)) for c, up in zip(columns, self.rising, strict=True)]

    def unpack(self, packed: list[bytes]) -> list[np.ndarray]:
        each = [expand(b, t) for b, t in zip(packed, self.dtypes, strict=True)]
        return [np.cumsum(c, dtype=c.dtype) if up else c for c, up in zip(each, self.rising, strict=True)]

    def rows(self, asker: str, route: np.ndarray, columns: list[np.ndarray], ranges: int, first: int = 0) -> tuple[list[tuple], np.ndarray]:
        """Requests (asker, range, columns) by range, and the order in which the entries are in them."""
        which = range_of(route, ranges)
        order = np.arange(len(which)) if (which[1:] >= which[:-1]).all() else np.argsort(which, kind="stable")
        held, starts = np.unique(which[order], return_index=True)
        ends = np.append(starts[1:], len(which))
        return [(asker, int(r), self.pack([c[order[a:b]] for c in columns])) for r, a, b in zip(held, starts, ends, strict=True)], order


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


#: answer(columns of all entries of a range) -> (replies: an array for each reply column, aligned with the entries; evidence: a number summed up by the caller)
Answer = Callable[[list[np.ndarray]], tuple[list[np.ndarray], int]]
#: combine(columns of pooled entries) -> (columns of fewer entries that ask the same, where each entry is among them)
Combine = Callable[[list[np.ndarray]], tuple[list[np.ndarray], np.ndarray]]
_REPLY = pa.schema([("asker", pa.string()), ("range", pa.int32()), ("reply", pa.list_(pa.binary())), ("evidence", pa.int64())])
_POOLED = pa.schema([("asker", pa.string()), ("range", pa.int32()), ("columns", pa.list_(pa.binary())), ("members", pa.list_(pa.string())), ("slice", pa.int32())])


class Exchange:
    """One kind of question. route(columns) are the entries' hashes; combine, where given, must keep the routes of what it merges together."""

    def __init__(self, wire: Wire, route: Callable[[list[np.ndarray]], np.ndarray], answer: Answer, replies: Wire, ranges: int, combine: Combine | None = None) -> None:
        self.wire, self.route, self.answer, self.replies, self.combine = wire, route, answer, replies, combine
        self.slices = ranges if ranges <= DIRECT else int(np.ceil(ranges**0.5))
        self.per = 1 if ranges <= DIRECT else -(-ranges // self.slices)

    def ask(self, asker: str, columns: list[np.ndarray]) -> tuple[list[tuple], np.ndarray]:
        """Rows of ASKED, and the order in which the replies will come."""
        return self.wire.rows(asker, self.route(columns), columns, self.slices)

    def run(self, asked: DataFrame, askers: int, name: str) -> tuple[DataFrame, int]:
        """(asker, replies): the reply columns of a chunk's ranges, one after the other in the order of ask(); and the sum of evidence. asked: rows of ASKED; askers: about
        how many there are."""
        if self.per == 1:
            told = materialize(self._answered(asked), name)
            return _by_asker(told), _evidence(told)
        groups = max(1, -(-askers // self.per))
        keyed = asked.withColumn("_group", F.pmod(F.xxhash64("asker"), F.lit(groups)).cast("int"))
        pooled = materialize(keyed.groupBy("_group", "range").applyInArrow(lambda key, table: self._pool(key, table), "asker string, range int, columns array<binary>, members array<string>, slice int"), f"{name}_pooled")
        told = materialize(self._answered(pooled.where("range >= 0").select("asker", "range", "columns")), f"{name}_told")
        meta = pooled.where("range < 0").select("asker", "columns", "members", "slice")
        back = meta.join(_by_asker(told), "asker").mapInArrow(lambda batches: self._unpool(batches), "asker string, range int, reply array<binary>, evidence long")
        return _by_asker(materialize(back, name)), _evidence(told)

    def _answered(self, asked: DataFrame) -> DataFrame:
        def reply(table: pa.Table) -> pa.Table:
            parts = [self.wire.unpack(c) for c in table.column("columns").to_pylist()]
            found, evidence = self.answer([np.concatenate(c) for c in zip(*parts, strict=True)])
            ends = np.cumsum([len(p[0]) for p in parts]).tolist()
            packed = [self.replies.pack([f[e - len(p[0]) : e] for f in found]) for p, e in zip(parts, ends, strict=True)]
            columns = [table.column("asker"), table.column("range"), pa.array(packed, pa.list_(pa.binary())), pa.array([evidence, *[0] * (len(parts) - 1)], pa.int64())]
            return pa.table(columns, schema=_REPLY)

        return asked.groupBy("range").applyInArrow(reply, "asker string, range int, reply array<binary>, evidence long")

    def _pool(self, key: tuple, table: pa.Table) -> pa.Table:
        """The entries of a group's chunks in one slice, asked about together; and a row that tells whose they are."""
        asker, names = f"{key[0].as_py()}/{key[1].as_py()}", table.column("asker").to_pylist()
        parts = [self.wire.unpack(c) for c in table.column("columns").to_pylist()]
        columns, where = [np.concatenate(c) for c in zip(*parts, strict=True)], None
        if self.combine is not None:
            columns, where = self.combine(columns)
        rows, order = self.wire.rows(asker, self.route(columns), columns, self.slices * self.per)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sent = (place if where is None else place[where]).astype(np.uint32)
        meta = (asker, -1, [squeeze(sent), squeeze(np.array([len(p[0]) for p in parts], np.int64))], names, key[1].as_py())
        return table_of([*((*r, None, None) for r in rows), meta], _POOLED)

    def _unpool(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed, members, slice_, replies in rows_of(batches, "columns", "members", "slice", "replies", at_once=1):
            sent, ends = expand(packed[0], np.uint32), np.cumsum(expand(packed[1], np.int64)).tolist()
            found = [c[sent] for c in joined(replies, self.replies)]
            rows = [(m, slice_, self.replies.pack([f[a:b] for f in found]), 0) for m, a, b in zip(members, [0, *ends], ends, strict=False)]
            yield batch_of(rows, _REPLY)


def _by_asker(told: DataFrame) -> DataFrame:
    """Replies in the order of ranges."""
    return told.groupBy("asker").agg(F.transform(F.sort_array(F.collect_list(F.struct("range", "reply"))), lambda x: x["reply"]).alias("replies"))


def _evidence(told: DataFrame) -> int:
    return told.agg(F.coalesce(F.sum("evidence"), F.lit(0))).first()[0]


def joined(replies: list[list[bytes]] | None, wire: Wire) -> list[np.ndarray]:
    """The reply columns of one asker, in the order of its request."""
    each = [wire.unpack(r) for r in replies or []]
    return [np.concatenate(c) for c in zip(*each, strict=True)] if each else [np.empty(0, t) for t in wire.dtypes]


def adding(columns: int) -> tuple[Wire, Answer, Wire, Combine]:
    """Wires, answer and pooling of counts: entries are sorted distinct keys and so many numbers each; the replies are the sums over all askers in 64 bits; the evidence is how
    many distinct keys have a sum over 0."""
    wire = Wire((np.uint64,) * (columns + 1), (True,) + (False,) * columns)

    def answer(entries: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
        _, total, where = sums(entries[0], np.stack(entries[1:]))
        return list(total[:, where]), int((total.sum(axis=0) > 0).sum())

    def combine(entries: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        keys, total, where = sums(entries[0], np.stack(entries[1:]))
        return [keys, *total], where

    return wire, answer, Wire((np.uint64,) * columns, (False,) * columns), combine
