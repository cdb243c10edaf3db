"""Line dedup by content-defined chunks of lines.

A line's hash is rolled with those of the ROLL - 1 lines before it; a chunk ends after a line whose rolled hash is 0 modulo MEAN_LINES. Boundaries
thus depend on ROLL lines only, and text that moves within or between documents is cut alike. Chunks of several lines, of which one has a
word, are counted over all documents by hash. Chunks with a repeated hash are compared by their bytes: grouping is by the bytes
themselves. The first copy stays (least doc_id, then text hash, then place; null ids last), the others are removed with their line ends.

A passage rarely begins and ends where chunks do, and a short one has no whole chunk. So dedup_runs() matches the windows of two lines at every place too,
counted and compared in the same way: each repeated run of two lines or more is found to its edges, whatever surrounds it. dedup() removes chunks only.

Hot chunks: grouping combines within tasks first, so a chunk that a third of all documents have is one row a task; occurrences meet hot
groups by a broadcast of fewer than HOT_SHARE rows.

Defined results: null texts stay null and have no lines; empty texts have one empty line and no chunk; repeated rows are one document and stay both,
or lose the same lines; an empty table gives an empty result; other columns stay where lines are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, materialize, neutral, read, restore, rows_of, utf8

ROLL, MEAN_LINES, MIN_LINES = 2, 4, 2
#: windows are numbered from here, by their first line; chunks below
WINDOWS = 2**30
LAST = 2**63 - 1
KEY = ["_id", "_t"]


def chunks(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(first line, one past the last, lines) of each chunk."""
    lines = text.split(b"\n")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    rolled = hashes.copy()
    for back in range(1, ROLL):
        rolled[back:] = rolled[back:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-back]
    rolled ^= rolled >> np.uint64(32)
    ends = (np.flatnonzero(rolled % np.uint64(MEAN_LINES) == 0) + 1).tolist()
    if not ends or ends[-1] != len(lines):
        ends.append(len(lines))
    return [(a, b, lines[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def eligible(lines: list[bytes]) -> bool:
    return len(lines) >= MIN_LINES and any(x.strip() for x in lines)


def windows(lines: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(first line, bytes) of each two lines that follow one another, of which one has a word."""
    worded = [bool(x.strip()) for x in lines]
    for i in range(len(lines) - 1):
        if worded[i] or worded[i + 1]:
            yield i, lines[i] + b"\n" + lines[i + 1]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_t"), "text")


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for doc, t, text in rows_of(batches, "_id", "_t", "text"):
        if text is None:
            continue
        out += [(doc, t, i, xxhash.xxh3_64_intdigest(b"\n".join(lines)) - 2**63) for i, (_, _, lines) in enumerate(chunks(utf8(text))) if eligible(lines)]
        if len(out) > 16384:
            yield _emit(out, [pa.int64(), pa.int64(), pa.int32(), pa.int64()], [*KEY, "chunk", "h"])
            out = []
    if out:
        yield _emit(out, [pa.int64(), pa.int64(), pa.int32(), pa.int64()], [*KEY, "chunk", "h"])


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of find(), and the windows; another seed keeps their hashes apart."""
    types, names = [pa.int64(), pa.int64(), pa.int32(), pa.int64()], [*KEY, "chunk", "h"]
    out: list[tuple] = []
    for doc, t, text in rows_of(batches, "_id", "_t", "text"):
        if text is None:
            continue
        data = utf8(text)
        out += [(doc, t, i, xxhash.xxh3_64_intdigest(b"\n".join(lines)) - 2**63) for i, (_, _, lines) in enumerate(chunks(data)) if eligible(lines)]
        out += [(doc, t, WINDOWS + i, xxhash.xxh3_64_intdigest(body, 1) - 2**63) for i, body in windows(data.split(b"\n"))]
        if len(out) > 16384:
            yield _emit(out, types, names)
            out = []
    if out:
        yield _emit(out, types, names)


def _emit(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks and windows that are asked for."""
    types, names = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()], [*KEY, "chunk", "h", "bytes"]
    out, held = [], 0
    for doc, t, text, asked in rows_of(batches, *KEY, "text", "_asked"):
        every, lines = chunks(utf8(text)), utf8(text).split(b"\n")
        for ask in asked:
            at = ask["chunk"] - WINDOWS
            body = b"\n".join(lines[at : at + 2] if at >= 0 else every[ask["chunk"]][2])
            out.append((doc, t, ask["chunk"], ask["h"], body))
            held += len(body)
        if held > 4_000_000:
            yield _emit(out, types, names)
            out, held = [], 0
    if out:
        yield _emit(out, types, names)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces text by what stays of it; adds n_lines, n_chunks and n_removed_lines."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts, lines, many, removed = [], [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("_gone").to_pylist(), strict=True):
                n = 0 if text is None else text.count("\n") + 1
                lost, k = 0, 0
                if gone:
                    every, drop, lost_lines = chunks(utf8(text)), {x for x in gone if x < WINDOWS}, set()
                    for i in drop:
                        lost_lines.update(range(*every[i][:2]))
                    for x in gone:
                        if x >= WINDOWS:
                            lost_lines.update((x - WINDOWS, x - WINDOWS + 1))
                    keep = [x for i, x in enumerate(utf8(text).split(b"\n")) if i not in lost_lines]
                    lost, k = n - len(keep), len(drop)
                    text = b"\n".join(keep).decode("utf-8", "surrogatepass")
                texts.append(text)
                lines.append(n)
                many.append(k)
                removed.append(lost)
            columns = {name: part.column(name) for name in part.schema.names if name not in ("text", "_gone")}
            columns |= {"text": pa.array(texts, pa.string()), "_n_lines": pa.array(lines, pa.int64()), "_n_chunks": pa.array(many, pa.int64()), "_n_lost": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)


def removals(docs: DataFrame, seek: Callable | None = None) -> DataFrame:
    """(_id, _t, _gone): the chunks, and with find_runs the windows, that each document loses."""
    keyed = _keyed(docs)
    found = materialize(keyed.mapInArrow(seek or find, "_id long, _t long, chunk int, h long"), "chunks").distinct()
    shared = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows = materialize(hot_join(found, shared, ["h"], "n", found.count()), "candidates")
    asked = rows.groupBy(*KEY).agg(F.collect_list(F.struct("chunk", "h")).alias("_asked"))
    bodies = keyed.where("text is not null").dropDuplicates(KEY) if _repeats(docs) else keyed.where("text is not null")
    bodies = bodies.join(asked.hint("merge"), KEY).mapInArrow(fetch, "_id long, _t long, chunk int, h long, bytes binary")
    place = F.struct("_id", "_t", "chunk")
    same = materialize(bodies.groupBy("h", "bytes").agg(F.min(place).alias("first"), F.count("*").alias("copies")).select("h", "first", "copies", F.sha2("bytes", 256).alias("digest")), "compared")
    texts = same.groupBy("h").agg(F.count("*").alias("kinds"), F.first("first").alias("first"), F.first("copies").alias("n"))
    sole = hot_join(rows.drop("n"), texts.where("kinds = 1 and n > 1").drop("kinds"), ["h"], "n", found.count())
    gone = sole.where(place != F.col("first")).select(*KEY, "chunk")
    split = texts.where("kinds > 1")
    if split.take(1):  # different chunks with one hash
        again = bodies.withColumn("digest", F.sha2("bytes", 256)).join(split.select("h"), "h", "left_semi").drop("bytes")
        again = again.join(same, ["h", "digest"]).where(place != F.col("first"))
        gone = gone.unionByName(again.select(*KEY, "chunk"))
    return materialize(gone.groupBy(*KEY).agg(F.collect_list("chunk").alias("_gone")), "gone")


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").take(1))


def dedup(docs: DataFrame, seek: Callable | None = None) -> DataFrame:
    """doc_id, text (what stays of it), the other columns as neutral() names them, _n_lines, _n_chunks (removed) and _n_lost."""
    docs, _ = neutral(docs, "doc_id", "text")
    gone = removals(docs, seek)
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(LAST)), "_t": F.xxhash64("text")})
    # a plan for every size: the list isn't broadcast where it happens to be short
    joined = keyed.join(gone.hint("merge"), KEY, "left").drop(*KEY)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return joined.mapInArrow(cut, f"{schema}, text string, _n_lines long, _n_chunks long, _n_lost long")


def dedup_runs(docs: DataFrame) -> DataFrame:
    """dedup() of chunks and of all repeated runs of two lines or more."""
    return dedup(docs, find_runs)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_chunks").alias("n_removed_chunks"), F.col("_n_lost").alias("n_removed_lines"), F.sha2("text", 256).alias("kept_sha256"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which nothing is left but blank lines go, if they lost something."""
    done = dedup_runs(docs).where((F.col("_n_lost") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        done = done.withColumn(f"c{docs.columns.index('n_chars')}", F.length("text").cast("long"))
    return restore(done, docs.columns)
