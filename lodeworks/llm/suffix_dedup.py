"""Exact removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (smaller document id, or earlier in the document), as the LPF array of the whole
corpus would tell: LPF >= LENGTH at the string's start. One suffix array of everything isn't needed for that. Every LENGTH-byte window has
an anchor, the leftmost of its GRAM-byte substrings with the least hash; equal windows have equal anchors at equal offsets. So suffixes are compared only with
suffixes that share the anchor:

1. Each document is cut into runs: consecutive windows with one anchor. Chunks of documents ask, in a packed exchange by anchor (see exchange.py), about
   the class of each run, a 128-bit BLAKE2b digest of its bytes. A run whose class occurs earlier is removed whole. If an anchor has runs of one class only,
   nothing else can match.
2. The earliest runs of anchors with several classes, where passages begin and end, are brought together with their bytes. A task sorts their
   suffixes to depth LENGTH by prefix doubling, takes the common prefixes of neighbours in that order, finds each suffix's previous and next smaller text
   position, and the longer of the common prefixes with these two is its longest previous factor; windows of LENGTH or more are removed.
3. Removed windows become spans, spans meet their documents by id and text.

Hot anchors: copies of a run combine within a chunk, so a passage that a third of all documents hold is one entry a chunk. An anchor with more than HOT_CLASSES classes
in one chunk, or HOT_TOTAL in all (a short phrase in ever other surroundings), is spread in step 2: its runs are cut where the anchor's offset in the window passes a
multiple of OFFSETS, and each part is keyed by the bytes that all windows of such offsets have in common (LENGTH - OFFSETS + 1 around the anchor). Only keys that still have more than
HOT_TOTAL rows are keyed by the bytes of their single windows. Equal bytes of one key are one row a task there, and one in the memory of the task that compares, so that task
holds HOT_TOTAL runs of a key at most (some 3 MB).

Defined results: a null text is empty; empty texts and texts under LENGTH bytes lose nothing; documents with one id aren't earlier than each other,
so repeated rows keep the same; null ids come last; an empty table gives an empty result; other columns stay where spans are removed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, neutral, read, restore, rows_of, utf8
from .exchange import ASKED, ASKED_SCHEMA, CHUNK_BYTES, Exchange, Wire, batch_of, expand, joined, ranges_for, small_batches, squeeze
from .minhash_dedup import mix

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
HOT_CLASSES, HOT_TOTAL = 64, 20_000
#: Windows of so many neighbouring offsets of a hot anchor stay together; a third of all.
OFFSETS = 23
#: Bytes of runs that one task compares.
TASK_BYTES = 48 << 20
LAST = 2**63 - 1
#: Texts are searched in pieces of so many windows; positions in a piece fit into the low bits of the hashes.
PIECE_BITS = 20
LOW = np.uint64((1 << PIECE_BITS + 1) - 1)
NOTHING, REMOVED, COMPARE, SPREAD = range(4)
KEY = ["_id", "_t"]


def smaller_before(p: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each element of a suffix order the common prefix with the nearest one before it that has a smaller text position p; 0 where it is under `least`. common[i]: that
    of i - 1 and i. Each element follows the pointers of those that it passes, all at once, so rounds are few."""
    before, low = np.arange(-1, len(p) - 1), common.copy()
    low[:1] = 0
    todo = np.flatnonzero((low >= least) & (p[before] >= p))
    while len(todo):
        j = before[todo]
        low[todo] = np.minimum(low[todo], low[j])
        before[todo] = before[j]
        low[todo[before[todo] < 0]] = 0
        todo = todo[(low[todo] >= max(least, 1)) & (p[before[todo]] >= p[todo])]
    low[low < least] = 0
    return low


def previous_factors(p: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factors in suffix order, from the previous and the next smaller position; 0 where they are under `least`."""
    back = np.append(0, common[:0:-1]) if len(p) else common
    return np.maximum(smaller_before(p, common, least), smaller_before(p[::-1], back, least)[::-1])


class Suffixes:
    """Suffix order and common prefixes to a depth of LENGTH bytes, of windows that start at the given places of data (which has LENGTH bytes and more after each)."""

    def __init__(self, data: bytes, start: np.ndarray) -> None:
        n = len(data) - 7
        word = np.ndarray((n,), ">u8", data, 0, (1,)).astype(np.uint64)
        self.word, self.levels, rank = word, [], ranked(word)
        for step in (8, 16, 32):
            self.levels.append((step, rank.astype(np.uint32)))
            rank = ranked((rank[:-step] << np.uint64(32)) | rank[step:])
        self.levels.append((64, rank.astype(np.uint32)))
        depth = (rank[start] << np.uint64(32)) | rank[start + LENGTH - 64]  # bytes 0-63 and 36-99
        self.order = np.argsort(depth)
        self.same = np.append(False, np.diff(depth[self.order]) == 0)[: len(start)]
        self.start = start

    def common(self) -> np.ndarray:
        """Of each suffix and the one before it in the order, LENGTH at most."""
        out = np.where(self.same, LENGTH, 0)
        odd = np.flatnonzero(~self.same)[1:]
        a, b = self.start[self.order[odd - 1]], self.start[self.order[odd]]
        upto = np.zeros(len(odd), np.int64)
        for step, rank in reversed(self.levels):
            upto += step * (rank[a + upto] == rank[b + upto])
        differ = self.word[a + upto] ^ self.word[b + upto]
        out[odd] = upto + sum((differ < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        return out


def longest_previous_factor(data: bytes) -> np.ndarray:
    """LPF of one text, LENGTH at most, by the same steps: the length of the longest prefix of each suffix that also starts earlier."""
    n = len(data)
    # an end that is smaller than any byte, each suffix's own, keeps matches within the text
    suffixes = Suffixes(data + bytes(2 * LENGTH), np.arange(n))
    common = np.minimum(suffixes.common(), n - np.maximum(suffixes.order, np.append(0, suffixes.order[:-1]))) if n else np.empty(0, np.int64)
    out = np.zeros(n, np.int64)
    out[suffixes.order] = previous_factors(suffixes.order, common)
    return out


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, anchor position, first and last window of each run of a text of LENGTH bytes or more."""
    found = [_runs(data[at : at + (1 << PIECE_BITS) + LENGTH - 1], at) for at in range(0, len(data) - LENGTH + 1, 1 << PIECE_BITS)]
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(data: bytes, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    word = mix(np.ndarray((n - 7,), "<u8", data, 0, (1,)))
    h = word[: n - GRAM + 1].copy()
    for j in range(8, GRAM, 8):
        h = mix(h) + word[j : n - GRAM + 1 + j]
    h = mix(h)
    keyed = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    least, size = keyed, 1
    while 2 * size <= WINDOW:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    windows = n - LENGTH + 1
    least = np.minimum(least[:windows], least[WINDOW - size : WINDOW - size + windows])
    anchor = (least & LOW).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], windows) - 1
    return h[anchor[first]], anchor[first] + base, first + base, last + base


def classes(data: bytes, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each run's bytes and of the anchor's place in them, as two numbers."""
    salts = [i.to_bytes(16, "little") for i in range(WINDOW)]
    offsets, starts, ends = (anchor - first).tolist(), first.tolist(), (last + LENGTH).tolist()
    digests = b"".join(blake2b(data[a:b], digest_size=16, salt=salts[o]).digest() for a, b, o in zip(starts, ends, offsets, strict=True))
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


#: Entries: anchor, class (two numbers, both 0 in a marker), document id. Replies: what is to be done.
WIRE, REPLIES = Wire((np.uint64, np.uint64, np.uint64, np.int64), (False, False, False, True)), Wire((np.uint8,), (False,))
_META = pa.schema([("ids", pa.binary()), ("runs", pa.list_(pa.int32())), ("texts", pa.list_(pa.int64())), ("local", pa.binary()), ("asked", pa.binary())])
_REQUEST = pa.schema([*ASKED_SCHEMA, *_META])
_REQUESTS = f"{ASKED}, ids binary, runs array<int>, texts array<long>, local binary, asked binary"


def asking(ranges: int) -> Exchange:
    """Anchors are minima, so their hashes are small: mixed again they are even routes."""
    return Exchange(WIRE, lambda columns: mix(columns[0]), answer, REPLIES, ranges)


class _Chunk:
    """Runs of some documents."""

    def __init__(self) -> None:
        self.ids, self.texts, self.keys, self.classes, self.bytes = [], [], [], [], 0

    def add(self, doc: int, t: int, data: bytes) -> None:
        h, anchor, first, last = runs(data)
        self.ids.append(doc)
        self.texts.append(t)
        self.keys.append(h)
        self.classes.append(classes(data, anchor, first, last))
        self.bytes += len(data) + 100

    def rows(self, exchange: Exchange) -> Iterator[tuple]:
        ids, counts = np.array(self.ids, np.int64), [len(k) for k in self.keys]
        key, kind, doc = np.concatenate(self.keys), np.concatenate(self.classes), np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((ids[doc], kind[:, 1], kind[:, 0], key))  # stable: places in a document stay in order
        k, c, d = key[order], kind[order], doc[order]
        new_key = np.append(True, k[1:] != k[:-1])
        new_class = new_key | np.append(True, (c[1:] != c[:-1]).any(axis=1))
        head = np.maximum.accumulate(np.where(new_class, np.arange(len(k)), 0))
        again = ~new_class & ((ids[d] > ids[d[head]]) | np.append(False, d[1:] == d[:-1]))
        local = np.zeros(len(key), np.uint8)
        local[order[again]] = REMOVED
        # anchors with too many classes here: one marker instead, and single windows later
        starts = np.flatnonzero(new_key)
        kinds = np.add.reduceat(new_class.astype(np.int64), starts)
        hot = np.repeat(kinds > HOT_CLASSES, np.diff(np.append(starts, len(k))))
        local[order[hot & ~again]] = SPREAD
        ask = np.zeros(len(key), bool)
        ask[order[(new_class & ~hot) | (~new_class & ~again & ~hot) | (new_key & hot)]] = True
        kind = kind.copy()
        kind[order[hot]] = 0
        chunk, run = uuid.uuid4().hex, np.flatnonzero(ask)
        asked, sent = exchange.ask(chunk, [key[run], kind[run, 0], kind[run, 1], ids[doc[run]]])
        yield from ((*r, None, None, None, None, None) for r in asked)
        yield chunk, -1, None, squeeze(ids), counts, self.texts, squeeze(local), squeeze(np.diff(run[sent], prepend=0).astype(np.int32))


def ask(exchange: Exchange):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for doc, t, text in rows_of(batches, "_id", "_t", "text"):
            data = utf8(text)
            if len(data) >= LENGTH:
                chunk.add(doc, t, data)
            if chunk.bytes >= CHUNK_BYTES:
                yield batch_of(list(chunk.rows(exchange)), _REQUEST)
                chunk = _Chunk()
        if chunk.ids:
            yield batch_of(list(chunk.rows(exchange)), _REQUEST)

    return each


def answer(columns: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """What is to be done with each run of one range of anchors; as evidence, how many anchors are hot."""
    k, a, b, d = columns
    order = np.lexsort((d, b, a, k))
    k, a, b, d = k[order], a[order], b[order], d[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new_class = new_key | np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    starts = np.flatnonzero(new_key)
    sizes = np.diff(np.append(starts, len(k)))
    kinds = np.add.reduceat(new_class.astype(np.int64), starts)
    marker = (a == 0) & (b == 0)
    hot = marker[starts] | (kinds > HOT_TOTAL)  # a marker sorts first
    head = np.maximum.accumulate(np.where(new_class, np.arange(len(k)), 0))
    status = np.where(np.repeat(hot, sizes), SPREAD, np.where(np.repeat(kinds > 1, sizes), COMPARE, NOTHING)).astype(np.uint8)
    status[(d > d[head]) & ~marker] = REMOVED
    back = np.empty(len(k), np.uint8)
    back[order] = status
    return [back], int(hot.sum())


def statuses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is to be done with each run of a document, for documents where anything is."""
    for packed_ids, counts, texts, packed_local, packed_asked, replies in rows_of(batches, "ids", "runs", "texts", "local", "asked", "replies", at_once=1):
        ids, status = expand(packed_ids, np.int64), expand(packed_local, np.uint8).copy()
        run, told = np.cumsum(expand(packed_asked, np.int32), dtype=np.int64), joined(replies, REPLIES)[0]
        # a run that was marked within its chunk keeps that; a marker only speaks for its anchor
        status[run] = np.where(status[run] == SPREAD, SPREAD, told)
        ends = np.cumsum(counts)
        each = [status[e - n : e] for e, n in zip(ends.tolist(), counts, strict=True)]
        some = [i for i, s in enumerate(each) if s.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[some], pa.int64()), pa.array([texts[i] for i in some], pa.int64()), pa.array([squeeze(each[i]) for i in some], pa.binary())], names=[*KEY, "status"]
        )


_FOUND = pa.schema([("key", pa.int64()), ("_id", pa.int64()), ("_t", pa.int64()), ("at", pa.int32()), ("bytes", pa.binary()), ("spans", pa.list_(pa.int32()))])


def spans_of(first: np.ndarray, last: np.ndarray) -> list[int]:
    """Flat starts and ends of what the windows first..last of each run cover; runs in order."""
    if not len(first):
        return []
    ends = np.maximum.accumulate(last + LENGTH)
    cut = np.flatnonzero(first[1:] > ends[:-1])
    return np.stack([first[np.append(0, cut + 1)], ends[np.append(cut, len(ends) - 1)]], axis=1).reshape(-1).tolist()


def parts_of(data: bytes, anchor: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """(key, first, last) of the parts of a run of a hot anchor. Equal windows have the anchor at equal offsets, so they are in parts of one key."""
    for low in range((anchor - last) // OFFSETS * OFFSETS, anchor - first + 1, OFFSETS):
        high = low + OFFSETS - 1
        common = data[anchor - low : anchor - high + LENGTH]
        yield xxhash.xxh3_64_intdigest(common, low) - 2**63, max(first, anchor - high), min(last, anchor - low)


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot keys window by window, keyed by its bytes."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            rows = rows_of(iter([batch.slice(start, 4096)]), *KEY, "at", "bytes")
            each = [(xxhash.xxh3_64_intdigest(x[j : j + LENGTH]) - 2**63, i, t, at + j, x[j : j + LENGTH]) for i, t, at, x in rows for j in range(len(x) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*each, strict=True), _FOUND, strict=False)], schema=pa.schema(list(_FOUND)[:5]))


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of runs that are removed whole, and the bytes of those to be compared. Of equal bytes in one task the earliest go on; the others are
    removed at once."""
    held: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
    spans: list[tuple] = []
    size = 0

    def keep(key: int, offset: int, body: bytes, place: tuple[int, int, int]) -> int:
        """Returns the bytes that are now held in addition."""
        old = held.get((key, offset, body))
        if old is None or place[0] < old[0] or place == old or (place[:2] == old[:2] and place < old):
            late, held[key, offset, body] = old, place
        elif place[0] > old[0] or place[:2] == old[:2]:
            late = place
        else:  # another document with this id: neither is earlier
            return keep(key, offset + 1_000_000, body, place)
        if late is not None and late != place or late == place and old is not None and old != place:
            spans.append((None, late[0], late[1], None, None, [late[2], late[2] + len(body)]))
        return len(body) + 100 if old is None else 0

    def flush() -> pa.RecordBatch:
        rows = [(key, p[0], p[1], p[2], body, None) for (key, _, body), p in held.items()] + spans
        held.clear()
        spans.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOUND.types, strict=True)], schema=_FOUND)

    for doc, t, text, packed in rows_of(batches, *KEY, "text", "status"):
        data, status = utf8(text), expand(packed, np.uint8)
        h, anchor, first, last = runs(data)
        gone = status == REMOVED
        if gone.any():
            spans.append((None, doc, t, None, None, spans_of(first[gone], last[gone])))
        todo = np.flatnonzero(status >= COMPARE)
        for k, o, a, b, s in zip(h[todo].view(np.int64).tolist(), (anchor[todo] - first[todo]).tolist(), first[todo].tolist(), last[todo].tolist(), status[todo].tolist(), strict=True):
            if s == COMPARE:
                size += keep(k, o, data[a : b + LENGTH], (doc, t, a))
            else:
                for part, v, w in parts_of(data, a + o, a, b):
                    size += keep(part, a + o - v, data[v : w + LENGTH], (doc, t, v))
        if size > 12_000_000 or len(spans) > 50_000:
            yield flush()
            size = 0
    if held or spans:
        yield flush()


def ranked(code: np.ndarray) -> np.ndarray:
    """Ranks of the values, equal ones alike."""
    order = np.argsort(code)
    sorted_ = code[order]
    rank = np.empty(len(code), np.uint64)
    rank[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1])).astype(np.uint64)
    return rank


def compare(ids: np.ndarray, texts: np.ndarray, at: np.ndarray, bodies: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(id, t, start, end) of what removed windows cover. Rows of one anchor follow one another, sorted by id, text and place; so the number of a window is its text
    position among those that it can equal."""
    sizes = np.array([len(b) for b in bodies])
    begins, many = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    row = np.repeat(np.arange(len(bodies)), many)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    suffixes = Suffixes(b"".join(bodies) + bytes(2 * LENGTH), begins[row] + offset)
    order, common = suffixes.order, suffixes.common()
    gone = np.zeros(len(row), bool)
    if _one_text_each(ids, texts):
        gone[order] = previous_factors(order, common, LENGTH) >= LENGTH
    else:  # documents with one id aren't earlier than each other: smaller ids first, then earlier places in the same document
        document = np.cumsum(np.append(0, (np.diff(ids) != 0) | (np.diff(texts) != 0)))
        block = np.cumsum(~suffixes.same)
        gone[order] = previous_factors(ids[row[order]], common, LENGTH) >= LENGTH
        within = order[np.lexsort((order, document[row[order]], block))]
        of_block = np.empty(len(row), np.int64)
        of_block[order] = block
        gone[within[1:]] |= (of_block[within[1:]] == of_block[within[:-1]]) & (document[row[within[1:]]] == document[row[within[:-1]]])
    found = np.flatnonzero(gone)
    if len(found):
        r, p = row[found], at[row[found]] + offset[found]
        first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)))
        last = np.append(first[1:], len(r)) - 1
        yield from zip(ids[r[first]].tolist(), texts[r[first]].tolist(), p[first].tolist(), (p[last] + LENGTH).tolist(), strict=True)


def _one_text_each(ids: np.ndarray, texts: np.ndarray) -> bool:
    pairs = np.unique(np.stack([ids, texts]), axis=1)
    return len(np.unique(ids)) == pairs.shape[1]


_SPANS = "_id long, _t long, spans array<int>"


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, id, t and place; whole groups are compared, many small ones at once. A row whose bytes the group has from an earlier document, or from an
    earlier place in the same one, is removed as it comes, so that the group holds its different bytes only."""
    rows: list[tuple] = []
    spans: list[tuple] = []
    firsts: dict[bytes, tuple] = {}
    size = 0

    def emit(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            i, t, a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.int64()), pa.array(list(zip(a, b, strict=True)), pa.list_(pa.int32()))], names=[*KEY, "spans"])

    def done(part: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(part) > 1 or any(len(x[4]) > LENGTH for x in part):
            _, ids, texts, at, bodies = zip(*part, strict=True)
            yield from emit(list(compare(np.array(ids), np.array(texts), np.array(at), list(bodies))))

    before: tuple | None = None
    for x in rows_of(batches, "key", *KEY, "at", "bytes"):
        if before is None or x[0] != before[0]:
            firsts.clear()
            if size > 1_000_000:
                yield from done(rows)
                rows, size = [], 0
        elif x[:4] == before[:4]:  # repeated rows of a document
            continue
        before = x[:4]
        first = firsts.setdefault(x[4], x)
        if first is x or (x[1] == first[1] and x[2] != first[2]):
            rows.append(x)
            size += len(x[4])
        else:
            spans.append((x[1], x[2], x[3], x[3] + len(x[4])))
            if len(spans) == 50_000:
                yield from emit(spans)
                spans = []
    yield from emit(spans)
    yield from done(rows)


def removed_spans(docs: DataFrame) -> DataFrame:
    """(_id, _t, spans): flat starts and ends in bytes, in no order; they may overlap."""
    with small_batches(docs):
        return materialize(_removed_spans(docs), "spans")


def _removed_spans(docs: DataFrame) -> DataFrame:
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_t"), "text")
    size, many = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    exchange = asking(ranges_for(size / 40))  # about a run for 35 bytes of text
    asked = materialize(keyed.mapInArrow(ask(exchange), _REQUESTS), "runs")
    told, _ = exchange.run(asked.where("range >= 0").select("asker", "range", "columns"), -(-size // CHUNK_BYTES), "replies")
    meta = asked.where("range = -1").select("asker", "ids", "runs", "texts", "local", "asked")
    status = materialize(meta.join(told, "asker", "left").mapInArrow(statuses, "_id long, _t long, status binary"), "status")
    found = keyed.join(status.dropDuplicates(KEY), KEY).mapInArrow(gather, "key long, _id long, _t long, at int, bytes binary, spans array<int>")
    found = materialize(found, "compared")
    rows = found.where("bytes is not null").select("key", *KEY, "at", "bytes")
    hot = materialize(rows.groupBy("key").count().where(F.col("count") > HOT_TOTAL).select("key"), "hot_keys")
    if hot.take(1):  # one key for HOT_TOTAL rows at most
        single = rows.join(F.broadcast(hot), "key", "left_semi").mapInArrow(single_windows, "key long, _id long, _t long, at int, bytes binary")
        rows = materialize(rows.join(F.broadcast(hot), "key", "left_anti").unionByName(single), "spread")
    weight = rows.agg(F.coalesce(F.sum(F.length("bytes") + 50), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(weight // TASK_BYTES) + 1)
    late = rows.repartition(parts, "key").sortWithinPartitions("key", *KEY, "at").mapInArrow(compare_groups, _SPANS)
    every = found.where("spans is not null").select(*KEY, "spans").unionByName(late)
    return every.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(data)], strict=True))


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, flat in rows_of(iter([batch]), "doc_id", "text", "spans"):
            data, spans = utf8(text), merged(flat)
            out.append((doc_id, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()))
        if out:
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces text by what stays of it, without broken characters at the cuts."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [t if not s else kept_bytes(utf8(t), merged(s)).decode("utf-8", "ignore") for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in part.schema.names if n != "spans"], names=[n for n in part.schema.names if n != "spans"])


def with_spans(docs: DataFrame) -> DataFrame:
    spans = removed_spans(docs)
    return docs.withColumns({"_id": F.coalesce("doc_id", F.lit(LAST)), "_t": F.xxhash64("text")}).join(spans, KEY, "left").drop(*KEY)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, their repeated bytes cut out of the text."""
    plain, names = neutral(docs, "doc_id", "text")
    return restore(with_spans(plain).mapInArrow(cut, plain.schema), names)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP7_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 200) as s from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as p from d where length(h) >= 200)),
g as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as r from w) where r > 1),
i as (select doc_id, p, coalesce((p > lag(p) over (partition by doc_id order by p) + 100)::int, 1) as new from g),
sp as (select doc_id, min(p) as a, max(p) + 100 as b from (select *, sum(new) over (partition by doc_id order by p) as k from i) group by doc_id, k),
kp as (
  select doc_id, string_agg(piece, '' order by a) as k from (
    select sp.doc_id, a, substr(h, 2 * coalesce(lag(b) over (partition by sp.doc_id order by a), 0) + 1, 2 * (a - coalesce(lag(b) over (partition by sp.doc_id order by a), 0))) as piece from sp join d on d.doc_id = sp.doc_id
    union all
    select m.doc_id, m.b, substr(h, 2 * m.b + 1) from (select doc_id, max(b) as b from sp group by doc_id) m join d on d.doc_id = m.doc_id)
  group by doc_id),
t as (select doc_id, sum(b - a)::bigint as n, count(*) as k from sp group by doc_id)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(t.n, 0) as n_removed, coalesce(t.k, 0) as n_spans, sha256(unhex(coalesce(kp.k, h))) as kept_sha256
from d left join t on t.doc_id = d.doc_id left join kp on kp.doc_id = d.doc_id
"""
