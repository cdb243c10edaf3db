"""MinHash near-duplicates with tensored banding.

Two collections of BANDS sub-keys are made, each of ROWS minhashes; a table key is one sub-key of the first with one of the second, so
BANDS ** 2 tables of 2 * ROWS minhashes each cost 2 * BANDS * ROWS minhashes a document, not BANDS ** 2 * 2 * ROWS. A pair of similarity s is a
candidate with probability (1 - (1 - s ** ROWS) ** BANDS) ** 2: for s = 0.85, ROWS = 3 and BANDS = 10 all but 0.00015.

1. Documents with equal shingle sets form a class; only classes take part from here on.
2. Table keys that two classes share are buckets. No pairs of a bucket's members are made. First each class is compared with its buckets'
   heads. What is left are buckets whose members are still in different components. What such buckets hold together, through their heads, is a family; its centre is the shingles that more than half of its classes have, and
   a class is described by its differences from the centre (shingles it lacks or has besides). Sets of `percent` similarity differ in
   (100 - percent) / (100 + percent) * (their sizes) shingles at most, and their differences from any one set differ in as many. So either
   they share a difference, or their differences together are no more than that. In the latter case both link with the class nearest to the centre (it
   stands for either of them in that sum), so each near class is compared with that one only. In the former the first shared difference in a common
   order (by how many of the family have it) has few others before it in both. So copies of a template, each with its own changes, make no pairs; and
   no link within a family is lost.
3. A comparison is exact: sizes of intersection and union of the full shingle sets (64-bit hashes of shingles), which are written once for all classes in buckets.
4. Components of the confirmed links come from written edge tables; nothing is collected.

Hot groups: classes and buckets are found by partial aggregation; rows meet hot classes, buckets, shingles and nodes through broadcasts of fewer than
HOT_SHARE rows; a rare shingle of many classes is met block by block, each block pair its own key.

Defined results: null, empty and white-space texts have an empty set and are linked with nothing; repeated rows have one component; rows
with one id and different texts are different documents; a null id is named only by a component without any other id; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, hot_join, materialize, neutral, read, restore, rows_of, spread_join, utf8
from .components import components

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK = 256


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    rows: int = 2
    bands: int = 9


PIPELINE, CONTRACT = Params(), Params(words=3, percent=85, rows=3, bands=10)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of k words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(k, n)
    s = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        s = mix(s) + h[j : n - k + 1 + j]
    return np.unique(mix(s))


def node_of(shingle_set: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingle_set.tobytes())).astype(np.int64))


def sub_keys(shingle_set: np.ndarray, a: np.ndarray, p: Params) -> np.ndarray:
    """2 * bands sub-keys from 2 * bands * rows minhashes."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingle_set), 4096):
        part = shingle_set[start : start + 4096]
        np.minimum(least, (part[None, :] * a[:, None]).min(axis=1), out=least)
    m = least.reshape(2 * p.bands, p.rows)
    key = m[:, 0]
    for j in range(1, p.rows):
        key = mix(key) + m[:, j]
    return mix(key).view(np.int64)


def signer(p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        a = np.random.default_rng(20).integers(0, 2**63, 2 * p.bands * p.rows, np.uint64) * np.uint64(2) + np.uint64(1)
        out: list[tuple] = []
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            s = shingles(utf8(text), p.words, hashes)
            out.append((doc_id, len(s), node_of(s) if len(s) else None, sub_keys(s, a, p) if len(s) else None))
            if len(out) == 2048:
                yield _signed(out)
                out = []
        if out:
            yield _signed(out)

    return sign


def _signed(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, nodes, keys = zip(*rows, strict=True)
    arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "node", "keys"])


def set_maker(p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        out, held = [], 0
        for node, text in rows_of(batches, "node", "text"):
            s = shingles(utf8(text), p.words, hashes)
            if len(s) and node_of(s) == node:  # else another text of the same document id
                out.append((node, s.tobytes()))
                held += s.nbytes
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["node", "shingles"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["node", "shingles"])

    return make


def confirmer(p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, links = [], [], []
            for u, v, x, y in rows_of(iter([batch]), "u", "v", "x", "y"):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                us.append(u)
                vs.append(v)
                links.append(100 * both >= p.percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(links, pa.bool_())], names=["u", "v", "linked"])

    return confirm


def buckets(classes: DataFrame, p: Params) -> DataFrame:
    """(key, node, head, n): the rows of table keys that several classes share."""
    tables = F.array(*(F.xxhash64(F.lit(i * p.bands + j), F.col("keys")[i], F.col("keys")[p.bands + j]) for i in range(p.bands) for j in range(p.bands)))
    rows = classes.select("node", F.explode(tables).alias("key"))
    shared = materialize(rows.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"), "shared")
    return materialize(hot_join(rows, shared, ["key"], "n", classes.count() * p.bands**2), "buckets")


def exploder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingle) of sets."""
    for nodes, sets in (([n for n, _ in part], [np.frombuffer(x, np.int64) for _, x in part]) for part in _parts(rows_of(batches, "node", "shingles"))):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.int64), [len(x) for x in sets])), pa.array(np.concatenate(sets))], names=["node", "shingle"])


def _parts(rows: Iterator[tuple], most: int = 2_000_000) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Linker:
    """Compares candidate pairs and keeps what was compared."""

    def __init__(self, docs: DataFrame, classes: DataFrame, rows: DataFrame, p: Params) -> None:
        self.classes, self.p = classes, p
        self.tested: DataFrame | None = None
        self.labels: DataFrame | None = None
        wanted = rows.select("node").distinct().join(classes.select("node", F.col("rep").alias("doc_id")), "node")
        texts = docs.select("doc_id", "text").join(wanted, "doc_id")
        self.sets = materialize(texts.mapInArrow(set_maker(p), "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def components_of(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        if self.labels is None:
            return rows.withColumn(name, F.col(column))
        labels = self.labels.select(F.col("node").alias(column), F.col("component").alias(name))
        return rows.join(labels, column, "left").withColumn(name, F.coalesce(name, column))

    def test(self, pairs: DataFrame, name: str) -> int:
        """pairs: u > v, distinct. Returns how many links were new."""
        size = self.classes.select("node", "n_shingles")
        sized = pairs.join(size.select(F.col("node").alias("u"), F.col("n_shingles").alias("a")), "u").join(size.select(F.col("node").alias("v"), F.col("n_shingles").alias("b")), "v")
        # the ratio of the sizes bounds the similarity
        pairs = sized.where(F.least("a", "b") * 100 >= F.greatest("a", "b") * self.p.percent).select("u", "v")
        pairs = materialize(pairs, f"pairs_{name}")
        if not pairs.take(1):
            return 0
        # a node that is in many pairs as v is copied once for each block of them
        full = spread_join(pairs, self.sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v").join(self.sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u")
        done = materialize(full.select("u", "v", "x", "y").mapInArrow(confirmer(self.p), "u long, v long, linked boolean"), f"tested_{name}")
        new = done.where("linked").select("u", "v")
        many = new.count()
        if many:
            known = new if self.labels is None else new.unionByName(self.labels.select(F.col("node").alias("u"), F.col("component").alias("v")))
            self.labels = materialize(components(known), f"labels_{name}")
        self.tested = done.select("u", "v") if self.tested is None else self.tested.unionByName(done.select("u", "v"))
        return many

    def open(self, pairs: DataFrame) -> DataFrame:
        """The pairs not compared yet, of nodes in different components."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["u", "v"], "left_anti")
        return self.components_of(self.components_of(pairs, "u", "_cu"), "v", "_cv").where("_cu <> _cv").select("u", "v")


def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, node, c, n, d, shingle): what a set and its family's centre don't share, d shingles in all; and a row of every node with a null shingle."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = (np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist())
            centres = (np.empty(0, np.int64) if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in part.column("centre"))
            odd = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(sets, centres, strict=True)]
            sizes = np.array([len(x) for x in odd])
            row = np.repeat(np.arange(part.num_rows), sizes + 1)
            last = np.cumsum(sizes + 1) - 1
            shingle, none = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
            none[last] = True
            shingle[~none] = np.concatenate(odd)
            columns = [part.column(c).take(pa.array(row)) for c in ("family", "node", "c", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes[row], pa.int64()), pa.array(shingle, mask=none)], names=["family", "node", "c", "n", "d", "shingle"])


def families(linker: Linker, rows: DataFrame) -> DataFrame | None:
    """(family, node, c, n, d, shingle), see differ(), of the classes of buckets that have several components. A family is what such buckets hold together, its centre the shingles
    that more than half of its classes have."""
    c = materialize(linker.components_of(rows.select("key", "head", "node"), "node", "c"), "bucket_components")
    mixed = c.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    mixed = materialize(mixed, "mixed")
    total = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return None
    held = materialize(hot_join(c, mixed, ["key"], "n", total).select("node", "head", "c").distinct(), "mixed_rows")
    family = components(held.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")))
    nodes = held.select("node", "c").distinct().join(family.withColumnRenamed("component", "family"), "node")
    nodes = materialize(nodes.join(linker.classes.select("node", F.col("n_shingles").alias("n")), "node"), "mixed_nodes")
    members, many = nodes.groupBy("family").agg(F.count("*").alias("m")), nodes.count()
    has = nodes.select("family", "node").join(linker.sets, "node").select(F.col("family").alias("node"), "shingles").mapInArrow(exploder, "node long, shingle long")
    counts = materialize(has.groupBy(F.col("node").alias("family"), "shingle").agg(F.count("*").alias("df")).where("df > 1"), "shingle_counts")
    centre = hot_join(counts, members, ["family"], "m", many).where("2 * df > m").groupBy("family").agg(F.collect_list("shingle").alias("centre"))
    centre = materialize(members.join(centre, "family", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>"))), "centres")
    told = hot_join(nodes, centre, ["family"], "m", many).join(linker.sets, "node").select("family", "node", "c", "n", "shingles", "centre")
    return materialize(told.mapInArrow(differ, "family long, node long, c long, n long, d long, shingle long"), "differences")


def near_pairs(odd: DataFrame, p: Params) -> DataFrame:
    """Classes so near the centre that they link with the class nearest to it, and that class."""
    far = odd.where("shingle is null").withColumn("far", F.expr(f"{100 + p.percent} * d - {100 - p.percent} * n"))
    nearest = far.groupBy("family").agg(F.min(F.struct("far", "node")).alias("m"), F.count("*").alias("rows"))
    near = hot_join(far, nearest, ["family"], "rows", far.count()).where("far + m.far <= 0 and node <> m.node")
    return near.select(F.greatest("node", "m.node").alias("u"), F.least("node", "m.node").alias("v"))


def mixed_pairs(odd: DataFrame, p: Params) -> DataFrame:
    """Candidates among the classes of a family: pairs of different components, of which one is too far from the centre for near_pairs(), that share a rare difference from it."""
    known = odd.where("shingle is not null")
    shared = materialize(known.groupBy("family", "shingle").agg(F.count("*").alias("df")).where("df > 1"), "shared_shingles")
    # a difference of one class only comes first in the order and finds no other, so it only takes up room
    known = hot_join(known, shared, ["family", "shingle"], "df", known.count())
    known = known.groupBy("family", "node", "c", "n", "d").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s")).withColumn("lone", F.col("d") - F.size("s"))
    # the other set has 100 * n div percent shingles at most
    room = F.expr(f"{100 - p.percent} * (n + 100 * n div {p.percent}) div {100 + p.percent} + 1 - lone")
    first = known.where(room > 0).select("family", "node", "c", "n", "d", "lone", F.posexplode(F.slice("s", F.lit(1), room.cast("int"))).alias("at", "x"))
    first = materialize(first.select("node", "c", "n", "d", (F.col("lone") + F.col("at")).alias("at"), "family", F.col("x.shingle").alias("shingle")), "rare")
    many = materialize(first.groupBy("family", "shingle").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("family", "shingle", "m"), "rare_keys")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    r = hot_join(first, many, ["family", "shingle"], "m", first.count())
    r = materialize(r.withColumns({"own": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.sequence(F.lit(0), blocks - 1)}).drop("m"), "rare_rows")
    side = lambda x, y: r.select("family", "shingle", *(F.col(k).alias(f"{k}{x}") for k in ("node", "c", "n", "d", "at")), F.col("own").alias(f"b{x}"), F.explode("other").alias(f"b{y}"))
    met = side("u", "v").join(side("v", "u"), ["family", "shingle", "bu", "bv"]).where("nodeu > nodev and cu <> cv")
    met = met.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * p.percent)
    # what comes before the first shared difference tells the sets apart, and so does what one has more of after it
    most = f"{100 - p.percent} * (nu + nv)"
    met = met.where(f"{100 + p.percent} * (atu + atv + abs((du - atu) - (dv - atv))) <= {most} and {100 + p.percent} * (du + dv) > {most}")
    return met.select(F.col("nodeu").alias("u"), F.col("nodev").alias("v")).distinct()


def groups(docs: DataFrame, p: Params) -> DataFrame:
    """One row per document: doc_id, n_shingles, node (its class), component_id, kept."""
    signed = materialize(docs.select("doc_id", "text").mapInArrow(signer(p), "doc_id long, n_shingles long, node long, keys array<long>"), "signed")
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.count("*").alias("n_docs"))
    classes = materialize(classes, "classes")
    # the representative's id may be null: such a class takes no part in comparisons by id, but keeps its members
    rows = buckets(classes.where("rep is not null"), p)
    linker = Linker(docs, classes, rows, p)
    heads = rows.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    heads = materialize(heads.distinct(), "heads")
    linker.test(heads, "heads")
    odd = families(linker, rows)
    if odd is not None:
        linker.test(linker.open(near_pairs(odd, p).unionByName(mixed_pairs(odd, p)).distinct()), "mixed")
    labelled = linker.components_of(classes.drop("keys"), "node", "c")
    named = labelled.groupBy("c").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    named = hot_join(labelled.select("node", "c", "n_docs"), named, ["c"], "n", classes.count()).select("node", "component_id", "n_docs")
    named = materialize(named, "named")
    full = hot_join(signed.where("node is not null").drop("keys"), named, ["node"], "n_docs", signed.count()).select("doc_id", "n_shingles", "node", "component_id")
    lone = signed.where("node is null").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id"))
    return full.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"), CONTRACT).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, p: Params = PIPELINE) -> DataFrame:
    """One document of each group, with all its columns, and every document without words. Of rows that repeat the kept id and text, one stays. Rows
    without an id all stay, because a verdict can't name them."""
    docs, names = neutral(docs, "doc_id", "text")
    judged = materialize(groups(docs, p), "judged")
    again = judged.where("kept and node is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    gone = judged.where("not kept").select("doc_id").distinct()
    mixed = again.join(gone, "doc_id", "left_semi")  # one id, several texts, not all of them kept: told apart by the set below
    plain = docs.join(gone.join(mixed, "doc_id", "left_anti"), "doc_id", "left_anti")
    twice = again.where("n > 1").select("doc_id").union(mixed.select("doc_id")).distinct()
    if not twice.take(1):
        return restore(plain, names)
    keep = judged.where("kept and node is not null").select("doc_id", "node").distinct()
    columns = docs.columns
    marked = docs.join(twice, "doc_id", "left_semi")
    nodes = marked.select("doc_id", "text").distinct().mapInArrow(_noder(p), "doc_id long, node long, text string")
    right = nodes.join(keep, ["doc_id", "node"], "left_semi").select("doc_id", "text")
    sole = marked.join(right, ["doc_id", "text"], "left_semi").dropDuplicates(["doc_id", "text"])
    return restore(plain.join(twice, "doc_id", "left_anti").select(*columns).unionByName(sole.select(*columns)), names)


def _noder(p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(utf8(t), p.words, hashes) for t in batch.column("text").to_pylist()]
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), nodes, batch.column("text")], names=["doc_id", "node", "text"])

    return give


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 85 * (nx.n + ny.n - k)),
e as (select x, y from l union all select y, x from l),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.y, r.root from r join e on e.x = r.doc_id)
select r.doc_id, coalesce(any_value(n), 0) as n_shingles, min(root) as component_id, r.doc_id = min(root) as kept
from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""
