"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, probed by every training token window.

Words are the runs of digits, a-z and characters beyond ASCII after lower-casing A-Z. A window is WINDOW words of an item, or a whole
shorter item. Documents are probed with a hash of three of a window's fully lower-cased words (equal windows have equal hashes), in one codegen
stage: split, explode positions, broadcast hash join. A hit counts only if all the window's words, A-Z lower-cased, equal the item's: windows
that share the three words, hash collisions and other case foldings fall out there. Then hits are joined into intervals, and items are counted by distinct text, so that
copies of an item cost nothing until their ids are listed.

The set is broadcast while it has at most MAX_BROADCAST windows of at most MAX_BYTES together. A larger one is joined by shuffle: rows of (document, place, hash of
the whole window) that pass a Bloom filter of the windows' hashes (of at most MAX_BLOCKS words; a set for which that is too small goes without) meet the windows, hot
windows in blocks, and the hits of a document meet its text once, to be compared. No text is in a row of a position there.

Ids of items are no part of the set that is broadcast: windows name texts, and texts ids, in tables that are joined by shuffle, hot ones in blocks.

Defined results: null and empty texts have no words and are clean; null item texts have no windows; items with equal ids or texts each count
under their id (once); an item without an id has windows that count in n_hit and contaminated, but no name, so it isn't in n_items and the digest; repeated documents are
judged alike, one row each; empty tables give empty results or clean documents; very long texts are probed whole. Other columns of the documents stay where documents or
spans are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import url_filters
from .common import ascii_lower, materialize, neutral, read, restore, spread_join

WINDOW = 10
MAX_BROADCAST, MAX_BYTES, MAX_BLOCKS = 500_000, 128 << 20, 2_000_000
CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["doc_id", "_t"]


def cased_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), CASED_GAP), "")


def folded(words: Column) -> Column:
    """The words in full lower case, which is the same for words that differ in the case of A-Z only. The capital sigma
    goes first: its lower case depends on what follows."""
    return F.split(F.lower(F.replace(F.array_join(words, " "), F.lit("Σ"), F.lit("σ"))), " ")


def window_key(words: Column, at: Column, length: int, whole: bool = False) -> Column:
    """The hash under which a window is looked up: of its first, middle and last word, or of all. Windows are compared whole afterwards."""
    return F.xxhash64(*(F.get(words, at + j) for j in (range(length) if whole else sorted({0, length // 2, length - 1}))))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wid, len, words): each distinct window; (wid, tid): the distinct texts that have it; (tid, item_id): the ids of these."""
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), ascii_lower(F.array_join(cased_words(F.col("text")), " ")).alias("norm")).where("norm <> ''")
    named = materialize(named.withColumn("tid", F.sha2("norm", 256)), "items")
    w = named.select("tid", "norm").distinct().select("tid", F.split("norm", " ").alias("_w"))
    w = w.withColumn("len", F.least(F.size("_w"), F.lit(WINDOW)))
    w = w.select("tid", "len", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("len"))).alias("at"))
    w = w.select("tid", "len", F.array_join(F.slice("_w", F.col("at") + 1, F.col("len")), " ").alias("words"))
    w = materialize(w.withColumn("wid", F.sha2(F.concat_ws(" ", F.col("len").cast("string"), "words"), 256)), "windows")
    return w.select("wid", "len", "words").dropDuplicates(["wid"]), w.select("wid", "tid").distinct(), named.where("item_id is not null").select("tid", "item_id").distinct()


def _with_key(windows: DataFrame, whole: bool) -> DataFrame:
    low = folded(F.split("words", " "))
    key = F.coalesce(*(F.when(F.col("len") == n, window_key(low, F.lit(0), n, whole)) for n in range(1, WINDOW + 1)))
    return windows.select(key.alias("key"), F.col("len").alias("_len"), "wid", "words")


def _positions(docs: DataFrame, lengths: list[int], whole: bool) -> DataFrame:
    """(doc_id, _t, _orig, at, len, key): the windows of each document."""
    d = docs.select("doc_id", F.xxhash64("text").alias("_t"), cased_words(F.col("text")).alias("_orig"))
    d = d.withColumn("_low", folded(F.col("_orig")))
    # outer: for the inner form Catalyst infers a filter on the array, and moves it below the projections, so all words would be split twice
    p = d.select(*KEY, "_orig", "_low", F.posexplode_outer("_low").alias("at", "_word"))
    fits = lambda n: F.col("at") + n <= F.size("_low")
    if len(lengths) == 1:
        n = lengths[0]
        return p.where(fits(n)).select(*KEY, "_orig", "at", F.lit(n).alias("len"), window_key(F.col("_low"), F.col("at"), n, whole).alias("key"))
    each = F.array(*(F.when(fits(n), F.struct(F.lit(n).alias("len"), window_key(F.col("_low"), F.col("at"), n, whole).alias("key"))) for n in lengths))
    return p.select(*KEY, "_orig", "at", F.explode(each).alias("_k")).select(*KEY, "_orig", "at", "_k.len", "_k.key")


def _same(words: Column, at: Column, length: Column, window: Column) -> Column:
    return ascii_lower(F.array_join(F.slice(words, at + 1, length), " ")) == window


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, _t, at, len, wid): every occurrence of a window in a document, verified. windows: a written table."""
    of_length = windows.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.octet_length("words") + 100).alias("bytes")).collect()  # at most WINDOW rows
    lengths, many = sorted(r.len for r in of_length), sum(r.n for r in of_length)
    if not lengths:
        return docs.select("doc_id", F.lit(0).cast("long").alias("_t"), F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit("").alias("wid")).where("false")
    if many <= MAX_BROADCAST and sum(r.bytes for r in of_length) <= MAX_BYTES:
        found = _positions(docs, lengths, False).join(F.broadcast(_with_key(windows, False)), "key").where(F.col("len") == F.col("_len"))
        # each begins with the other: an equality would become a key of the join, and all words of the window be put together at every position
        own = ascii_lower(F.array_join(F.slice("_orig", F.col("at") + 1, F.col("len")), " "))
        return found.where(own.startswith(F.col("words")) & F.col("words").startswith(own)).select(*KEY, "at", "len", "wid")
    lookup = materialize(_with_key(windows, True), "lookup")
    places = _positions(docs, lengths, True).drop("_orig").distinct()  # distinct: repeated rows of a document
    blocks = max(1, -(-many // url_filters.URLS_PER_BLOCK))
    if blocks <= MAX_BLOCKS:
        keys = lookup.select(F.col("key").alias("canon"))
        filter_ = materialize(url_filters.bloom(keys, blocks), "bloom")
        places = url_filters.possible(_positions(docs, lengths, True).drop("_orig").withColumn("canon", F.col("key")), filter_, blocks).drop("canon").distinct()
    met = spread_join(materialize(places, "places"), lookup, "key").where(F.col("len") == F.col("_len"))
    each = met.groupBy("doc_id", "_t").agg(F.collect_list(F.struct("at", "len", "wid", "words")).alias("_met"))
    each = materialize(each, "met").withColumnRenamed("doc_id", "_id").withColumnRenamed("_t", "_ht")
    texts = docs.select("doc_id", F.xxhash64("text").alias("_t"), "text").join(each, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_ht")))
    texts = texts.withColumn("_orig", cased_words(F.col("text")))
    sound = F.filter("_met", lambda m: _same(F.col("_orig"), m["at"], m["len"], m["words"]))
    return texts.select(*KEY, F.explode(sound).alias("m")).select(*KEY, "m.at", "m.len", "m.wid")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, _t (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated."""
    windows, of_window, of_text = benchmark_windows(benchmark)
    found = materialize(hits(docs, materialize(windows, "distinct_windows")).distinct(), "hits")  # distinct: repeated rows of a document
    before = Window.partitionBy(*KEY).orderBy("at", "len")
    ends = found.withColumn("_end", F.col("at") + F.col("len"))
    ends = ends.withColumn("_reached", F.coalesce(F.max("_end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n_hit = ends.groupBy(*KEY).agg(F.sum(F.greatest(F.lit(0), F.col("_end") - F.greatest("at", "_reached"))).cast("long").alias("n_hit"))
    tids = spread_join(materialize(found.select(*KEY, "wid").distinct(), "found"), of_window, "wid").select(*KEY, "tid").distinct()
    ids = spread_join(materialize(tids, "tids"), of_text, "tid").select(*KEY, "item_id")
    items = ids.groupBy(*KEY).agg(F.sort_array(F.collect_set("item_id")).alias("_items"))
    items = items.select(F.col("doc_id").alias("_iid"), F.col("_t").alias("_it"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    marked = n_hit.join(items, F.col("doc_id").eqNullSafe(F.col("_iid")) & (F.col("_t") == F.col("_it")), "left").drop("_iid", "_it").withColumnRenamed("doc_id", "_id").withColumnRenamed("_t", "_ht")
    every = docs.select("doc_id", F.xxhash64("text").alias("_t"), F.size(cased_words(F.col("text"))).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return every.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_ht")), "left").select(
        *KEY,
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("_t")


def drop_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns."""
    windows, _, _ = benchmark_windows(benchmark)
    dirty = hits(docs, materialize(windows, "windows")).select(F.col("doc_id").alias("_id"), F.col("_t").alias("_ht")).distinct()
    dirty = materialize(dirty, "contaminated")
    docs, names = neutral(docs, "doc_id", "text")
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    return restore(keyed.join(dirty, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_ht")), "left_anti"), names)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, their hit words and the gaps before these cut out of the text."""
    windows, _, _ = benchmark_windows(benchmark)
    found = hits(docs, materialize(windows, "windows")).groupBy(*KEY).agg(F.collect_set(F.struct("at", "len")).alias("_spans"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_ht"), F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))).alias("_hit"))
    docs, names = neutral(docs, "doc_id", "text")
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    joined = keyed.join(materialize(found, "spans"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_ht")), "left")
    joined = joined.withColumns({"_words": cased_words(F.col("text")), "_gaps": F.split("text", CASED_WORD), "_flags": F.sort_array("_hit")})
    # a map of hit positions would be searched linearly; hits are few against words, so positions to keep come from a set difference
    joined = joined.withColumn("_keep", F.array_except(F.sequence(F.lit(0), F.size("_words") - 1), F.col("_flags")))
    cut = F.concat(F.array_join(F.expr("transform(_keep, i -> concat(_gaps[i], _words[i]))"), ""), F.element_at("_gaps", -1))
    return restore(joined.withColumn("text", F.when(F.col("_hit").isNull(), F.col("text")).otherwise(cut)), names)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_documents(docs, read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
n as (select item_id, w, least(len(w), 10) as len from b where len(w) > 0),
win as (select distinct item_id, len, array_to_string(w[i:i + len - 1], ' ') as win from (select *, unnest(range(1, len(w) - len + 2)) as i from n)),
pos as (select doc_id, w, l.len, unnest(range(1, len(w) - l.len + 2)) as i from d, (select distinct len from n) l where len(w) >= l.len),
hit as (select distinct doc_id, i, p.len, item_id from (select doc_id, i, len, array_to_string(w[i:i + len - 1], ' ') as win from pos) p join win on win.win = p.win and win.len = p.len),
word as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + len)) as k from hit) group by doc_id),
item as (select doc_id, count(item_id) as n_items, sha256(coalesce(string_agg(item_id, ',' order by item_id), '')) as items_sha256 from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from d left join word using (doc_id) left join item using (doc_id)
"""
