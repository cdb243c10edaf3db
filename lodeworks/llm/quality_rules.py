"""Quality rules: adaptive thresholds from mergeable quantile sketches per language and source, then a joined filter.

Documents that fail the base rule are no part of the sketches. The sketch is a log-linear histogram of integers: the leading SKETCH_BITS bits of a value name its bin, so a bin is at
most 1/64 of its value wide, bins of any two parts of the data add up, and a group has at most a few thousand of them.
Quantiles of a group are read off its bins; a group under MIN_GROUP documents uses the merged sketch of its language.
A document is an outlier if a measure is over the group's upper decile by SPREADS spreads (for lengths of words also if it is under the lower decile by as many).
A spread is what the sketch says: the distance of that decile from the median; for measures of which nearly all documents have none (duplicate lines, repeats)
at least a third of the way from the upper decile to the highest centile; for symbols, which whole templates of junk have in plenty, at least an eighth of the lower
decile of the documents that have any. FLOORS only keep a constant measure from having no spread. Thus an even corpus loses nothing, in contrast
to a cut at a fixed quantile. So that a source full of junk can't raise its own limit at will, a limit is at most LIFT halves of that of its language.

Defined results: a null text has no words and fails the base rule; null languages and sources are one group with the
empty string; repeated rows are judged alike, each by itself; an empty table gives an empty result; other columns stay
where the filter is used (names of the measures are prefixed there).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, materialize, neutral, read, restore

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SKETCH_BITS, MIN_GROUP, SPREADS, LIFT = 7, 100, 6, 3
#: measure: (the least spread in the unit of the measure, what else a spread is at least)
MEASURES = {"m_symbols": (2, "p10 div 8"), "m_dup_lines": (25, "(q99 - q90) div 3"), "m_word_length": (5, "0"), "m_repeats": (10, "(q99 - q90) div 3")}
#: measures with a lower limit too
LOW = ["m_word_length"]
THRESHOLDS = [*(f"t_{m}" for m in MEASURES), *(f"t_{m}_low" for m in LOW)]
QUANTILES = {"q10": (1, 10), "q50": (1, 2), "q90": (9, 10), "q99": (99, 100)}


def base_measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines to (doc_id, lang, source, text)."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(
        "doc_id",
        "lang",
        "source",
        (F.length(text) - F.length(F.regexp_replace(text, SPACE + "+", ""))).alias("_spaces"),
        F.length(text).cast("long").alias("_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        words.alias("_words"),
    )
    d = d.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        (F.col("_chars") - F.col("_spaces")).alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "case when size(_words) < 4 then cast(array() as array<bigint>) else "
            "transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) end"
        ).alias("_h"),
    )
    # where no window is found twice, nothing is sorted
    d = d.withColumn("_s", F.expr("case when size(array_distinct(_h)) < size(_h) then sort_array(transform(_h, (h, i) -> struct(h, i))) end"))
    d = d.withColumn("_p", F.expr("sort_array(filter(transform(_s, (x, j) -> case when x.h = get(_s, j - 1).h or x.h = get(_s, j + 1).h then x.i end), i -> i is not null))"))
    covered = F.expr(
        "aggregate(_p, named_struct('last', -3, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(3, i - a.last)), a -> a.n)"
    )
    return d.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines"
    )


def with_ratios(measured: DataFrame) -> DataFrame:
    """Whole-number measures, so that every engine bins them alike: per mille, and hundredths of a character a word."""
    per = lambda a, b, k: F.expr(f"({k} * {a}) div greatest({b}, 1)")
    return measured.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "word_chars", 1000).alias("m_symbols"),
        per("n_dup_lines", "n_lines", 1000).alias("m_dup_lines"),
        per("word_chars", "n_words", 100).alias("m_word_length"),
        per("n_repeat_words", "n_words", 1000).alias("m_repeats"),
    )


def sketch_bin(value: Column) -> Column:
    """The lower end of the bin of a whole number of 0 or more."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - SKETCH_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, measure, bin, n): merges with any other sketch by adding n."""
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), sketch_bin(F.col(m)).alias("bin")) for m in measures))).alias("_m"))
    return long.groupBy(*keys, F.col("_m.measure").alias("measure"), F.col("_m.bin").alias("bin")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, n, q10, q50, q90, q99, p10): the lowest bins at which these shares of the rows are reached, and at which a tenth of the rows over 0 is."""
    by = Window.partitionBy(*keys, "measure")
    zeros = F.coalesce(F.sum(F.when(F.col("bin") == 0, F.col("n"))).over(by), F.lit(0))
    c = sketches.select("*", F.sum("n").over(by.orderBy("bin")).alias("c"), F.sum("n").over(by).alias("t"), zeros.alias("z"))
    q = lambda k, of: F.min(F.when(of * F.col("c") >= k * F.col("t"), F.col("bin")))
    p10 = F.min(F.when((F.col("bin") > 0) & (10 * (F.col("c") - F.col("z")) >= F.col("t") - F.col("z")), F.col("bin")))
    return c.groupBy(*keys, "measure").agg(F.first("t").alias("n"), *(q(*share).alias(name) for name, share in QUANTILES.items()), F.coalesce(p10, F.lit(0)).alias("p10"))


def limits(q: DataFrame, name: str) -> DataFrame:
    """Adds <name>, the greatest value that isn't an outlier, and <name>_low, the least, by the quantiles of each row."""
    pick = lambda i: reduce(lambda c, m: c.when(F.col("measure") == m[0], F.expr(str(m[1][i]))), MEASURES.items(), F)
    spread = F.greatest(F.col("q90") - F.col("q50"), pick(0), pick(1))
    return q.withColumns({name: F.col("q90") + SPREADS * spread, f"{name}_low": F.col("q10") - SPREADS * F.greatest(F.col("q50") - F.col("q10"), pick(0))})


def thresholds(rows: DataFrame) -> DataFrame:
    """(_lang, _source, n_group, t_<measure>..., t_<measure>_low...): the values that each measure mustn't pass."""
    fine = sketch(rows.where("not base_failed"), ["_lang", "_source"], list(MEASURES))
    own, wide = limits(quantiles(fine, ["_lang", "_source"]), "own"), limits(quantiles(merge(fine, ["_lang"]), ["_lang"]), "wide")
    both = own.join(wide.select("_lang", "measure", "wide", "wide_low"), ["_lang", "measure"])
    small = F.col("n") < MIN_GROUP
    limit = F.when(small, F.col("wide")).otherwise(F.least("own", F.expr(f"{LIFT} * wide div 2")))
    low = F.when(small, F.col("wide_low")).otherwise(F.greatest("own_low", F.expr(f"2 * wide_low div {LIFT}")))
    at = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    found = both.groupBy("_lang", "_source").agg(*(at(m, limit).alias(f"t_{m}") for m in MEASURES), *(at(m, low).alias(f"t_{m}_low") for m in LOW))
    # a group of which the base rule leaves nothing has no thresholds
    return rows.groupBy("_lang", "_source").agg(F.count("*").alias("n_group")).join(found, ["_lang", "_source"], "left")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, the thresholds of its group, base_failed and kept."""
    rows = with_ratios(base_measures(docs)).withColumns({"_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))})
    rows = materialize(rows, "measures")  # the texts are read and measured once
    limits = materialize(thresholds(rows), "thresholds")
    total = rows.count()
    judged = hot_join(rows, limits, ["_lang", "_source"], "n_group", total)
    outlier = reduce(lambda a, b: a | b, [*(F.col(m) > F.col(f"t_{m}") for m in MEASURES), *(F.col(m) < F.col(f"t_{m}_low") for m in LOW)])
    return judged.withColumn("kept", ~F.col("base_failed") & ~outlier)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(read(spark, sf_dir, "documents")).select(*names, *THRESHOLDS)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Verdicts meet documents by id and text digest, so that repeated
    ids with other texts are told apart."""
    docs, names = neutral(docs, "doc_id", "lang", "source", "text")
    key = {"_qid": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_qtext": F.xxhash64("text", "lang", "source")}
    keyed = docs.withColumns(key)
    marked = docs.select(F.struct(key["_qid"].alias("a"), key["_qtext"].alias("b")).alias("doc_id"), "lang", "source", "text")
    passed = judge(marked).where("kept").select(F.col("doc_id.a").alias("_qid"), F.col("doc_id.b").alias("_qtext")).distinct()
    return restore(keyed.join(passed, ["_qid", "_qtext"], "left_semi"), names)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs)


def _limits_sql() -> str:
    rows = " union all ".join(f"select _lang, _source, '{m}' as measure, {m} as v from r where not base_failed" for m in MEASURES)
    picks = ", ".join([*(f"max(hi) filter (measure = '{m}') as t_{m}" for m in MEASURES), *(f"max(lo) filter (measure = '{m}') as t_{m}_low" for m in LOW)])
    floor = "case measure " + " ".join(f"when '{m}' then {v[0]}" for m, v in MEASURES.items()) + " end"
    least = "case measure " + " ".join(f"when '{m}' then {v[1].replace('div', '//')}" for m, v in MEASURES.items()) + " end"

    def level(name: str, by: str, source: str) -> str:
        c = f"select {by}, measure, bin, sum(n) over (partition by {by}, measure order by bin) as c, sum(n) over (partition by {by}, measure) as t, coalesce(sum(n) filter (bin = 0) over (partition by {by}, measure), 0) as z from {source}"
        q = ", ".join(f"min(bin) filter ({of} * c >= {k} * t) as {n}" for n, (k, of) in QUANTILES.items())
        q = f"select {by}, measure, max(t) as n, {q}, coalesce(min(bin) filter (bin > 0 and 10 * (c - z) >= t - z), 0) as p10 from ({c}) group by all"
        return f"{name} as (select {by}, measure, n, q90 + {SPREADS} * greatest(q90 - q50, {floor}, {least}) as {name}, q10 - {SPREADS} * greatest(q50 - q10, {floor}) as {name}_low from ({q}))"

    return f"""
v as ({rows}),
s as (select _lang, _source, measure, ((v >> greatest(0, length(bin(v)) - {SKETCH_BITS})) << greatest(0, length(bin(v)) - {SKETCH_BITS})) as bin, count(*) as n from v group by all),
{level("own", "_lang, _source", "s")},
{level("wide", "_lang", "(select _lang, measure, bin, sum(n) as n from s group by all)")},
lim as (select _lang, _source, {picks} from (
  select _lang, _source, measure, case when own.n < {MIN_GROUP} then wide else least(own, {LIFT} * wide // 2) end as hi, case when own.n < {MIN_GROUP} then wide_low else greatest(own_low, trunc(2 * wide_low / {LIFT})::bigint) end as lo
  from own join wide using (_lang, measure)) group by all)"""


OP1_SQL = f"""
with d as (select doc_id, coalesce(lang, '') as _lang, coalesce(source, '') as _source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
g as (select doc_id, i, [w[i], w[i + 1], w[i + 2]] as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select doc_id, count(distinct x) as n from (select doc_id, unnest([i, i + 1, i + 2]) as x from (select *, count(*) over (partition by doc_id, k) as c from g) where c > 1) group by doc_id),
m as (
  select doc_id, _lang, _source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(l) as n_lines
  from w left join rep using (doc_id)),
r as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
    (1000 * n_symbols) // greatest(word_chars, 1) as m_symbols, (1000 * n_dup_lines) // greatest(n_lines, 1) as m_dup_lines,
    (100 * word_chars) // greatest(n_words, 1) as m_word_length, (1000 * n_repeat_words) // greatest(n_words, 1) as m_repeats from m),{_limits_sql()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join([*(f"{m} <= t_{m}" for m in MEASURES), *(f"{m} >= t_{m}_low" for m in LOW)])} as kept, {", ".join(f"{t}::bigint as {t}" for t in THRESHOLDS)}
from r left join lim using (_lang, _source)
"""
