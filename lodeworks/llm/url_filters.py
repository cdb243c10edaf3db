"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of the possible hits.

Rules come first: a rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's; the longest wins. Rules are
configuration, at most MAX_RULES, and become one expression. URLs that no rule fits are looked up in a list: a block of the filter
is one 64-bit word that takes BITS bits a URL; a URL whose bits are all set is a possible hit, and only those reach the exact join, by the
canonical URL itself. The filter is broadcast while it has at most MAX_BLOCKS words, and joined by shuffle beyond.

A canonical URL is host, path and query, without the scheme, a leading www. or m., user, default port, fragment, trailing slashes or .html, and without
parameters that only track (TRACKING); the others stand in order. So /a?page=2 is another page than /a, and /a?utm_source=feed isn't.

URLs are parsed once, into a written table of which each later step reads the columns that it needs.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is never listed; repeated rows are judged alike;
empty tables give empty results; a very long url is parsed whole, in time in proportion to its length; other columns of the pages aren't returned, so that their
names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, hot_join, materialize, read

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
MAX_RULES, MAX_BLOCKS = 2000, 2_000_000
BITS, URLS_PER_BLOCK = 4, 4
#: A canonical URL that was fetched under so many forms, where http and https, www, fragments and tracking make no other form, is listed as a crawler's trap.
TRAP_FORMS = 2
TRACKING = "^(utm_[a-z]+|gclid|fbclid|msclkid|mc_[a-z]+|ref)="


def parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(n, rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def query_of(url: Column) -> Column:
    """The parameters in order, without those that track, after a question mark; else empty."""
    given = F.substring(F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*[^?#]*(\?[^#]*)?", 1), 2, 2**31 - 1)
    kept = F.array_sort(F.filter(F.split(given, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)?$", "")


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Null where there is no host."""
    host = F.regexp_replace(_bare(host), r"^(www\.|m\.)", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, r"(/+|\.html?)$", ""), query))


def form(host: Column, path: Column, query: Column) -> Column:
    """A spelling without what is usual to differ."""
    return F.concat(F.regexp_replace(_bare(host), r"^www\.", ""), path, query)


def bits(hashed: Column) -> Column:
    """The bits of a URL within its block, from parts of the hash that don't choose the block."""
    one = F.lit(1).cast("long")
    each = [F.call_function("shiftleft", one, F.call_function("shiftrightunsigned", hashed, F.lit(40 - 6 * j)).bitwiseAND(F.lit(63)).cast("int")) for j in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(hashed), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, mask) of the distinct canonical URLs in column canon."""
    h = F.xxhash64("canon")
    return listed.select(block(h, blocks).alias("block"), bits(h).alias("b")).groupBy("block").agg(F.bit_or("b").alias("mask"))


def possible(urls: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows of urls (canon not null) whose bits are all set."""
    h = F.xxhash64("canon")
    small = F.broadcast(filter_) if blocks <= MAX_BLOCKS else filter_
    keyed = urls.select("*", block(h, blocks).alias("block"), bits(h).alias("_bits"))
    return keyed.join(small, "block").where(F.col("mask").bitwiseAND(F.col("_bits")) == F.col("_bits")).drop("block", "_bits", "mask")


def listed_among(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct canonical URLs of urls that are listed. Both sides have column canon."""
    listed = materialize(listed.where("canon is not null").select("canon").distinct(), "listed")
    blocks = max(1, -(-listed.count() // URLS_PER_BLOCK))
    maybe = possible(urls.where("canon is not null").select("canon"), bloom(listed, blocks), blocks)
    # copies of one URL become one row before the exact join, so a hot URL costs no more than another
    return maybe.groupBy("canon").agg(F.count("*").alias("n_rows")).join(listed, "canon")


def parsed(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, canon, form, rule, _verdict), written."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), query_of(F.col("url")).alias("_query"))
    each = [F.col(c) for c in ("host", "path", "_query")]
    found = split.select("page_id", "host", "path", canonical(*each).alias("canon"), form(*each).alias("form"), rule_of(each[0], each[1], rules).alias("_rule"))
    return materialize(found.select("page_id", "host", "path", "canon", "form", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict")), "parsed")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed, canon), one row per row of pages. listed: column canon."""
    return judge_parsed(parsed(pages, rules), listed)


def judge_parsed(found: DataFrame, listed: DataFrame) -> DataFrame:
    ruled, free = found.where("rule is not null"), found.where("rule is null")
    blocked = materialize(listed_among(free, listed), "blocked")
    named = free.where("canon is not null")
    hit = hot_join(named, blocked, ["canon"], "n_rows", blocked.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0])
    missed = free.where("canon is null").unionByName(anti_hot(named, blocked))
    columns = ["page_id", "host", "path", "rule"]
    done = lambda df, verdict, on: df.select(*columns, verdict.alias("verdict"), F.lit(on).alias("listed"), "canon")
    return done(ruled, F.col("_verdict"), False).unionByName(done(hit, F.lit("block"), True)).unionByName(done(missed, F.lit("allow"), False))


def anti_hot(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows whose URL isn't blocked. The blocked rows leave by a filter of the same kind as above first: a row that it doesn't pass
    needs no join, and rows that it passes wrongly are spread over many URLs."""
    blocks = max(1, -(-blocked.count() // URLS_PER_BLOCK))
    filter_ = bloom(blocked, blocks)
    h = F.xxhash64("canon")
    keyed = rows.select("*", block(h, blocks).alias("block"), bits(h).alias("_bits"))
    marked = keyed.join(F.broadcast(filter_) if blocks <= MAX_BLOCKS else filter_, "block", "left")
    clear = F.coalesce(F.col("mask").bitwiseAND(F.col("_bits")) != F.col("_bits"), F.lit(True))
    marked = marked.withColumn("_clear", clear).drop("block", "_bits", "mask")
    return marked.where("_clear").drop("_clear").unionByName(marked.where("not _clear").drop("_clear").join(blocked.select("canon"), "canon", "left_anti"))


def traps(found: DataFrame) -> DataFrame:
    """(canon): the canonical URLs of parsed() pages that have TRAP_FORMS forms or more. Combined within tasks first, so that a hot URL is a row a task and form."""
    forms = found.where("canon is not null").groupBy("canon", "form").agg(F.count("*").alias("n"))
    return forms.groupBy("canon").agg(F.count("*").alias("forms")).where(F.col("forms") >= TRAP_FORMS).select("canon")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsed(read(spark, sf_dir, "pages"), RULES)
    return judge_parsed(found, traps(found)).select("page_id", "host", "path", "rule", "verdict", "listed")


OP8_SQL = r"""
with u as (
  select page_id, url,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages),
r(v, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
q as (select *, list_filter(string_split(substr(regexp_extract(coalesce(url, ''), '://[^/?#]*[^?#]*(\?[^#]*)?', 1), 2), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|msclkid|mc_[a-z]+|ref)=')) as ps from u),
b as (select *, case when len(ps) > 0 then '?' || array_to_string(list_sort(ps), '&') else '' end as query, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', '') as bare from q),
c as (select page_id, host, path, nullif(regexp_replace(bare, '^(www\.|m\.)', ''), '') || regexp_replace(path, '(/+|\.html?)$', '') || query as canon, regexp_replace(bare, '^www\.', '') || path || query as form from b),
t as (select canon from c where canon is not null group by canon having count(distinct form) >= 2),
m as (select c.*, (select arg_max(r.h || r.p || '|' || r.v, length(r.h || r.p)) from r where (c.host = r.h or ends_with(c.host, '.' || r.h)) and starts_with(c.path, r.p)) as rv from c)
select page_id, host, path, split_part(rv, '|', 1) as rule,
  case when rv is not null then split_part(rv, '|', 2) when canon in (select canon from t) then 'block' else 'allow' end as verdict,
  rv is null and coalesce(canon in (select canon from t), false) as listed
from m
"""
