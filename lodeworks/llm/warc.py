"""Content-addressed WARC archive: each payload is stored once under a verified strong digest, record headers are kept
exactly and apart, and records come back by joining the two.

An archive is two Parquet tables in one folder: headers (head: the exact bytes of a record before its payload, that is WARC header and HTTP header; content key) and
payloads (content key, bytes). The content key is SHA-256 and length of the payload. Of records with equal payloads of at least min_bytes the one with the
largest id is the response, and the others are revisits that refer to it; smaller ones are all responses (and share one stored payload
nevertheless). Reading joins head and payload to the record's bytes again, parses these, and recomputes both digests: SHA-256 of each stored payload, SHA-1 of each
record's; it fails if one doesn't fit.

Hot payloads: winners are found by a partial aggregation, and headers meet them by a join that broadcasts hot keys (fewer than HOT_SHARE), so
a third of all pages with one payload is no hot task. When records are rebuilt, a payload of many records is copied once for each BLOCK of them. Payload bytes move once
when they are written, and only those of winners stay; the shuffle files of writing are gone before reading makes its own.

Defined results: a null html is an empty payload; a null url is an empty target; a null id is the smallest; repeated rows (same id
and payload) get equal records; an id with several payloads gets one record for each; an empty table gives empty archives and results; a very long payload is one
value of its row. Records have three columns (record_id, target, payload) and a date if there is one; others aren't stored, so their names can't clash.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, materialize, read, rows_of, scratch, utf8

CRLF = "\r\n"
#: So many records share one copy of a payload when they are rebuilt.
BLOCK = 10_000
#: Spark deletes an action's shuffle files at its end, if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stands for a null id inside the archive.
NO_ID = -(2**63)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for record_id, target, date, text in rows_of(batches, "record_id", "target", "date", "payload"):
        payload = utf8(text) if isinstance(text, str) or text is None else bytes(text)
        out.append((record_id, target, date, len(payload), base32_sha1(payload), f"{hashlib.sha256(payload).hexdigest()}-{len(payload)}"))
        if len(out) == 4096:
            yield _batch(out, _DIGESTS)
            out = []
    if out:
        yield _batch(out, _DIGESTS)


_DIGESTS = pa.schema([("record_id", pa.int64()), ("target", pa.string()), ("date", pa.timestamp("us")), ("n_bytes", pa.int64()), ("sha1", pa.string()), ("key", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _uri(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), record_id.cast("string"), F.lit(">"))


def http_head() -> Column:
    """The HTTP header of the response, which precedes the payload; a revisit has it without the payload."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))


def record_head() -> Column:
    """The exact bytes of a record before its payload, as text: WARC header, empty line, HTTP header, empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("record_type") == "revisit"
    http = http_head()
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uri(F.col("record_id"))),
        line("WARC-Date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("target", F.lit("")), "[\r\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Refers-To", _uri(F.col("refers_to")))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))).cast("string")),
        F.lit(CRLF),
        http,
    )


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside are deleted when each ends, not when the driver happens to collect its garbage. The session's setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def write_archive(records: DataFrame, path: str, min_bytes: int = 0) -> None:
    """records: (record_id long, target string, payload string or binary, and perhaps date timestamp in UTC; else all bear the time of writing)."""
    with shuffles_freed(records.sparkSession):
        _write_archive(records, path, min_bytes)


def _write_archive(records: DataFrame, path: str, min_bytes: int) -> None:
    date = F.col("date") if "date" in records.columns else F.lit(datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    records = records.select(F.coalesce("record_id", F.lit(NO_ID)).alias("record_id"), "target", date.alias("date"), "payload")
    known = materialize(records.mapInArrow(digests, "record_id long, target string, date timestamp_ntz, n_bytes long, sha1 string, key string"), "digests")
    winners = materialize(known.groupBy("key").agg(F.max("record_id").alias("winner"), F.count("*").alias("n_group")), "winners")
    joined = hot_join(known, winners, ["key"], "n_group", known.count())
    revisit = (F.col("n_bytes") >= min_bytes) & (F.col("record_id") < F.col("winner"))
    typed = joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("winner"))})
    blocks = F.expr(f"cast(n_group div {BLOCK} as int) + 1")
    part = F.pmod(F.xxhash64("record_id", "target"), blocks).cast("int")
    typed.select("record_id", F.encode(record_head(), "UTF-8").alias("head"), "key", part.alias("part")).write.option("compression", "zstd").parquet(f"{path}/headers")
    body = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    keyed = records.select("record_id", body.alias("payload"))
    keyed = keyed.withColumn("key", F.concat_ws("-", F.sha2("payload", 256), F.length("payload").cast("string")))
    if known.groupBy("record_id", "key").agg(F.count("*").alias("n")).where("n > 1").take(1):  # repeated rows; else payloads needn't move again
        keyed = keyed.dropDuplicates(["record_id", "key"])
    wanted = winners.select(F.col("winner").alias("record_id"), "key", blocks.alias("parts"))
    # the ids come from small rows; payloads meet them once, by id and key
    bodies = keyed.join(wanted, ["record_id", "key"])
    bodies.select("key", "parts", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def sound(payload: Column, key: Column) -> Column:
    """The payload, if its SHA-256 and length are its key; else the job fails."""
    fault = F.raise_error(F.concat(F.lit("stored payload "), key, F.lit(" is damaged"))).cast("binary")
    return F.when(key == F.concat_ws("-", F.sha2(payload, 256), F.length(payload).cast("string")), payload).otherwise(fault)


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(record, payload): the bytes of each record as they stand in a WARC file, and its payload, which is for a revisit that of the response it refers to."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    copies = payloads.select("key", sound(F.col("payload"), F.col("key")).alias("payload"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = headers.select("head", "key", "part").join(copies, ["key", "part"])
    is_revisit = F.substring(F.col("head"), 1, len(_REVISIT)) == F.lit(_REVISIT)
    return joined.select(F.concat(F.col("head"), F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit((CRLF * 2).encode())).alias("record"), "payload")


_REVISIT = b"WARC/1.1\r\nWARC-Type: revisit\r\n"
_INDEX = pa.schema([("record_id", pa.int64()), ("target", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def fields_of(header: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in header.decode("utf-8", "surrogatepass").split(CRLF)[1:] if x)


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each record says, held against its payload."""
    number = lambda uri: None if uri is None or (n := int(uri.removeprefix("<urn:record:").removesuffix(">"))) == NO_ID else n
    out: list[tuple] = []
    for record, payload in rows_of(batches, "record", "payload", at_once=64):
        ((header, block),) = parse_warc(record)
        f = fields_of(header)
        revisit = f["WARC-Type"] == "revisit"
        head, _, body = block.partition(b"\r\n\r\n")
        digest = base32_sha1(payload)
        if f["WARC-Payload-Digest"] != f"sha1:{digest}" or body != (b"" if revisit else payload) or int(re.search(rb"Content-Length: (\d+)", head)[1]) != len(payload):
            raise ValueError(f"record {f['WARC-Record-ID']} differs from its payload")
        out.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], len(payload), digest, f["WARC-Type"], number(f.get("WARC-Refers-To"))))
        if len(out) == 4096:
            yield _batch(out, _INDEX)
            out = []
    if out:
        yield _batch(out, _INDEX)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from its rebuilt bytes: record_id, target, payload_bytes, payload_digest, record_type, refers_to."""
    return reconstruct(spark, path).mapInArrow(parsed, "record_id long, target string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block, content block) of each record of a WARC file, plain or gzipped by record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"no end of the header at byte {at}")
        header = data[at : end + 4]
        length = re.search(rb"(?im)^content-length:\s*(\d+)", header)
        if not header.startswith(b"WARC/") or length is None:
            raise ValueError(f"no WARC record at byte {at}")
        stop = end + 4 + int(length[1])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield header, data[end + 4 : stop]
        at = stop + 4


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    pages = read(spark, sf_dir, "pages")
    write_archive(pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("target"), F.col("html").alias("payload")), path)
    return read_index(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with d as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as winner from pages)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id < winner then 'revisit' else 'response' end as record_type,
  case when page_id < winner then winner end as refers_to
from d
"""
