"""WARC archives: writing, reading and revisit resolution.

`write_archive` turns pages into WARC/1.1 records.  Only headers (id, digest, length) are
grouped by payload digest; among records of one digest that of the least id is the
original, a `response`, and each other is a `revisit` that refers to it and carries no
payload.  A Bloom filter of the digests that repeat tells the records whose digest is their
own: those are written where they were read.  Of the others, only such as may be originals
go to the join with their payload.  `read_archive` parses records; `resolve` joins revisit
records to their original responses by the original's id and gives each its payload's
figures back.  `rewrite` does the same from archive to archive with fresh headers; revisits
that the input has are resolved to their originals first, and chains of them end at the
response.

A response's block is an HTTP response with the payload as its body; lengths and digests of
payloads are the body's.  Record ids are UUIDs from archive and row id, so that rows with
equal ids share one.  A header of its own, `X-Row-Id`, has the row id.

Archives are written by Spark's text sink with the record separator as its line
separator, so that its commit protocol keeps them whole if executors are lost, in gzip
files of about `file_bytes` (from the payloads' mean length).  A reader has a file's
compressed bytes and one record at a time.

A null payload counts as empty; payloads of any length make one record.  A null URL is left
out of the header.  A null id has no record id to refer to: such records are written as
responses and stay responses.  Rows that repeat the least id of a payload are all responses.
Payloads shorter than `min_bytes` are always responses.  An empty table gives an archive
without records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from base64 import b32encode
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom_join import may_have
from .textkit import Scratch, fresh_dir, give_back, pages, stored

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "id long, url string, date string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MAX_FILTER_BYTES = 256 << 20


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: 20 bits at a time, as 5 of them."""
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")


def _records(rows: DataFrame, archive: str) -> Column:
    """The text of a record from id, url, date, record_type, payload_digest,
    payload_bytes, refers_to and payload; the closing blank lines are the separator."""

    def urn(c: Column) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(archive), F.coalesce(c.cast("string"), F.lit("null"))).cast("binary"))
        # version 5, variant 8: a name-based UUID
        return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    # a URL can hold no line break or other control as it stands
    safe = F.when(F.regexp_like("url", F.lit(r"[\x00-\x20\x7F%]")), F.regexp_replace(F.url_encode("url"), r"\+", "%20")).otherwise(F.col("url"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("id")),
        _header("WARC-Date", F.col("date")),
        _header("WARC-Target-URI", safe),
        _header("X-Target-URI-Encoded", F.when(safe != F.col("url"), F.lit("yes"))),
        _header("X-Row-Id", F.col("id").cast("string")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
        _header("X-Refers-To-Row-Id", F.when(revisit, F.col("refers_to").cast("string"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise((F.octet_length("payload") + len(HEAD)).cast("string")),
        F.lit(END),
        F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HEAD), "payload")),
    )


def _parse(f: BinaryIO) -> Iterator[tuple]:
    """The records of an archive, in the order of RECORD's fields."""
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = f.read(size)
        if not line or len(block) != size:
            raise ValueError(f"record {head.get('warc-record-id')} is cut off")
        number = lambda v: int(v) if v else None
        url, kind = head.get("warc-target-uri"), head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        if head.get("x-target-uri-encoded"):
            url = unquote(url)
        digest, payload = head.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
            made = b32encode(hashlib.sha1(payload).digest()).decode()
            if digest not in (None, made):
                raise ValueError(f"payload of record {head['warc-record-id']} doesn't match its digest")
            digest = made
        yield number(head.get("x-row-id")), url, head.get("warc-date"), kind, digest, None if payload is None else len(payload), number(head.get("x-refers-to-row-id")), None if payload is None else payload.decode("utf-8", "replace")


def _read(with_payload: bool):
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()][: 8 if with_payload else 7]
    names = [x.split()[0] for x in RECORD.split(", ")][: len(types)]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                # the file's bytes as they lie in the batch, not copied
                data = pa.BufferReader(content.as_buffer())
                rows: list[tuple] = []
                size = 0
                for r in _parse(gzip.GzipFile(fileobj=data) if name.endswith(".gz") else data):
                    rows.append(r)
                    size += len(r[7] or "") if with_payload else 0
                    if len(rows) == 5000 or size > 8 << 20:
                        yield _batch(rows, types, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, types, names)
        give_back()

    return run


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archive files in a folder; the columns of RECORD, without the
    payload if it isn't asked for.  Digests of responses are checked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    out = RECORD if payload else RECORD.rpartition(", ")[0]
    return files.mapInArrow(_read(payload), out)


def originals(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """digest, first (least id), n and bytes of the payloads of at least min_bytes; from id,
    payload_digest and payload_bytes.  Each task sends one row for each digest, however many
    records have it."""
    long_enough = rows.where((F.col("payload_bytes") >= min_bytes) & F.col("payload_digest").isNotNull())
    return long_enough.groupBy(F.col("payload_digest").alias("digest")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("payload_bytes").alias("bytes"))


def decide(s: Scratch, rows: DataFrame, min_bytes: int = 0, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """rows with record_type and refers_to, and the payload of responses only.  rows has id,
    payload_digest, payload_bytes, payload and whatever else.

    Digests, and digests with their original's id, are marked in a Bloom filter if they
    repeat; single digests that it marks by mistake are in a second one.  Records that the
    first doesn't know are responses.  Those that it knows by digest, but not with their id,
    and that the second doesn't know are revisits and join their original without payload.
    The others (originals and mistakes) join with it.  If a filter would exceed
    max_filter_bytes all records join with their payload."""
    heads = s.stored(originals(rows, min_bytes), "digests")
    repeated = heads.where("n > 1 and first is not null").select("digest", "first")
    one, two = (lambda d: F.xxhash64(d)), (lambda d, i: F.xxhash64(d, i, F.lit(1)))
    marks = repeated.select(F.explode(F.array(one("digest"), two("digest", "first"))).alias("h"))
    known, look = may_have(s.spark, marks, max_filter_bytes), None
    if known is not None:
        mistakes = heads.where("n = 1").select(one("digest").alias("h")).where(known("h"))
        look = may_have(s.spark, s.stored(mistakes, "mistakes"), max_filter_bytes)
    out = rows.withColumn("__d", one("payload_digest")).withColumn("__p", two("payload_digest", "id"))
    short = (F.col("payload_bytes") < min_bytes) | F.col("payload_digest").isNull()
    if look is None:
        out = out.withColumn("__way", F.when(short, 0).otherwise(2))
    else:
        out = out.withColumn("__a", known("__d")).withColumn("__b", known("__p")).withColumn("__c", look("__d"))
        out = out.withColumn("__way", F.when(short | ~F.col("__a"), 0).when(F.col("id").isNull() | F.col("__b") | F.col("__c"), 2).otherwise(1))
    plain = lambda d: d.select(*rows.columns, "record_type", "refers_to")
    own = plain(out.where("__way = 0").withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")))
    rest = out.where("__way > 0").withColumn("payload", F.when(F.col("__way") == 2, F.col("payload")))
    rest = rest.join(repeated, F.col("payload_digest") == F.col("digest"), "left")
    again = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("first"))
    rest = rest.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))
    return own.unionByName(plain(rest.withColumn("payload", F.when(~again, F.col("payload")))))


def write_records(rows: DataFrame, path: str, max_records: int, compression: str = "gzip") -> None:
    """Writes records; rows has the columns of RECORD."""
    writer = rows.select(_records(rows, uuid.uuid4().hex).alias("value")).write.option("lineSep", END).option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", max_records).text(path)


def _per_file(heads: DataFrame, file_bytes: int) -> int:
    """Records of mean length that make a file."""
    mean = heads.agg((F.sum(F.col("n") * F.col("bytes")) / F.sum("n"))).first()[0] or 0
    return max(1, min(1_000_000, int(file_bytes // (float(mean) + 512))))


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, min_bytes: int = 0, file_bytes: int = 64 << 20) -> None:
    """A deduplicated archive of df's rows in the folder `path`.

    WARC-Date is `date_col` (a timestamp) or, without one, the time of writing."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    date = F.date_format(F.to_utc_timestamp(F.col(f"`{date_col}`") if date_col else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), date.alias("date"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    with Scratch(df.sparkSession) as s:
        size = df.select(F.octet_length(payload).alias("bytes"), F.lit(1).alias("n"))
        # hex digests are turned into base32 once, when all else is decided
        write_records(decide(s, rows, min_bytes).withColumn("payload_digest", base32(F.col("payload_digest"))), path, _per_file(size, file_bytes))


def resolve(records: DataFrame) -> DataFrame:
    """Records whose revisits have the digest and length of the response they refer to.
    A revisit whose response is missing keeps its digest; its length is null.  The headers
    of responses are written to the shared folder, so that the revisits of one response can
    be split in the join."""
    there = records.where("record_type = 'response' and id is not null").groupBy(F.col("id").alias("__id")).agg(F.min(F.struct("payload_digest", "payload_bytes")).alias("__of"))
    there = stored(there, "responses")
    responses, revisits = records.where("record_type <> 'revisit'"), records.where("record_type = 'revisit'")
    found = revisits.join(there, F.col("refers_to") == F.col("__id"), "left")
    found = found.withColumn("payload_bytes", F.col("__of.payload_bytes")).withColumn("payload_digest", F.coalesce("__of.payload_digest", "payload_digest"))
    return responses.unionByName(found.select(records.columns))


def rewrite(spark: SparkSession, path: str, to: str, min_bytes: int = 0, file_bytes: int = 64 << 20) -> None:
    """Reads archives and writes them deduplicated, with fresh headers.

    Revisits of the input have the payload of the response with their digest; a revisit
    without one in the input stays as it is.  Dates are those of the input."""
    records = read_archive(spark, path)
    responses = records.where("record_type = 'response'").drop("record_type", "refers_to")
    with Scratch(spark) as s:
        held = s.stored(originals(responses), "held")
        revisits = records.where("record_type = 'revisit'").join(held, F.col("payload_digest") == F.col("digest"), "left")
        revisits = revisits.withColumn("refers_to", F.coalesce("first", "refers_to")).withColumn("payload_bytes", F.coalesce("payload_bytes", "bytes")).select(records.columns)
        # ids of responses alone decide which is the original, so that it has a payload
        write_records(decide(s, responses, min_bytes).select(records.columns).unionByName(revisits), to, _per_file(held, file_bytes))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_dir(spark, "warc")
    write_archive(pages(spark, sf_dir), at)
    out = resolve(read_archive(spark, at, payload=False))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p),
b AS (SELECT page_id, payload_bytes, f, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(x, 5 * (i // 4)::INT + 1, 5))::INT >> (5 * (3 - (i % 4)))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM b
"""
