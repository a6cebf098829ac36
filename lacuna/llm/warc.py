"""WARC records and the resolution of not-modified revisits.

A revisit says that a page had not changed since an earlier capture. It is resolved by an as-of join on
the canonical URL: to the latest full response (status 200) that came earlier, by (time, record id).
Validators are then checked: the strongest that both sides carry decides, an entity tag (compared
weakly), else Last-Modified, else the payload's digest. If it agrees, the revisit gets that response's
payload, and the response's headers with those replaced that a 304 may update.

A URL that holds a third of all records must not become one window, whether they spread over years or
came in one second. Records are dealt by ranges of (URL, time, record id), which Spark cuts at sampled
quantiles, so that a hot URL stands in many slices of like size; a slice hands on its last full response
per URL, one row for each URL and slice, and only these are ordered across slices; within (URL, slice) a
window orders that slice's records.

Each record gets a verdict: full; resolved; mismatch (a validator differs); unverified (no validator in
common, resolved as the revisit claims); orphan (no earlier response); other (any other record, and
responses that aren't 200). Records with a null URL or time are never joined: revisits among them are
orphans. Ties of time go by record id; rows that repeat a record id and time are told apart by nothing
and one of those that are responses gives headers and payload.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import ship
from .common import Scratch, shuffle_partitions

#: Headers of a stored response that a 304 may update (RFC 9110, section 15.4.5; fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SCHEMA = "record_id string, url string, ts long, type string, status int, headers map<string,string>, payload binary"

# ---- records as bytes


def write_record(record_id: str, url: str, ts: str, kind: str, status: int, headers: dict[str, str], payload: bytes | None) -> bytes:
    """One WARC/1.1 record with an HTTP head; a revisit has no payload."""
    http = f"HTTP/1.1 {status} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + (payload or b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": url, "WARC-Date": ts, "Content-Type": "application/http;msgtype=response"}
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _head(stream: io.BufferedIOBase) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    while line := stream.readline():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _lines(stream: io.BufferedIOBase) -> Iterator[bytes | None]:
    """First lines of records; None where the stream can't be read on."""
    while True:
        try:
            line = stream.readline()
        except (OSError, EOFError, zlib.error):
            yield None
            return
        if not line:
            return
        yield line


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """(record_id, url, time text, type, status, headers, payload) of each record of a WARC stream.

    What isn't a record doesn't end the file: bytes up to the next line that begins one, a record without a length that
    can be read, one that the stream's end cuts, and a broken compressed member give one row of type ``malformed`` each.
    """
    bad, lost = (None, None, None, "malformed", None, {}, None), False
    for line in _lines(stream):
        if line is None:
            yield bad
            return
        if not line.startswith(b"WARC/"):
            if line.strip() and not lost:
                lost = True
                yield bad
            continue
        lost = False
        try:
            head = _head(stream)
            length = int(head.get("content-length", ""))
            data = stream.read(length) if length >= 0 else b""
        except (ValueError, OSError, EOFError, zlib.error):
            lost = True
            yield bad
            continue
        if len(data) != length:
            yield bad
            return
        block = io.BytesIO(data)
        status, headers, payload = None, {}, data
        if "application/http" in head.get("content-type", ""):
            first = block.readline().split()
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() and len(first[1]) < 6 else None
            headers, payload = _head(block), block.read()
        yield head.get("warc-record-id", "").strip("<>"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-type"), status, headers, payload


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 4 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["record_id", "url", "time", "type", "status", "headers", "payload"]
    for b in batches:
        for content in b["content"].to_pylist():
            raw = io.BytesIO(content)
            stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
            rows: list[tuple] = []
            for r in read_records(stream):
                rows.append((*r[:5], list(r[5].items()), r[6]))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows.clear()
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped by member; ts is in microseconds. A file is read whole by one task, so it must be
    under 2 GB (crawls cut theirs at about 1 GB); what can't be read gives rows of type ``malformed``, never an error."""
    files = ship(spark).read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(_parse, "record_id string, url string, time string, type string, status int, headers map<string,string>, payload binary")
    return out.select("record_id", "url", F.unix_micros(F.expr("try_to_timestamp(time)")).alias("ts"), "type", "status", "headers", "payload")


# ---- resolution


def canonical(url: Column | str) -> Column:
    """A URL's canonical form: no scheme, www., fragment, tracking parameters, default port, last slash; host in lower case."""
    x = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z]+://(www\.)?", "")
    host, rest = F.lower(F.regexp_extract(x, r"^[^/?]*", 0)), F.regexp_extract(x, r"^[^/?]*(.*)$", 1)
    host = F.regexp_replace(host, r"^www\.|:(80|443)$", "")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref)=[^&]*", r"$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def _tag(headers: str) -> Column:
    return F.regexp_replace(F.col(headers)["etag"], r"^W/", "")


def resolve(records: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per row of ``records`` (see ``SCHEMA``; further columns are not read; header names in lower case):

    record_id, canonical, type, verdict, refers_to, payload and headers as merged. ``slices``: ranges that records are dealt to,
    Spark's number of shuffle partitions by default.

    Everything is decided on a table without payloads. Only then are payloads moved, once, from the
    responses to the revisits that get them; other records keep theirs where they are.
    """
    scratch = Scratch(records.sparkSession, "warc")
    key = ["canonical", "ts", "record_id"]
    full = (F.col("type") == "response") & (F.col("status") == 200)
    read = records.select("record_id", "url", F.col("ts").cast("long").alias("ts"), "type", "status", "headers", "payload").withColumn("canonical", canonical("url"))
    whole = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    own = read.withColumns({"full": F.coalesce(full & whole, F.lit(False)), "revisit": F.coalesce(F.col("type") == "revisit", F.lit(False))})
    light = scratch.save(own.where("full OR revisit").select(*key, "full", "revisit", "headers", F.when(F.col("full"), F.sha2("payload", 256)).alias("digest")), "light")
    placed = light.where(whole).select(*key, "full", "revisit").repartitionByRange(slices or shuffle_partitions(scratch.spark), *key)
    placed = scratch.save(placed.withColumn("slice", F.spark_partition_id()), "placed")
    place = F.when(F.col("full"), F.struct("ts", "record_id"))
    # the last full response of each (URL, slice), handed to later slices: as many rows a URL as slices hold it
    ahead = placed.groupBy("canonical", "slice").agg(F.max(place).alias("own"))
    ahead = ahead.withColumn("carried", F.max("own").over(Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    ahead = scratch.save(ahead.where("carried IS NOT NULL").select("canonical", "slice", F.col("carried.ts").alias("c_ts"), F.col("carried.record_id").alias("c_id")), "ahead")
    inside = Window.partitionBy("canonical", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("seen", F.max(place).over(inside)).where("revisit").join(ahead, ["canonical", "slice"], "left")
    links = seen.select(*key, F.coalesce("seen.record_id", "c_id").alias("refers_to"), F.coalesce("seen.ts", "c_ts").alias("b_ts"))
    links = scratch.save(links.where("refers_to IS NOT NULL").dropDuplicates(key), "links")
    bases = scratch.save(light.where("full").groupBy("canonical", F.col("ts").alias("b_ts"), F.col("record_id").alias("refers_to")).agg(F.first("headers").alias("b_headers"), F.first("digest").alias("b_digest"), F.count(F.lit(1)).alias("n")), "bases")
    links = scratch.save(links.join(bases, ["canonical", "b_ts", "refers_to"]), "told")
    repeated = not links.where("n > 1").isEmpty()

    revisits = own.where("revisit").select(*key, "type", "headers", "payload")
    out = revisits.join(links, key, "left")
    agree = F.coalesce(_tag("headers") == _tag("b_headers"), F.col("headers")["last-modified"] == F.col("b_headers")["last-modified"], F.col("headers")["x-payload-digest"] == F.col("b_digest"))
    verdict = F.when(F.col("refers_to").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    permitted = F.coalesce(F.map_filter("headers", lambda k, _: k.isin(*PERMITTED)), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter("b_headers", lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    out = scratch.save(out.select(*key, "type", verdict.alias("verdict"), "refers_to", "b_ts", "headers", F.coalesce(merged, permitted).alias("merged"), "payload"), "revisits")
    taken = F.col("verdict").isin("resolved", "unverified")
    bodies = own.where("full").select("canonical", F.col("ts").alias("b_ts"), F.col("record_id").alias("refers_to"), F.col("payload").alias("b_payload"))
    if repeated:  # a response that stands in several rows gives its payload once
        bodies = bodies.groupBy("canonical", "b_ts", "refers_to").agg(F.first("b_payload").alias("b_payload"))
    given = out.where(taken).drop("payload").join(bodies, ["canonical", "b_ts", "refers_to"])
    none = F.lit(None).cast("string")
    return (
        own.where("NOT revisit").select("record_id", "canonical", "type", F.when(F.col("full"), "full").otherwise("other").alias("verdict"), none.alias("refers_to"), "payload", "headers")
        .unionByName(out.where(~taken).select("record_id", "canonical", "type", "verdict", none.alias("refers_to"), "payload", "headers"))
        .unionByName(given.select("record_id", "canonical", "type", "verdict", "refers_to", F.col("b_payload").alias("payload"), F.col("merged").alias("headers")))
    )


def captures(pages: DataFrame) -> DataFrame:
    """The table ``pages`` as a crawl: each page is a full response, then a not-modified revisit.

    Times follow page_id. A revisit comes a little later, for every eleventh page before its response; its
    entity tag is of the page's text, for every fifth of another. It keeps no payload.
    """
    id_, html = F.col("page_id"), F.coalesce("html", F.lit("")).cast("binary")
    tag = lambda x: F.concat(F.lit('"'), F.md5(x), F.lit('"'))
    first = F.struct(
        id_.cast("string").alias("record_id"), F.col("url").alias("url"), (id_ * 4).alias("ts"), F.lit("response").alias("type"), F.lit(200).alias("status"),
        F.create_map(F.lit("date"), (id_ * 4).cast("string"), F.lit("etag"), tag(html), F.lit("server"), F.lit("origin")).alias("headers"), html.alias("payload"),
    )
    at = F.when(id_ % 11 == 0, id_ * 4 - 1).otherwise(id_ * 4 + 1 + id_ % 7 * 400)
    then = F.when(id_ % 5 == 0, tag(F.concat(html, F.lit("new").cast("binary")))).otherwise(F.concat(F.lit("W/"), tag(html)))
    later = F.struct(
        F.concat(id_.cast("string"), F.lit("r")).alias("record_id"), F.col("url").alias("url"), at.alias("ts"), F.lit("revisit").alias("type"), F.lit(304).alias("status"),
        F.create_map(F.lit("date"), at.cast("string"), F.lit("etag"), then, F.lit("server"), F.lit("cache")).alias("headers"), F.lit(None).cast("binary").alias("payload"),
    )
    return pages.select(F.explode(F.array(first, later)).alias("r")).select("r.*")


def digest(out: DataFrame) -> DataFrame:
    """Ids, verdicts, and digests of what was merged."""
    keys = F.array_sort(F.map_keys("headers"))
    line = F.array_join(F.transform(keys, lambda k: F.concat_ws("=", k, F.col("headers")[k])), ";")
    return out.select("record_id", F.col("canonical").alias("canonical_url"), "verdict", "refers_to", F.sha2("payload", 256).alias("payload_sha256"), line.alias("merged_headers"))


ORACLE = r"""
WITH x AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://(www\.)?', '') AS u FROM pages),
h AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.|:(80|443)$', '') AS host,
  regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g') AS rest FROM x),
c AS (SELECT page_id, html, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g') AS canonical FROM h),
full_ AS MATERIALIZED (SELECT CAST(page_id AS VARCHAR) AS record_id, canonical, page_id * 4 AS ts, html, '"' || md5(html) || '"' AS etag FROM c),
late AS MATERIALIZED (SELECT CAST(page_id AS VARCHAR) || 'r' AS record_id, canonical, CASE WHEN page_id % 11 = 0 THEN page_id * 4 - 1 ELSE page_id * 4 + 1 + page_id % 7 * 400 END AS ts,
  '"' || md5(CASE WHEN page_id % 5 = 0 THEN html || 'new' ELSE html END) || '"' AS bare, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'W/' END AS weak FROM c),
joined AS (SELECT l.*, f.record_id AS base, f.html, f.etag FROM late l ASOF LEFT JOIN full_ f ON l.canonical = f.canonical AND l.ts > f.ts)
SELECT record_id, canonical AS canonical_url, CASE WHEN canonical IS NULL THEN 'other' ELSE 'full' END AS verdict, NULL AS refers_to, sha256(html) AS payload_sha256,
  'date=' || ts || ';etag=' || etag || ';server=origin' AS merged_headers FROM full_
UNION ALL
SELECT record_id, canonical, CASE WHEN base IS NULL THEN 'orphan' WHEN etag = bare THEN 'resolved' ELSE 'mismatch' END, CASE WHEN etag = bare THEN base END,
  CASE WHEN etag = bare THEN sha256(html) END, 'date=' || ts || ';etag=' || weak || bare || ';server=' || CASE WHEN etag = bare THEN 'origin' ELSE 'cache' END FROM joined
"""
