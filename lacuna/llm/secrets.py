"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in whole texts. A candidate's value is hashed, and hashes are aggregated over
the corpus: by how many distinct owners and repositories each is held. A value that many owners hold, or
that one owner copies through many repositories, was copied from a document or a tutorial ("example");
one that few hold looks like a live credential of theirs ("live"). Base patterns always stay in the
findings, with that verdict; bare tokens of high entropy, which patterns alone can't tell from
identifiers, are added only where they look live.

Counts are distinct (hash, owner) and (hash, repository) pairs, then pairs per hash: both aggregate before
the shuffle, so a value in a third of all documents is no hot key. Null text counts as empty, a null owner
as an owner of that name, and rows that repeat an id are scanned each. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
# greedy runs that must reach a length: the same as dropping shorter matches, since a run's start is its first chance
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HINT = re.compile(r"[:=]")
#: A bare token needs this many bits of entropy a character, a digit and a letter.
ENTROPY = 3.5
#: A value that more owners or more repositories than this hold is an example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 20


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of base matches and bare tokens, in code points, sorted."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    base, at, reach = sorted((s, e) for s, _, e, _ in out), 0, 0
    for m in _TOKEN.finditer(text):
        # tokens come in order, so base spans that start before this one's end are passed once
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        v = m[0]
        if reach <= m.start() and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= ENTROPY:
            out.append((m.start(), 3, m.end(), v))
    return sorted(out)


_SPAN = "struct<start:int,kind:int,end:int,h1:bigint,h2:bigint>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
_signed = lambda x: x - (1 << 64) if x >> 63 else x


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = []
        for text in b["text"].to_pylist():
            own = []
            for start, kind, end, value in scan(text) if text else ():
                h = xxhash.xxh3_128_intdigest(value)
                own.append({"start": start, "kind": kind, "end": end, "h1": _signed(h >> 64), "h2": _signed(h & (1 << 64) - 1)})
            spans.append(own)
        yield pa.RecordBatch.from_arrays([b["id"], b["owner"], b["repository"], pa.array(spans, _SPANS)], ["id", "owner", "repository", "spans"])


def find_secrets(docs: DataFrame, owner_col: str = "source", repository_col: str = "doc_id", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, findings.

    findings: array of (kind, start, end, owners, repositories, verdict) by start, then kind; kind counts
    as in ``KINDS``.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    id_type = docs.schema[id_col].dataType.simpleString()
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), name(owner_col).alias("owner"), name(repository_col).alias("repository"), F.col(text_col).alias("text"))
    own = scratch.save(read.mapInArrow(_scan, f"id {id_type}, owner string, repository string, spans array<{_SPAN}>").withColumn("row", F.monotonically_increasing_id()), "own")
    each = own.select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s.*")
    count = lambda by: each.groupBy("h1", "h2", by).agg(F.lit(1)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias(by))
    held = scratch.save(count("owner").join(count("repository"), ["h1", "h2"]), "held")
    verdict = F.when((F.col("owners") > most_owners) | (F.col("repositories") > most_repositories), "example").otherwise("live")
    told = each.select("row", "start", "kind", "end", "h1", "h2").join(held.withColumnsRenamed({"owner": "owners", "repository": "repositories"}), ["h1", "h2"])
    told = told.withColumn("verdict", verdict).where("kind < 3 OR verdict = 'live'")
    one = F.struct("start", "kind", "end", "owners", "repositories", "verdict")
    rows = told.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("findings"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,verdict:string>>")
    return own.select("id", "row").join(rows, "row", "left").select(F.col("id").alias(id_col), F.coalesce("findings", none).alias("findings"))


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of ``find_secrets``, the counts of verdicts beside them."""
    kind = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["kind"])
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")
    base = F.filter("findings", lambda x: x["kind"] < 3)
    n = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    live = F.size(F.filter("findings", lambda x: x["verdict"] == "live")).cast("long")
    return out.select(id_col, *(n(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(joined(base), 256).alias("base_sha256"), joined("findings").alias("spans"), live.alias("n_live"))
