"""Exact substring deduplication by bucket-pointer refinement over sampled suffixes.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else, in the same
or another document; matches never cross documents and overlapping occurrences count.

Bucket-pointer refinement sorts suffixes into buckets of a common q-gram and refines a bucket by the
bucket identifiers that its members have at other offsets, until a bucket holds one suffix or the
wanted depth is reached. Here

* only *anchors* take part: of every window of ``length`` bytes, the (rightmost) q-gram of least
  hash. The choice depends on the window's bytes alone, so equal windows choose the same q-gram at
  the same offset, and a window is settled by its anchor's bucket;
* the initial bucket is the anchor's q-gram. A bucket of one settles all its windows as unique;
* an anchor's windows start up to ``length - q`` bytes before it. A node is a range of those offsets.
  Its *core* are the bytes in all its windows, its *hull* those in any of them. Refinement replaces a
  bucket by (bucket, identifier of the bytes before or after it), that is by the core of a smaller
  node. A repeated hull settles a node as repeated, a unique core as unique; the others are refined
  again, from all offsets to ``STEP`` of them and then to single windows;
* an identifier is a 128-bit hash of the bytes (a hull's 64 bits more, since hulls are compared within a
  bucket only), so each task names buckets without asking others, and a shuffle only has to count
  members. Bytes aren't compared again: two of a corpus's 10^12 anchors share an identifier by chance
  about once in 10^14 such corpora.

Long repeats are settled at the first level, so the rows made are in proportion to anchors and to
ends of repeats, not to bytes. Members are counted by partial aggregation and flagged by a join that
AQE splits where one bucket (a licence line, thousands of copies) is hot; no bucket is ever gathered.

Null text counts as empty. Texts under ``length`` bytes are kept whole. Ids are whole numbers. Rows that repeat an id and a
text are two places of that text, as any copies are; a null id is an id of its own. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of a q-gram; a window of 400 then has 273 of them.
Q = 128
#: Offsets in a node of the second level.
STEP = 17
#: Windows that are looked at together, to bound memory for long texts.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def _qgram_hashes(data: bytes, q: int) -> np.ndarray:
    """A hash of each q-gram: a polynomial modulo 2^64 from prefix sums, then mixed."""
    n = len(data)
    size = 1 << max(16, n.bit_length())
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    x *= _powers(pow(_BASE, -1, 1 << 64), size)[:n]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(x, out=sums[1:])
    h = (sums[q:] - sums[:-q]) * _powers(_BASE, size)[: n - q + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _chosen(data: bytes, q: int, length: int) -> np.ndarray:
    """For each window of the data, where its anchor starts: the least hash, the rightmost of equals."""
    w = length - q + 1
    h = _qgram_hashes(data, q)
    m = len(h)
    key = (h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64))
    rows = np.full(m + -m % w, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows[:m] = key
    rows = rows.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = m - w + 1
    return (_LOW - (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & _LOW)).astype(np.int64)


def anchors(data: bytes, q: int, length: int) -> list[tuple[int, int, int]]:
    """(place, least, most): the windows that chose the anchor start ``least`` to ``most`` bytes before it."""
    out: list[tuple[int, int, int]] = []
    for start in range(0, len(data) - length + 1, SEGMENT):
        sel = _chosen(data[start : start + SEGMENT + length - 1], q, length)
        first = np.flatnonzero(np.diff(sel, prepend=-1))
        last = np.append(first[1:] - 1, len(sel) - 1)
        at = sel[first]
        new = list(zip((at + start).tolist(), (at - last).tolist(), (at - first).tolist(), strict=True))
        if out and new[0][0] == out[-1][0]:
            place, _, most = out.pop()
            new[0] = (place, new[0][1], most)
        out += new
    return out


def _arrow(names: str, rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names.split())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _two(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)


_I, _L = pa.int32(), pa.int64()
_NODES = "id long, th long, at int, least int, most int, c1 long, c2 long, hull long"
_FLUSH = 50_000


def _roots(q: int, length: int):
    span = length - q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        flush = lambda: _arrow("id th at least most c1 c2 hull", rows, [_L, _L, _I, _I, _I, _L, _L, _L])
        for b in batches:
            for id_, th, text in zip(b["id"].to_pylist(), b["th"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = text.encode()
                for at, least, most in anchors(data, q, length) if len(data) >= length else ():
                    low = max(0, at - span)
                    rows.append((id_, th, at, least, most, *_two(data[at : at + q]), _signed(xxhash.xxh3_64_intdigest(data[low : at + length], at - low))))
                if len(rows) >= _FLUSH:
                    yield flush()
                    rows.clear()
        yield flush()

    return run


def _contexts(length: int):
    """The bytes that the nodes of an undecided anchor can touch; ``low``: where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for id_, th, text, nodes in zip(*(b[c].to_pylist() for c in ("id", "th", "text", "nodes")), strict=True):
                data = text.encode()
                for at, least, most in {(x["at"], x["least"], x["most"]) for x in nodes}:
                    low = max(0, at - (most // STEP * STEP + STEP - 1))
                    rows.append((id_, th, at, least, most, low, data[low : at + length - least // STEP * STEP]))
            yield _arrow("id th at least most low data", rows, [_L, _L, _I, _I, _I, _I, pa.binary()])

    return run


def _children(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for id_, th, at, least, most, low, data in zip(*(b[c].to_pylist() for c in ("id", "th", "at", "least", "most", "low", "data")), strict=True):
                for node in range(least // STEP * STEP, most + 1, STEP):
                    far, p = node + STEP - 1, at - low
                    hull = data[max(0, p - far) : p + length - node]
                    core = data[max(0, p - node) : p + length - far]
                    # the seed keeps nodes apart whose bytes are equal by chance of a period
                    rows.append((id_, th, at, max(least, node), min(most, far), *_two(core + node.to_bytes(2, "little")), _signed(xxhash.xxh3_64_intdigest(hull, min(p, far)))))
            yield _arrow("id th at least most c1 c2 hull", rows, [_L, _L, _I, _I, _I, _L, _L, _L])

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for id_, th, at, low, data, nodes in zip(*(b[c].to_pylist() for c in ("id", "th", "at", "low", "data", "nodes")), strict=True):
                for back in sorted({x for n in nodes for x in range(n["least"], n["most"] + 1)}):
                    start = at - back
                    rows.append((id_, th, start, *_two(data[start - low : start - low + length])))
            yield _arrow("id th start c1 c2", rows, [_L, _L, _I, _L, _L])

    return run


def _repeated(scratch: Scratch, df: DataFrame, tag: str, *keys: str) -> DataFrame:
    """Rows whose keys stand in two rows or more: counted by partial aggregation, then a semi-join.

    The keys are a written table, so that the join's sides are plain shuffles and AQE can split a hot key.
    """
    many = scratch.save(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), f"{tag}-many")
    return df.join(many, list(keys), "left_semi")


def _refined(scratch: Scratch, nodes: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """The nodes that are repeated throughout, and those to refine.

    To refine are nodes whose core is repeated but whose hull is not, and with them one node of each
    repeated hull in their buckets: the others' windows may recur in it, and one place is enough to
    tell. Equal hulls hold the same windows, so any of the group will do.
    """
    held = scratch.save(_repeated(scratch, nodes, tag, "c1", "c2"), f"{tag}-held")
    one = ["id", "th", "at", "least", "most"]
    groups = scratch.save(held.groupBy("c1", "c2", "hull").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in one)), f"{tag}-groups")
    alone, many = groups.where("n = 1"), groups.where("n > 1")
    whole = scratch.save(held.join(many.select("c1", "c2", "hull"), ["c1", "c2", "hull"], "left_semi").select(*one), f"{tag}-whole")
    scratch.drop(f"{tag}-held")
    return whole, alone.select(*one).unionByName(many.join(alone.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi").select(*one))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and th name a row: rows that share both have the same text and so the same result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.xxhash64(text, F.col(id_col).isNull()).alias("th"), F.col(id_col).alias("own_id"), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = 400, q: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Scratch]:
    """(id, th, spans): for each row with repeated bytes its runs [start, end), unmerged; and their scratch tables."""
    q = min(Q, max(1, length // 3)) if q is None else q
    if not 0 < q <= length:
        raise ValueError("q must be between 1 and length")
    scratch = Scratch(docs.sparkSession, "substring")
    keyed = _keyed(docs, id_col, text_col).drop("own_id")
    long_enough = keyed.where(F.octet_length("text") >= length)
    roots = scratch.save(long_enough.mapInArrow(_roots(q, length), _NODES), "roots")
    whole, parts = _refined(scratch, roots, "roots")
    scratch.drop("roots")
    node = F.struct("at", "least", "most")
    todo = parts.groupBy("id", "th").agg(F.collect_list(node).alias("nodes"))
    contexts = scratch.save(long_enough.join(todo.hint("shuffle_hash"), ["id", "th"]).mapInArrow(_contexts(length), "id long, th long, at int, least int, most int, low int, data binary"), "contexts")
    children = scratch.save(contexts.mapInArrow(_children(length), _NODES), "children")
    some, rest = _refined(scratch, children, "children")
    scratch.drop("children")
    todo = rest.groupBy("id", "th", "at").agg(F.collect_list(F.struct("least", "most")).alias("nodes"))
    opened = contexts.join(todo.hint("shuffle_hash"), ["id", "th", "at"])
    windows = scratch.save(opened.mapInArrow(_windows(length), "id long, th long, start int, c1 long, c2 long"), "windows")
    scratch.drop("contexts")
    span = lambda df: df.select("id", "th", (F.col("at") - F.col("most")).alias("start"), (F.col("at") - F.col("least") + length).alias("end"))
    single = _repeated(scratch, windows, "windows", "c1", "c2").select("id", "th", "start", (F.col("start") + length).alias("end"))
    spans = span(whole).unionByName(span(some)).unionByName(single)
    return spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("runs")), scratch


def merged(runs: list[dict]) -> list[list[int]]:
    """Sorted maximal runs of overlapping or adjoining spans."""
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_bytes, spans, kept = [], [], []
        for text, runs in zip(b["text"].to_pylist(), b["runs"].to_pylist(), strict=True):
            data, cut = text.encode(), merged(runs or [])
            ends = [0, *(x for s in cut for x in s), len(data)]
            n_bytes.append(len(data))
            spans.append([{"start": s, "end": e} for s, e in cut])
            kept.append(b"".join(data[s:e] for s, e in zip(ends[::2], ends[1::2], strict=True)) if cut else data)
        kind = pa.list_(pa.struct([("start", _L), ("end", _L)]))
        yield pa.RecordBatch.from_arrays([b["own_id"], pa.array(n_bytes, _L), pa.array(spans, kind), pa.array(kept, pa.binary())], ["own_id", "n_bytes", "spans", "kept"])


def deduplicate_substrings(docs: DataFrame, length: int = 400, q: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (maximal removed runs in bytes), kept (remaining bytes).

    ``kept`` is binary since a run may end inside a character.
    """
    runs, _ = repeated_spans(docs, length, q, id_col, text_col)
    keyed = _keyed(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    out = keyed.join(runs.hint("shuffle_hash"), ["id", "th"], "left").select("own_id", "text", "runs").mapInArrow(_cut, f"own_id {id_type}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("own_id", id_col)


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of ``deduplicate_substrings``, and what is left as text (a character that a run cuts is replaced)."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
