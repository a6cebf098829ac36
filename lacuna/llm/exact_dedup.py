"""Exact deduplication against a history held in a minimal perfect hash.

Texts are equal when equal after deleting ASCII white space; the digest is the SHA-256 of what is left.
The history's distinct digests are dealt into shards of bounded size by their own bytes. A shard's hash
function places keys in levels of bit tables: a key that is alone in its place of a level stays there,
the others go on to the next level; the rank of its bit is its slot, so that n keys fill n slots. A slot
holds the full 32-byte digest and its class (the row that stays, its length, the number of rows).

A lookup finds a slot for any digest, so it compares all 32 bytes: equal means a repeat of history, else
the digest is no member, and its rows form a group of their own. Rows are aggregated to one per digest
before anything is looked up, so a text that a third of all rows share is one lookup.

Of equal texts the row with most code points in the original text stays, then the least id (nulls last),
then one of the rows that repeat id and text. Null text counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch, numbered

#: Distinct digests in a shard of the index, about.
SHARD = 20_000
#: Places of a level for each key that it gets, and levels before the rest is listed.
_SPARE, _LEVELS = 1.5, 40
_L = pa.int64()


def normal_digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode().translate(None, WHITE)).digest()


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests; a slot also for digests that it hasn't seen."""

    def __init__(self, digests: np.ndarray):
        """digests: (n, 32) bytes, distinct."""
        left, self.levels, self.n = np.arange(len(digests)), [], len(digests)
        for level in range(_LEVELS):
            if not len(left):
                break
            m = int(len(left) * _SPARE) + 1
            at = self._place(digests[left], level, m)
            alone = np.bincount(at, minlength=m) == 1
            self.levels.append(alone)
            left = left[~alone[at]]
        self.rest = {digests[i].tobytes(): k for k, i in enumerate(left.tolist())}

    @staticmethod
    def _place(digests: np.ndarray, level: int, m: int) -> np.ndarray:
        w = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        h = w[:, 0] + np.uint64(2 * level + 1) * w[:, 1]
        h ^= h >> np.uint64(31)
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[:, 2]
        h ^= h >> np.uint64(29)
        return (h % np.uint64(m)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """For members their own slot of 0 to n-1; for others any slot, or -1."""
        out, open_, base = np.full(len(digests), -1), np.arange(len(digests)), 0
        for level, alone in enumerate(self.levels):
            at = self._place(digests[open_], level, len(alone))
            hit = alone[at]
            out[open_[hit]] = base + np.cumsum(alone)[at[hit]] - 1
            open_, base = open_[~hit], base + int(alone.sum())
        for i in open_.tolist() if self.rest else ():
            out[i] = base + k if (k := self.rest.get(digests[i].tobytes())) is not None else -1
        return out

    def dump(self) -> bytes:
        parts = [len(self.levels).to_bytes(4, "little")]
        for alone in self.levels:
            parts += [len(alone).to_bytes(8, "little"), np.packbits(alone).tobytes()]
        return b"".join([*parts, self.n.to_bytes(8, "little"), *self.rest])

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        out, at = cls.__new__(cls), 4
        out.levels = []
        for _ in range(int.from_bytes(data[:4], "little")):
            m = int.from_bytes(data[at : at + 8], "little")
            end = at + 8 + (m + 7) // 8
            out.levels.append(np.unpackbits(np.frombuffer(data[at + 8 : end], np.uint8))[:m].astype(bool))
            at = end
        out.n = int.from_bytes(data[at : at + 8], "little")
        out.rest = {data[s : s + 32]: k for k, s in enumerate(range(at + 8, len(data), 32))}
        return out


def _as_rows(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b["text"].to_pylist()
        more = [c for c in ("row",) if c in b.schema.names]
        yield pa.RecordBatch.from_arrays([b["id"], b["old"], pa.array([normal_digest(t) for t in texts], pa.binary()), pa.array([len(t or "") for t in texts], _L), *(b[c] for c in more)], ["id", "old", "digest", "chars", *more])


_CLASS = "digest binary, chars long, id long, row long, n long"


def _classes(own: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the number of rows."""
    best = F.max(F.struct("chars", (-F.col("id")).alias("id"), (-F.col("row")).alias("row"))).alias("best")
    return own.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best).select("digest", F.col("best.chars").alias("chars"), (-F.col("best.id")).alias("id"), (-F.col("best.row")).alias("row"), "n")


def _build(table: pa.Table) -> pa.Table:
    """A shard's classes in slot order, beside the hash function."""
    digests = table["digest"].to_pylist()
    mph = PerfectHash(rows := _as_rows(digests))
    order = np.argsort(mph.slots(rows))
    held = table.take(pa.array(order))
    one = lambda c: pa.array([held[c].to_pylist()], pa.list_(_L))
    return pa.table([table["shard"][:1], pa.array([mph.dump()], pa.binary()), pa.array([b"".join(held["digest"].to_pylist())], pa.binary()), *map(one, ("chars", "id", "row", "n"))], ["shard", "mph", "digests", "chars", "id", "row", "n"])


def build_index(classes: DataFrame, shards: int) -> DataFrame:
    """One row per shard: hash function, slots' digests and locators. classes: as of ``_classes``."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    return classes.select(shard, "*").groupBy("shard").applyInArrow(_build, "shard int, mph binary, digests binary, chars array<long>, id array<long>, row array<long>, n array<long>")


def _better(a: tuple, b: tuple) -> bool:
    """Whether class row a (chars, id, row) stays before b."""
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return key(a) < key(b)


def _lookup(key: tuple, index: pa.Table, new: pa.Table) -> pa.Table:
    """All classes of a shard: history's with the repeats that came, then the groups of nonmembers."""
    digests = new["digest"].to_pylist()
    best = list(zip(*(new[c].to_pylist() for c in ("chars", "id", "row")), strict=True))
    count = new["n"].to_pylist()
    slot, kept, held, n = np.full(len(digests), -1), [], [], []
    if index.num_rows:
        held = list(zip(*(index[c][0].as_py() for c in ("chars", "id", "row")), strict=True))
        n = index["n"][0].as_py()
        all_ = index["digests"][0].as_py()
        kept = [all_[s : s + 32] for s in range(0, len(all_), 32)]
        if digests:
            slot = PerfectHash.load(index["mph"][0].as_py()).slots(_as_rows(digests))
    out = [[d, *b, k, True] for d, b, k in zip(kept, held, n, strict=True)]
    for d, b, k, s in zip(digests, best, count, slot.tolist(), strict=True):
        if s >= 0 and kept[s] == d:
            own = out[s]
            if _better(b, tuple(own[1:4])):
                own[1:4] = b
            own[4] += k
        else:
            out.append([d, *b, k, False])
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    types = [pa.binary(), _L, _L, _L, _L, pa.bool_()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["digest", "chars", "id", "row", "n", "known"])


def exact_duplicates(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs`` and ``history``: id, old, digest, keep_id, group_size, kept, known, row.

    ``old``: the row is of history; ``known``: its text is in history. Ids are whole numbers. Either
    table may be empty, and a row may repeat; of rows that repeat id and text one stays. ``row`` is a
    number of each row's own, or that of ``row_col``. Texts of any length are hashed whole, in the task
    that reads them. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    part = lambda df, old: df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(old).alias("old"), *([F.col(row_col).alias("row")] if row_col else []))
    both = part(docs, False) if history is None else part(docs, False).unionByName(part(history, True))
    own = both.mapInArrow(_digests, "id long, old boolean, digest binary, chars long" + ", row long" * bool(row_col))
    own = scratch.save(own if row_col else own.withColumn("row", F.monotonically_increasing_id()), "own")  # written once, so the numbers hold
    new = scratch.save(_classes(own.where("not old")), "new")
    old = scratch.save(_classes(own.where("old")), "old")
    shards = max(1, -(-max(new.count(), old.count()) // shard))
    index = scratch.save(build_index(old, shards), "index")
    to = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    told = index.groupBy("shard").cogroup(new.select(to, "*").groupBy("shard")).applyInArrow(_lookup, _CLASS.replace("n long", "n long, known boolean"))
    told = scratch.save(told, "told").select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"), "known")
    return own.join(told, "digest").select(F.col("id").alias(id_col), "old", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "known", "row")


def by_arrival(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A table as a new batch and a history: even halves by a hash of the id, a null id in history."""
    old = F.coalesce(F.xxhash64(F.col(id_col)) < 0, F.lit(True)) | F.col(id_col).isNull()
    return docs.where(~old), docs.where(old)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Of a class of equal texts it is the row that the class names, whatever
    repeats in ids and texts: rows are numbered in a written table, so the numbers hold."""
    rows = numbered(docs, Scratch(docs.sparkSession, "exact"), id=id_col, text=text_col)
    kept = exact_duplicates(*by_arrival(rows, "id"), "id", "text", row_col="row").where("kept").select("row")
    return rows.select("row", "_row").join(kept, "row", "left_semi").select("_row.*")


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return out.select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
r AS (SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d
  WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(body) AS text_sha256 FROM r
"""
