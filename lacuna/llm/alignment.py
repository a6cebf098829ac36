"""Alignment of two tokenizers' ids over the same bytes, and how often ids are linked across a corpus.

A document is encoded twice: a space and the text by a byte-level tokenizer (A), the text by a piece tokenizer
(B), which puts the space itself. Each byte gets a label: no token ends there, one of A, one of B, or both. A
regular expression cuts the string of labels behind each ``both``; how many A-ends and B-ends a span holds says
which ids form its group. The two last ids of a group end together: they are linked.

NULL and empty texts, and texts whose tokens' bytes don't join to a space and the text on either side (a
normalised character, for instance), have no tokens: zeros, and an empty string in place of the digest of the
groups. Rows that repeat an id count each for itself; other columns are not read; an empty table gives no rows.

A pair's links are summed within a document, then within a task, before they are shuffled. The numbers come
back to documents in two ways: the ``HOT`` commonest pairs by a broadcast of that many rows at most, the rest,
of which none holds more than one link in ``HOT``, by a join on the pair. The highest count of each B id has as
many rows as B's vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import Scratch
from .packing import vocabulary

#: Pairs whose counts go to all tasks: three numbers each.
HOT = 1 << 16
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
_SPANS = re.compile(rb"[^\x03]*\x03", re.DOTALL)
_NO_GROUPS = np.zeros(0, np.int64)


class Tokens:
    """One side: ids of texts, bytes of ids, and the ids' decimal strings by what follows them."""

    def __init__(self, pieces: list[bytes], inner: str, last: str):
        self.pieces = pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.inner, self.last = (np.array([f"{k}{c}" for k in range(len(pieces))], object) for c in (inner, last))

    def joined(self, ids: list[int]) -> bytes:
        own = self.pieces
        return b"".join([own[i] for i in ids])


@cache
def byte_side(path: str):
    """texts -> ids of a space and each text, and the tokens' bytes; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    from .packing import plain_text_encoder

    own, encode = Tokenizer.from_file(path), plain_text_encoder(path)
    # the usual byte-level alphabet: printable bytes stand for themselves, the others for what follows 255
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    names = (own.id_to_token(k) for k in range(own.get_vocab_size()))
    pieces = [bytes(byte_of[c] for c in name) if name is not None and all(c in byte_of for c in name) else (name or "").encode() for name in names]
    return (lambda texts: [encode(" " + t) for t in texts]), Tokens(pieces, ",", "|")


@cache
def piece_side(path: str):
    """texts -> ids, and the tokens' bytes."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(own.id_to_piece(k)[3:5], 16)]) if own.is_byte(k) else own.id_to_piece(k).replace("▁", " ").encode() for k in range(own.get_piece_size())]
    return (lambda texts: own.encode(texts, num_threads=1)), Tokens(pieces, ",", ";")


def labels(lengths_a: np.ndarray, lengths_b: np.ndarray) -> bytes:
    """A label for each byte; both sides cover the same bytes and no token is empty."""
    out = np.zeros(int(lengths_a.sum()), np.uint8)
    out[np.cumsum(lengths_a) - 1] = A_END
    out[np.cumsum(lengths_b) - 1] += B_END
    return out.tobytes()


def group_sizes(own: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of A and of B in each group."""
    spans = _SPANS.findall(own)
    return tuple(np.fromiter((s.count(end) for s in spans), np.int64, len(spans)) + 1 for end in (A_END, B_END))


def written(a: Tokens, b: Tokens, ids_a: np.ndarray, ids_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``."""
    parts = np.empty(len(ids_a) + len(ids_b), object)
    upto_a, upto_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    # an id of A has before it the ids of A before it and the ids of B of earlier groups; one of B those of A up to its own group
    at_a = np.arange(len(ids_a)) + np.repeat(upto_b - sizes_b, sizes_a)
    at_b = np.arange(len(ids_b)) + np.repeat(upto_a, sizes_b)
    parts[at_a], parts[at_b] = a.inner[ids_a], b.inner[ids_b]
    parts[at_a[upto_a - 1]], parts[at_b[upto_b - 1]] = a.last[ids_a[upto_a - 1]], b.last[ids_b[upto_b - 1]]
    return "".join(parts.tolist())[:-1]


def align(a: Tokens, b: Tokens, text: str | None, ids_a: list[int], ids_b: list[int]):
    """(ids of A, ids of B, sizes of groups in both), None if there is nothing to align."""
    if not text or a.joined(ids_a) != (own := b" " + text.encode()) or b.joined(ids_b) != own:
        return None
    x, y = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    return x, y, *group_sizes(labels(a.lengths[x], b.lengths[y]))


_NAMES = ("n_a", "n_b", "n_groups")
_GROUP = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))


def _encode(path_a: str, path_b: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, a), (encode_b, b) = byte_side(path_a), piece_side(path_b)
        for batch in batches:
            counts, hashes, pairs, times, groups = [], [], [], [], []
            for text in batch["text"].to_pylist():
                own = align(a, b, text, encode_a([text])[0], encode_b([text])[0]) if text else None
                if own is None:
                    counts.append((0, 0, 0)), hashes.append(""), pairs.append(_NO_GROUPS), times.append(_NO_GROUPS), groups.append([])
                    continue
                x, y, p, q = own
                upto_a, upto_b = np.cumsum(p), np.cumsum(q)
                linked, n = np.unique(x[upto_a - 1] << 32 | y[upto_b - 1], return_counts=True)
                counts.append((len(x), len(y), len(p))), hashes.append(hashlib.sha256(written(a, b, x, y, p, q).encode()).hexdigest()), pairs.append(linked), times.append(n)
                if with_groups:
                    groups.append([{"a": s, "b": t} for s, t in zip(np.split(x, upto_a[:-1]), np.split(y, upto_b[:-1]), strict=True)])
            columns = [batch["id"], *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(hashes, pa.string()), *(pa.array(v, pa.list_(pa.int64())) for v in (pairs, times))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(groups, _GROUP)] if with_groups else []), ["id", *_NAMES, "groups_sha256", "pairs", "times", *(["groups"] if with_groups else [])])

    return run


def align_documents(docs: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, n_a, n_b, n_groups, groups_sha256, the linked pairs (A's id shifted by 32, with B's) and how often each is linked
    in the row; if asked for, the groups themselves as arrays of ids."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups array<struct<a: array<int>, b: array<int>>>" * with_groups
    work = _encode(byte_tokenizer or vocabulary(), piece_tokenizer or vocabulary("piece_bpe_32k.model"), with_groups)
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def _linked(aligned: DataFrame, *columns: str) -> DataFrame:
    return aligned.select(*columns, F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select(*columns, F.col("_l.pairs").alias("pair"), F.col("_l.times").alias("times"))


def link_counts(aligned: DataFrame, scratch: Scratch) -> DataFrame:
    """(pair, links, best): corpus-wide links of each pair, and whether no pair of its B id has more."""
    counts = scratch.save(_linked(aligned).groupBy("pair").agg(F.sum("times").alias("links")), "counts").withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    highest = counts.groupBy("b").agg(F.max("links").alias("highest"))
    return scratch.save(counts.join(F.broadcast(highest), "b").select("pair", "links", (F.col("links") == F.col("highest")).alias("best")), "links")


def link_scores(docs: DataFrame, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", **tokenizers: str) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    scratch = Scratch(docs.sparkSession, "alignment")
    aligned = align_documents(docs, id_col=id_col, text_col=text_col, **tokenizers).withColumn("row", F.monotonically_increasing_id())
    aligned = scratch.save(aligned, "aligned")
    links = link_counts(aligned, scratch)
    common = scratch.save(links.orderBy(F.desc("links"), "pair").limit(hot), "common")
    own = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    each = _linked(aligned, "row")
    near = each.join(F.broadcast(common), "pair").groupBy("row").agg(*own)
    far = each.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(links.join(F.broadcast(common.select("pair")), "pair", "left_anti"), "pair").groupBy("row").agg(*own)
    sums = near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(id_col, *_NAMES, F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
