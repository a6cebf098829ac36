"""Cost-balanced packing of tokenised documents into sequences.

A document is its token ids and an end id. Attention over a piece of n tokens costs about
``linear * n + quadratic * n * n``. Ids are packed in runs of up to ``block`` of them, document by
document, within the task that made them, so nothing is shuffled and memory is bounded by a run:

* a document's whole sequences of ``size`` ids come first and each fill a sequence;
* the rest of each document, in descending length, goes to the sequence of the lowest cost so far
  among those with room for all of it;
* what fits nowhere whole is cut over the sequences with the most room;
* the ids of the last, partly filled sequence are dealt to sequences of powers of two, which need no
  padding, so a run leaves none.

The order of rows within a partition decides the packing, so the same files and splits give the same
sequences, and a recomputed task gives what the lost one gave. Null text is an empty document: its end
id alone. Rows that repeat an id are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..deploy import ship

SIZE, END = 2048, 1
#: Attention cost of a piece: linear and quadratic weight of its tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Ids that are packed together.
BLOCK = 1 << 22
#: No sequence: it costs more than any.
_NONE = (float("inf"), -1)
_L = pa.int64()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str):
    """text -> ids, as the tokenizers library's file says: strings of its special tokens are those tokens.

    Where the same vocabulary lies beside it as ranks, tiktoken makes the same ids several times as fast.
    """
    if not (ranked := _ranks(path)):
        return file_encoder(path)
    added = json.loads(Path(path).read_text())["added_tokens"]
    own, special = ranked({t["content"]: t["id"] for t in added}), [t["content"] for t in added]
    return lambda text: own.encode(text, allowed_special="all") if any(s in text for s in special) else own.encode_ordinary(text)


@cache
def plain_text_encoder(path: str):
    """text -> ids, where strings of special tokens are plain text."""
    return ranked({}).encode_ordinary if (ranked := _ranks(path)) else file_encoder(path, plain=True)


def _ranks(path: str):
    """special tokens -> the encoding of the ranks that lie beside a file; None where there are none."""
    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return None
    import public_tokenizers
    import tiktoken

    pairs = (line.split() for line in ranks.read_bytes().splitlines() if line)
    own = {base64.b64decode(a): int(b) for a, b in pairs}
    return lambda special: tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens=special)


def file_encoder(path: str, plain: bool = False):
    """text -> ids by the library itself; ``plain``: strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = plain
    return lambda text: own.encode(text, add_special_tokens=False).ids


def pack(lengths: list[int], size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences are numbered from 0."""
    out, rests, used = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - size + 1, size):
            out.append((d, start, size, used, 0))
            used += 1
        if n % size:
            rests.append((n % size, d))
    rests.sort(key=lambda x: (-x[0], x[1]))
    total = sum(n for n, _ in rests)
    bins = total // size
    fill = [0] * bins
    by_room = [[] for _ in range(size)]  # of each room from 1 on the sequences that have it, a heap of (cost, sequence)
    least = [_NONE] * (2 * size)  # a tree over the rooms: the least (cost, sequence) below each node
    over: list[tuple[int, int, int]] = []  # (document, start, length)

    def put(b: int, d: int, start: int, n: int) -> None:
        out.append((d, start, n, used + b, fill[b]))
        fill[b] += n

    def renew(k: int) -> None:
        """The tree above room ``k``, whose heap has changed."""
        i = size + k - 1
        least[i] = by_room[k - 1][0] if by_room[k - 1] else _NONE
        while i > 1:
            i >>= 1
            least[i] = min(least[2 * i], least[2 * i + 1])

    if bins:
        by_room[-1] = [(0.0, b) for b in range(bins)]
        renew(size)
    for n, d in rests:
        i = size + n - 1
        best = least[i]
        while i > 1:  # rooms of n or more: the leaf and all right siblings on its way up
            if not i & 1:
                best = min(best, least[i + 1])
            i >>= 1
        cost, b = best
        if b < 0:
            over.append((d, lengths[d] - n, n))
            continue
        free = size - fill[b]
        heapq.heappop(by_room[free - 1])
        renew(free)
        put(b, d, lengths[d] - n, n)
        if free > n:
            heapq.heappush(by_room[free - n - 1], (cost + linear * n + quadratic * n * n, b))
            renew(free - n)
    room = [(fill[b] - size, b) for b in range(bins) if fill[b] < size]
    heapq.heapify(room)
    left: list[tuple[int, int, int]] = []
    for d, start, n in over:
        while n and room:
            free, b = heapq.heappop(room)
            take = min(n, -free)
            put(b, d, start, take)
            start, n = start + take, n - take
            if fill[b] < size:
                heapq.heappush(room, (fill[b] - size, b))
        if n:
            left.append((d, start, n))
    used += bins
    rest = sum(n for *_, n in left)
    power = size
    at = 0
    while rest:
        while power > rest:
            power //= 2
        at = 0
        while at < power:
            d, start, n = left.pop(0)
            take = min(n, power - at)
            out.append((d, start, take, used, at))
            if take < n:
                left.insert(0, (d, start + take, n - take))
            at += take
        used, rest = used + 1, rest - power
    return out


def _pack(path: str, size: int, end: int, block: int, linear: float, quadratic: float, with_ids: bool):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(path), TaskContext.get().partitionId() << 36
        ids, owners, held = [], [], 0

        def done(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal first, held
            pieces = pack([len(x) for x in ids], size, linear, quadratic)
            own = [ids[d][s : s + n] for d, s, n, *_ in pieces]
            columns = [
                pa.array([owners[d] for d, *_ in pieces], kind),
                *(pa.array([p[k] for p in pieces], _L) for k in (1, 2)),
                pa.array([zlib.crc32(x.tobytes()) for x in own], _L),
                pa.array([len(ids[p[0]]) for p in pieces], _L),
                pa.array([first + p[3] for p in pieces], _L),
                pa.array([p[4] for p in pieces], _L),
                *([pa.array(own, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))] if with_ids else []),
            ]
            first += 1 + max((p[3] for p in pieces), default=-1)
            ids.clear(), owners.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names)

        kind = None
        for b in batches:
            kind = b["id"].type
            for id_, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                own = encode(text) if text else []
                own.append(end)
                ids.append(np.array(own, dtype="<u4"))
                owners.append(id_)
                held += len(own)
                if held >= block:
                    yield done(kind)
        if ids:
            yield done(kind)

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False, block: int = BLOCK, linear: float = LINEAR, quadratic: float = QUADRATIC, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return own.mapInArrow(_pack(tokenizer or vocabulary(), size, end, block, linear, quadratic, with_ids), schema).withColumnRenamed("id", id_col)
