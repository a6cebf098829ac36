"""Packing: an exact round trip of ids, full sequences, balance."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lacuna.llm import packing as P

SCHEMA = "doc_id long, text string"


def check(pieces, ids, size):
    """pieces: (doc, start, length, crc, tokens, sequence, offset); ids: doc -> ids."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, start, n, crc, total, seq, off in pieces:
        assert n > 0 and total == len(ids[d]) and crc == zlib.crc32(np.array(ids[d][start : start + n], "<u4").tobytes())
        by_doc[d].append((start, n))
        by_seq[seq].append((off, n))
    for d, x in ids.items():
        at = 0
        for start, n in sorted(by_doc[d]):
            assert start == at
            at += n
        assert at == len(x)
    for x in by_seq.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= size and at & (at - 1) == 0  # whole, or a power of two: no padding
    return by_seq


@pytest.mark.parametrize("block", [P.BLOCK, 500])
def test_round_trip(spark, block):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abc déñ日 <|endoftext|>'s 12\n", k=r.randrange(1, 9)))
    rows = [(i, " ".join(word() for _ in range(r.choice([0, 1, 5, 50, 400])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "  \n\n \t x"), (103, "x" * 60_000), (104, "<|endoftext|>")]
    plain = P.file_encoder(P.vocabulary())
    out = P.pack_documents(spark.createDataFrame(rows, SCHEMA), size=256, block=block)
    pieces = [tuple(p) for p in out.collect()]
    check(pieces, {d: plain(t or "") + [1] for d, t in rows}, 256)
    assert sorted(pieces) == sorted(tuple(p) for p in out.collect())


def test_ids_are_those_of_the_file():
    r = random.Random(2)
    path = P.vocabulary()
    texts = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 900), r.randrange(0x4E00, 0x4F00), 10, 32, 0x1F600])) for _ in range(300)) for _ in range(60)]
    end = "<|endoftext|>"
    texts += [end, f"a {end} b", f"{end}{end}", f"  {end}\n", "<|endoftext", f"x{end}y <| endoftext|>"]
    for plain, fast in ((P.file_encoder(path), P.encoder(path)), (P.file_encoder(path, plain=True), P.plain_text_encoder(path))):
        assert [plain(t) for t in texts] == [list(fast(t)) for t in texts]
    assert P.encoder(path)(end) == [50256] and len(P.plain_text_encoder(path)(end)) > 1


def test_balance_and_few_cuts():
    r = random.Random(3)
    lengths = [r.randrange(1, 5000) for _ in range(3000)]
    pieces = P.pack(lengths)
    cost = defaultdict(float)
    for _, _, n, seq, _ in pieces:
        cost[seq] += P.LINEAR * n + P.QUADRATIC * n * n
    assert len({p[3] for p in pieces}) <= sum(lengths) // 2048 + 12
    assert len(pieces) < 1.3 * sum(n // 2048 + bool(n % 2048) for n in lengths)


def test_cheapest_sequence_with_room_is_found_among_many():
    r = random.Random(5)
    lengths = [max(1, int(r.lognormvariate(5.5, 1.2))) for _ in range(3000)]
    size = 512
    rests = sorted(((n % size, d) for d, n in enumerate(lengths) if n % size), key=lambda x: (-x[0], x[1]))
    used, bins = sum(n // size for n in lengths), sum(n for n, _ in rests) // size
    assert bins > 500
    cost, fill, want, cut = [0.0] * bins, [0] * bins, {}, set()
    for n, d in rests:
        b = min((b for b in range(bins) if fill[b] + n <= size), key=lambda b: (cost[b], b), default=None)
        if b is None:
            cut.add(d)
            continue
        want[d] = (used + b, fill[b])
        cost[b] += P.LINEAR * n + P.QUADRATIC * n * n
        fill[b] += n
    got = {d: (seq, off) for d, start, n, seq, off in P.pack(lengths, size) if n < size and start == lengths[d] // size * size and d not in cut}
    assert got == want


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 2047], [7] * 1000, [4096, 1, 1], [1500] * 40])
def test_small_inputs(lengths):
    out = P.pack(lengths)
    assert sum(n for _, _, n, *_ in out) == sum(lengths)
    fill = defaultdict(int)
    for _, _, n, seq, off in out:
        assert off == fill[seq]
        fill[seq] += n
    assert all(n <= 2048 and not n & (n - 1) for n in fill.values())


def test_ids_empty_repeated_and_other_columns(spark):
    assert P.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "abc", 5), (1, "abc", 5), (None, "q", 6)], "doc_id long, text string, offset int")
    out = P.pack_documents(odd, with_ids=True).collect()
    assert sum(len(p.ids) for p in out) == sum(p.length for p in out) and out[0].ids
    with pytest.raises(ValueError):
        P.pack_documents(odd, size=1000)
