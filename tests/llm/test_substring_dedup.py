"""Exact substring deduplication against brute force over all positions."""

import hashlib
import random
from collections import Counter

import pytest

from lacuna.llm.substring_dedup import deduplicate_substrings, digest

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    """Expected (doc_id, n_bytes, n_removed, n_spans, sha) per row."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s : s + length] for _, d in data for s in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for p in range(len(d)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, length, q=None):
    out = digest(deduplicate_substrings(spark.createDataFrame(rows, SCHEMA), length, q))
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, length)


def words(r, n):
    return " ".join(r.choice(["ab", "é", "abc", "zz", "日本", "q"]) for _ in range(n))


@pytest.mark.parametrize("length,q", [(40, None), (40, 1), (40, 40), (60, 7)])
def test_random_overlaps(spark, length, q):
    r = random.Random(length + (q or 0))
    passages = [words(r, 40) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [words(r, r.randrange(1, 12)) for _ in range(3)]
        for p in r.sample(passages, r.randrange(3)):
            cut = r.randrange(len(p) // 2)
            parts.insert(r.randrange(len(parts)), p[cut : cut + r.randrange(10, 90)])
        rows.append((i, " ".join(parts)))
    check(spark, rows, length, q)


def test_full_length_edges(spark):
    r = random.Random(5)
    base = "".join(r.choices("abcdefgh ", k=3000))
    rows = [(0, base), (1, "x" + base[100:499] + "y"), (2, "x" + base[1000:1400] + "y"), (3, base[2000:]), (4, base[:401])]
    rows += [(10 + k, base[k * 37 : k * 37 + 390 + k]) for k in range(30)]
    check(spark, rows, 400)


def test_periods_ties_nulls_and_repeated_rows(spark):
    rows = [(1, "a" * 300), (2, None), (3, ""), (4, "ab" * 100), (5, "short"), (6, "x" * 50 + "a" * 39 + "y"), (7, "same " * 3 + "end"), (7, "same " * 3 + "end"), (None, "é" * 45), (None, "other"), (8, "".join(map(chr, range(300, 400))))]
    check(spark, rows, 40)


def test_repeated_row_goes_whole(spark):
    text = "".join(random.Random(1).choices("abcdef", k=100))
    check(spark, [(1, text), (1, text), (2, text[:39])], 40)


def test_very_long_text(spark):
    r = random.Random(2)
    long = "".join(r.choices("abcdefghij", k=2_300_000))
    rows = [(1, long), (2, long[1_048_000:1_049_500]), (3, "k" * 500)]
    got = {r[0]: r[2] for r in digest(deduplicate_substrings(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: 1500, 2: 1500, 3: 500}


def test_empty_table_and_other_columns(spark):
    assert deduplicate_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "abc", "z", 2)], "doc_id long, text string, spans string, id int")
    assert deduplicate_substrings(odd).columns == ["doc_id", "n_bytes", "spans", "kept"]
