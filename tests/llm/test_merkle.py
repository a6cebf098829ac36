"""The manifest against a plain recursive tree and against SQL."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from lacuna.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, at int, place string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The top of a list of nodes and each node's siblings (before, after), level by level."""
    paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, merged = [], []
        for k in range(0, len(nodes), 8):
            run = nodes[k : k + 8]
            for j in range(len(run)):
                for i in groups[k + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            up.append(h(*run))
            merged.append([i for g in groups[k : k + 8] for i in g])
        nodes, groups = up, merged
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    none_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    tops, inner = {}, {}
    for lang in sorted({r[2] for r in rows}, key=none_first):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (none_first(r[0]), leaf(r)))
        inner[lang] = own
        tops[lang] = climb([leaf(r) for r in own])
    root, above = climb([t for t, _ in tops.values()]) if tops else ("", [])
    out = []
    for (lang, own), path in zip(inner.items(), above, strict=True):
        for r, p in zip(own, tops[lang][1], strict=True):
            steps = p + path
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if hit and r[4] is not None else r[4]
            now = leaf((*r[:4], text))
            for before, after in steps:
                now = h(*before, now, *after)
            out.append((r[0], leaf(r), tops[lang][0], root, h(*(x for before, after in steps for x in before + after)), now, now == root))
    return sorted(out, key=repr)


def given(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)


def check(spark, rows):
    docs = given(spark, rows)
    got = merkle.manifest(docs, merkle.tampered(docs)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    return got


def test_levels_blocks_nulls_and_lone_leaves(spark):
    r = random.Random(1)
    text = lambda k: r.choice([None, "", f"Äé {k} QZ日本", "plain", "A" * 3000])
    sizes = {"hot": merkle.BLOCK + 1, None: 65, "": 8, "é": 9, "lone": 1, "z": 64, "zz": 2}
    rows = [(k * 7 + j, r.choice([None, "s", "ß"]), lang, r.choice([None, 0, k]), text(k)) for j, (lang, n) in enumerate(sizes.items()) for k in range(n)]
    got = check(spark, rows)
    assert {x.verified for x in got} == {True, False}


def test_many_groups_ties_and_repeated_rows(spark):
    rows = [(k % 5, "s", f"l{k % 70:03}", 1, "Same") for k in range(140)]
    rows += [(3, "s", "l000", 1, "other"), (None, "s", "l000", None, "Q"), (None, "s", "l000", None, "q")] + [(3, "s", "l000", 1, "twice")] * 20
    check(spark, rows)


def test_empty_table_and_one_row(spark):
    assert check(spark, []) == []
    check(spark, [(1, None, None, None, None)])


def test_proof_folds_to_the_root(spark):
    rows = [(k, "s", "l", 1, f"t{k}") for k in range(80)] + [(k, "s", "m", 1, "x") for k in range(3)]
    for r in merkle.manifest(given(spark, rows), with_proof=True).collect():
        now = r.leaf
        for step in r.proof:
            now = h(step.before, now, step.after)
        assert now == r.root == r.folded_root and r.verified
        assert h(*(s.before + s.after for s in r.proof)) == r.proof_sha256
        assert [len(s.before + s.after) // 64 for s in r.proof][-1] == 1


def test_a_change_of_any_field_shows(spark):
    docs = given(spark, [(k, "s", "l", k, "t") for k in range(20)])
    for field, value in (("source", F.lit("S")), ("n_chars", F.lit(None).cast("long")), ("text", F.lit(None).cast("string"))):
        assert not any(r.verified for r in merkle.manifest(docs, {field: value}).collect())


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512])
def test_matrices_equal_plain_lists(n):
    nodes = [h(str(k)) for k in range(n)]
    top, paths = climb(nodes)
    tree = merkle.climb(merkle.matrix(nodes), merkle.levels_within(n))
    assert merkle._texts(tree[-1]) == [top]
    assert merkle._path(tree, n) == [[{"before": "".join(b), "after": "".join(a)} for b, a in p] for p in paths]
    at, current = np.arange(n), merkle.matrix(nodes)
    for level in tree[:-1]:
        current, at = merkle.fold(level, at, current), at // 8
    assert Counter(merkle._texts(current)) == {top: n}


def test_same_as_sql(spark, tmp_path):
    rows = [(k // 2, "s" if k % 3 else None, [None, "a", "é", "b"][k % 7 % 4], k, f"Text {k}") for k in range(300)] + [(None, None, None, None, None)]
    same(spark, queries.op12_merkle_manifest, merkle.oracle(), {"documents": given(spark, rows)}, tmp_path)
