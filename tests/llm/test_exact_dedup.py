"""Exact deduplication against SQL, and the perfect hash against a dict."""

import hashlib
import random

import numpy as np
import pytest
from oracle import same

from lacuna.llm import exact_dedup as E
from lacuna.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark):
    r = random.Random(7)
    bodies = ["".join(r.choices("abé ", k=r.randrange(30))) for _ in range(60)]
    rows = [(i, r.choice(bodies).replace(" ", r.choice([" ", "  ", "\n", "\x0b "])), "en", "s", 1) for i in range(300)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, " \r", None, None, None), (903, "x y", None, None, None), (904, "xy", None, None, None), (905, "z" * 300_000, None, None, None), (906, "z " * 300_000, None, None, None)]
    return spark.createDataFrame(rows + rows[:5], SCHEMA)


def test_against_sql(spark, tmp_path):
    same(spark, queries.op3_exact_dedup, E.ORACLE, {"documents": frame(spark)}, tmp_path)


def test_null_ids_and_small_shards(spark):
    rows = [(None, "a b"), (None, "ab"), (5, "ab"), (4, "a b"), (None, "only"), (7, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = E.exact_duplicates(*E.by_arrival(docs), shard=1).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == sorted([("None", "4", 4, False)] * 2 + [("5", "4", 4, False), ("4", "4", 4, True), ("None", "None", 1, True), ("7", "7", 1, True)])


def test_history_marks_repeats_only(spark):
    new = spark.createDataFrame([(1, "seen"), (2, "fresh"), (3, "fre sh")], "doc_id long, text string")
    old = spark.createDataFrame([(9, "se en"), (8, "gone")], "doc_id long, text string")
    got = {r.doc_id: (r.known, r.keep_id, r.group_size, r.kept) for r in E.exact_duplicates(new, old).collect()}
    assert got == {1: (True, 9, 2, False), 9: (True, 9, 2, True), 2: (False, 3, 2, False), 3: (False, 3, 2, True), 8: (True, 8, 1, True)}
    assert not E.exact_duplicates(new).where("known").count()


def test_keep_first(spark):
    docs = frame(spark)
    out = E.keep_first(docs)
    assert out.columns == docs.columns
    want = sorted(str(r.doc_id) for r in E.exact_duplicates(docs).where("kept").collect())
    assert sorted(str(r.doc_id) for r in out.collect()) == want


def test_empty_tables_and_other_columns(spark):
    assert E.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a", "x", True, b"q", 4)], "doc_id long, text string, digest string, kept boolean, _doc binary, id int")
    assert E.digest(E.exact_duplicates(odd)).collect()[0].text_sha256 == hashlib.sha256(b"a").hexdigest()
    assert E.keep_first(odd).columns == odd.columns


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    r = random.Random(n)
    keys = [r.randbytes(32) for _ in range(n)]
    mph = E.PerfectHash.load(E.PerfectHash(E._as_rows(keys)).dump())
    assert sorted(mph.slots(E._as_rows(keys)).tolist()) == list(range(n))
    other = mph.slots(E._as_rows([r.randbytes(32) for _ in range(50)]))
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_perfect_hash_lists_what_levels_leave(monkeypatch):
    monkeypatch.setattr(E, "_LEVELS", 1)
    keys = [random.Random(i).randbytes(32) for i in range(200)]
    mph = E.PerfectHash.load(E.PerfectHash(E._as_rows(keys)).dump())
    assert sorted(mph.slots(E._as_rows(keys)).tolist()) == list(range(200))
    assert (mph.slots(np.zeros((1, 32), np.uint8)) >= -1).all()
