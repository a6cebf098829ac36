"""Quality rules: counts and verdicts against SQL, EM on known voters."""

import random

import pytest
from oracle import same

from lacuna.llm import quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(r, kind):
    word = lambda: r.choice(["the", "of", "is"]) if r.random() < 0.3 else "".join(r.choice(["ba", "re", "ti", "on", "us"]) for _ in range(r.randrange(2, 4)))
    w = [word() + r.choice([".", "", "", ","]) for _ in range(r.randrange(60, 200))]
    if kind == "symbols":
        w = [x + "###" for x in w]
    if kind == "capitals":
        w = [x.upper() + "!!" for x in w]
    if kind == "repeat":
        w = w[:10] * 9
    if kind == "lines":
        return "\n".join([" ".join(w[:9])] * 40 + [" ".join(r.sample(w, 20)) for _ in range(9)])
    return " ".join(w)


def frame(spark):
    r = random.Random(1)
    kinds = ["clean"] * 6 + ["symbols", "capitals", "repeat", "lines"]
    rows = [(i, text(r, kinds[i % 10]), "en", "s", 1) for i in range(120)]
    odd = [None, "", " \t\n\x0b\x0c\r ", "a b", "a b c", "a b c a b c", "x\n\nx\n \nx", "É é x y", "a " * 3000, "w " + "long" * 40_000]
    rows += [(200 + i, t, None, None, None) for i, t in enumerate(odd)] + [(None, "a b c", None, None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


def test_against_sql(spark, tmp_path):
    got = same(spark, queries.op2_quality_rules, quality.oracle(), {"documents": frame(spark)}, tmp_path)
    assert len(got) == 133


def test_verdicts(spark):
    kept = {r.doc_id: r.kept for r in quality.judge(frame(spark)).collect()}
    assert all(kept[i] == (i % 10 < 6) for i in range(120))
    assert not any(kept[200 + i] for i in range(10))


def test_keep_good_returns_columns(spark):
    docs = frame(spark)
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    want = sorted(r.doc_id for r in quality.judge(docs).where("kept").collect())
    assert sorted(r.doc_id for r in out.collect()) == want


def test_empty_and_clashing_columns(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, _f string, n_words int")
    assert quality.digest(quality.judge(odd)).collect()[0].n_words == 2
    assert quality.keep_good(odd).columns == odd.columns


def test_native(spark):
    plan = quality.judge(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_em_finds_the_better_voter():
    r = random.Random(2)
    count = {}
    for _ in range(20_000):
        good = r.random() < 0.8
        votes = tuple((1 if good == (r.random() < acc) else -1) if r.random() < 0.9 else 0 for acc in (0.95, 0.7, 0.9, 0.55))
        count[votes] = count.get(votes, 0) + 1
    prior, odds = quality.estimate(sorted(count.items()))
    assert prior == pytest.approx(1.386, abs=0.3)  # after a fixed number of rounds
    spread = [o[1] - o[-1] for o in odds]
    assert spread[0] > spread[2] > spread[1] > spread[3] > 0
    assert abs(odds[0][0]) < 0.2


def test_em_of_nothing():
    assert quality.estimate([])[0] == 0
