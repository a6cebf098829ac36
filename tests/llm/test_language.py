"""Language ID: held-out accuracy, calibration and odd inputs."""

import random
import zlib

import pytest

from lacuna.llm import language as L

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": "ba da ka lo mi", "bb": "tre vin cho sil eux", "cc": "éa öß ün ig sch", "dd": "日本 語の 文字 です ます"}


def text(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang].split(), k=r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    return [(i, text(r, lang := r.choice(list(SYLLABLES)), r.randrange(3, 80)), lang) for i in range(800)]


def test_held_out_accuracy_and_repeatability(spark, rows):
    odd = [(5000, None, None), (5001, "", "aa"), (5002, "123 !?_", "aa"), (5003, "ba da", None), (None, "tre vin", "bb"), (5004, "ba " * 400_000, None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    got = L.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    lang = {i: x for i, _, x in rows}
    held = [g for g in got if g.doc_id in lang and g.held_out]
    assert len(held) > 100 and sum(g.lang_pred == lang[g.doc_id] for g in held) >= 0.98 * len(held)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got if g.doc_id is not None)
    assert all(0 <= g.score <= 1 and g.lang_pred in {*SYLLABLES, "und"} for g in got)
    by = {g.doc_id: g for g in got}
    assert [by[i].lang_pred for i in (5000, 5001, 5002, 5003, 5004, None)] == ["und", "und", "und", "aa", "aa", "bb"]
    assert sorted(map(str, got)) == sorted(map(str, L.identify(docs.repartition(7)).collect()))


def test_calibration_rejects_noise(rows):
    r = random.Random(2)
    model = L.train([(t, lang) for _, t, lang in rows])
    own = [model.predict(text(r, "aa", 30))[1] >= model.reject for _ in range(100)]
    noise = [model.predict("".join(r.choices("qwxzjy ", k=60)))[1] >= model.reject for _ in range(100)]
    assert sum(own) >= 90 and sum(noise) <= 60


def test_held_out_rows_teach_nothing(spark, rows):
    out = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    assert "zz" not in L.fit(spark.createDataFrame(out, SCHEMA)).languages


def test_parts_and_nothing_to_learn(spark, rows, monkeypatch):
    model = L.train([(t, lang) for _, t, lang in rows[:200]])
    whole = model.predict(rows[0][1] * 3)
    monkeypatch.setattr(L, "_PART", 50)
    assert model.predict(rows[0][1] * 3)[0] == whole[0]
    assert L.identify(spark.createDataFrame([(1, "abc", None)], SCHEMA)).collect()[0].lang_pred == "und"
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "abc", "x", 4)], SCHEMA + ", score int")
    assert L.identify(odd).columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]


def plain_features(text):
    """Buckets by their definition, one n-gram after another, with whole numbers of Python."""
    data = b" " + text.lower().encode() + b"  "
    word = 0xFFFFFFFF
    out = []
    for k in range(len(data) - 2):
        three = data[k] | data[k + 1] << 8 | data[k + 2] << 16
        out.append((three * 2654435761 & word) >> 32 - L.BITS)
    for k in range(len(data) - 3):
        four = data[k] | data[k + 1] << 8 | data[k + 2] << 16 | data[k + 3] << 24
        out.append(((four ^ four >> 15) * 0x85EBCA6B & word) >> 32 - L.BITS)
    return out


def test_features_and_logits_against_plain_arithmetic(rows):
    r = random.Random(3)
    model = L.train([(t, lang) for _, t, lang in rows[:120]])
    for t in ["a", "ÀÉ ß", "日本", " \n\t", rows[5][1], "".join(r.choices("aé日 Z", k=300))]:
        want = plain_features(t)
        assert sorted(L.features(t).tolist()) == sorted(want)
        logits = [sum(float(model.table[b][k]) for b in want) / len(want) + float(model.bias[k]) for k in range(len(model.languages))]
        assert model.logits(t).tolist() == pytest.approx(logits, rel=1e-6, abs=1e-6)


def test_a_repeated_row_is_one_row_of_the_sample(spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda own: seen.append(own))
    same = (rows[0][0], rows[0][1], rows[0][2])
    assert zlib.crc32(str(same[0]).encode()) % 4 != 2
    L.fit(spark.createDataFrame([same] * 5000 + rows[1:100], SCHEMA), sample=10_000)
    assert seen[0].count((same[1], same[2])) == 1 and len(seen[0]) == len(set(seen[0])) > 50
    L.fit(spark.createDataFrame(rows, SCHEMA), sample=40)
    assert len(seen[1]) <= 80


def test_accuracy_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in L.identify(docs).collect() if r.held_out and r.lang_pred != "und" and lang[r.doc_id]]
    assert len(held) > 150 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
