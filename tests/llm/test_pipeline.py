"""The pipeline's stages against brute force on the smallest documents."""

from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline as P
from lacuna.llm import packing, quality

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{ROOT}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in P.STAGES:
        stage(spark, docs, ROOT).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == COLUMNS
        out[name] = docs.collect()
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality(stages):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{ROOT}/documents.parquet'")
    want = con.sql(quality.oracle()).fetchall()
    assert ids(stages["quality_rules"]) == sorted(r[0] for r in want if r[-1])
    bad = {d for d, q in con.sql(f"SELECT doc_id, quality FROM '{ROOT}/labels.parquet'").fetchall() if q == 0}
    assert not bad & set(ids(stages["quality_rules"]))


def test_exact(stages):
    best = {}
    for r in stages["quality_rules"]:
        key = b"".join(r.text.encode().split())
        best[key] = min(best.get(key, (0, 0)), (-len(r.text), r.doc_id)) if key in best else (-len(r.text), r.doc_id)
    assert ids(stages["exact_dedup"]) == sorted(i for _, i in best.values())


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near(stages):
    own = {r.doc_id: shingles(r.text) for r in stages["exact_dedup"]}
    kept = set(ids(stages["near_dedup"]))
    like = {(a, b): len(x & y) / len(x | y) for a, x in own.items() for b, y in own.items() if a < b and x & y}
    group = {d: d for d in own}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for (a, b), j in like.items():
        if j >= 0.8 - 1e-12:
            group[max(find(a), find(b))] = min(find(a), find(b))
    assert kept == {find(d) for d in own} and len(kept) < len(own)


def test_mix(stages):
    size = lambda r: len(r.text.encode().split())
    before, after, whole = defaultdict(int), defaultdict(int), {}
    for r in stages["near_dedup"]:
        before[r.source] += size(r)
        whole[r.doc_id] = r.text
    for r in stages["mixing"]:
        after[r.source] += size(r)
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    # the level to which targets rise, by trying each number of capped sources
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(before))}
    ratio = sorted(before, key=lambda s: 3 * before[s] / weight[s])
    for k in range(len(ratio) + 1):
        level = (sum(before.values()) - sum(3 * before[s] for s in ratio[:k])) / max(1, sum(weight[s] for s in ratio[k:]))
        if k == len(ratio) or 3 * before[ratio[k]] >= level * weight[ratio[k]]:
            break
    target = {s: min(3.0 * before[s], level * weight[s]) for s in before}
    assert dict(after) == {s: int(t) for s, t in target.items() if int(t)}


def test_pack(stages):
    plain = packing.file_encoder(packing.vocabulary())
    rows = stages["mixing"]
    total = sum(len(plain(r.text)) + 1 for r in rows)
    assert sum(p.length for p in stages["packing"]) == total
    fill = defaultdict(list)
    for p in stages["packing"]:
        fill[p.sequence_id].append((p.offset, p.length))
    for x in fill.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 2048 and not at & (at - 1)


def test_run_gives_the_last_stage(spark, stages):
    assert P.run(spark, ROOT).count() == len(stages["packing"])


def odd_rows():
    long = " ".join(f"w{k}" for k in range(30_000))
    plain = " ".join(f"word{k % 97}x{k}" for k in range(120))
    rows = [(k, " ".join(f"t{k}w{j}" for j in range(80)), "en", ("a", "b", None)[k % 3], 5, "z") for k in range(40)]
    rows += [(100, None, "en", "a", None, None), (None, None, None, None, None, None), (101, "", None, "b", 0, "q"), (102, long, "de", "c", 9, "x"), (None, plain, "en", "a", 1, "k")]
    return rows + [(103, plain, "en", "a", 1, "k"), (103, plain, "en", "a", 1, "k"), (103, plain + " more", "en", "b", 1, "k"), (104, "x" * 200_000, "en", "a", 1, "k")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_each_stage_takes_odd_rows(spark, name, stage):
    """Nulls, empty and long texts, ties, repeated rows and a column that is named like an inner one."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    out = stage(spark, docs, ROOT)
    rows = out.collect()
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == len(odd_rows())
        return
    assert out.columns == docs.columns and 40 <= len(rows)
    kept = [r for r in rows if r.doc_id == 102]
    assert kept and all(r._row == "x" for r in kept)
    texts = [r.text for r in rows]
    if name == "quality_rules":
        assert None not in texts and "" not in texts
    elif name == "exact_dedup":
        assert sum(not t for t in texts) == 1 and sum((t or "").startswith("word0x0 ") for t in texts) == 2
    elif name == "near_dedup":
        assert sum(not t for t in texts) == 1 and sum((t or "").startswith("word0x0 ") for t in texts) == 1
    else:
        assert all(texts) and all(r.n_chars == len(r.text) for r in rows)
    empty = stage(spark, docs.where("false"), ROOT)
    assert empty.columns == docs.columns and empty.count() == 0


def test_two_pipelines_do_not_disturb_each_other(spark):
    """A stage that is built before another's result is read keeps its tables."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    first = P.near(spark, docs, ROOT)
    P.exact(spark, docs, ROOT).count()
    mixed = P.mix(spark, first, ROOT)  # of a result that isn't written
    assert mixed.count() > 0 and first.count() > 0
