"""Quantiles by narrowed ranges against numpy, and kept layers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import quantiles
from lacuna.sources import layers

SHARES = (0.0, 0.25, 0.5, 0.9, 1.0)


def want(values):
    own = [v for v in values if v is not None]
    return (len(own), *(pytest.approx(np.quantile(own, s), rel=1e-12) for s in SHARES)) if own else (0, *(None for _ in SHARES))


@pytest.mark.parametrize("few", [quantiles.FEW, 3])
def test_groups(spark, few, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 8)
    r = random.Random(few)
    of = {"plain": [r.gauss(0, 1) for _ in range(300)], "ties": [r.choice([1.0, 2.0, 2.0, 7.0]) for _ in range(200)], "wide": [10 ** r.uniform(-12, 12) for _ in range(150)], "one": [5.0], "none": [None, None], None: [float(k) for k in range(40)], "same": [3.0] * 50, "two": [1.0, None, 4.0]}
    rows = [(g, v) for g, own in of.items() for v in own]
    r.shuffle(rows)
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", SHARES, "g", few).collect()
    assert {x.g: tuple(x)[1:] for x in got} == {g: want(own) for g, own in of.items()}


@pytest.mark.parametrize("few", [quantiles.FEW, 2])
def test_whole_table(spark, few):
    r = random.Random(7)
    own = [r.lognormvariate(0, 3) for _ in range(2000)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in own], "v double")
    assert [tuple(x) for x in quantiles.exact_quantiles(df, "v", SHARES, few=few).collect()] == [want(own)]
    assert [tuple(x) for x in quantiles.exact_quantiles(df.where("false"), F.abs("v"), (0.5,)).collect()] == [(0, None)]
    assert [tuple(x) for x in quantiles.exact_quantiles(df.where("v IS NULL"), "v", (0.5,)).collect()] == [(0, None)]


def test_a_kept_layer_is_built_once_and_read_by_the_next(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    calls = []

    def build():
        calls.append(1)
        return source.where("id % 2 = 0")

    root = str(tmp_path / "layers")
    first = layers.kept("even", [source], build, root=root, filter="id % 2 = 0")
    second = layers.kept("even", [source], build, root=root, filter="id % 2 = 0")
    assert first.count() == second.count() == 50 and len(calls) == 1
    assert second.inputFiles() and all("/layers/even-" in f for f in second.inputFiles())
    layers.kept("even", [source], build, root=root, filter="other")
    layers.kept("even", [source], build, root=root, version=2, filter="id % 2 = 0")
    assert len(calls) == 3
    spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
    fresh = spark.read.parquet(str(tmp_path / "in"))
    layers.kept("even", [fresh], build, root=root, filter="id % 2 = 0")
    assert len(calls) == 4 and not [p for p in (tmp_path / "layers").iterdir() if "." in p.name]


def test_a_layer_that_another_writer_finished_is_kept(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "layers")

    def slow():
        layers.kept("x", [source], lambda: source.limit(3), root=root)  # another writer, in between
        return source

    assert layers.kept("x", [source], slow, root=root).count() == 3
    assert len(list((tmp_path / "layers").iterdir())) == 1
