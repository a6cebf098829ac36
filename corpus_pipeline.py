"""Corpus preparation in five stages; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import exact_dedup, mixing, packing, quality, simhash
from lacuna.llm.common import Scratch, release, scratch_made


class _Made(threading.local):
    """Tables that this thread's stages made on their way, by the stage's place."""

    def __init__(self):
        self.by_stage: dict[int, list[Scratch]] = {}


_made = _Made()


def stage(place: int) -> Callable:
    """A stage; when it begins, the tables of the stage just before it go, whose result is written by then.

    Only those of the stage before it: another order of stages finds its tables. And only if the documents aren't read from them: a
    stage that is given the unwritten result of the one before leaves them alone.
    """

    def wrap(work: Callable) -> Callable:
        @wraps(work)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before = _made.by_stage.get(place - 1, [])
            if before and not any(s.root.rpartition("/")[2] in f for f in docs.inputFiles() for s in before):
                release(before)
            with scratch_made(_made.by_stage.setdefault(place, [])):
                return work(spark, docs, sf_dir)

        return run_stage

    return wrap


@stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. NULL and empty texts have no words and are rejected; rows that are alike, or share an
    id, are judged each for itself; columns beyond those of ``documents``, whatever their names, stay; an empty table stays empty."""
    return quality.keep_good(docs)


@stage(1)
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the longest, of equals the least id; of rows alike in both any one. NULL is
    an empty text; further columns stay; an empty table stays empty."""
    return exact_dedup.keep_first(docs)


@stage(2)
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least id, a NULL id last: five-word shingles, similarity 0.8 or
    more. Texts without words, NULL included, are copies of one another; further columns stay; an empty table stays empty."""
    return simhash.keep_one(docs)


@stage(3)
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, the last of a source in part, with ``n_chars`` anew. A NULL source is a
    source; texts without words, NULL included, are never taken; rows that are alike are taken as one order of them says, the
    same at each run; further columns stay; an empty table stays empty."""
    return mixing.take(docs)


@stage(4)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the mix's tokens; one row per piece. NULL and empty texts are an end id; rows that repeat an id, as the mix makes
    them, are documents of their own; other columns are not read; an empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
#: Fingerprints of XXH64 and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's result is a table; when it is written, the result of the stage before it goes."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, work) in enumerate(STAGES):
        docs = scratch.save(work(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
