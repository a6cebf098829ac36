"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the
votes estimates, without labels, how often a rule gives each vote on good and on bad documents; the
posterior probability of good then replaces the demand that every rule passes. Documents matter to
the estimate only by their pattern of votes, so it runs on counts of patterns: at most 3^rules rows,
whatever the corpus, and the verdict is a sum of per-rule log odds in the plan.

A base check stands before the rules: fewer than ``MIN_WORDS`` words, or over half the words in
repeated 3-word windows, fail. Null text counts as empty and fails it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MIN_WORDS = 50
#: Frequent function words of English, French, German and Spanish (fixed values, from common stop-word lists).
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "de", "la", "le", "et", "que", "les", "der", "die", "und", "den", "das", "el", "los", "en", "y")
#: Rounds of expectation-maximisation, and the count added to each vote's.
ROUNDS, SMOOTHING = 20, 1.0


@dataclass(frozen=True)
class Rule:
    """Votes bad below ``low`` or above ``high``, good within [``from_``, ``to``], else abstains."""

    name: str
    value: str
    low: float
    from_: float
    to: float
    high: float

    def vote(self) -> str:
        """The vote as an expression that Spark and DuckDB both take."""
        return f"CASE WHEN {self.value} < {self.low}e0 OR {self.value} > {self.high}e0 THEN -1 WHEN {self.value} BETWEEN {self.from_}e0 AND {self.to}e0 THEN 1 ELSE 0 END"


def _share(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) / CAST(greatest({whole}, 1) AS DOUBLE))"


RULES = (
    Rule("symbols", _share("n_symbols", "n_words"), -1, 0, 0.1, 0.3),
    Rule("repeats", _share("n_repeat_words", "n_words"), -1, 0, 0.1, 0.25),
    Rule("lines", _share("n_dup_lines", "n_lines"), -1, 0, 0.1, 0.3),
    Rule("word_length", _share("word_chars", "n_words"), 3, 4, 6.3, 8),
    Rule("capitals", _share("n_capitals", "word_chars"), -1, 0, 0.1, 0.3),
    Rule("stop_words", _share("n_stop", "n_words"), 0.01, 0.05, 0.5, 0.7),
    Rule("closings", _share("n_closings", "n_words"), 0.004, 0.02, 0.4, 0.6),
)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_capitals", "n_stop", "n_closings"]
BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"


def _repeat_words(windows: Column) -> Column:
    """Words covered by flagged windows of three, from their sorted places."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, w: F.struct(w.alias("last"), (acc["n"] + F.least(F.lit(3), w - acc["last"])).alias("n"))
    return F.aggregate(windows, start, step, lambda acc: acc["n"])


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``_f`` of all counts, from whole texts; no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    less = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_w", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    out = out.withColumn("_l", lines)
    # windows by (hash, place), sorted: equal ones are neighbours
    at = F.sequence(F.lit(0), F.size("_w") - 3)
    window = lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))
    out = out.withColumn("_s", F.when(F.size("_w") >= 3, F.sort_array(F.transform(at, window))))
    same = lambda x, j: F.coalesce(x["h"] == F.get("_s", j)["h"], F.lit(False))
    repeated = F.transform(F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    stop = F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": less(r"[#*$%&|<>]+"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(_repeat_words(F.sort_array(repeated)), F.lit(0)),
        "n_lines": F.size("_l"),
        "n_capitals": less(r"[A-ZÀ-ÖØ-Þ]+"),
        "n_stop": F.size(stop),
        "n_closings": less(r"[.?]+"),
    }
    return out.withColumn("_f", F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))).drop("_w", "_l", "_s")


def _with_votes(flat: DataFrame) -> DataFrame:
    return flat.withColumns({f"v_{r.name}": F.expr(r.vote()) for r in RULES})


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """(log odds of good before votes, for each rule the log odds that each vote adds), by expectation-maximisation.

    Starts from the balance of votes; rules are taken as independent given the class. No patterns: no evidence, odds even.
    """
    rules = len(patterns[0][0]) if patterns else len(RULES)
    good = [0.5 + 0.45 * sum(v) / rules for v, _ in patterns]
    prior, odds = 0.0, [dict.fromkeys((-1, 0, 1), 0.0) for _ in range(rules)]
    for _ in range(ROUNDS if patterns else 0):
        mass = [sum(n * p for (_, n), p in zip(patterns, good, strict=True)), sum(n * (1 - p) for (_, n), p in zip(patterns, good, strict=True))]
        prior = math.log((mass[0] + SMOOTHING) / (mass[1] + SMOOTHING))
        for r in range(rules):
            for vote in (-1, 0, 1):
                own = [(n * p, n * (1 - p)) for (v, n), p in zip(patterns, good, strict=True) if v[r] == vote]
                a, b = sum(x for x, _ in own), sum(y for _, y in own)
                odds[r][vote] = math.log((a + SMOOTHING) / (mass[0] + 3 * SMOOTHING)) - math.log((b + SMOOTHING) / (mass[1] + 3 * SMOOTHING))
        good = [_sigmoid(prior + sum(o[x] for o, x in zip(odds, v, strict=True))) for v, _ in patterns]
    return prior, odds


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def fit(flat: DataFrame) -> Column:
    """The log odds of good, as a column over the votes, from counts of the vote patterns of documents that pass the base."""
    names = [f"v_{r.name}" for r in RULES]
    # at most 3^rules groups: bounded by the rules, not by the corpus
    rows = _with_votes(flat).where(f"NOT {BASE_FAILED}").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    prior, odds = estimate(sorted((tuple(r[c] for c in names), r["n"]) for r in rows))
    out = F.lit(prior)
    for name, o in zip(names, odds, strict=True):
        out = out + F.when(F.col(name) == -1, F.lit(o[-1])).when(F.col(name) == 1, F.lit(o[1])).otherwise(F.lit(o[0]))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, all counts, votes, base_failed, quality (posterior of good), kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    own = features(docs.select(F.col(id_col), F.col(text_col).alias("_t")), "_t").select(F.col(id_col).alias("own_id"), "_f.*")
    flat = scratch.save(own, "counts")
    odds = fit(flat)
    out = _with_votes(flat).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).withColumnRenamed("own_id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns. Counts are made twice, so no text is shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    flat = scratch.save(features(docs.select(F.col(text_col).alias("_t")), "_t").select("_f.*"), "counts")
    odds = fit(flat)
    kept = features(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_t")), "_t").select("_row", "_f.*", F.monotonically_increasing_id().alias("_at"))
    # _at keeps the filter above the counts: pushed below, it would make them again for each vote
    return _with_votes(kept).where((F.col("_at") >= 0) & ~F.expr(BASE_FAILED) & (1 / (1 + F.exp(-odds)) >= threshold)).select("_row.*")


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return out.select(id_col, *BASE, "base_failed", "kept")


def oracle() -> str:
    """The same in DuckDB SQL: counts from words as rows, EM as a chain of aggregations."""
    votes = ", ".join(f"{r.vote()} AS v{k}" for k, r in enumerate(RULES))
    names = ", ".join(f"v{k}" for k in range(len(RULES)))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    chain = []
    for k in range(1, ROUNDS + 1):
        terms = " + ".join(f"CASE v{r} WHEN -1 THEN b{r} WHEN 1 THEN g{r} ELSE z{r} END" for r in range(len(RULES)))
        share = lambda r, v: f"ln((sum(CASE WHEN v{r} = {v} THEN n * p ELSE 0 END) + {SMOOTHING}e0) / (sum(n * p) + {3 * SMOOTHING}e0)) - ln((sum(CASE WHEN v{r} = {v} THEN n * (1 - p) ELSE 0 END) + {SMOOTHING}e0) / (sum(n * (1 - p)) + {3 * SMOOTHING}e0))"
        odds = ", ".join(f"{share(r, -1)} AS b{r}, {share(r, 0)} AS z{r}, {share(r, 1)} AS g{r}" for r in range(len(RULES)))
        chain.append(f"odds{k} AS MATERIALIZED (SELECT ln((sum(n * p) + {SMOOTHING}e0) / (sum(n * (1 - p)) + {SMOOTHING}e0)) AS prior, {odds} FROM post{k - 1})")
        chain.append(f"post{k} AS MATERIALIZED (SELECT {names}, n, 1 / (1 + exp(-(prior + {terms}))) AS p FROM post{k - 1}, odds{k})")
    first = " + ".join(f"v{k}" for k in range(len(RULES)))
    final = terms
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
word AS MATERIALIZED (SELECT rid, w, i FROM (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM docs)),
tri AS (SELECT rid, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS r FROM tri),
covered AS (SELECT rid, bool_or(r) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM rep),
reps AS (SELECT rid, count(*) FILTER (WHERE c) AS n_repeat_words FROM covered GROUP BY rid),
words AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE lower(w) IN ({stop})) AS n_stop FROM word GROUP BY rid),
line AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM line GROUP BY rid),
counts AS MATERIALIZED (SELECT doc_id, rid, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_stop, 0) AS n_stop,
  length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals, length(text) - length(regexp_replace(text, '[.?]', '', 'g')) AS n_closings
  FROM docs LEFT JOIN words USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN reps USING (rid)),
voted AS MATERIALIZED (SELECT *, {BASE_FAILED} AS base_failed, {votes} FROM counts),
post0 AS MATERIALIZED (SELECT {names}, n, 0.5e0 + 0.45e0 * ({first}) / {len(RULES)} AS p FROM (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM voted WHERE NOT base_failed GROUP BY {names})),
{", ".join(chain)}
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND 1 / (1 + exp(-(prior + {final}))) >= 0.5e0 AS kept FROM voted, odds{ROUNDS}
"""
