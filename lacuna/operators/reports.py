"""Profiles, validation, equity and error metrics over score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.layers import written
from .quantiles import exact_quantiles

# ---- profiles


def describe(df: DataFrame, by: str | None, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of defined values; quartiles are exact and interpolated, and no task holds a group."""
    held = written(df.select(*([by] if by else []), value), "describe")
    v = F.col(value)
    stats = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    cuts = exact_quantiles(held, value, (0.25, 0.5, 0.75), by, held=True)
    cuts = cuts.select(*([F.col(by).alias("_by")] if by else []), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    if not by:
        return held.agg(*stats).join(F.broadcast(cuts))  # one row each
    out = held.groupBy(by).agg(*stats)
    return out.join(cuts, out[by].eqNullSafe(cuts["_by"])).drop("_by")


def null_profile(df: DataFrame, columns: Sequence[str], only_nulls: bool = False) -> DataFrame:
    """(column, nulls, distinct, zeros) in long form."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    wide = df.agg(
        *(F.count_if(F.col(c).isNull()).alias(f"{c}|nulls") for c in columns),
        *((F.count_if(F.col(c) == 0) if c in numeric else F.lit(0).cast("long")).alias(f"{c}|zeros") for c in columns),
        *(F.count_distinct(c).alias(f"{c}|distinct") for c in columns),
    )
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}|{n}`").alias(n) for n in ("nulls", "distinct", "zeros"))) for c in columns))
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    return out.where("nulls > 0") if only_nulls else out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values by falling frequency, NULL left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct keys, and rows beyond the first of their key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("n") - 1).alias("n_extra"))


def top_groups(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The largest groups of equal values, ties by the values."""
    some = df.dropna(subset=list(columns))
    return some.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(n)


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, n): keys of one table that the other lacks; both 0 if the sets are equal."""
    count = lambda x, y, side: x.join(y.select(key), key, "left_anti").select(key).distinct().agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(a, b, "only_left").unionByName(count(b, a, "only_right"))


# ---- validation


def match_rate(df: DataFrame, by: str, a: Column, b: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(a.eqNullSafe(b).cast("int")).alias("match_rate"))


def placeholder_check(df: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(component, total, expected, diff, within) of sums, NULL as 0, against mean x rows; within half a unit of the sixth place a row."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in targets))
    rows = F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("total"), (F.lit(float(t)) * F.col("n")).alias("expected"), F.col("n").alias("n_rows")) for c, t in targets.items()))
    out = wide.select(F.explode(rows).alias("r")).select("r.*").withColumn("diff", F.col("total") - F.col("expected"))
    return out.withColumn("within", F.abs("diff") < F.lit(0.5e-6) * F.col("n_rows"))


def format_checks(df: DataFrame, key: str, score: str, rows: int | DataFrame, width: int) -> DataFrame:
    """(check_name, ok) of an export, in one pass: text keys of a width, digits, no repeats, no blanks, range, rows, leading zeros.

    ``rows``: how many are due, or the table that has them, which is counted in the same plan.
    """
    k, s = F.col(key), F.col(score)
    checks = {
        "key_width": F.bool_and(F.length(k) == width),
        "key_digits": F.bool_and(k.rlike("^[0-9]+$")),
        "key_unique": F.count(k) == F.count_distinct(k),
        "no_nulls": F.count_if(k.isNull() | s.isNull()) == 0,
        "in_range": F.bool_and(s.between(0, 1)),
        "row_count": F.count(F.lit(1)) == (rows if isinstance(rows, int) else F.max("_due")),
        "leading_zero": F.bool_or(F.startswith(k, F.lit("0"))),
        "six_places": F.bool_and(F.abs(s * 1e6 - F.round(s * 1e6)) < 1e-3),
        "not_constant": F.min(s) < F.max(s),
    }
    if not isinstance(rows, int):
        df = df.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_due"))))  # one row
    wide = df.agg(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("ok")) for n in checks))).alias("r")).select("r.*")


def consistency(df: DataFrame, a: Column, b: Column, eps: float = 1e-9) -> DataFrame:
    """Rows compared, median and largest difference, share of exact rows, and rows where only one is defined."""
    held = written(df.select(F.abs(a - b).alias("d"), (a.isNull() != b.isNull()).alias("differs")), "consistency")
    d = F.col("d")
    median = exact_quantiles(held, "d", (0.5,), held=True).select(F.col("q0").alias("median_diff"))
    out = held.agg(F.count(d).alias("n"), F.max(d).alias("max_diff"), F.avg((d <= eps).cast("int")).alias("exact_share"), F.count_if("differs").alias("n_undefined_differs"))
    return out.join(F.broadcast(median)).select("n", "median_diff", "max_diff", "exact_share", "n_undefined_differs")  # one row each


# ---- equity


def disparity(df: DataFrame, value: str, strata: dict[str, Column]) -> DataFrame:
    """(stratum, mean_in, mean_out, ratio, pct_larger) over defined values, all strata in one pass."""
    return disparities(df, [value], strata).drop("component")


def disparities(df: DataFrame, values: Sequence[str], strata: dict[str, Column]) -> DataFrame:
    """(component, stratum, mean_in, mean_out, ratio, pct_larger) of several values, all in one pass over the table."""
    mean = lambda v, c: F.avg(F.when(c, F.col(v)))
    wide = df.agg(*(mean(v, c if inside else ~c).alias(f"{v}|{n}|{inside}") for v in values for n, c in strata.items() for inside in (True, False)))
    one = lambda v, n: F.struct(F.lit(v).alias("component"), F.lit(n).alias("stratum"), F.col(f"`{v}|{n}|True`").alias("mean_in"), F.col(f"`{v}|{n}|False`").alias("mean_out"))
    out = wide.select(F.explode(F.array(*(one(v, n) for v in values for n in strata))).alias("r")).select("r.*").withColumn("ratio", F.try_divide("mean_in", "mean_out"))
    return out.withColumn("pct_larger", (F.col("ratio") - 1) * 100)


def quartiles(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds the quartile (1 to 4) by exact cut points.

    Cut points are one row; a global ntile() would sort all rows in one task.
    """
    cuts = exact_quantiles(df, value, (0.25, 0.5, 0.75)).select(F.array("q0", "q1", "q2").alias("cuts"))
    q = sum(((F.col(value) > F.col("cuts")[i]).cast("int") for i in (1, 2)), (F.col(value) > F.col("cuts")[0]).cast("int")) + 1
    return df.join(F.broadcast(cuts)).withColumn("quartile", q).drop("cuts")


def leave_one_out(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The mean of the group's other defined values; from aggregates, so no group is gathered."""
    sums = df.groupBy(by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    v = F.col(value)
    other = F.try_divide(F.col("_s") - F.coalesce(v, F.lit(0.0)), F.col("_n") - v.isNotNull().cast("int"))
    return df.join(sums, by, "left").withColumn(name, other).drop("_s", "_n")


# ---- error metrics; error = prediction - reference


def regression_metrics(df: DataFrame, by: str | None, pred: str, ref: str) -> DataFrame:
    p, r = F.col(pred), F.col(ref)
    both = p.isNotNull() & r.isNotNull()
    stats = [F.count_if(both).alias("n"), F.avg(F.abs(p - r)).alias("mae"), F.sqrt(F.avg((p - r) * (p - r))).alias("rmse"), F.corr(pred, ref).alias("corr"), F.regr_r2(ref, pred).alias("r2"), F.avg(p - r).alias("bias")]
    return df.groupBy(by).agg(*stats) if by else df.agg(*stats)


def conformal(df: DataFrame, pred: str, ref: str, level: float = 0.9) -> DataFrame:
    """One row: the half width that covers ``level`` of errors, what it covers when clipped to [0, 1], and the mean width."""
    df = written(df.select(pred, ref), "conformal")
    q = exact_quantiles(df, F.abs(F.col(pred) - F.col(ref)), (level,), held=True).select(F.col("q0").alias("q_hat"))
    low, high = F.greatest(F.lit(0.0), F.col(pred) - F.col("q_hat")), F.least(F.lit(1.0), F.col(pred) + F.col("q_hat"))
    out = df.where(F.col(pred).isNotNull() & F.col(ref).isNotNull()).join(F.broadcast(q))
    return out.agg(F.max("q_hat").alias("q_hat"), F.avg(F.col(ref).between(low, high).cast("int")).alias("coverage"), F.avg(high - low).alias("mean_width"))


def perturb_all(df: DataFrame, value: str, d: float, high: float = 0.995, digits: int = 6) -> DataFrame:
    """Every value moved by d, down where it would pass ``high``."""
    moved = F.col(value) + F.when(F.col(value) > high, F.lit(-d)).otherwise(F.lit(d))
    return df.withColumn("perturbed", F.round(moved, digits)).withColumn("flipped", F.col(value) > high)


def perturb_rows(df: DataFrame, key: str, value: str, moves: dict[int, float]) -> DataFrame:
    """Some rows moved by a step of their own; fails where that leaves [0, 1]."""
    moved = F.col(value)
    for k, d in moves.items():
        moved = F.when(F.col(key) == k, F.col(value) + d).otherwise(moved)
    bad = ~moved.between(0, 1)
    return df.withColumn("perturbed", F.when(bad, F.raise_error(F.concat(F.lit("out of range: "), F.col(key).cast("string"))).cast("double")).otherwise(moved))


def fix_and_perturb(df: DataFrame, key: str, value: str, fixed: dict[int, float], moves: dict[int, float]) -> DataFrame:
    """Some rows set to known values, then some moved by a step of their own (also of those just set); fails where that leaves [0, 1]."""
    set_ = F.col(value)
    for k, v in fixed.items():
        set_ = F.when(F.col(key) == k, F.lit(v)).otherwise(set_)
    return perturb_rows(df.withColumn(value, set_), key, value, moves)


def proxy(b: Column, a: Column, r: Column, p: Column, u: Column) -> Column:
    """The linear proxy u - 1 - (b + 2 a + r + p) / 4, not below 0; NULL if any part is."""
    x = u - 1 - (b + 2 * a + r + p) / 4
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))


def ends(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first and the last ``n`` rows in this order, with their side; rows of a short table are on both."""
    first = df.orderBy(*order).limit(n).withColumn("side", F.lit("first"))
    return first.unionByName(df.orderBy(*(F.desc(c) for c in order)).limit(n).withColumn("side", F.lit("last")))


def decode_mae_case(n: Column, base: Column, moved: Column, d: Column, eps: float = 1e-9) -> Column:
    """(error, case) of a row whose value fell by d: its error if it lies between 0 and d; else the mean absolute error moves by d / n whatever
    the error is, and only a bound can be told (``at_most`` 0, ``at_least`` d). A larger move has another cause: ``not_one_row``."""
    step = n * (moved - base)
    case = F.when(F.abs(step) > d + eps, "not_one_row").when(step >= d - eps, "at_most").when(step <= eps - d, "at_least").otherwise("exact")
    error = F.when(case == "at_most", F.lit(0.0)).when(case == "at_least", d).when(case == "exact", decode_mae(n, base, moved, d))
    return F.struct(error.alias("error"), case.alias("case"))


def decode_mae(n: Column, base: Column, moved: Column, d: Column) -> Column:
    """A row's error, between 0 and d, from the mean absolute error before and after its value fell by d."""
    return (d - n * (moved - base)) / 2


def decode_rmse(n: Column, base: Column, moved: Column, d: Column) -> Column:
    """A row's error from the root mean square errors before and after its value fell by d."""
    return (n * base * base + d * d - n * moved * moved) / (2 * d)


def rows_from_rmse(base: Column, moved: Column, d: Column) -> Column:
    """How many rows are scored, if moving one whose error is 0 by d changes the root mean square error so."""
    return F.try_divide(d * d, moved * moved - base * base)


def implied_component(component: Column, k: Column, error: Column) -> Column:
    """A component's value in the reference, if the error of the composite, a mean of k components, is all its own."""
    return component + k * error


def error_budget(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Sum of errors and of absolute errors, the largest, and its share."""
    e = F.col(pred) - F.col(ref)
    out = df.agg(F.count(e).alias("n"), F.sum(e).alias("sum_error"), F.sum(F.abs(e)).alias("sum_abs_error"), F.max(F.abs(e)).alias("max_abs_error"))
    return out.withColumn("max_share", F.try_divide("max_abs_error", "sum_abs_error"))
