"""Spatial joins as equi-joins on grid cells.

Catalyst plans an overlap of boxes as a nested loop. Here each side names the grid cells that it meets, rows of one cell
are joined by hash, and a pair is kept only in the first cell that both meet, so that it comes out once and no DISTINCT
shuffle is needed. Points have one cell and aren't exploded. A crowded cell is a skewed join key, which AQE splits; the
pair count falls with the cell's size, the number of cells a box meets rises, so ``cell`` should be about a box's width.

Two things keep the number of cells down where sizes vary:

* a straight segment names the cells it crosses, column by column, and not those of its box: a diagonal of n cells has
  about 2 n of them in place of n * n;
* with ``levels`` above 1, a box wider than a cell or two belongs to a coarser grid, of ``FACTOR`` times the cell at each
  level, where it has at most nine cells. A row visits its own level and the coarser ones, a pair meets at the coarser
  of both levels, so a row has at most 4 * levels + 5 cells however wide it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs, planar

Box = tuple[str, str, str, str]
#: Each level's cells are so many times as wide as those of the one before.
FACTOR = 4.0
#: By what share of a cell a segment's range in a column is widened, so that rounding loses no touched cell.
_SLACK = 1e-9


def _ordered(df: DataFrame, box: Box) -> DataFrame:
    x0, x1, y0, y1 = (F.col(c) for c in box)
    return df.where((x0 <= x1) & (y0 <= y1))


def _is_point(box: Box) -> bool:
    return box[0] == box[1] and box[2] == box[3]


def with_cells(df: DataFrame, box: Box, cell: float, lead: str) -> DataFrame:
    """Adds a row for each cell that the box (xmin, xmax, ymin, ymax) meets; boxes upside down or NULL meet none."""
    x0, x1, y0, y1 = (F.col(c) for c in box)
    df = _ordered(df, box).withColumns({f"{lead}i": planar.cell(x0, cell), f"{lead}j": planar.cell(y0, cell)})
    if _is_point(box):
        return df.withColumns({"ci": F.col(f"{lead}i"), "cj": F.col(f"{lead}j")})
    df = df.withColumn("ci", F.explode(F.sequence(F.col(f"{lead}i"), planar.cell(x1, cell))))
    return df.withColumn("cj", F.explode(F.sequence(F.col(f"{lead}j"), planar.cell(y1, cell))))


def _segment_rows(segment: Box, column: Column, cell: float) -> tuple[Column, Column]:
    """The cells' rows that the segment's part in a column of cells reaches."""
    ax, ay, dx, dy = (F.col(c) for c in segment)
    low, high = F.least(ax, ax + dx), F.greatest(ax, ax + dx)
    bottom, top = F.least(ay, ay + dy), F.greatest(ay, ay + dy)
    left, right = F.greatest(low, column * cell), F.least(high, (column + 1) * cell)
    at = lambda x: ay + F.try_divide(x - ax, dx) * dy
    a, b = F.coalesce(at(left), bottom), F.coalesce(at(right), top)
    lo, hi = F.greatest(bottom, F.least(a, b) - _SLACK * cell), F.least(top, F.greatest(a, b) + _SLACK * cell)
    return planar.cell(lo, cell), planar.cell(hi, cell)


def with_segment_cells(df: DataFrame, segment: Box, cell: float, lead: str) -> DataFrame:
    """Adds a row for each cell that the segment (ax, ay, dx, dy) crosses or touches, and the rows of cells that it has in that column
    and in the one before (``{lead}l``, ``{lead}h``, ``{lead}pl``, ``{lead}ph``)."""
    ax, ay, dx, dy = (F.col(c) for c in segment)
    low, high, bottom = F.least(ax, ax + dx), F.greatest(ax, ax + dx), F.least(ay, ay + dy)
    df = df.where(low.isNotNull() & bottom.isNotNull()).withColumns({f"{lead}i": planar.cell(low, cell), f"{lead}j": planar.cell(bottom, cell)})
    df = df.withColumn("ci", F.explode(F.sequence(F.col(f"{lead}i"), planar.cell(high, cell))))
    (lo, hi), (plo, phi) = _segment_rows(segment, F.col("ci"), cell), _segment_rows(segment, F.col("ci") - 1, cell)
    before = F.col("ci") > F.col(f"{lead}i")
    df = df.withColumns({f"{lead}l": lo, f"{lead}h": hi, f"{lead}pl": F.when(before, plo), f"{lead}ph": F.when(before, phi)})
    return df.withColumn("cj", F.explode(F.sequence(F.col(f"{lead}l"), F.col(f"{lead}h"))))


def with_levels(df: DataFrame, box: Box, cell: float, levels: int, lead: str) -> DataFrame:
    """The same on the grids of the box's own level and of all coarser ones (column ``level``); ``{lead}own`` is its own level.

    Boxes wider than two cells of the coarsest grid have as many cells there as they need.
    """
    x0, x1, y0, y1 = (F.col(c) for c in box)
    wide = F.greatest(x1 - x0, y1 - y0) / cell
    own = F.lit(0) if _is_point(box) else F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.ceil(F.log(F.greatest(wide, F.lit(1.0)) / 2) / F.log(F.lit(FACTOR))).cast("int")))
    df = _ordered(df, box).withColumn(f"{lead}own", own).withColumn("level", F.explode(F.sequence(F.col(f"{lead}own"), F.lit(levels - 1))))
    size = F.lit(float(cell)) * F.pow(F.lit(FACTOR), F.col("level"))
    at = lambda c: F.floor(c / size)
    df = df.withColumns({f"{lead}i": at(x0), f"{lead}j": at(y0)})
    df = df.withColumn("ci", F.explode(F.sequence(F.col(f"{lead}i"), at(x1))))
    return df.withColumn("cj", F.explode(F.sequence(F.col(f"{lead}j"), at(y1))))


def grid_join(
    left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, cell: float, predicate: Column | None = None, by: tuple[str, ...] = (), segment: Box | None = None, levels: int = 1
) -> DataFrame:
    """Inner join of rows whose closed boxes overlap and that meet the predicate.

    Column names must differ between sides, but for those in ``by``, which must be equal (a variant's name, a region). Where both
    sides' boxes carry a reference system (see ``crs.tagged``), it must be the same. ``segment``: the columns (ax, ay, dx, dy) of which
    the left box is the box; then pairs in no common cell of the segment, whose boxes overlap but which don't meet, are left
    out as well. ``levels``: see above.
    """
    clash = (set(left.columns) & set(right.columns)) - set(by)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    for a, b in zip(left_box, right_box, strict=True):
        crs.same_code(left, right, (a, b))
    if segment and levels > 1:
        raise ValueError("segments are short or their cells few: they need no levels")
    own = [*left.columns, *(c for c in right.columns if c not in by)]
    (lx0, lx1, ly0, ly1), (rx0, rx1, ry0, ry1) = (tuple(F.col(c) for c in box) for box in (left_box, right_box))
    if segment:
        # the left box is made anew from the segment after the join, so that it need not be shuffled
        ax, ay, dx, dy = (F.col(c) for c in segment)
        lx0, lx1, ly0, ly1 = F.least(ax, ax + dx), F.greatest(ax, ax + dx), F.least(ay, ay + dy), F.greatest(ay, ay + dy)
    overlap = (lx0 <= rx1) & (lx1 >= rx0) & (ly0 <= ry1) & (ly1 >= ry0)
    ci, cj = F.col("ci"), F.col("cj")
    if levels > 1:
        a, b = with_levels(left, left_box, cell, levels, "_l"), with_levels(right, right_box, cell, levels, "_r")
        first = (ci == F.greatest("_li", "_ri")) & (cj == F.greatest("_lj", "_rj")) & (F.col("level") == F.greatest("_lown", "_rown"))
        return _met(a.join(b, ["ci", "cj", "level", *by]), overlap & first, own, predicate)
    a = with_segment_cells(left, segment, cell, "_l") if segment else with_cells(left, left_box, cell, "_l")
    joined = a.select(*left.columns, "ci", "cj", *(["_ll", "_lpl", "_lph"] if segment else [])).join(with_cells(right, right_box, cell, "_r").select(*right.columns, "ci", "cj"), ["ci", "cj", *by])
    ri, rj = planar.cell(rx0, cell), planar.cell(ry0, cell)
    if segment:
        # a segment's columns that meet the box are consecutive: the first is the first of both, or the one before has no row of the box
        earlier = (ci > ri) & (F.col("_lpl") <= planar.cell(ry1, cell)) & (F.col("_lph") >= rj)
        first = ~F.coalesce(earlier, F.lit(False)) & (cj == F.greatest("_ll", rj))
    else:
        first = (ci == F.greatest(planar.cell(lx0, cell), ri)) & (cj == F.greatest(planar.cell(ly0, cell), rj))
    return _met(joined, overlap & first, own, predicate)


def _met(joined: DataFrame, condition: Column, own: list[str], predicate: Column | None) -> DataFrame:
    out = joined.where(condition).select(*own)
    return out if predicate is None else out.where(predicate)


def naive_join(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, predicate: Column | None = None) -> DataFrame:
    """The same by comparing all pairs: for tests on small tables."""
    (lx0, lx1, ly0, ly1), (rx0, rx1, ry0, ry1) = (tuple(F.col(c) for c in box) for box in (left_box, right_box))
    overlap = (lx0 <= rx1) & (lx1 >= rx0) & (ly0 <= ry1) & (ly1 >= ry0)
    return left.join(right, overlap if predicate is None else overlap & predicate)
