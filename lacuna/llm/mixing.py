"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern (the set of
their sources), and a flow routes each pattern's tokens to the quotas of its sources: a pattern's tokens
can be taken up to ``repeats`` times, and each further time costs more (0, 1, 2, ...: convex), so that
text is repeated no more than quotas force. Within a pattern everything is taken a whole number of times
and documents chosen by a seeded hash once more, the last of them in part, so quotas are met exactly.

Targets: sources in order (by code point, null last) have weights 1, 2, 3, repeating, or given ones, and
share the total of all sizes; no target is above ``repeats`` times its source's size, and the excess is
reshared by weight until none is.

Sources are rows of a table, however many there are: their places in the order come from a sort by ranges, and the level up
to which targets rise is found by a few aggregations over them. A source that shares no document with another needs no
flow: its quota is its target. Sources that do share documents are joined to components, and each component's flow is one
task's work on its patterns. Documents are never gathered or globally sorted. Their order within a pattern is that of a
hash of seed, id and text: rows that share all three are one class, aggregated before anything is
ordered, so neither null ids nor copies make a bucket hot. Classes are put in buckets by leading digits
of the hash, as many as keep a bucket small; buckets' totals are summed in order on two levels, and a
window orders a bucket's own classes only. Within a class any row will do: rows are counted in slices.

Null text has size 0 and is never taken; a null source is a source of its own. Rows that repeat an id are
documents of their own; a null id is hashed as the empty text. Reruns give the same rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_order, numbered
from .components import connected_components

WEIGHTS, REPEATS, SEED = (1, 2, 3), 3, "mix"
#: About so many documents are ordered in one bucket of a pattern; a bucket's name are leading hexadecimal digits, of which
#: the first COARSE are summed on one level and the others below it. A class's rows are counted in so many slices.
BUCKET_ROWS, COARSE, SLICES = 250, 4, 256


@dataclass
class Edge:
    to: int
    free: int
    cost: int
    back: int


class Flow:
    """Min-cost flow; capacities are whole numbers, costs whole and not negative.

    Potentials keep all costs that are left at zero or more, so that a heap finds the cheapest paths; all paths of one cost are then
    filled at once, level by level of the edges that are on any of them. There are as many rounds as there are different costs.
    """

    def __init__(self, nodes: int):
        self.out: list[list[Edge]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> Edge:
        there = Edge(b, capacity, cost, len(self.out[b]))
        self.out[a].append(there)
        self.out[b].append(Edge(a, 0, -cost, len(self.out[a]) - 1))
        return there

    def _distances(self, source: int, high: list[int]) -> list[int | None]:
        dist: list[int | None] = [None] * len(self.out)
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if dist[a] is not None:
                continue
            dist[a] = d
            for e in self.out[a]:
                if e.free and dist[e.to] is None:
                    heapq.heappush(queue, (d + e.cost + high[a] - high[e.to], e.to))
        return dist

    def _levels(self, source: int, high: list[int]) -> list[int]:
        level = [-1] * len(self.out)
        level[source], now = 0, [source]
        while now:
            new = []
            for a in now:
                for e in self.out[a]:
                    if e.free and level[e.to] < 0 and e.cost + high[a] == high[e.to]:
                        level[e.to] = level[a] + 1
                        new.append(e.to)
            now = new
        return level

    def _fill(self, source: int, sink: int, high: list[int], level: list[int]) -> None:
        """Fills paths along rising levels until there is none; an edge that leads nowhere is not tried again."""
        tried = [0] * len(self.out)
        path: list[Edge] = []
        at = source
        while True:
            if at == sink:
                n = min(e.free for e in path)
                for e in path:
                    e.free -= n
                    self.out[e.to][e.back].free += n
                path, at = [], source
                continue
            while tried[at] < len(self.out[at]):
                e = self.out[at][tried[at]]
                if e.free and level[e.to] == level[at] + 1 and e.cost + high[at] == high[e.to]:
                    break
                tried[at] += 1
            if tried[at] < len(self.out[at]):
                path.append(self.out[at][tried[at]])
                at = path[-1].to
            elif path:
                back = path.pop()
                at = self.out[back.to][back.back].to
                tried[at] += 1
            else:
                return

    def run(self, source: int, sink: int) -> None:
        high = [0] * len(self.out)
        while True:
            dist = self._distances(source, high)
            if dist[sink] is None:
                return
            # what can't be reached stays as far as the farthest, so that costs left stay at zero or more
            far = max(d for d in dist if d is not None)
            high = [h + (far if d is None else d) for h, d in zip(high, dist, strict=True)]
            while (level := self._levels(source, high))[sink] >= 0:
                self._fill(source, sink, high, level)


def route(patterns: Sequence[tuple[Sequence[int], int]], goal: dict[int, float], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Of each pattern (sources, size) the tokens that go to each of its sources; ``goal``: the sources' targets."""
    names = {s: k for k, s in enumerate(sorted(goal))}
    flow = Flow(2 + len(patterns) + len(names))
    edges: list[dict[int, Edge]] = []
    for k, (sources, size) in enumerate(patterns):
        for t in range(repeats):
            flow.edge(0, 2 + k, size, t)
        edges.append({s: flow.edge(2 + k, 2 + len(patterns) + names[s], repeats * size, 0) for s in sources})
    for s, k in names.items():
        flow.edge(2 + len(patterns) + k, 1, int(goal[s]), 0)
    flow.run(0, 1)
    return [{s: repeats * size - e.free for s, e in own.items()} for own, (_, size) in zip(edges, patterns, strict=True)]


def _routed(repeats: int):
    def run(table: pa.Table) -> pa.Table:
        """One component: rows (pattern, size, k, goal) of its patterns' sources."""
        sources, size, goal = {}, {}, {}
        for p, n, k, g in zip(*(table[c].to_pylist() for c in ("pattern", "size", "k", "goal")), strict=True):
            sources.setdefault(p, []).append(k)
            size[p], goal[k] = n, g
        keys = sorted(sources)
        flows = route([(sorted(sources[p]), size[p]) for p in keys], goal, repeats)
        return pa.table({"pattern": pa.array(keys, pa.string()), "flow": pa.array([sum(f.values()) for f in flows], pa.int64())})

    return run


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, k, target) of sources (source, source_size): places from 0 by code point, NULL last, and shares of the total by
    weight, capped at ``repeats`` times the source's size, the excess reshared.

    A target is the lesser of its cap and ``level`` times its weight. The level rises to where targets sum to the total: from the
    sources that are capped at one level follows the next, which is never too high, until no further source is capped.
    """
    own = in_order(sizes.withColumn("none", F.col("source").isNull()), ["none", "source"], scratch, "sources").drop("none")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    own = own.withColumns({"weight": weight, "cap": F.col("source_size") * repeats})
    total = own.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        n, caps, left = own.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not left:
            break
        level, capped = (total - caps) / left, n
    target = F.when(F.col("cap") < F.lit(level) * F.col("weight"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return own.select("source", "source_size", "k", target.alias("target"))


def quotas(patterns: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(pattern, total, flow, source_size, target) of patterns (pattern, size): the tokens that are taken of each, and size and target of its
    first source."""
    member = patterns.select("pattern", "size", F.posexplode(pattern_of("pattern")).alias("place", "source")).withColumn("name", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")))
    sizes = member.groupBy("name").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goals = source_targets(sizes.drop("name"), scratch, weights, repeats)
    # sources share what there is: a document of two sources counts once
    both = patterns.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.size(pattern_of("pattern"))), F.lit(0)), F.coalesce(F.max(F.size(pattern_of("pattern"))), F.lit(0))).first()
    scale = min(1.0, both[0] / max(1, both[1]))
    goals = goals.select(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("name"), "source_size", "k", (F.col("target") * scale if scale < 1 else F.col("target")).alias("goal"))
    member = scratch.save(member.drop("source").join(goals, "name").drop("name"), "members")
    first = member.where("place = 0").select("pattern", F.col("size").alias("total"), "source_size", F.col("goal").alias("target"), "k")
    alone = F.floor("target").cast("long")
    if both[2] <= 1:
        return first.withColumn("flow", alone).drop("k")
    least = member.where("place > 0").select("pattern").distinct().join(first.select("pattern", F.col("k").alias("a")), "pattern")
    edges = least.join(member.select("pattern", F.col("k").alias("b")), "pattern").select("a", "b")
    groups = connected_components(edges, scratch).select(F.col("node").alias("k"), "component")
    shared = member.join(groups, "k").groupBy("component").applyInArrow(_routed(repeats), "pattern string, flow long")
    return first.join(shared, "pattern", "left").withColumn("flow", F.coalesce("flow", alone)).drop("k")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [len(t.encode().split()) if t else 0 for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["row"], b["id"], b["pattern"], b["hash"], pa.array(n, pa.int64())], ["row", "id", "pattern", "hash", "size"])


def _before(what: str, by: list[str], order: str):
    """The sum of a column over what stands before a row."""
    return F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _starts(own: DataFrame, digits: int) -> DataFrame:
    """Of classes (pattern, hash, size, n) each with the words before it in its pattern: buckets' totals are summed in order of
    their first digits (16^COARSE at most), then below them."""
    named = own.withColumns({"coarse": F.substring("hash", 1, min(digits, COARSE)), "bucket": F.substring("hash", 1, digits), "words": F.col("size") * F.col("n")})
    sums = named.groupBy("pattern", "coarse", "bucket").agg(F.sum("words").alias("words"))
    high = sums.groupBy("pattern", "coarse").agg(F.sum("words").alias("words")).withColumn("high", _before("words", ["pattern"], "coarse")).drop("words")
    low = sums.withColumn("low", _before("words", ["pattern", "coarse"], "bucket")).drop("words")
    starts = low.join(high.hint("merge"), ["pattern", "coarse"]).select("pattern", "bucket", (F.col("high") + F.col("low")).alias("start"))
    inside = named.withColumn("inside", _before("words", ["pattern", "bucket"], "hash"))
    return inside.join(starts.hint("merge"), ["pattern", "bucket"]).select("pattern", "hash", "size", "n", (F.col("start") + F.col("inside")).alias("start"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = REPEATS,
    seed: str = SEED,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, pattern (sorted sources), size, taken (words, repeats counted), of the pattern's first
    source source_size and target, and row: a number of the row's own, or that of ``row_col``.

    ``source_col`` is a string or an array of strings. Other columns are not read; an empty table stays empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    is_list = docs.schema[source_col].dataType.typeName() == "array"
    pattern = F.sort_array(F.array_distinct(F.coalesce(F.col(source_col), F.array(F.lit(None).cast("string"))))) if is_list else F.array(F.col(source_col))
    pattern = F.when(F.size(pattern) == 0, F.array(F.lit(None).cast("string"))).otherwise(pattern) if is_list else pattern
    id_type = docs.schema[id_col].dataType.simpleString()
    blank = lambda c: F.coalesce(c, F.lit(""))
    hash_ = F.md5(F.concat(F.lit(f"{seed}:"), blank(F.col(id_col).cast("string")), F.lit(":"), F.md5(blank(F.col(text_col)))))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    read = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.to_json(pattern).alias("pattern"), hash_.alias("hash"), F.col(text_col).alias("text"))
    own = scratch.save(read.mapInArrow(_sizes, f"row long, id {id_type}, pattern string, hash string, size long"), "own")
    patterns = scratch.save(own.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "patterns")
    told = scratch.save(quotas(patterns.drop("n"), scratch, weights, repeats), "told")
    most, digits = patterns.agg(F.max("n")).first()[0] or 0, 1
    while 16**digits * bucket_rows < most:
        digits += 1
    some = own.where("size > 0")
    classes = _starts(some.groupBy("pattern", "hash", "size").agg(F.count(F.lit(1)).alias("n")), digits).join(told.select("pattern", "total", "flow"), "pattern")
    # of a class's words beyond whole rounds, ``part`` are taken: of its first rows in whole, of the next one in part
    part = F.greatest(F.lit(0), F.least(F.col("size") * F.col("n"), F.expr("flow % total") - F.col("start")))
    classes = scratch.save(classes.select("pattern", "hash", "n", F.expr("flow div total").alias("base"), part.alias("part")), "classes")
    held = some.join(classes, ["pattern", "hash"])
    words = lambda rank: F.col("base") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - rank * F.col("size")))
    single = held.where("n = 1").select("row", "id", "pattern", "size", words(F.lit(0)).alias("taken"))
    many = scratch.save(held.where("n > 1").withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(SLICES))), "many")
    ahead = many.groupBy("pattern", "hash", "slice").agg(F.count(F.lit(1)).alias("k")).withColumn("ahead", _before("k", ["pattern", "hash"], "slice")).drop("k")
    nth = F.row_number().over(Window.partitionBy("pattern", "hash", "slice").orderBy("row")) - 1
    ranked = many.withColumn("nth", nth).join(ahead.hint("merge"), ["pattern", "hash", "slice"])
    several = ranked.select("row", "id", "pattern", "size", words(F.col("ahead") + F.col("nth")).alias("taken"))
    none = own.where("size = 0").select("row", "id", "pattern", "size", F.lit(0).cast("long").alias("taken"))
    out = single.unionByName(several).unionByName(none).join(told.select("pattern", "source_size", "target"), "pattern")
    return out.select(F.col("id").alias(id_col), pattern_of("pattern").alias("pattern"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "row")


def pattern_of(column: str):
    return F.from_json(column, "array<string>")


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that a document gives: whole copies, then a part that ends after its last word."""
    for b in batches:
        index, texts = [], []
        for k, (text, size, taken) in enumerate(zip(b["text"].to_pylist(), b["size"].to_pylist(), b["taken"].to_pylist(), strict=True)):
            whole, rest = divmod(taken, size)
            index += [k] * (whole + bool(rest))
            texts += [text] * whole
            if rest:
                data, at = text.encode(), 0
                for w in data.split()[:rest]:
                    at = data.index(w, at) + len(w)
                texts.append(data[:at].decode())
        row = b["_row"].take(pa.array(index, pa.int64()))
        yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], ["_row", "text"])


def take(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, the last one of a pattern in part.

    Sources may overlap (an array column). Rows are numbered in a written table and joined by that number, once. Of rows that
    share id, text and sources those with lower numbers are taken first. Texts without words are never taken.
    """
    rows = numbered(docs, Scratch(docs.sparkSession, "taking"), id=id_col, text=text_col, source=source_col)
    told = mix(rows, source_col="source", id_col="id", text_col="text", row_col="row", **options).where("taken > 0").select("row", "size", "taken")
    kind = rows.schema["_row"].dataType.simpleString()
    # the text is taken out of the row after the join, so that the shuffle carries it once
    out = rows.select("row", "_row").join(told, "row").select("_row", F.col("_row").getField(text_col).alias("text"), "size", "taken").mapInArrow(_copies, f"_row {kind}, text string")
    new = {text_col: F.col("text")} | ({length_col: F.length("text").cast("long")} if length_col in docs.columns else {})
    return out.select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return out.select(id_col, "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS hash, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, {REPEATS} * source_size AS cap, (k - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, k) AS r FROM w),
l AS (SELECT *, (SELECT sum(source_size) FROM o) - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
  sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o),
f AS (SELECT *, cap >= CAST(left_ AS DOUBLE) / CAST(weights AS DOUBLE) * weight AS below FROM l),
level AS (SELECT arg_min(CAST(left_ AS DOUBLE) / CAST(weights AS DOUBLE), r) AS level, min(r) AS first FROM f WHERE below),
t AS (SELECT source, source_size, CASE WHEN r < first THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM f, level),
q AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS flow,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(flow // greatest(source_size, 1) * size + greatest(0, least(size, flow % greatest(source_size, 1) - before)) AS BIGINT) AS taken FROM q
"""
