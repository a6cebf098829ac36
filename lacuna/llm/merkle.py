"""Merkle manifest of a dataset: a root for each group of rows, one for all, and each row's proof.

H is lowercase hex SHA-256 of its inputs joined; digests join as hex text. A row's leaf is H over its fields,
each ``-`` if NULL, else the count of its UTF-8 bytes, ``:`` and the value. Within a group leaves ascend by key
(NULL first; rows of one key by leaf, and rows alike in both are interchangeable). While a group has more than
one node, every ``FANOUT`` consecutive ones become their H, the last run with what is left, even one. What
remains is the group's subroot; subroots in the order of their group (NULL first, UTF-8 bytewise) make the root
likewise. A row's proof is the other nodes of its run, level by level.

A group's nodes are cut into aligned blocks of ``BLOCK`` positions, a power of the fanout, so that a block
is a subtree of its own: its hex digests are one contiguous matrix that is reshaped by fanout and hashed row by
row, level by level, and siblings are found by index arithmetic. Blocks' tops are the next round's nodes.
A task never holds more than a block, a round has a 512th of the rows of the one before, and each round is a
written table. Positions come from a sort by ranges, so no group passes through one task, however large.

An empty table gives no rows. Empty texts are ``0:``; columns that aren't fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FANOUT, DEEP = 8, 3
BLOCK = FANOUT**DEEP
#: Width of a hex digest.
HEX = 64
_PATH = "array<struct<before: string, after: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- matrices of digests: one row of HEX bytes per node


def matrix(digests: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, HEX)


def hash_rows(rows: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """H of the first ``widths`` bytes of each row."""
    data, w, sha = rows.tobytes(), rows.shape[1], hashlib.sha256
    own = [sha(data[k : k + n]).hexdigest() for k, n in zip(range(0, len(data), w), widths.tolist(), strict=True)]
    return matrix(own)


def by_runs(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes reshaped to (runs, FANOUT, HEX), the last run filled up with zeros, and the nodes of each run."""
    m = len(nodes)
    runs = -(-m // FANOUT)
    full = np.zeros((runs * FANOUT, HEX), np.uint8)
    full[:m] = nodes
    held = np.full(runs, FANOUT)
    held[-1] = m - FANOUT * (runs - 1)
    return full.reshape(runs, FANOUT, HEX), held


def climb(nodes: np.ndarray, levels: int) -> list[np.ndarray]:
    """The matrix of each level, the given one first."""
    out = [nodes]
    for _ in range(levels):
        full, held = by_runs(out[-1])
        out.append(hash_rows(full.reshape(len(full), -1), held * HEX))
    return out


def levels_within(n: int) -> int:
    """Levels that a block of a group of ``n`` nodes goes up: to its one node, or a block's whole height."""
    if n > BLOCK:
        return DEEP
    k = 0
    while n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


def siblings(nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the nodes at ``at``: the others of the run in order, (n, FANOUT - 1, HEX); how many there are; how many stand before."""
    full, held = by_runs(nodes)
    run, slot = at // FANOUT, at % FANOUT
    others = np.arange(FANOUT - 1)
    others = others + (others >= slot[:, None])
    return full[run[:, None], others], held[run] - 1, slot


def fold(nodes: np.ndarray, at: np.ndarray, current: np.ndarray) -> np.ndarray:
    """The parents of ``current`` put in the place of the nodes at ``at``."""
    full, held = by_runs(nodes)
    run = at // FANOUT
    rows = full[run]
    rows[np.arange(len(at)), at % FANOUT] = current
    return hash_rows(rows.reshape(len(at), -1), held[run] * HEX)


def _texts(rows: np.ndarray) -> list[str]:
    data = rows.tobytes().decode("ascii")
    return [data[k : k + HEX] for k in range(0, len(data), HEX)]


def _path(tree: list[np.ndarray], m: int) -> list[list[dict]]:
    """Of each of the first level's nodes: per level the siblings before and after it, joined."""
    out: list[list[dict]] = [[] for _ in range(m)]
    at = np.arange(m)
    for nodes in tree[:-1]:
        others, count, slot = siblings(nodes, at)
        data, w = others.tobytes().decode("ascii", "replace"), (FANOUT - 1) * HEX
        for k, (c, s) in enumerate(zip(count.tolist(), slot.tolist(), strict=True)):
            out[k].append({"before": data[k * w : k * w + s * HEX], "after": data[k * w + s * HEX : k * w + c * HEX]})
        at = at // FANOUT
    return out


# ---- tasks: a group is one block


def _top(block: pa.Table) -> pa.Table:
    """A block's node of the next round."""
    block = block.sort_by("at")
    n, at = block["n"][0].as_py(), block["at"][0].as_py()
    tree = climb(matrix(block["digest"].to_pylist()), levels_within(n))
    return pa.table({"place": block["place"][:1], "at": pa.array([at // BLOCK], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": pa.array(_texts(tree[-1]), pa.string())})


def _paths(block: pa.Table, above: pa.Table) -> pa.Table:
    """(place, at, label, path, subroot, root) of a block's nodes, from those of the node above them."""
    block = block.sort_by("at")
    m = len(block)
    tree = climb(matrix(block["digest"].to_pylist()), levels_within(block["n"][0].as_py()) if m else 0)
    upper = above["path"][0].as_py() if m else []
    own = [p + upper for p in _path(tree, m)]
    same = lambda c: above[c].to_pylist() * m if m else []
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.table({"place": block["place"], "at": block["at"], "label": block["label"], "path": pa.array(own, kind), "subroot": pa.array(same("subroot"), pa.string()), "root": pa.array(same("root"), pa.string())})


def _prove(with_proof: bool):
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        m = len(block)
        nodes = matrix(block["digest"].to_pylist())
        tree = climb(nodes, levels_within(block["n"][0].as_py()) if m else 0)
        upper = above["path"][0].as_py() if m else []
        at, current, proofs = np.arange(m), matrix(block["seen"].to_pylist()), [hashlib.sha256() for _ in range(m)]
        for level in tree[:-1]:
            others, count, _ = siblings(level, at)
            data, w = others.tobytes(), (FANOUT - 1) * HEX
            for k, (p, c) in enumerate(zip(proofs, count.tolist(), strict=True)):
                p.update(data[k * w : k * w + c * HEX])
            current, at = fold(level, at, current), at // FANOUT
        rest = "".join(x["before"] + x["after"] for x in upper).encode()
        for p in proofs:
            p.update(rest)
        for x in upper:
            before, after = (np.frombuffer(x[c].encode(), np.uint8) for c in ("before", "after"))
            rows = np.concatenate([np.broadcast_to(before, (m, len(before))), current, np.broadcast_to(after, (m, len(after)))], axis=1)
            current = hash_rows(rows, np.full(m, rows.shape[1]))
        folded, root = _texts(current), above["root"][0].as_py() if m else None
        same = lambda c: pa.array(above[c].to_pylist() * m if m else [], pa.string())
        out = {"key": block["key"], "leaf": block["digest"], "subroot": same("subroot"), "root": same("root"), "proof_sha256": pa.array([p.hexdigest() for p in proofs], pa.string())}
        out |= {"folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())}
        if with_proof:
            out["proof"] = pa.array([p + upper for p in _path(tree, m)], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
        return pa.table(out)

    return run


# ---- tables


def leaf(fields: Sequence[Column]) -> Column:
    """H over fields of whole numbers or texts."""
    text = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*map(text, fields)).cast("binary"), 256)


def _placed(rows: DataFrame, order: Sequence[str], scratch: Scratch, tag: str) -> DataFrame:
    """Adds ``at``, a row's position in its ``place`` in this order, and ``n``, the place's rows.

    A sort by ranges numbers each partition's rows; how many rows of a place the partitions before hold comes
    from a table with a row for each place and partition that has rows of it.
    """
    ranged = rows.repartitionByRange("place", *order).sortWithinPartitions("place", *order).withColumn("row", F.monotonically_increasing_id())
    saved = scratch.save(ranged, tag).withColumn("part", F.shiftright("row", 33))
    parts = saved.groupBy("place", "part").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_first"))
    own = Window.partitionBy("place")
    parts = parts.select("place", "part", (F.sum("_n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    return saved.join(parts, ["place", "part"]).withColumn("at", F.col("row") + F.col("_shift")).drop("row", "part", "_shift")


def _rounds(nodes: DataFrame, scratch: Scratch, tag: str) -> list[DataFrame]:
    """Tables (place, at, n, digest) up to the one in which each place that is left has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        many = out[-1].where("n > 1").select("place", "at", "n", "digest").withColumn("block", F.expr(f"at div {BLOCK}"))
        tops = many.groupBy("place", "block").applyInArrow(_top, "place string, at long, n long, digest string")
        out.append(scratch.save(tops, f"{tag}-{len(out)}"))
    return out


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(place, digest): the last node of each place."""
    lone = [r.where("n = 1").select("place", "digest") for r in rounds]
    out = lone[0]
    for r in lone[1:]:
        out = out.unionByName(r)
    return out


def _down(rounds: list[DataFrame], tops: DataFrame, last, schema: str) -> DataFrame:
    """From each place's (place, path, subroot, root) down to the nodes of the first round, for which ``last`` gives the rows."""
    paths: DataFrame | None = None
    for k in range(len(rounds) - 1, -1, -1):
        ends = rounds[k].where("n = 1").select("place", "at").join(tops, "place")
        above = ends if paths is None else ends.unionByName(paths.select("place", "at", "path", "subroot", "root"))
        nodes = rounds[k].withColumn("block", F.expr(f"at div {BLOCK}"))
        if k and "label" not in nodes.columns:
            nodes = nodes.withColumn("label", F.lit(""))
        # names of their own: both sides may come of one table
        above = above.select(F.col("place").alias("_place"), F.col("at").alias("_block"), "path", "subroot", "root")
        pairs = nodes.groupBy("place", "block").cogroup(above.groupBy("_place", "_block"))
        paths = pairs.applyInArrow(last if not k else _paths, schema if not k else f"place string, at long, label string, path {_PATH}, subroot string, root string")
    return paths


def manifest(docs: DataFrame, seen: dict[str, Column] | None = None, with_proof: bool = False, group_col: str = "lang", key_col: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row and, if asked for, its proof.

    ``seen``: fields as a reader finds them now, if not as they were; folded_root is made from that leaf and the
    siblings of the original ones, and verified says whether it is the root. ``proof``: an array of the joined siblings
    before and after the row's node, level by level, through the subroot to the root.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    kind = docs.schema[key_col].dataType.simpleString()
    now = [(seen or {}).get(c, docs[c]) for c in fields]
    place = F.when(docs[group_col].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs[group_col].cast("string")))
    rows = docs.select(place.alias("place"), docs[key_col].alias("key"), leaf([docs[c] for c in fields]).alias("digest"), leaf(now).alias("seen"))
    # written, so that the sort's sample doesn't hash all texts once more
    rows = scratch.save(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    nodes = _placed(rows, ("key", "digest", "tie"), scratch, "placed").drop("tie")
    rounds = _rounds(nodes, scratch, "round")
    subroots = scratch.save(_tops(rounds), "subroots")
    groups = _placed(subroots.select(F.lit("").alias("place"), F.col("place").alias("label"), "digest"), ("label",), scratch, "groups")
    upper = _rounds(groups, scratch, "upper")
    root = _tops(upper).select("place", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    tops = _down(upper, root, _paths, f"place string, at long, label string, path {_PATH}, subroot string, root string")
    tops = tops.select(F.col("label").alias("place"), "path", "root").join(subroots.withColumnRenamed("digest", "subroot"), "place")
    tops = scratch.save(tops.select("place", "path", "subroot", "root"), "tops")
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", proof {_PATH}" * with_proof
    return _down(rounds, tops, _prove(with_proof), schema).withColumnRenamed("key", key_col)


def tampered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """Fields after someone lower-cased A-Z in the texts of the ids whose decimal CRC-32 3 divides; other ids, and NULL, stay."""
    hit = F.crc32(docs[id_col].cast("string").cast("binary")) % 3 == 0
    return {text_col: F.when(hit, F.translate(docs[text_col], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(docs[text_col])}


def oracle(deep: int = 8, groups_deep: int = 4) -> str:
    """SQL for ``manifest(documents, tampered(documents))``: levels unrolled, 8 ** deep rows a language pos most."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    plain = " || ".join(map(field, FIELDS))
    byte = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, (d & 1) * 3988292384))))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d0 AS (SELECT doc_id, lang, sha256({plain}) AS leaf, CASE WHEN ({crc}) % 3 = 0 THEN {lower} ELSE text END AS text, source, n_chars FROM documents)",
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, leaf, sha256({plain}) AS seen FROM d0)",
        "l0 AS (SELECT g, doc_id, seen, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d)",
    ]

    def up(first: str, prefix: str, levels: int) -> None:
        now = first
        for k in range(levels):
            parts.append(f"{prefix}r{k} AS (SELECT g, pos // 8 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {now} GROUP BY ALL)")
            now = f"{prefix}n{k}"
            parts.append(f"{now} AS (SELECT g, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 7) // 8 AS n FROM {prefix}r{k})")

    def along(frame: str, prefix: str, levels: int, group: str) -> str:
        """Adds to the path (p) and the folded value (f) of each row of ``frame`` the siblings of each level."""
        for k in range(levels):
            slot = f"(x.pos // {8**k}) % 8"
            before, after = f"array_to_string(r.hs[1:{slot}], '')", f"array_to_string(r.hs[{slot} + 2:], '')"
            parts.append(
                f"{frame}{k} AS (SELECT x.* REPLACE (CASE WHEN r.n > 1 THEN x.p || {before} || {after} ELSE x.p END AS p, CASE WHEN r.n > 1 THEN sha256({before} || x.f || {after}) ELSE x.f END AS f) "
                f"FROM {frame if not k else frame + str(k - 1)} x JOIN {prefix}r{k} r ON r.g = {group} AND r.run = x.pos // {8 ** (k + 1)})"
            )
        return f"{frame}{levels - 1}"

    up("l0", "a", deep)
    parts.append(f"s0 AS (SELECT '' AS g, g AS place, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM an{deep - 1})")
    up("s0", "b", groups_deep)
    parts.append("y AS (SELECT doc_id, g AS own, h AS leaf, pos, '' AS p, seen AS f FROM l0)")
    mid = along("y", "a", deep, "x.own")
    parts.append(f"w AS (SELECT m.doc_id, m.leaf, s.h AS subroot, s.pos AS pos, m.p, m.f FROM {mid} m JOIN s0 s ON s.place = m.own)")
    end = along("w", "b", groups_deep, "''")
    return "WITH " + ",\n".join(parts) + f"\nSELECT w.doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM {end} w, bn{groups_deep - 1} r"
