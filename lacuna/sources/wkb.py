"""Well-known binary to rings of points and back, for ingest.

The codec is the one step that column functions can't express; it runs once, in Arrow batches, on whole columns: the
geometries of a batch are read in step, each with a cursor of its own, so that a round parses one header or one count of
points for all of them, and coordinates move as one gather into flat buffers. There is no Python object for a vertex.

Read are points, lines, polygons, their multi forms and collections, of either byte order, with or without a reference
id, with extra dimensions, which are dropped. NULL stays NULL; a geometry cut short or of another kind is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..deploy import ship

_POINT, _LINE, _POLYGON, _MULTI_POINT, _COLLECTION = 1, 2, 3, 4, 7
RINGS = "array<array<struct<x:double,y:double>>>"
_BYTE, _WORD = np.arange(8), np.arange(4)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each start and the numbers that follow it, as often as its count says, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Cursors:
    """The bytes of a column and where each geometry is being read."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.at, self.ends = data, starts.astype(np.int64), ends
        self.big = np.zeros(len(starts), bool)

    def _need(self, rows: np.ndarray, n: np.ndarray | int) -> None:
        if (self.at[rows] + n > self.ends[rows]).any():
            raise ValueError("a geometry ends before its coordinates do")

    def order(self, rows: np.ndarray) -> None:
        self._need(rows, 5)
        self.big[rows] = self.data[self.at[rows]] == 0
        self.at[rows] += 1

    def word(self, rows: np.ndarray) -> np.ndarray:
        """The next unsigned 32-bit number of each of these rows."""
        self._need(rows, 4)
        four = self.data[self.at[rows][:, None] + _WORD].astype(np.int64)
        four[self.big[rows]] = four[self.big[rows]][:, ::-1]
        self.at[rows] += 4
        return four @ (1 << (8 * _WORD.astype(np.int64)))


def decode_column(column: pa.Array) -> pa.Array:
    """A binary array as an array of lists of lists of (x, y)."""
    n = len(column)
    size = 8 if pa.types.is_large_binary(column.type) else 4
    bounds = np.frombuffer(column.buffers()[1], np.int64 if size == 8 else np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    read = _Cursors(data, bounds[:-1], bounds[1:].astype(np.int64))
    parts = valid.astype(np.int64)  # geometries that are yet to come: a multi form has several
    rings, dims, lone = (np.zeros(n, np.int64) for _ in range(3))
    found: list[tuple[np.ndarray, ...]] = []
    while True:
        heads = np.flatnonzero((parts > 0) & (rings == 0))
        if len(heads):
            read.order(heads)
            code = read.word(heads)
            ided = heads[(code & 0x20000000) != 0]
            read.at[ided] += 4
            kind, thousand = (code & 0xFFFF) % 1000, (code & 0xFFFF) // 1000
            dims[heads] = 2 + ((code & 0x80000000) != 0) + ((code & 0x40000000) != 0) + np.select([thousand == 3, thousand > 0], [2, 1], 0)
            if bad := sorted({int(k) for k in kind[(kind < _POINT) | (kind > _COLLECTION)]}):
                raise ValueError(f"geometry kind {bad[0]} is not supported")
            parts[heads] -= 1
            many, areas = heads[kind >= _MULTI_POINT], heads[kind == _POLYGON]
            parts[many] += read.word(many)
            rings[areas] = read.word(areas)
            rings[heads[kind <= _LINE]] = 1
            lone[heads] = kind == _POINT
        rows = np.flatnonzero(rings > 0)
        if len(rows):
            counts = np.ones(len(rows), np.int64)
            counted = lone[rows] == 0
            counts[counted] = read.word(rows[counted])
            wide = dims[rows] * 8 * counts
            read._need(rows, wide)
            found.append((rows, read.at[rows].copy(), counts, dims[rows], read.big[rows]))
            read.at[rows] += wide
            rings[rows] -= 1
        elif not len(heads):
            break
    row, start, counts, width, big = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
    order = np.argsort(row, kind="stable")  # rings of a row were found in their order
    row, start, counts, width, big = (x[order] for x in (row, start, counts, width, big))
    place = _ranges(np.zeros_like(counts), counts)  # a point's number in its ring
    first = np.repeat(start, counts) + place * np.repeat(width, counts) * 8
    flip = np.repeat(big.astype(bool), counts)

    def coordinate(offset: int) -> pa.Array:
        eight = data[(first + offset)[:, None] + _BYTE] if len(first) else np.zeros((0, 8), np.uint8)
        eight[flip] = eight[flip][:, ::-1]
        return pa.array(np.ascontiguousarray(eight).view("<f8").reshape(-1))

    points = pa.StructArray.from_arrays([coordinate(0), coordinate(8)], ["x", "y"])
    ring_ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    own = np.concatenate([[0], np.cumsum(np.bincount(row.astype(np.int64), minlength=n))]).astype(np.int32)
    outer = pa.array(own, pa.int32(), mask=np.append(~valid, False)) if n and not valid.all() else pa.array(own, pa.int32())
    return pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(ring_ends, pa.int32()), points))


def encode_column(column: pa.Array, kind: int = _POLYGON) -> pa.Array:
    """Lists of rings as little-endian points, lines (of the first ring) or polygons."""
    n = len(column)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    inner = column.flatten()
    rings_of = np.diff(column.offsets.to_numpy()) * valid
    counts = np.diff(inner.offsets.to_numpy()) if len(inner) else np.zeros(0, np.int64)
    points = inner.flatten()
    xy = np.stack([points.field(k).to_numpy() for k in (0, 1)], axis=1) if len(points) else np.zeros((0, 2))
    if kind != _POLYGON and (rings_of[valid] != 1).any():
        raise ValueError("a point or line has one ring")
    if kind == _POINT and (counts != 1).any():
        raise ValueError("a point has one vertex")
    ring_head = 0 if kind == _POINT else 4
    head = 5 + 4 * (kind == _POLYGON)
    ring_bytes = ring_head + 16 * counts.astype(np.int64)
    of_ring = np.repeat(np.arange(n), rings_of)
    sizes = head * valid + np.bincount(of_ring, ring_bytes, minlength=n).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    word = lambda at, values: out.__setitem__(at[:, None] + _WORD, np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4))
    own = starts[valid]
    out[own] = 1
    word(own + 1, np.full(len(own), kind))
    if kind == _POLYGON:
        word(own + 5, rings_of[valid])
    before = np.cumsum(ring_bytes) - ring_bytes
    first_of = np.zeros(n, np.int64)
    first_of[rings_of > 0] = before[(np.cumsum(rings_of) - rings_of)[rings_of > 0]]
    ring_at = starts[of_ring] + head + before - first_of[of_ring]
    if ring_head:
        word(ring_at, counts)
    at = _ranges((ring_at + ring_head), 16 * counts.astype(np.int64))
    out[at] = np.ascontiguousarray(xy.astype("<f8")).view(np.uint8).reshape(-1)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    mask = None if valid.all() else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), n, [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def decode(data: bytes) -> list[list[tuple[float, float]]]:
    """One geometry's rings, lines or points, in order."""
    return [[(p["x"], p["y"]) for p in ring] for ring in decode_column(pa.array([data], pa.binary()))[0].as_py()]


def encode(rings: list[list[tuple[float, float]]], kind: int = _POLYGON) -> bytes:
    """One little-endian point, line or polygon."""
    kinds = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    return encode_column(pa.array([[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]], kinds), kind)[0].as_py()


def _mapped(df: DataFrame, column: str, kind: str, change) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([change(b.column(k)) if k == at else b.column(k) for k in range(b.num_columns)], b.schema.names)

    out = df.mapInArrow(run, ", ".join(f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in df.schema))
    for f in df.schema:  # such as a reference system
        out = out.withMetadata(f.name, f.metadata) if f.metadata else out
    return out


def with_rings(df: DataFrame, column: str = "geometry") -> DataFrame:
    """The WKB column replaced by its rings."""
    return _mapped(df, column, RINGS, decode_column)


def with_wkb(df: DataFrame, column: str = "geometry", kind: int = _POLYGON) -> DataFrame:
    """The column of rings replaced by WKB."""
    return _mapped(df, column, "binary", lambda c: encode_column(c, kind))
