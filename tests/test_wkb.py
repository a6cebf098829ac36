"""The WKB codec on columns against a plain recursive reader."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.functions import planar
from lacuna.sources import wkb


def made(r, kind, big, dims, ided, depth=0):
    """(bytes, rings) of a random geometry."""
    o = ">" if big else "<"
    code = kind + {0: 0, 1: 1000, 2: 2000, 3: 3000}[dims] if not ided else kind | 0x20000000 | (0x80000000 if dims in (1, 3) else 0) | (0x40000000 if dims in (2, 3) else 0)
    n_dims = 2 + {0: 0, 1: 1, 2: 1, 3: 2}[dims]
    head = struct.pack(o + "BI", not big, code) + (struct.pack(o + "I", 4326) if ided else b"")

    def points(n):
        p = [tuple(r.uniform(-180, 180) for _ in range(n_dims)) for _ in range(n)]
        return struct.pack(f"{o}{n * n_dims}d", *(v for q in p for v in q)), [q[:2] for q in p]

    if kind == 1:
        b, p = points(1)
        return head + b, [p]
    if kind == 2:
        n = r.randrange(5)
        b, p = points(n)
        return head + struct.pack(o + "I", n) + b, [p]
    if kind == 3:
        n = r.randrange(4)
        out, rings = head + struct.pack(o + "I", n), []
        for _ in range(n):
            k = r.randrange(6)
            b, p = points(k)
            out, rings = out + struct.pack(o + "I", k) + b, [*rings, p]
        return out, rings
    n = r.randrange(4)
    out, rings = head + struct.pack(o + "I", n), []
    for _ in range(n):
        own = {4: 1, 5: 2, 6: 3}.get(kind) or r.choice([1, 2, 3, 6] if depth else [1, 2, 3, 4, 7])
        b, q = made(r, own, r.random() < 0.5, r.randrange(4), r.random() < 0.3, depth + 1)
        out, rings = out + b, rings + q
    return out, rings


@pytest.mark.parametrize("seed", range(4))
def test_random_geometries(seed):
    r = random.Random(seed)
    given = [(None, None) if r.random() < 0.1 else made(r, r.randrange(1, 8), r.random() < 0.5, r.randrange(4), r.random() < 0.3) for _ in range(300)]
    column = pa.array([b for b, _ in given], pa.binary())
    for part, want in ((column, given), (column.slice(37, 150), given[37:187]), (column.slice(0, 0), []), (column.cast(pa.large_binary()), given)):
        got = wkb.decode_column(part).to_pylist()
        assert [None if g is None else [[(p["x"], p["y"]) for p in ring] for ring in g] for g in got] == [rings for _, rings in want]


def test_encode_and_back():
    r = random.Random(9)
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    shapes = [None if r.random() < 0.2 else [[{"x": r.random(), "y": r.random()} for _ in range(r.randrange(5))] for _ in range(r.randrange(4))] for _ in range(200)]
    column = pa.array(shapes, kind)
    assert wkb.decode_column(wkb.encode_column(column)).to_pylist() == shapes
    assert wkb.decode_column(wkb.encode_column(column.slice(20, 60))).to_pylist() == shapes[20:80]
    lines = [None, [[{"x": 1.0, "y": 2.0}] * 3], [[]]]
    assert wkb.decode_column(wkb.encode_column(pa.array(lines, kind), 2)).to_pylist() == lines
    assert wkb.encode([[(1.5, -2.0)]], 1) == struct.pack("<BIdd", 1, 1, 1.5, -2.0)
    assert wkb.encode([[(0, 1), (2, 3)]]) == struct.pack("<BIIIdddd", 1, 3, 1, 2, 0, 1, 2, 3)
    with pytest.raises(ValueError):
        wkb.encode([[(0, 0), (1, 1)]], 1)
    with pytest.raises(ValueError):
        wkb.encode([], 2)


@pytest.mark.parametrize("bad", [b"\1\3\0\0", struct.pack("<BIII", 1, 3, 1, 5) + b"\0" * 32, struct.pack("<BI", 1, 99), struct.pack("<BII", 1, 2, 4_000_000_000), b""])
def test_broken_geometries_are_errors(bad):
    with pytest.raises(ValueError):
        wkb.decode(bad)


def test_columns_of_a_frame(spark):
    square = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]
    df = spark.createDataFrame([(1, bytearray(wkb.encode(square)), "a"), (2, None, None)], "id int, geometry binary, name string")
    rings = wkb.with_rings(df)
    assert rings.columns == df.columns
    back = wkb.with_wkb(rings).orderBy("id").collect()
    assert bytes(back[0].geometry) == wkb.encode(square) and back[1].geometry is None and back[0].name == "a"
    assert tuple(rings.select(planar.box_of_rings(F.col("geometry")).alias("b")).where("b.xmin IS NOT NULL").first().b) == (0, 4, 0, 4)
