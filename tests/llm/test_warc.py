"""WARC: byte round trip, resolution against brute force and SQL."""

import gzip
import io
import random

import pytest
from oracle import same

from lacuna.llm import queries
from lacuna.llm import warc as W


def test_round_trip(spark, tmp_path):
    want, data, packed = [], b"", b""
    for i in range(25):
        kind = "revisit" if i % 4 == 3 else "response"
        body = None if kind == "revisit" else (b"\r\n\r\nWARC/1.1 \xff" * i)
        rec = W.write_record(f"urn:{i}", f"http://h/{i}", f"2026-01-01T00:00:{i:02d}Z", kind, 304 if body is None else 200, {"etag": f'"{i}"', "vary": "a"}, body)
        data += rec
        packed += gzip.compress(rec)
        want.append((f"urn:{i}", f"http://h/{i}", 1767225600_000000 + i * 1_000_000, kind, 304 if body is None else 200, {"etag": f'"{i}"', "vary": "a"}, body or b""))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(packed)
    for name in ("a.warc", "b.warc.gz"):
        got = [tuple(r) for r in W.read_warc(spark, str(tmp_path / name)).collect()]
        assert [(*g[:6], bytes(g[6])) for g in got] == want


def test_malformed_records_end_nothing(spark, tmp_path):
    good = [W.write_record(f"urn:{i}", f"http://h/{i}", "2026-01-01T00:00:00Z", "response", 200, {}, b"x") for i in range(3)]
    no_length = b"WARC/1.1\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: many\r\n\r\n"
    assert [r[3] for r in W.read_records(io.BytesIO(b"junk\r\n"))] == ["malformed"]
    assert [r[0] for r in W.read_records(io.BytesIO(good[0] + b"junk\r\nmore\r\n" + good[1] + no_length + good[2]))] == ["urn:0", None, "urn:1", None, "urn:2"]
    assert [r[3] for r in W.read_records(io.BytesIO(good[0] + good[1][:-20]))] == ["response", "malformed"]
    (tmp_path / "a.warc").write_bytes(b"".join(good))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good[0]) + b"\x1f\x8b broken")
    kinds = sorted(r["type"] for r in W.read_warc(spark, str(tmp_path)).collect())
    assert kinds == ["malformed"] + ["response"] * 4


@pytest.mark.parametrize("a,b", [("http://www.A.com:80/x/?utm_source=f&b=1#t", "https://a.com/x?b=1"), ("http://a.com/", "http://a.com"), ("http://a.com/x?ref=q&utm_medium=z", "http://A.com/x/")])
def test_canonical(spark, a, b):
    df = spark.createDataFrame([(a,), (b,)], "url string").select(W.canonical("url").alias("c"))
    x, y = (r.c for r in df.collect())
    assert x == y


def records(r, n):
    out = []
    for i in range(n):
        url = r.choice(["http://hot/", "http://hot/", "http://www.hot", "http://b/x", f"http://c/{i}", None])
        kind = r.choice(["response", "revisit", "revisit", "request"])
        status = r.choice([200, 200, 200, 404]) if kind == "response" else 304
        headers = {k: r.choice("pq") for k in ("etag", "last-modified", "vary", "server") if r.random() < 0.5}
        out.append((f"r{i:04d}", url, r.choice([None, *range(40)]) if r.random() < 0.1 else r.randrange(40), kind, status, headers, None if kind == "revisit" else f"body{i}".encode()))
    return out


def brute(rows):
    out = {}
    name = lambda u: u and u.replace("http://", "").replace("www.", "").rstrip("/")
    for rid, url, ts, kind, status, headers, body in rows:
        best = None
        if kind == "revisit" and url and ts is not None:
            before = [x for x in rows if x[1] and name(x[1]) == name(url) and x[2] is not None and x[3] == "response" and x[4] == 200 and (x[2], x[0]) < (ts, rid)]
            best = max(before, key=lambda x: (x[2], x[0]), default=None)
        full = kind == "response" and status == 200 and url and ts is not None
        verdict = "full" if full else "other" if kind != "revisit" else "orphan" if best is None else "unverified"
        if best:
            for v in ("etag", "last-modified"):
                if v in headers and v in best[5]:
                    verdict = "resolved" if headers[v] == best[5][v] else "mismatch"
                    break
        if verdict in ("resolved", "unverified"):
            out[rid] = (verdict, best[0], best[6], best[5] | {k: v for k, v in headers.items() if k in W.PERMITTED})
        else:
            out[rid] = (verdict, None, body, headers)
    return out


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_against_brute_force(spark, slices):
    rows = records(random.Random(slices), 300)
    got = W.resolve(spark.createDataFrame(rows, W.SCHEMA), slices).collect()
    assert len(got) == len(rows)
    assert {g.record_id: (g.verdict, g.refers_to, g.payload and bytes(g.payload), g.headers) for g in got} == brute(rows)


def test_pages_against_sql(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.choice(["http://a.com/x", "https://www.a.com/x/?utm_a=1", "http://b.com/?p=1&ref=x#f", f"http://c.com/{i}", None]), r.choice(["<p>1", "<p>2", None, ""])) for i in range(300)]
    same(spark, queries.op10_warc_revisits, W.ORACLE, {"pages": spark.createDataFrame(rows, "page_id long, url string, html string")}, tmp_path)


def test_nulls_empty_repeats_and_other_columns(spark):
    assert W.resolve(spark.createDataFrame([], W.SCHEMA)).count() == 0
    rows = [(None, "http://a", 1, "response", 200, None, b"x"), ("a", "http://a", 1, None, None, None, None), ("b", "http://a", 2, "revisit", 304, None, None), ("c", "http://a", 3, "response", 200, None, b"y"), ("d", "http://a", 4, "revisit", 304, None, None), ("d", "http://a", 4, "revisit", 304, None, None)]
    got = W.resolve(spark.createDataFrame([(*x, "z") for x in rows], W.SCHEMA + ", canonical string")).collect()
    assert sorted((str(g.record_id), g.verdict) for g in got) == [("None", "other"), ("a", "other"), ("b", "orphan"), ("c", "full"), ("d", "unverified"), ("d", "unverified")]
