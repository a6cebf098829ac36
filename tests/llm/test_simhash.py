"""SimHash, Golay keys and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lacuna.llm import simhash as S
from lacuna.llm.common import Scratch
from lacuna.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    w = [x for x in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if x]
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, linked):
    root = {i: i for i in ids}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "One", "A b C", "a b c d", "É x  y\tz\nw ÀB q", "the cat " * 70_000, "Ünï cödé tEXT with more words than four"])
def test_fingerprint(text):
    assert S.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_every_pair_within_four_bits_shares_a_key():
    r = random.Random(3)
    x = np.array([r.getrandbits(64) for _ in range(4000)], dtype=np.uint64)
    y = np.array([int(v) ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for v in x], dtype=np.uint64)
    keys = [set() for _ in range(8000)]
    for off, fp in ((0, x), (4000, y)):
        for row, key in zip(*S.golay_keys(fp), strict=True):
            keys[off + row].add(int(key))
    assert all(keys[i] & keys[4000 + i] for i in range(4000))
    assert max(map(len, keys)) <= 50


def test_segment_indices_share_at_two_bits_exhaustively():
    r = random.Random(4)
    for v in [0, (1 << 23) - 1, *(r.getrandbits(23) for _ in range(40))]:
        near = [v] + [v ^ 1 << a for a in range(23)] + [v ^ 1 << a ^ 1 << b for a in range(23) for b in range(a)]
        got = S.indices(np.array(near))
        own = set(got[0].tolist()) - {-1}
        assert all(own & set(g) for g in got.tolist())


@pytest.mark.parametrize("bucket", [2048, 16])
def test_components_with_dense_groups(spark, bucket):
    r = random.Random(bucket)
    fps = [r.getrandbits(64) for _ in range(200)]
    for centre in fps[:3]:
        fps += [centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for _ in range(150)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    linked = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    want = components(fps, linked)
    scratch = Scratch(spark, "test")
    links = S.hamming_links(spark.createDataFrame([(f,) for f in fps], "fp long"), scratch, bucket=bucket)
    got = {r.node: r.component for r in connected_components(links, scratch).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_near_duplicates_whole(spark):
    r = random.Random(9)
    vocabulary = ["w%d" % i for i in range(500)]
    rows = []
    for i in range(60):
        w = r.choices(vocabulary, k=r.randrange(1, 300))
        rows.append((i * 3, " ".join(w)))
        if i % 4 == 0:
            w[r.randrange(len(w))] = "other"
            rows.append((i * 3 + 1, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t"), (3, rows[2][1].upper()), (3, rows[2][1]), (None, "lonely text here now"), (None, None)]
    got = S.digest(S.near_duplicates(spark.createDataFrame(rows, SCHEMA))).collect()
    fp = [slow_fingerprint(t) for _, t in rows]
    comp = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    least = {}
    for i, (d, _) in enumerate(rows):
        least[comp[i]] = min((x for x in (least.get(comp[i]), d) if x is not None), default=None)
    want = [(d, f"{fp[i]:016x}", least[comp[i]]) for i, (d, _) in enumerate(rows)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table_and_other_columns(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "abc", 5, 6)], "doc_id long, text string, fp long, id int")
    assert S.digest(S.near_duplicates(odd)).collect()[0].component_id == 1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_blocks_give_the_same_groups(spark):
    r = random.Random(13)
    w = ["".join(r.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = [(i, " ".join([*w[:i], f"x{i}", *w[i + 1 :]])) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = keepers(docs)
    assert len(set(whole.values())) == 1 and len(whole) == 60
    assert keepers(docs, bucket=7) == whole


def test_repeated_rows_and_ids(spark):
    """Repeated rows are copies; rows that share an id only are not."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (1, one), (1, two), (None, one), (None, two), (7, None), (7, ""), (None, None)]
    kept = sorted(((r.doc_id, r.text) for r in S.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert [k for k in kept if k[0] == 1] == [(1, one), (1, two)] and len(kept) == 3 and kept[-1][0] == 7


def test_keep_one_drops_near_copies_only(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(2, 8)))
    rows, copies = [], set()
    for i in range(80):
        w = [word() for _ in range(r.randrange(150, 400))]
        rows.append((i * 10, " ".join(w), "en"))
        for k in range(r.choice([0, 0, 1, 3])):
            other = list(w)
            other[r.randrange(len(w))] = word()
            rows.append((i * 10 + k + 1, " ".join(other), "en"))
            copies.add(i * 10 + k + 1)
        if i % 5 == 0:  # half of it is other text: not a copy
            rows.append((i * 10 + 9, " ".join(w[: len(w) // 2] + [word() for _ in range(len(w) // 2)]), "en"))
    rows += [(2000, None, None), (2001, "", None), (None, "a b", None), (2002, "x" * 200_000, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", _key string")
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept == {r[0] for r in rows} - copies - {2001}
    assert S.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_estimates_jaccard():
    r = random.Random(12)
    a = np.array([r.getrandbits(64) for _ in range(2000)], dtype=np.uint64)
    b = np.concatenate([a[:1600], np.array([r.getrandbits(64) for _ in range(400)], dtype=np.uint64)])
    x, y = (np.frombuffer(S.sketch(h), np.uint16)[None] for h in (a, b))
    assert S.estimate(x, y)[0] == pytest.approx(1600 / 2400, abs=0.1)
    none = np.frombuffer(S.sketch(a[:0]), np.uint16)[None]
    assert S.estimate(x, x)[0] == 1 and S.estimate(none, none)[0] == 1 and S.estimate(x, none)[0] == 0


def test_pairs_near_the_threshold_are_settled_exactly():
    r = random.Random(19)
    word = lambda: "".join(r.choices("abcdefghij", k=7))
    seen = set()
    for share in (0.020, 0.021, 0.022, 0.023, 0.024, 0.025) * 10:
        w = [word() for _ in range(1500)]
        other = list(w)
        for i in r.sample(range(1500), round(share * 1500)):
            other[i] = word()
        texts = [" ".join(w), " ".join(other)]
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(1496)} for t in texts)
        want = len(x & y) / len(x | y) >= 0.8
        seen.add(want)
        sets = [S.shingle_set(t, 5) for t in texts]
        pair = pa.RecordBatch.from_pydict({"a": pa.array([None, 1], pa.int64()), "b": [0, 0], "own": [x.tobytes() for x in sets]})
        assert sum(b.num_rows for b in S._settled(0.8)(iter([pair]))) == want
        looks = [S.sketch(h) for h in sets]
        told = next(S._told(iter([pa.RecordBatch.from_pydict({"a": [1], "b": [0], "x": looks[:1], "y": looks[1:]})])))
        assert told.to_pydict() == {"a": [1], "b": [0], "sure": [False]}  # left to the full sets
    assert seen == {True, False}


def test_signatures_rule_out_pairs_by_proof():
    """Never a pair at its similarity; nearly all pairs of short texts that are clearly below 0.8, which sketches leave open."""
    r = np.random.default_rng(23)
    new = lambda n: np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
    low = 0
    for n in (1, 3, 31, 33, 350, 500, 3000, 40_000):
        for share in (0.0, 0.1, 0.5, 0.6, 0.79, 0.8, 0.81, 1.0):
            both, a, b = new(int(n * share)), new(int(n * (1 - share) / 2)), new(int(n * (1 - share)))
            a, b = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            at_most = S.at_most(S.signature(a), S.signature(b), len(a), len(b))
            assert S.jaccard(a, b) <= at_most <= 1
            assert at_most == S.at_most(S.signature(b), S.signature(a), len(b), len(a))
            low += n == 350 and share <= 0.6 and at_most < 0.8
    assert low == 4 and S.filled(S.sketch(new(350))) == b"" and S.filled(S.sketch(new(3000)))
    # widths that differ, one set within the other
    a = new(600)
    assert S.at_most(S.signature(a), S.signature(a[:100]), 600, 100) >= 1 / 6
    assert S.at_most(b"", S.signature(a), 0, 600) == 0 and S.at_most(S.signature(a[:0]), S.signature(a[:0]), 0, 0) == 1


def test_clear_pairs_of_short_texts_need_no_sets():
    """Texts of 350 words that share a third: ruled out before any text or set is read again."""
    r = random.Random(24)
    text = lambda n: [str(r.getrandbits(40)) for _ in range(n)]
    line = text(120)
    rows = [(i, " ".join([*line, *text(230)])) for i in range(2)] + [(2, " ".join(line))]
    sets = [S.shingle_set(t, 5) for _, t in rows]
    pairs = [(1, 0), (2, 0), (2, 1), (2, 2)]
    look = lambda k, f: [f(sets[p[k]]) for p in pairs]
    full = lambda h: S.filled(S.sketch(h))
    batch = {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs], "x": look(0, full), "y": look(1, full), "p": look(0, S.signature), "q": look(1, S.signature), "n": look(0, len), "m": look(1, len)}
    told = pa.Table.from_batches(S._judged(0.8)(iter([pa.RecordBatch.from_pydict(batch)])))
    assert told.to_pydict() == {"a": [2], "b": [2], "sure": [False]}


def keepers(docs, **more):
    """id -> the keeper's id, for rows in groups."""
    rows, told = S.near_copies(docs, **more)
    ids = {r.row: r.id for r in rows.select("row", "id").collect()}
    return {ids[r.row]: ids[r.keeper] for r in told.collect()}


def groups_of(rows, similarity=0.8, size=5):
    """Brute force: text index -> least index of its component."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    return components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if like(sets[i], sets[j]) >= similarity])


def test_no_pair_at_the_threshold_is_missed_and_none_below_goes(spark):
    """Copies with several edits, close to 0.8 on both sides, from 50 words to several thousand."""
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(3, 9)))
    rows = []
    for length, many in ((50, 60), (120, 60), (300, 40), (1000, 30), (4000, 12)):
        for _ in range(many):
            w = [word() for _ in range(length)]
            rows.append((len(rows), " ".join(w)))
            for share in (0.018, 0.021, 0.023, 0.025, 0.028):
                other = list(w)
                for i in r.sample(range(length), max(1, round(share * length))):
                    other[i] = word()
                if r.random() < 0.3:
                    rows.append((len(rows), " ".join(other)))
    want = groups_of(rows)
    assert 100 < sum(i != c for i, c in want.items()) and 100 < len(set(want.values())) < len(rows)
    kept = {x.doc_id for x in S.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(want.values())


def test_groups_do_not_depend_on_the_word_fingerprints(spark, monkeypatch):
    """Pairs that no fingerprint links are found by their prefixes, hot shingles included."""
    r = random.Random(18)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    line = [word() for _ in range(40)]
    rows = []
    for _ in range(40):
        w = [*line, *(word() for _ in range(r.randrange(5, 200)))]
        rows.append((len(rows), " ".join(w)))
        w[r.randrange(len(w))] = word()
        rows.append((len(rows), " ".join(w)))
    want = groups_of(rows)
    monkeypatch.setattr(S, "hamming_links", lambda fps, scratch, *a, **k: spark.createDataFrame([], "a long, b long, space long"))
    for bucket, hub, miss in ((512, 1024, S.MISS), (7, 1, 0.0)):
        monkeypatch.setattr(S, "HUB", hub)
        assert keepers(spark.createDataFrame(rows, SCHEMA), bucket=bucket, miss=miss) == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}


def test_prefixes_of_similar_sets_meet():
    """At the threshold, with common shingles on both sides; the longer prefixes are the complete ones."""
    r, none = np.random.default_rng(20), np.zeros(0, np.uint64)
    new = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    for n in (1, 4, 5, 9, 40, 400, 4000):
        for usual in (0.0, 0.3, 0.7, 0.9, 1.0):
            for _ in range(20):
                both = np.unique(new(n))
                more = new(int(n * 0.25))  # the union is 1.25 n
                mine = r.random(len(more)) < 0.5
                a, b = np.unique(np.concatenate([both, more[mine]])), np.unique(np.concatenate([both, more[~mine]]))
                assert S.jaccard(a, b) >= 0.8
                common = np.sort(r.choice(both, int(usual * n), replace=False))
                x, y = (S.prefix(s, 0.8, common, np.full(len(common), 3)) for s in (a, b))
                assert len(np.intersect1d(x, y))
                assert len(S.prefix(a, 0.8, none, none)) <= 18
                full = len(a) - int(np.ceil(0.8 * len(a) - 1e-9)) + 1
                assert len(S.prefix(a, 0.8, common, np.full(len(common), 3), 0.0)) == full
