"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A fingerprint is the majority of its shingles' 64-bit hashes, bit by bit. Two fingerprints link at
``max_bits`` (4) or fewer differing bits. Candidates share a key:

* 64 bits are two segments G1, G2 of 23 bits and a rest R of 18. A segment with its parity bit is a
  word of even weight; the extended binary Golay code has one codeword within distance 2 of it, or
  else exactly six at distance 4. The 12-bit indices of these are the segment's indices. Words that
  differ in at most two data bits share an index (two bits more move a word within its sextet).
* 4 errors over (G1, G2, R): if R has none, G1 or G2 has two at most: keys (R, index of G1) and
  (R, index of G2). Otherwise G1 and G2 have three together: two at most in each, key (index of G1,
  index of G2), or three and none, key G1 or G2 itself. That is up to 50 keys, about 41 on average,
  and no linked pair is missed.

Equal fingerprints are one row from the start, so exact copies cost nothing. Keys are counted first;
a key with more than ``bucket`` fingerprints is cut into blocks and each pair of blocks is its own
task, so that no task holds more than two blocks. Within a bucket all pairs are compared, vectorised,
but only links from each fingerprint to the least one it reaches there leave it; components are the
same as with all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered
from .components import connected_components

#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR = 0b110001110101
_LONG = pa.int64()
#: Shingles that are hashed at a time.
_BLOCK = 1 << 16


# ---- fingerprints


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def shingle_hashes(w: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than ``size`` make one shingle, none make none."""
    if not w:
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(w))
    line = b" ".join(w)
    ends = list(accumulate((len(x) + 1 for x in w), initial=-1))
    h = xxhash.xxh64_intdigest
    out = [h(line[s + 1 : e], seed) for s, e in zip(ends, ends[size:], strict=False)]
    return np.array(out, dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint: bits that over half the hashes have; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[s : s + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The SimHash of whole word shingles, as a signed 64-bit number."""
    return majority(shingle_hashes(words(text), size, seed))


# ---- Golay keys


def _remainder(x: np.ndarray) -> np.ndarray:
    """Of 23-bit words as polynomials, divided by the generator: 11 bits."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (_GENERATOR << (bit - 11))
    return x


@cache
def _leaders() -> np.ndarray:
    """For each syndrome the lightest even errors of 24 bits: one, or the six tetrads of a sextet; -1 fills up."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in (0, 2, 4):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(24), weight)], dtype=np.int64)
        for s, e in zip(_remainder(errors >> 1).tolist(), errors.tolist(), strict=True):
            if not found[s] or found[s][0].bit_count() == weight:
                found[s].append(e)
    return np.array([f + [-1] * (6 - len(f)) for f in found], dtype=np.int64)


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 and the lower 11 bits' words; they add up to that of the whole."""
    return _remainder(np.arange(1 << 12, dtype=np.int64) << 11), np.arange(1 << 11, dtype=np.int64)


def indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords nearest to 23-bit words; -1 where there are fewer."""
    segment = segment.astype(np.int64)
    upper, lower = _syndromes()
    leaders = _leaders()[upper[segment >> 11] ^ lower[segment & 2047]]
    even = (segment << 1) | (np.bitwise_count(segment) & 1)
    return np.where(leaders < 0, -1, (even[:, None] ^ leaders) >> 12)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of unsigned fingerprints."""
    fp = fp.astype(np.uint64)
    g1, g2, r = ((fp >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    i1, i2 = indices(g1), indices(g2)
    kind = lambda k, key, ok: np.where(ok, (np.int64(k) << 40) | key, -1)
    keys = np.concatenate(
        [
            kind(1, r[:, None] << 12 | i1, i1 >= 0),
            kind(2, r[:, None] << 12 | i2, i2 >= 0),
            kind(3, (i1[:, :, None] << 12 | i2[:, None, :]).reshape(len(fp), 36), ((i1[:, :, None] >= 0) & (i2[:, None, :] >= 0)).reshape(len(fp), 36)),
            kind(4, g1, True)[:, None],
            kind(5, g2, True)[:, None],
        ],
        axis=1,
    )
    row, at = np.nonzero(keys >= 0)
    return row, keys[row, at]


# ---- candidates and links


#: Keys have fewer bits than this; the number of the space stands above them.
_SPACE = 45


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, space = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "space"))
        for s in range(0, len(fp), 4096):
            row, key = golay_keys(fp[s : s + 4096].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(space[s : s + 4096][row] << _SPACE | key, _LONG), pa.array(fp[s : s + 4096][row], _LONG)], ["key", "fp"])


def reached(x: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint of a bucket the index of the first one that links reach from it."""
    label = np.arange(len(x))
    while True:
        new = label.copy()
        for s in range(0, len(x), 256):
            near = np.bitwise_count(x[s : s + 256, None] ^ x[None, :]) <= max_bits
            new[s : s + 256] = np.where(near, label[None, :], len(x)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def small_pairs(x: np.ndarray, group: np.ndarray, max_bits: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of the same group, compared at each distance up to the widest group's."""
    left, right = [], []
    for d in range(1, widest):
        if len(x) <= d:
            break
        at = np.flatnonzero((group[d:] == group[:-d]) & (np.bitwise_count(x[d:] ^ x[:-d]) <= max_bits))
        left.append(at)
        right.append(at + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


#: Buckets up to this size are compared many at a time.
_SMALL = 48


def _stars(x: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups of sorted rows, each row with the first that it reaches."""
    start = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(group)))
    many = np.repeat(size > _SMALL, size)
    at = np.flatnonzero(~many & np.repeat(size > 1, size))
    label = np.arange(len(x))
    if len(at):
        i, j = small_pairs(x[at], group[at], max_bits, int(size[size <= _SMALL].max()))
        i, j = at[i], at[j]
        while True:
            new = label.copy()
            np.minimum.at(new, j, label[i])
            np.minimum.at(new, i, label[j])
            new = new[new]
            if (new == label).all():
                break
            label = new
    for s, n in zip(start[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True):
        label[s : s + n] = s + reached(x[s : s + n], max_bits)
    at = np.flatnonzero(label != np.arange(len(x)))
    return at, label[at]


def _link(max_bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last group of a batch waits for the next."""
        key, fp = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

        def done(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum((np.diff(key, axis=0, prepend=key[:1]) != 0).any(axis=1)) if len(key) else np.zeros(0, np.int64)
            i, j = _stars(fp, group, max_bits)
            x = fp.view(np.int64)
            pairs = np.unique(np.stack([np.maximum(x[i], x[j]), np.minimum(x[i], x[j]), key[i, 0] >> _SPACE], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k], _LONG) for k in range(3)], ["a", "b", "space"])

        for b in batches:
            k = np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("key", "sub")], axis=1)
            key, fp = np.concatenate([key, k]), np.concatenate([fp, b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key) < 20_000:
                continue
            cut = len(key) - int(np.argmax((key[::-1] != key[-1]).any(axis=1))) if (key != key[-1]).any() else 0
            if cut:
                yield done(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield done(key, fp)

    return run


def _dealt(rows: DataFrame, hot: DataFrame, key: str, member: str, bucket: int) -> DataFrame:
    """Rows with a column ``sub``, dealt and sorted by (key, sub). A hot key's members are cut into blocks of about ``bucket``
    by a hash, and each pair of blocks is a ``sub`` of its own; other keys have one."""
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), member), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j).cast("long") * blocks + F.greatest(own, j))
    out = rows.join(hot, key, "left").select(*rows.columns, F.explode(F.coalesce(pair, F.array(F.lit(0).cast("long")))).alias("sub"))
    return out.repartition(key, "sub").sortWithinPartitions(key, "sub", member)


def hamming_links(fps: DataFrame, scratch: Scratch, max_bits: int = 4, bucket: int = 2048, tag: str = "links") -> DataFrame:
    """Links (a, b, space) between distinct fingerprints (column fp) at ``max_bits`` or fewer differing bits.

    A column ``space``, if there is one, holds small whole numbers: only fingerprints of one space link.

    Each is a star: a fingerprint with the least it reaches in a shared bucket, enough for components.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys find up to 4 differing bits")
    spaced = fps.select("fp", F.col("space").cast("long") if "space" in fps.columns else F.lit(0).cast("long").alias("space"))
    keys = spaced.mapInArrow(_emit_keys, "key long, fp long")
    hot = scratch.save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket), f"{tag}-hot")
    return _dealt(keys, hot, "key", "fp", bucket).mapInArrow(_link(max_bits), "a long, b long, space long")


def _fingerprints(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([fingerprint(t, size, seed) for t in b["text"].to_pylist()], _LONG)], ["id", "fp"])

    return run


def near_duplicates(docs: DataFrame, size: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp (signed), component (the least id linked to it over any links, itself included).

    Null and blank texts have fingerprint zero and link like any other. Rows that repeat an id each
    get a row. A null id is never a component unless all its linked rows have null ids. Other columns
    are not read. Equal fingerprints are linked, at no cost in pairs.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    id_type = docs.schema[id_col].dataType.simpleString()
    own = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(size, 42), f"id {id_type}, fp long"), "own")
    fps = scratch.save(own.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    links = hamming_links(fps.select("fp"), scratch, max_bits).select("a", "b")
    groups = connected_components(links, scratch).withColumnRenamed("node", "fp")
    whole = fps.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("component"))
    told = scratch.save(whole.join(least, "root").select("fp", "component"), "told")
    return own.join(told, "fp").select(F.col("id").alias(id_col), "fp", "component")


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of ``near_duplicates``."""
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# ---- near copies by similarity of word shingles


#: Fingerprints of each text's distinct words; slots and bits of the sketch that sorts out clear cases.
SEEDS, SLOTS = (42, 43), 256
#: Sketches with so many slots filled settle a pair whose estimate is below the first or from the second bound on; at a
#: similarity of 0.8 the chance of either is under 1e-14. Signatures rule out pairs by proof. All other pairs are settled on the full sets.
FILLED, NEVER, SURE = 250, 0.55, 0.97
#: About so many pairs of one row are settled in one run of rows.
HUB = 128
#: Of texts one in 32, or so many if that is more, say which shingles are common; at most so many shingles are held as common.
_SAMPLE, _COMMON = 8192, 1 << 18
#: The chance, for a text, that none of the shingles it is looked for by stands in a text that is similar enough; 0: none, with
#: a fifth of all shingles in place of some 18 a text.
MISS = 1e-12


def sketch(h: np.ndarray) -> bytes:
    """One minimum of 16 bits for each slot of the shingles' hashes: equal slots estimate the sets' Jaccard similarity."""
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    slot, value = (mixed % np.uint64(SLOTS)).astype(np.int64), mixed >> np.uint64(8)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, slot, value)
    out = (least & np.uint64(0x7FFF)).astype(np.uint16)
    out[least == np.iinfo(np.uint64).max] = 0xFFFF
    return out.tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches, along the last axis; slots empty in both say nothing, and empty sets are equal."""
    some = (a != 0xFFFF) | (b != 0xFFFF)
    return np.where(some.any(axis=-1), ((a == b) & some).sum(axis=-1) / np.maximum(1, some.sum(axis=-1)), 1.0)


def filled(look: bytes) -> bytes:
    """The sketch, or nothing if so few of its slots are filled that it settles nothing."""
    return look if (np.frombuffer(look, np.uint16) != 0xFFFF).sum() >= FILLED else b""


def signature(h: np.ndarray) -> bytes:
    """A bit for each shingle's hash, of the least power of two of bits that is twice their number or more, 64 to 65,536."""
    width = 1 << min(16, max(6, (2 * len(h) - 1).bit_length() if len(h) else 0))
    bits = np.zeros(width, dtype=bool)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: bytes, width: int) -> int:
    """The signature with this many bytes: a bit of a half is set if it is in either."""
    out, now = int.from_bytes(bits, "little"), len(bits)
    while now > width:
        now //= 2
        out = (out >> 8 * now) | (out & ((1 << 8 * now) - 1))
    return out


def at_most(x: bytes, y: bytes, n: int, m: int) -> float:
    """What the Jaccard similarity of sets of n and m shingles with these signatures can't exceed.

    Each bit that only one of them has stands for a shingle or more that the other set lacks.
    """
    if not n or not m:
        return float(n == m)
    width = min(len(x), len(y))
    a, b = _folded(x, width), _folded(y, width)
    both = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return both / (n + m - both)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Hashes of the text's distinct shingles, sorted."""
    return np.unique(shingle_hashes(words(text), size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted sets; empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, weight: np.ndarray, miss: float = MISS) -> np.ndarray:
    """The set's first shingles, rare ones first: sets of ``similarity`` or more have one of these in common.

    The order is the same for all texts: by the weight of ``common`` shingles, 0 for others, then by hash. Of n shingles a
    set that is similar enough lacks m = n - ceil(similarity * n) at most, so the first m + 1 can't all be missing. Of r
    rare ones, in an order as good as random, the first k are all missing with a chance of (m / r)^k at most; so k that
    brings this under ``miss`` will do where that is fewer.
    """
    if not len(h):
        return h
    at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
    own = np.where(common[at] == h, weight[at], 0) if len(common) else np.zeros(len(h), np.int64)
    missing = len(h) - int(np.ceil(similarity * len(h) - 1e-9))
    rare, take = h[own == 0], missing + 1
    if miss and 0 < missing < len(rare):
        take = min(take, int(np.ceil(np.log(miss) / np.log(missing / len(rare)))))
    return rare[:take] if take <= len(rare) else h[np.lexsort((h, own))[:take]]


def _sampled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, size).view(np.int64), _LONG)], ["shingle"])

    return run


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and their counts in a sample. They only order shingles: any other list gives the same pairs."""
    share = max(1 / 32, min(1.0, _SAMPLE / max(1, texts.count())))
    some = texts.where(F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    found = some.mapInArrow(_sampled(size), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = found.orderBy(F.desc("n"), "shingle").limit(_COMMON).toArrow()
    shingle, n = (rows[c].to_numpy().astype(np.int64) for c in ("shingle", "n"))
    order = np.argsort(shingle.view(np.uint64))
    return shingle.view(np.uint64)[order], n[order]


def _looks(size: int, similarity: float, common: np.ndarray, weight: np.ndarray, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sketches, bits, n, first = [], [], [], [], []
            for text in b["text"].to_pylist():
                w = words(text)
                own = sorted(set(w))
                fps.append([majority(np.array([xxhash.xxh64_intdigest(x, s) for x in own], dtype=np.uint64)) for s in SEEDS])
                h = np.unique(shingle_hashes(w, size))
                sketches.append(filled(sketch(h)))
                bits.append(signature(h))
                n.append(len(h))
                first.append(prefix(h, similarity, common, weight, miss).view(np.int64))
            columns = [pa.array(fps, pa.list_(_LONG)), pa.array(sketches, pa.binary()), pa.array(bits, pa.binary()), pa.array(n, _LONG), pa.array(first, pa.list_(_LONG))]
            yield pa.RecordBatch.from_arrays([b["row"], *columns], ["row", "fps", "look", "bits", "shingles", "first"])

    return run


def sharing(group: np.ndarray, part: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group (sorted) and other parts that may be similar: neither by the sizes ``n`` of their sets nor by
    what is left of them after the places ``at`` of the shingle that they share is it ruled out. The first shared one never rules it out."""
    left, right, i, d = [], [], np.arange(len(group)), 0
    while True:
        d += 1
        i = i[i + d < len(group)]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        j = i + d
        most = np.minimum(n[i] - at[i], n[j] - at[j])
        ok = (part[i] != part[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6) & (most >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6)
        left.append(i[ok])
        right.append(j[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _sharing(similarity: float, best_only: bool) -> Callable:
    """Pairs (a, b) of rows that share a shingle; ``best_only``: for each row of a group that in which the shingle stands first."""
    names = ["shingle", "sub", "row", "part", "spot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (shingle, sub); the last group of a batch waits for the next."""
        rows = np.zeros((0, 5), np.int64)

        def done(x: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum((np.diff(x[:, :2], axis=0, prepend=x[:1, :2]) != 0).any(axis=1)) if len(x) else np.zeros(0, np.int64)
            i, j = sharing(group, x[:, 3], x[:, 4] >> 32, x[:, 4] & 0xFFFFFFFF, similarity)
            if best_only and len(i):
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
                order = np.lexsort((x[j, 4] & 0xFFFFFFFF, i))
                at = order[np.diff(i[order], prepend=-1) != 0]
                i, j = i[at], j[at]
            a, b = x[i, 2], x[j, 2]
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k], _LONG) for k in range(2)], ["a", "b"])

        for b in batches:
            rows = np.concatenate([rows, np.stack([b[c].to_numpy(zero_copy_only=False) for c in names], axis=1)])
            if len(rows) < 20_000:
                continue
            other = (rows[::-1, :2] != rows[-1, :2]).any(axis=1)
            cut = len(rows) - int(np.argmax(other)) if other.any() else 0
            if cut:
                yield done(rows[:cut])
                rows = rows[cut:]
        yield done(rows)

    return run


def _judged(similarity: float) -> Callable:
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that their signatures (columns p, q) and sizes (n, m) don't rule out."""
        for batch in batches:
            own = zip(*(batch[c].to_pylist() for c in ("p", "q", "n", "m")), strict=True)
            yield batch.filter(pa.array([at_most(*x) >= similarity for x in own], pa.bool_()))

    return lambda batches: _told(possible(batches))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches (columns x, y) don't rule out, and whether these prove them."""
    for batch in batches:
        if batch.num_rows:
            none = b"\xff" * 2 * SLOTS
            x, y = (np.frombuffer(b"".join(look or none for look in batch[c].to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("x", "y"))
            full = ((x != 0xFFFF).sum(axis=1) >= FILLED) & ((y != 0xFFFF).sum(axis=1) >= FILLED)
            like = estimate(x, y)
            keep = pa.array(~full | (like >= NEVER))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(full & (like >= SURE))], ["a", "b", "sure"]).filter(keep)


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array([shingle_set(t, size).tobytes() for t in batch["text"].to_pylist()], pa.binary())], ["row", "own"])

    return run


def _settled(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose shingle sets are similar enough. Rows (b, run, a, own) come sorted: first the set of b itself (a is NULL), then those
        of the rows that it is compared with, so a row's set is held once however many pairs it has."""
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for a, own in zip(batch["a"].to_pylist(), batch["own"].to_pylist(), strict=True):
                h = np.frombuffer(own, np.uint64)
                if a is None:
                    hub = h
                ok.append(a is not None and jaccard(h, hub) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class _Near:
    """The steps of ``near_copies`` over one table of rows."""

    def __init__(self, docs: DataFrame, size: int, similarity: float, id_col: str, text_col: str, bucket: int, miss: float):
        self.scratch, self.size, self.similarity, self.bucket = Scratch(docs.sparkSession, "near"), size, similarity, bucket
        self.base = numbered(docs, self.scratch, id=id_col, text=text_col)
        self.texts = self.base.select("row", "text")
        own = self.texts.mapInArrow(_looks(size, similarity, *_common(self.texts, size), miss), "row long, fps array<long>, look binary, bits binary, shingles long, first array<long>")
        self.looks = self.scratch.save(own, "looks")

    def golay_pairs(self) -> DataFrame:
        """Rows of close word fingerprints: each fingerprint's row with the row of the least fingerprint that it links to, in each
        space, and rows with the first one of the same fingerprint: at most one pair for each row and space."""
        named = self.looks.select("row", F.posexplode("fps").alias("space", "fp"))
        least = self.scratch.save(named.groupBy("space", "fp").agg(F.min("row").alias("least")), "least")
        links = hamming_links(least.select("space", "fp"), self.scratch).groupBy("space", "a").agg(F.min("b").alias("b"))
        links = self.scratch.save(links, "links")
        end = lambda c, name: least.select("space", F.col("fp").alias(c), F.col("least").alias(name))
        ends = links.join(end("a", "x"), ["space", "a"]).join(end("b", "y"), ["space", "b"]).select("x", "y")
        same = named.join(least, ["space", "fp"]).select(F.col("row").alias("x"), F.col("least").alias("y"))
        both = ends.unionByName(same).where("x <> y")
        return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    def verified(self, pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs whose shingle sets are similar enough: signatures and sketches settle what they can, sets decide on the rest.

        Each row of an open pair is hashed once. A pair carries the set of its row a; that of b goes ahead of its pairs, once for each run of
        about ``HUB`` of them, so neither a row of many pairs is copied for each nor all its pairs meet in one task.
        """
        save, pairs = self.scratch.save, self.scratch.save(pairs, f"{tag}-pairs")
        look = lambda *to: self.looks.select(*(F.col(c).alias(name) for c, name in zip(("row", "look", "bits", "shingles"), to, strict=True)))
        told = save(pairs.join(look("a", "x", "p", "n"), "a").join(look("b", "y", "q", "m"), "b").mapInArrow(_judged(self.similarity), "a long, b long, sure boolean"), f"{tag}-told")
        open_ = told.where("not sure")
        wanted = open_.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        sets = save(self.texts.join(wanted, "row").mapInArrow(_sets(self.size), "row long, own binary"), f"{tag}-sets")
        runs = open_.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("runs"))
        members = open_.join(runs, "b").select("b", F.pmod(F.xxhash64("a"), "runs").cast("int").alias("run"), "a").join(sets.withColumnRenamed("row", "a"), "a").select("b", "run", "a", "own")
        hubs = runs.select("b", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("long").alias("a")).join(sets.withColumnRenamed("row", "b"), "b").select("b", "run", "a", "own")
        dealt = hubs.unionByName(members).repartition("b", "run").sortWithinPartitions("b", "run", F.asc_nulls_first("a"))
        late = dealt.mapInArrow(_settled(self.similarity), "a long, b long")
        out = save(told.where("sure").select("a", "b").unionByName(late), f"{tag}-links")
        self.scratch.drop(f"{tag}-sets", f"{tag}-told")
        return out

    def parts(self, links: DataFrame, tag: str) -> DataFrame:
        return self.scratch.save(connected_components(links, self.scratch, tag).select(F.col("node").alias("row"), F.col("component").alias("part")), f"{tag}-parts")

    def shared(self, firsts: DataFrame, part: DataFrame, tag: str) -> DataFrame:
        """Of the rows (shingle, row, spot) those whose shingle stands in several parts, with part and number of rows."""
        own = firsts.join(part, "row", "left").select("shingle", "row", "spot", F.coalesce("part", "row").alias("part"))
        own = self.scratch.save(own, f"{tag}-firsts")
        live = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("shingle", "n")
        out = self.scratch.save(own.join(self.scratch.save(live, f"{tag}-live"), "shingle"), f"{tag}-shared")
        self.scratch.drop(f"{tag}-firsts")
        return out

    def prefix_pairs(self, rows: DataFrame, tag: str, best_only: bool) -> DataFrame:
        """Pairs of rows of different parts that share a shingle of their prefixes.

        A shingle of over ``bucket`` rows is cut into blocks, each part that is larger than a block into its own, and each pair
        of blocks is a group of its own, but for two of the same part: within a part nothing is compared.
        """
        half = max(1, self.bucket // 2)
        hot = rows.where(F.col("n") > self.bucket)
        size = hot.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("k"))
        blocks = lambda c: F.ceil(F.col(c) / half).cast("long")
        large = F.struct("part", blocks("k").alias("blocks"))
        keys = size.groupBy("shingle").agg(F.array_sort(F.collect_list(F.when(F.col("k") > half, large))).alias("large"), F.sum(F.when(F.col("k") > half, 0).otherwise(F.col("k"))).alias("rest"))
        keys = keys.select("shingle", "large", F.greatest(F.lit(1), blocks("rest")).alias("pool"))
        keys = self.scratch.save(keys.withColumn("all", F.col("pool") + F.aggregate("large", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])), f"{tag}-hot")
        own = F.filter("large", lambda x: x["part"] == F.col("part"))
        before = F.aggregate(F.filter("large", lambda x: x["part"] < F.col("part")), F.col("pool"), lambda s, x: s + x["blocks"])
        mixed = F.xxhash64(F.lit(7), "row")
        cut = hot.join(keys, "shingle").withColumn("own", F.get(own, F.lit(0))["blocks"])
        cut = cut.withColumns({"start": F.when(F.col("own").isNull(), F.lit(0).cast("long")).otherwise(before), "width": F.coalesce("own", "pool")})
        cut = cut.withColumn("block", F.col("start") + F.pmod(mixed, F.col("width")))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda x: F.col("own").isNull() | (x < F.col("start")) | (x >= F.col("start") + F.col("width")))
        cut = cut.withColumn("other", F.explode(others)).withColumn("sub", F.least("block", "other") * F.col("all") + F.greatest("block", "other"))
        names = ["shingle", "sub", "row", "part", "spot"]
        dealt = rows.where(F.col("n") <= self.bucket).withColumn("sub", F.lit(0).cast("long")).select(*names).unionByName(cut.select(*names))
        dealt = dealt.repartition("shingle", "sub").sortWithinPartitions("shingle", "sub", "row")
        return dealt.mapInArrow(_sharing(self.similarity, best_only), "a long, b long").distinct()

    def groups(self) -> DataFrame:
        links = self.verified(self.golay_pairs(), "golay")
        firsts = self.looks.select("row", "shingles", F.posexplode("first").alias("at", "shingle")).select("shingle", "row", (F.shiftleft("shingles", 32) + F.col("at")).alias("spot"))
        part = self.parts(links, "first")
        for tag, best_only in (("some", True), ("rest", False)):
            rows = self.shared(firsts, part, tag)
            firsts = rows.select("shingle", "row", "spot")
            found = self.verified(self.prefix_pairs(rows, tag, best_only), tag)
            part = self.parts(found.unionByName(part.select(F.col("row").alias("a"), F.col("part").alias("b"))), tag)
        return part


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bucket: int = 512, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (_row, id, text, row), and (row, keeper) for each row in a group of near copies.

    Groups are the components of all pairs of texts whose shingle sets have a Jaccard similarity of ``similarity`` or more; the
    keeper is the group's row of least id, nulls last. They are found in two passes, of which the second would find all of them
    (with ``miss`` 0 by proof, else but for that chance a text) and the first leaves it little to do:

    * links at 4 bits between fingerprints of the distinct words, any of ``SEEDS``, found with Golay keys as above: a changed
      word alters ``size`` shingles but one word, so copies have close word fingerprints. Each row is compared with one row
      that it links to in each space, and components of the pairs that are similar enough are parts;
    * prefixes: two sets that are similar enough share one of the first shingles of each, in one order, rare ones first (see
      ``prefix``). Rows of different parts that share one are compared, unless their sizes or places rule it out: first each
      with one other by each shingle, then, with the parts that are left, with all.

    Signatures rule out most pairs below ``similarity`` by proof, ``SLOTS`` minima settle pairs of long texts far from it, the full sets
    all others. Null and empty texts, without words, are one
    another's copies; repeated rows are copies, of which one stays.
    """
    near = _Near(docs, size, similarity, id_col, text_col, bucket, miss)
    groups = near.groups().join(near.base.select("row", "id"), "row")
    keeper = groups.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("k")).select("part", F.col("k.row").alias("keeper"))
    return near.base, near.scratch.save(groups.join(keeper, "part").select("row", "keeper"), "keepers")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for near copies of a row that stays, with their columns. An empty table stays empty."""
    rows, told = near_copies(docs, size, similarity, id_col, text_col)
    gone = told.where("row <> keeper").select("row")
    return rows.join(gone.hint("shuffle_hash"), "row", "left_anti").select("_row.*")
