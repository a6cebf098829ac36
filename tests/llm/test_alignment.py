"""Alignment against a plain walk over byte offsets with the tokenizers' own decoders."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from lacuna.llm import alignment as A
from lacuna.llm.packing import vocabulary

SCHEMA = "doc_id long, text string, pairs int, n_a string"


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def byte_of():
    """The byte-level alphabet as its definition has it."""
    kept = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {chr(b): b for b in kept}, 0
    for b in range(256):
        if b not in kept:
            out[chr(256 + n)] = b
            n += 1
    return out


def tokens(sides, text):
    a, b = sides
    table = byte_of()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    return ids_a, ids_b, bytes_a, bytes_b


def brute(sides, rows):
    groups, links = [], []
    for _, text in rows:
        own, pairs = [], []
        if text:
            ids_a, ids_b, bytes_a, bytes_b = tokens(sides, text)
            whole = (" " + text).encode()
            if b"".join(bytes_a) == whole == b"".join(bytes_b):
                ends = []
                for parts in (bytes_a, bytes_b):
                    at, found = 0, []
                    for p in parts:
                        at += len(p)
                        found.append(at)
                    ends.append(found)
                both = sorted(set(ends[0]) & set(ends[1]))
                low = 0
                for high in both:
                    own.append(([i for i, e in zip(ids_a, ends[0], strict=True) if low < e <= high], [i for i, e in zip(ids_b, ends[1], strict=True) if low < e <= high]))
                    low = high
                pairs = [(i, j) for i, e in zip(ids_a, ends[0], strict=True) for j, f in zip(ids_b, ends[1], strict=True) if e == f]
        groups.append(own)
        links.append(pairs)
    count = Counter(p for x in links for p in x)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (i, _), own, pairs in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append(
            (i, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if own else "")
        )
    return sorted(out, key=repr)


def texts():
    r = random.Random(1)
    words = ["the", "The", "straße", "été", "日本語", "don't", "a", "tokenization", "12345", "🙂", "<|endoftext|>", "<s>", "x\ty", "http://a.b/c", "\n", "  ", "ﬁ", "é", " "]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 8, 60])))) for k in range(60)]
    return rows + [(100, None), (101, ""), (102, " "), (103, "\n\n"), (104, "a ▁ b"), (105, "the the"), (105, "the the"), (None, "the"), (106, "y" * 4000), (107, "\x00a"), (108, " lead"), (109, "trail "), (110, "<0x41>")]


@pytest.mark.parametrize("hot", [A.HOT, 3])
def test_against_brute_force(spark, sides, hot):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], SCHEMA).repartition(3)
    got = A.link_scores(docs, hot=hot).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(sides, rows)


def test_nothing_to_align(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a▁b")], "doc_id long, text string")
    assert sorted(tuple(r) for r in A.link_scores(docs).collect()) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]
    assert A.link_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_join_to_the_text(spark, sides):
    rows = [(1, "Tokenization of straße, 日本."), (2, None)]
    got = {r.doc_id: r for r in A.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), with_groups=True).collect()}
    assert got[2].groups == []
    ids_a, ids_b, bytes_a, bytes_b = tokens(sides, rows[0][1])
    assert [i for g in got[1].groups for i in g.a] == ids_a and [i for g in got[1].groups for i in g.b] == ids_b
    at = [0, 0]
    for g in got[1].groups:
        spans = [b"".join(parts[at[k] : at[k] + len(own)]) for k, (parts, own) in enumerate(((bytes_a, g.a), (bytes_b, g.b)))]
        at = [at[0] + len(g.a), at[1] + len(g.b)]
        assert spans[0] == spans[1]


def test_labels_and_sizes():
    import numpy as np

    own = A.labels(np.array([1, 2, 3]), np.array([3, 1, 2]))
    assert list(own) == [1, 0, 3, 2, 0, 3]
    assert [list(x) for x in A.group_sizes(own)] == [[2, 1], [1, 2]]
