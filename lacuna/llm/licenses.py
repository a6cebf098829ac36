"""License scans: an automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions.

A text's words are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case; its other
characters only part words. An Aho-Corasick automaton over the words, joined by single spaces, finds all places of
all phrases in one pass, overlapping ones included. After an identifier tag (``SPDX-License-Identifier:``) stands an
expression of licence ids, ``and``, ``or``, ``with`` and brackets, on one line; its longest whole beginning is read, so
that a comment's end behind it does no harm, and an expression that never gets whole gives nothing.

Each licence has a strictness from 0 (do as you like) to 1 (all rights reserved). ``or`` leaves the choice, hence the
least of its sides; ``and`` binds to the greatest; ``with`` an exception loosens by ``EXCEPTION``. All that a document
holds applies together, so its score is the greatest of its findings; 0 without any.

NULL is an empty text, which has no words, labels or places. Rows that repeat an id are scanned each for itself, other
columns are not read, an empty table gives no rows. Texts are read whole; memory is a small multiple of one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

#: Phrases that any scan counts, and their labels. Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices.
NOTICES = {
    "mit license": "mit", "apache license": "apache", "bsd license": "bsd", "isc license": "isc", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl", "boost software license": "bsl",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0", "public domain": "public-domain", "do what the fuck you want to public license": "wtfpl", "european union public licence": "eupl", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx license identifier"
#: Strictness by label; an id's label is its longest beginning that stands here.
STRICTNESS = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "0bsd": 0.0, "wtfpl": 0.0,
    "mit": 0.2, "bsd": 0.2, "isc": 0.2, "apache": 0.2, "zlib": 0.2, "bsl": 0.2, "python": 0.2, "cc-by": 0.2,
    "mpl": 0.45, "lgpl": 0.45, "epl": 0.45, "cddl": 0.45, "eupl": 0.45, "cc-by-sa": 0.45,
    "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.8, "cc-by-nc-nd": 0.9, "reserved": 1.0,
}
#: Of an id that no label fits.
UNKNOWN = 0.5
#: What an exception takes off, as long as what is left is no less than the plainest licence with conditions.
EXCEPTION, LEAST = 0.25, 0.2

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_LETTERS = bytes(range(97, 123))
#: Of each byte: its lower case, or a space for ASCII that no word holds.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _LETTERS or 48 <= b <= 57 else 32 for b in range(256))
_LOWER = {b: b + 32 for b in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_COLON, _TOKEN = re.compile(r"[ \t]*:"), re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.:+-]*)")


@cache
def automaton():
    import ahocorasick

    own = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        own.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, len(phrase) + 2, phrase in BASE))
    own.make_automaton()
    return own


# ---- expressions


def family(identifier: str) -> str:
    """The label of a licence id: gpl of gpl-2.0-or-later+; an unknown id is its own."""
    parts = identifier.rstrip("+").split("-")
    for k in range(len(parts), 0, -1):
        if (label := "-".join(parts[:k])) in STRICTNESS:
            return label
    return identifier


def whole_beginning(tokens: list[str]) -> list[str]:
    """The longest beginning that is an expression."""
    depth, best, operand = 0, 0, True  # operand: one is due
    for k, t in enumerate(tokens):
        if operand:
            if t in _PRECEDENCE or t == ")":
                break
            depth += t == "("
            operand = t == "("
        elif t in _PRECEDENCE:
            operand = True
        elif t == ")" and depth:
            depth -= 1
        else:
            break
        if not operand and not depth:
            best = k + 1
    return tokens[:best]


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: ``with`` before ``and`` before ``or``, each from the left."""
    out, waiting = [], []
    for t in tokens:
        if t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif t in _PRECEDENCE:
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[t]:
                out.append(waiting.pop())
            waiting.append(t)
        else:
            out.append(t)
    return out + waiting[::-1]


def evaluate(tokens: list[str]) -> tuple[float, set[str]] | None:
    """Strictness and licence labels of a whole expression; None of none. What follows ``with`` is an exception, no licence."""
    held: list[tuple[float, set[str]]] = []
    for t in to_postfix(tokens):
        if t not in _PRECEDENCE:
            held.append((STRICTNESS.get(family(t), UNKNOWN), {family(t)}))
            continue
        (b, own_b), (a, own_a) = held.pop(), held.pop()
        if t == "with":
            held.append((max(min(a, LEAST), round(a - EXCEPTION, 6)), own_a))
        else:
            held.append((min(a, b) if t == "or" else max(a, b), own_a | own_b))
    return held[0] if held else None


def expression_at(lower: str, at: int) -> list[str]:
    """Tokens of the whole expression that stands behind a colon at ``at``."""
    if not (m := _COLON.match(lower, at)):
        return []
    tokens, at = [], m.end()
    while m := _TOKEN.match(lower, at):
        tokens.append(m[1])
        at = m.end()
    return whole_beginning(tokens)


# ---- texts


def scan(text: str) -> tuple[int, list[tuple[int, int, str, bool]], list[tuple[int, str, float, list[str]]]]:
    """Words; spans (first word, words, label, base) by place; expressions (first word of the tag, expression, strictness, labels)."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    joined = b" %b " % b" ".join(words)
    hits = [(end - width + 1, n, label, base) for end, (label, n, width, base) in automaton().iter(joined.decode("latin-1"))]
    if not hits:
        return len(words), [], []
    starts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)  # a word's number is that of the space before it
    places = np.searchsorted(starts, [h[0] for h in hits]).tolist()
    spans = sorted((w, n, label, base) for w, (_, n, label, base) in zip(places, hits, strict=True) if label)
    tags = sorted(w for w, h in zip(places, hits, strict=True) if not h[2])
    found = []
    if tags:
        lower = text.translate(_LOWER)
        ends = [m.end() for m in _WORD.finditer(lower)]
        for w in tags:
            if tokens := expression_at(lower, ends[w + 2]):
                strict, labels = evaluate(tokens)
                found.append((w, " ".join(tokens), strict, sorted(labels)))
    return len(words), spans, found


_SPAN = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
_EXPRESSION = pa.list_(pa.struct([("first_word", pa.int64()), ("expression", pa.string()), ("strictness", pa.float64()), ("labels", pa.list_(pa.string()))]))
_TYPES = "n_words long, spans array<struct<first_word: long, n_words: long, label: string, base: boolean>>, expressions array<struct<first_word: long, expression: string, strictness: double, labels: array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [scan(t or "") for t in b["text"].to_pylist()]
        names = lambda kind: [f.name for f in kind.value_type]
        of = lambda k, kind: pa.array([[dict(zip(names(kind), x, strict=True)) for x in row[k]] for row in found], kind)
        yield pa.RecordBatch.from_arrays([b["id"], pa.array([r[0] for r in found], pa.int64()), of(1, _SPAN), of(2, _EXPRESSION)], ["id", "n_words", "spans", "expressions"])


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans, expressions) of each row."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_scan, f"id {kind}, {_TYPES}").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    label = lambda spans: F.transform(spans, lambda s: s["label"])
    levels = F.create_map(*(F.lit(x) for kv in STRICTNESS.items() for x in kv))
    scores = F.concat(F.transform("spans", lambda s: levels[s["label"]]), F.transform("expressions", lambda e: e["strictness"]))
    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(label(base)).alias("base_labels"), joined(F.concat(label(F.col("spans")), F.flatten(F.transform("expressions", lambda e: e["labels"])))).alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
    )
