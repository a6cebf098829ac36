"""License scans against a plain search over words, and the expression parser against recursive descent."""

import random
import re

import pytest

from lacuna.llm import licenses as L

SCHEMA = "doc_id long, text string, n_words int, spans string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def places(text, phrases):
    own = WORD.findall(lower(text))
    return own, sorted((k, label) for p, label in phrases.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split())


def brute(text):
    own, base = places(text, L.BASE)
    _, notices = places(text, L.NOTICES)

    labels = sorted({x for _, x in base} | {x for _, x in notices})
    score = max((L.STRICTNESS[x] for x in labels), default=0.0)
    starts = [k for k, _ in base]
    return len(own), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), score


def query(spark, rows):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA)
    return {r[0]: tuple(r[1:]) for r in L.digest(L.find_licenses(docs)).collect()}


def test_random_texts(spark):
    r = random.Random(1)
    pieces = [w for p in [*L.BASE, *L.NOTICES] for w in p.split()] + ["été", "日本", "x", "BY", "CC", "ccby", "License"]
    gap = lambda: r.choice([" ", "-", "\n", ". ", "\t", "_", "\x00", " / ", "`", "{"])
    rows = [(k, "".join(r.choice([w, w.upper(), w.title()]) + gap() for w in (r.choice(pieces) for _ in range(r.choice([0, 3, 40, 400]))))) for k in range(120)]
    rows += [(200 + k, gap().join(p.split())) for k, p in enumerate([*L.BASE, *L.NOTICES])]
    assert query(spark, rows) == {i: brute(t) for i, t in rows}


def test_odd_texts(spark):
    long = "x" * 300_000 + " All Rights Reserved " + "word " * 50_000 + "CC-BY CC BY"
    rows = [(1, None), (2, ""), (3, " \t\n!"), (4, long), (5, "cc by cc by cc by"), (6, "all rights reservedé all rights"), (7, "ccby, CC\x00BY"), (8, "CC BY"), (8, "CC BY")]
    got = query(spark, rows)
    assert got == {i: brute(t) for i, t in rows}
    assert got[1] == got[2] == got[3] == (0, 0, None, None, "", "", 0.0) and got[5][1:4] == (3, 0, 4) and got[7][1] == 1
    assert L.digest(L.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"))).count() == len(rows)
    assert L.find_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "text,expression,strictness,labels",
    [
        ("SPDX-License-Identifier: MIT", "mit", 0.2, ["mit"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later */ int x", "gpl-2.0-or-later", 0.7, ["gpl"]),
        ("spdx-license-identifier:(MIT OR GPL-3.0+)AND CC0-1.0", "( mit or gpl-3.0+ ) and cc0-1.0", 0.2, ["cc0", "gpl", "mit"]),
        ("SPDX-License-Identifier: MIT OR GPL-2.0 AND AGPL-3.0", "mit or gpl-2.0 and agpl-3.0", 0.2, ["agpl", "gpl", "mit"]),
        ("SPDX-License-Identifier: (MIT OR GPL-2.0) AND AGPL-3.0", "( mit or gpl-2.0 ) and agpl-3.0", 0.8, ["agpl", "gpl", "mit"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0-only with classpath-exception-2.0", 0.45, ["gpl"]),
        ("SPDX-License-Identifier: CC0-1.0 WITH x", "cc0-1.0 with x", 0.0, ["cc0"]),
        ("SPDX-License-Identifier: MIT AND", "mit", 0.2, ["mit"]),
        ("SPDX-License-Identifier: MIT AND (Zlib", "mit", 0.2, ["mit"]),
        ("SPDX-License-Identifier: LicenseRef-own", "licenseref-own", 0.5, ["licenseref-own"]),
        ("SPDX-License-Identifier: Apache-2.0 the end", "apache-2.0", 0.2, ["apache"]),
        ("SPDX-License-Identifier: ((BSD-3-Clause))", "( ( bsd-3-clause ) )", 0.2, ["bsd"]),
    ],
)
def test_expressions(text, expression, strictness, labels):
    for before in ("", "Éa b. "):
        ((first, *found),) = L.scan(before + text)[2]
        assert found == [expression, strictness, labels] and first == (2 if before else 0)


@pytest.mark.parametrize("text", ["SPDX-License-Identifier MIT", "SPDX-License-Identifier:", "SPDX-License-Identifier: (MIT", "SPDX-License-Identifier: OR MIT", "SPDX-License-Identifier:\nMIT", "SPDX License: MIT"])
def test_no_expression(text):
    assert L.scan(text)[2] == []


def descend(tokens):
    """Another parser: recursive descent, strictness only."""

    def atom(k):
        if tokens[k] == "(":
            v, k = either(k + 1)
            return v, k + 1
        v, k = L.STRICTNESS.get(L.family(tokens[k]), L.UNKNOWN), k + 1
        return v, k

    def loose(k):
        v, k = atom(k)
        while k < len(tokens) and tokens[k] == "with":
            v, k = max(min(v, 0.2), round(v - 0.25, 6)), k + 2
        return v, k

    def both(k):
        v, k = loose(k)
        while k < len(tokens) and tokens[k] == "and":
            w, k = loose(k + 1)
            v = max(v, w)
        return v, k

    def either(k):
        v, k = both(k)
        while k < len(tokens) and tokens[k] == "or":
            w, k = both(k + 1)
            v = min(v, w)
        return v, k

    return either(0)[0]


def test_parser_equals_recursive_descent():
    r = random.Random(4)

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            own = [r.choice(["mit", "gpl-3.0-only", "agpl-3.0", "cc0-1.0", "mpl-2.0", "odd-1", "cc-by-nc-4.0"])]
            return own + ["with", "exception-1.0"] * (r.random() < 0.3)
        own = made(depth - 1) + [r.choice(["and", "or"])] + made(depth - 1)
        return ["(", *own, ")"] if r.random() < 0.5 else own

    for _ in range(300):
        tokens = made(4)
        assert L.whole_beginning(tokens) == tokens
        assert L.evaluate(tokens)[0] == pytest.approx(descend(tokens))
        cut = r.randrange(len(tokens))
        whole = L.whole_beginning(tokens[:cut])
        assert tokens[: len(whole)] == whole and (not whole or L.evaluate(whole))
    deep = ["("] * 50_000 + ["mit"] + [")"] * 50_000
    assert L.evaluate(L.whole_beginning(deep)) == (0.2, {"mit"})


def test_labels_and_score_join_notices_and_expressions(spark):
    got = query(spark, [(1, "MIT License. SPDX-License-Identifier: GPL-2.0 OR Zlib\nLicensed under CC BY-NC 4.0")])
    assert got[1][1:] == (1, 12, 12, "cc-by", "cc-by,cc-by-nc,gpl,mit,zlib", 0.8)
