"""Language identification: averaged hashed subword embeddings with a linear softmax, by SGD in numpy.

A text's features are its byte 3-grams and 4-grams, lower-cased, hashed into ``2 ** BITS`` buckets. Each
bucket has an embedding; a text is the mean of its embeddings, and a linear softmax over it gives the
languages. Training is stochastic gradient descent over single texts on the driver, on a bounded sample
of labelled rows (``SAMPLE`` rows of up to ``LONGEST`` characters, taken by a hash of the id, so the
same rows each time). A fifth of the sample is held from training to fit the softmax's temperature and
the score below which a prediction is rejected. Embeddings and softmax are both linear, so they fold
into one table of logits by bucket (2 MB for 4 languages), which tasks get with the function; a
prediction then gathers and sums it over the whole text.

Null text, or text without a letter, is ``und`` with score 0; so is every text if nothing can be learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

BITS, WIDTH, EPOCHS, RATE = 17, 16, 4, 0.5
SAMPLE, LONGEST = 4000, 50_000
#: The share of right predictions on held rows that the rejection keeps.
KEEP = 0.99
_WORDLIKE = re.compile(r"[^\W\d_]")
_PART = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L: number forms such as fractions and Roman numerals aren't."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def features(text: str) -> np.ndarray:
    """Buckets of the byte 3- and 4-grams of " text ", lower-cased."""
    a = np.frombuffer(b" " + text.lower().encode() + b"  ", dtype=np.uint8).astype(np.uint32)
    three = a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)
    four = three[:-1] | a[3:] << np.uint32(24)
    shift = np.uint32(32 - BITS)
    return np.concatenate([three * np.uint32(2654435761) >> shift, (four ^ four >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> shift])


def _parts(text: str) -> Iterator[str]:
    return (text[s : s + _PART] for s in range(0, len(text), _PART))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): logits that a feature adds, before the mean
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in _parts(text):
            f = features(part)
            total += self.table[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not has_letter(text):
            return "und", 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """rows: (text, language). Texts without a letter teach nothing."""
    rows = [(t, lang) for t, lang in rows if has_letter(t)]
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    known = [(np.unique(features(t), return_counts=True), languages.index(lang)) for t, lang in rows]
    order = rng.permutation(len(known))
    held, used = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 50 else (order[:0], order)
    table = rng.normal(0, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(used):
            (bucket, n), lang = known[i]
            share = (n / n.sum()).astype(np.float32)
            mean = share @ table[bucket]
            error = _softmax(mean @ weight + bias)
            error[lang] -= 1
            back = weight @ error.astype(np.float32)
            weight -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            # counts are few for each of many buckets: their step is not divided by the length
            table[bucket] -= rate * 20 * share[:, None] * back
    model = Model(languages, (table @ weight).astype(np.float32), bias)
    if len(held):
        z = np.array([(n / n.sum()) @ model.table[b] + bias for (b, n), _ in (known[i] for i in held)])
        y = np.array([known[i][1] for i in held])
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = min(np.geomspace(0.05, 20, 61).tolist(), key=loss)
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.reject = float(np.quantile(right, 1 - KEEP)) if len(right) else 0.0
    return model


def held_out(id_col: str):
    """Rows that nothing is learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from a sample of labelled rows that are not held out; rows without an id are not used."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & (F.length(text_col) <= LONGEST))
    n = usable.count()
    if not n:
        return train([])
    # about ``sample`` rows; the hash of id and text decides, not the layout, and rows that are alike count once, so that a
    # row that is repeated without end is one row here
    most = min(1.0, sample / n)
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < int(most * (1 << 30))
    rows = usable.where(draw).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).distinct().limit(2 * sample).collect()
    return train([(r["t"], r["l"]) for r in sorted(rows, key=lambda r: (r["i"], r["l"], r["t"]))])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.predict(t) for t in b["text"].to_pylist()]
            score = [s for _, s in out]
            yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array([p for p, _ in out], pa.string()), pa.array(score, pa.float64()), pa.array([s < model.reject for s in score], pa.bool_())], ["id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, rejected (below the calibrated score).

    Rows that repeat an id are predicted each; a null id is not held out. Other columns are not read.
    """
    ship(docs.sparkSession)
    model = model or fit(docs, id_col, text_col, lang_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return own.mapInArrow(_predict(model), f"id {id_type}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
