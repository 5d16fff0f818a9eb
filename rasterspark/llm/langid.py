"""Language identification: averaged hashed subword embeddings and a linear softmax.

Every run of 2, 3 or 4 bytes of a text (A-Z lowered, white space as one kind of byte) is hashed to a
row of an embedding table; the rows are averaged over the text and a linear layer with softmax names
the language. Both layers are trained together by stochastic gradient descent with momentum in
numpy. Confidence is calibrated on labelled rows kept from training: a temperature is fitted to
them, and texts whose confidence is below almost all correctly named ones are rejected.

Training takes about `per_language` rows of each language, chosen by a hash of doc_id, of at most
`languages` languages, those with the most rows: the documented bounds on what reaches the driver.
Tasks send the shares of the hashed runs and not the texts, so a row is of bounded size however long
its text is. Prediction reads whole texts of all rows, in place.

Null texts and texts without a letter (Unicode category L) are `und`, score 0, rejected. Rows with null
text, language or id are never learned from. Without any labelled row everything is `und`. Repeated
rows are learned from and named each; equal confidences go to the first language in order. Input
columns lang_pred, score and rejected are replaced; all others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: A-Z lowered, white space alike, other bytes as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def subwords(text: str, buckets: int) -> np.ndarray:
    """The bucket of every run of 2, 3 and 4 bytes of the text, framed by spaces."""
    b = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + b[2:] * np.uint32(0xC2B2AE3D)
    four = three[:-1] + b[3:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - (buckets - 1).bit_length())
    return np.concatenate([((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift for x in (two, three, four)]).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: embeddings times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def confidences(self, text: str) -> np.ndarray:
        rows = subwords(text, len(self.table))
        total = np.zeros(len(self.languages))
        for i in range(0, len(rows), 1 << 18):
            total += self.table.take(rows[i : i + (1 << 18)], axis=0).sum(axis=0, dtype=np.float64)
        return softmax(((total / len(rows) + self.bias) / self.temperature)[None])[0]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated confidence, rejected."""
        if text is None or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        p = self.confidences(text)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def shares(text: str, buckets: int) -> tuple[bytes, bytes]:
    """The buckets of a text's runs (little-endian 4-byte numbers) and the share of each (4-byte floats)."""
    rows = subwords(text, buckets)
    at, n = np.unique(rows, return_counts=True)
    return at.astype("<u4").tobytes(), (n / len(rows)).astype("<f4").tobytes()


def features(rows, buckets: int) -> np.ndarray:
    """Rows of shares as a matrix."""
    x = np.zeros((len(rows), buckets), np.float32)
    for i, (at, share) in enumerate(rows):
        x[i, np.frombuffer(at, "<u4")] = np.frombuffer(share, "<f4")
    return x


def train(rows: list[tuple[bytes, bytes, str]], buckets: int = 8192, dims: int = 16, epochs: int = 60, rate: float = 0.4, batch: int = 64, seed: int = 7, false_rejects: float = 0.001) -> Model:
    """rows: (buckets, shares, language). Every fifth row is kept from training, to calibrate on."""
    rows = sorted(rows)
    languages = sorted({r[2] for r in rows})
    if not rows:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    kept = rows[::5] if len(rows) >= 10 * len(languages) else []
    used = [r for i, r in enumerate(rows) if i % 5 or not kept]
    scale = np.float32(np.sqrt(buckets))
    y = np.array([languages.index(r[2]) for r in used])
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weight = (1 / np.maximum(share, 1e-9) / len(languages)).astype(np.float32)
    embed = rng.normal(0, 0.1, (buckets, dims)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dims, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    moments = [np.zeros_like(v) for v in (embed, layer, bias)]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(used)), max(1, len(used) // batch)):
            x = features([used[i][:2] for i in at], buckets) * scale
            hidden = x @ embed
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(at)), y[at]] -= 1
            error *= (weight[y[at]] / len(at))[:, None]
            grads = (x.T @ (error @ layer.T), hidden.T @ error, error.sum(axis=0))
            for value, moment, grad in zip((embed, layer, bias), moments, grads):
                moment *= 0.9
                moment += grad
                value -= step * 0.1 * moment
    model = Model(languages, np.ascontiguousarray(embed @ layer * np.float32(np.sqrt(buckets))), bias.astype(np.float64))
    if kept:
        logits = np.concatenate([features([r[:2] for r in kept[i : i + 512]], buckets) @ model.table for i in range(0, len(kept), 512)]).astype(np.float64) + model.bias
        truth = np.array([languages.index(r[2]) for r in kept])
        scales = np.geomspace(0.05, 20, 60)
        model.temperature = float(min(scales, key=lambda s: -np.log(np.maximum(softmax(logits / s)[np.arange(len(truth)), truth], 1e-12)).mean()))
        p = softmax(logits / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        model.threshold = min(0.5, float(np.quantile(right, false_rejects))) if len(right) else 0.0
    return model


def training_rows(docs: DataFrame, per_language: int, languages: int, buckets: int) -> list[tuple[bytes, bytes, str]]:
    """About per_language labelled rows of each language, those of the smallest hashes of doc_id, as shares."""
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000

    def run(batches):
        for b in batches:
            held = [(*shares(t, buckets), lang) for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()) if LETTER.search(t)]
            at, share, lang = zip(*held) if held else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(share, pa.binary()), pa.array(lang, pa.string())], names=["at", "share", "lang"])

    chosen = docs.filter(F.col("lang").isin(*counts)).filter(hashed < F.element_at(share, F.col("lang"))).select("text", "lang")
    return [(bytes(r.at), bytes(r.share), r.lang) for r in chosen.mapInArrow(run, "at binary, share binary, lang string").collect()]


def fit(docs: DataFrame, per_language: int = 400, languages: int = 200, buckets: int = 8192, **options) -> Model:
    """Learn from rows with doc_id, text and lang."""
    usable = docs.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null")
    return train(training_rows(usable, per_language, languages, buckets), buckets, **options)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs but any lang_pred, score and rejected, and these anew; whole texts, no shuffle."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # a fixed number of buckets times the languages

    def run(batches):
        known = held.value
        for batch in batches:
            found = [known.predict(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    plain = docs.drop("lang_pred", "score", "rejected")
    schema = ", ".join(f"`{n}` {t}" for n, t in plain.dtypes)
    return plain.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
