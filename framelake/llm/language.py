"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text, everything but letters being one kind of
space; tf is log1p(count), idf comes from the training rows, and vectors have length one. The weights are
learned by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, which leave most at
zero; a temperature is then fitted on training rows that the weights haven't seen. Training takes a
sample of about max_rows_per_label rows a label and max_rows in all, of the max_rows / 8 most frequent labels
at most; prediction reads every whole text. The driver sees the sample's document frequencies, a number a
bucket, and then of each row only the counts of the vocabulary's buckets.

Nulls: a text that is null or has no letter is "und" with score 0, as are all texts if nothing could be
learned; a null lang isn't learned from. Equal rows each give a row. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, written

BUCKETS = 1 << 16
_LETTER: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 32 for whatever isn't a letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[0][np.minimum(c, 0xFFFF)]
    far = c > 0xFFFF
    if far.any():
        letter = letter & ~far
        letter[far] = [chr(x).isalpha() for x in c[far].tolist()]
    return np.where(letter, c, 32).astype(np.uint32)


def grams(text: str | None) -> np.ndarray | None:
    """The buckets of all 1- to 3-grams, or None if there is no letter."""
    c = _codes(text or "")
    if not (c != 32).any():
        return None
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    k = np.uint32(0x9E3779B1)
    one = c * k
    two = (one[:-1] ^ c[1:]) * k
    three = (two[:-1] ^ c[2:]) * k
    # the salt keeps grams of unlike lengths apart
    return np.concatenate([(h ^ np.uint32(salt)) * np.uint32(0x85EBCA6B) >> np.uint32(16) for h, salt in ((one, 1), (two, 2), (three, 3))]).astype(np.int64)


class Model:
    """labels, the vocabulary's place per bucket (0: none), idf, weights and temperature."""

    def __init__(self, labels: list[str], place: np.ndarray, idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.labels, self.place, self.idf, self.weights, self.temperature = labels, place, idf, weights, temperature

    def vector(self, buckets: np.ndarray) -> np.ndarray:
        counts = np.bincount(self.place[buckets], minlength=len(self.idf) + 1)[1:]
        v = np.log1p(counts) * self.idf
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if self.labels else None
        if found is None:
            return "und", 0.0
        logits = (self.vector(found) @ self.weights[:-1] + self.weights[-1]) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 0.01) -> np.ndarray:
    """Weights (n + 1, classes), the last row the intercept, by FTRL-proximal with penalties l1 and l2."""
    z, s = np.zeros((n + 1, classes)), np.zeros((n + 1, classes))

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(s[i])) / alpha + l2))

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, v = rows[r]
            i, v = np.append(i, n), np.append(v, 1.0)
            w = weights(i)
            logits = v @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = v[:, None] * p
            after = s[i] + g * g
            z[i] += g - (np.sqrt(after) - np.sqrt(s[i])) / alpha * w
            s[i] = after
    return weights(np.arange(n + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, from 0.05 to 20.

    One row's worth of the target goes to the other labels, or rows without an error would ask for
    certainty.
    """
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    rest = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        a = logits / t
        a = a - a.max(axis=1, keepdims=True)
        own = (1 - rest) * a[np.arange(len(y)), y] + rest * a.mean(axis=1)
        return float(np.mean(np.log(np.exp(a).sum(axis=1)) - own))

    return float(min(grid, key=loss))


def vocabulary_of(df: np.ndarray, rows: int, size: int = 8192) -> np.ndarray:
    """The buckets that most rows have, in order."""
    chosen = np.argsort(-df, kind="stable")[:size]
    return np.sort(chosen[df[chosen] >= min(2, rows)])


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray | None = None) -> Model:
    """From (label, distinct buckets, their counts) and the number of rows that have each bucket; every fifth row is for the temperature."""
    labels = sorted({s[0] for s in samples})
    if df is None:
        df = np.zeros(BUCKETS, np.int64)
        for _, b, _ in samples:
            df[b] += 1
    chosen = vocabulary_of(df, len(samples))
    place = np.zeros(BUCKETS, np.int64)
    place[chosen] = np.arange(1, len(chosen) + 1)
    idf = np.log((1 + len(samples)) / (1 + df[chosen])) + 1
    rows, y = [], np.array([labels.index(s[0]) for s in samples], int)
    for _, b, n in samples:
        at = place[b]
        i, v = at[at > 0] - 1, np.log1p(n[at > 0])
        v = v * idf[i]
        rows.append((i, v / max(float(np.sqrt(v @ v)), 1e-12)))
    last = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~last)
    w = ftrl([rows[r] for r in learn], y[learn], len(chosen), max(len(labels), 1)) if labels else np.zeros((1, 1))
    logits = np.array([rows[r][1] @ w[rows[r][0]] + w[-1] for r in np.flatnonzero(last)])
    return Model(labels, place, idf, w, temperature(logits, y[last]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_rows_per_label: int = 1000, max_rows: int = 8000) -> Model:
    """Learned from rows with a lang, held-out ones aside, drawn by a hash of doc_id and text."""
    known = docs.filter("lang is not null").filter(~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows // 8).collect()
    if not counts:
        return train([])
    each = min(max_rows_per_label, max(1, max_rows // len(counts)))
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    draw = F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(1 << 30)) < F.try_element_at(share, "lang") * (1 << 30)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, bucket, count = [], [], []
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams(t)
                if found is not None:
                    b, n = np.unique(found, return_counts=True)
                    lang.append(x)
                    bucket.append(b.astype("<u2").tobytes())
                    count.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(bucket, pa.binary()), pa.array(count, pa.binary())], ["lang", "bucket", "count"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in batch.column(1).to_pylist():
                df[np.frombuffer(b, "<u2")] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], ["bucket", "n"])

    drawn = written(known.filter(draw).select("lang", "text").mapInArrow(collect, "lang string, bucket binary, count binary").limit(2 * max_rows), "grams")
    df = np.zeros(BUCKETS, np.int64)
    for b, n in drawn.mapInArrow(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        df[b] = n
    inside = np.zeros(BUCKETS, bool)
    inside[vocabulary_of(df, drawn.count())] = True

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, count = [], []
            for b, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                b, n = np.frombuffer(b, "<u2"), np.frombuffer(n, "<u4")
                bucket.append(b[inside[b]].tobytes())
                count.append(n[inside[b]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bucket, pa.binary()), pa.array(count, pa.binary())], ["lang", "bucket", "count"])

    rows = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in drawn.mapInArrow(narrowed, "lang string, bucket binary, count binary").collect())
    discard(drawn)
    rng = np.random.default_rng(1)
    samples = [(rows[k][0], np.frombuffer(rows[k][1], "<u2").astype(np.int64), np.frombuffer(rows[k][2], "<u4")) for k in rng.permutation(len(rows))]
    return train(samples, df)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Only the text is read for it."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                lang, score = zip(*[own.predict(t) for t in b.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return predicted(docs, fit(docs))
