"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of the lower-cased whole text, hashed to DIM columns; tf is
log(1 + count), idf comes from all documents, rows have length one. Training is FTRL-proximal with an
elastic net (l1 keeps the weights sparse, l2 small) on at most `sample_rows` labelled rows (in
expectation), in shards whose weights are averaged; a tenth of the sample is kept apart, and the softmax
temperature is the one that fits it best.

Defined results: a text that is null or has no letter is `und` with score 0. Without a labelled
row every text is `und`. Rows are kept one to one; labels that are null are not learned from. An empty table gives an empty
one. Of languages of equal probability the first by name counts. Columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.byte_bpe import codepoints
from tracewright.llm.textarrays import U, chunks

DIM = 1 << 13
#: Rows whose dense counts are held together.
ROWS = 128


@lru_cache(1)
def lowered() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case (if one code point), and whether it is a letter."""
    low, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] == "L":
            letter[c] = True
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
    return low, letter


def counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts as rows of DIM columns, whether the row has a letter)."""
    n = len(off) - 1
    cp, at = codepoints(data)
    low, letter = lowered()
    row = np.searchsorted(off, at, "right") - 1
    has = np.bincount(row[letter[cp]], minlength=n) > 0
    c = low[cp].astype(U)
    out = np.zeros(n * DIM, np.int64)
    shift = U(64 - DIM.bit_length() + 1)
    g = np.zeros(len(c), U)
    for k in range(3):
        m = len(c) - k
        if m <= 0:
            break
        g = g[:m] * U(0x9E3779B97F4A7C15) + (c[k:] + U(1 + k)) * U(0xD6E8FEB86659FD93)
        same = row[:m] == row[k:]
        h = ((g ^ (g >> U(29))) * U(0xBF58476D1CE4E5B9)) >> shift
        out += np.bincount(row[:m][same] * DIM + h[same].astype(np.int64), minlength=n * DIM)
    return out.reshape(n, DIM), has


def features(data: np.ndarray, off: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, has = counts(data, off)
    x = np.log1p(raw.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), has


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, off in chunks(column, 1 << 19):
        for a in range(0, hi - lo, ROWS):
            b = min(hi - lo, a + ROWS)
            yield lo + a, lo + b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """idf of each column, from all rows of texts (text): DIM numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, _, data, off in blocks(batch.column(0)):
                df += (counts(data, off)[0] > 0).sum(0)
                n += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM, dtype=np.int32)), pa.array(np.concatenate([[n], df]))], names=["f", "df"])

    got = texts.select("text").mapInArrow(run, "f int, df long").groupBy("f").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIM + 1)
    for r in got:
        df[r["f"] + 1] = r["df"]
    return np.log((1 + df[0]) / (1 + df[1:])).astype(np.float32) + 1


def ftrl(x: np.ndarray, y: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (features + 1, classes) by per-coordinate FTRL-proximal steps over small batches."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    z, n = np.zeros((x.shape[1], classes)), np.zeros((x.shape[1], classes))
    weights = lambda: np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 16):
            i = order[lo : lo + 16]
            w = weights()
            p = softmax(x[i] @ w)
            p[np.arange(len(i)), y[i]] -= 1
            g = x[i].T @ p
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z += g - sigma * w
            n += g * g
    return weights()


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIM + 1, languages)
    temperature: float = 1.0


def fit(docs: DataFrame, train: DataFrame, sample_rows: int = 4_000, shards: int = 4, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """docs: all documents, for the idf; train: the rows to learn from."""
    idf = document_frequencies(docs.select(F.col(text_col).cast("string").alias("text")))
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    found = sorted((r[lang_col], r["count"]) for r in rows.groupBy(lang_col).count().collect())
    if not found:
        return None
    languages = [k for k, _ in found]
    number = {k: i for i, k in enumerate(languages)}
    each = sample_rows / len(languages)
    share = F.coalesce(*(F.when(F.col(lang_col) == k, min(1.0, each / n)) for k, n in found))
    draw = F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1_000_000)) / 1e6
    sample = rows.where(draw < share).select(F.col(text_col).cast("string").alias("text"), F.create_map(*(F.lit(v) for kv in number.items() for v in kv))[F.col(lang_col)].alias("y"), F.pmod(F.xxhash64(F.lit(6), id_col), F.lit(10)).alias("fold"), F.pmod(F.xxhash64(F.lit(8), id_col), F.lit(shards)).alias("shard"))
    k = len(languages)

    def train_shard(t: pa.Table) -> pa.Table:
        x = np.concatenate([features(d, o, idf)[0] for c in t["text"].chunks for _, _, d, o in blocks(c)])
        w = ftrl(x, t["y"].to_numpy(), k, epochs, alpha, beta, l1, l2)
        f, c = np.nonzero(w)
        return pa.table({"f": pa.array(f, pa.int32()), "c": pa.array(c, pa.int32()), "w": pa.array(w[f, c])})

    w = np.zeros((DIM + 1, k))
    averaged = sample.where("fold > 0").select("shard", "text", "y").groupBy("shard").applyInArrow(train_shard, "f int, c int, w double").groupBy("f", "c").agg((F.sum("w") / shards).alias("w"))
    for r in averaged.collect():  # at most DIM + 1 rows a language
        w[r["f"], r["c"]] = r["w"]

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, d, o in blocks(batch.column(0)):
                a = features(d, o, idf)[0] @ w[:-1] + w[-1]
                yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.list_(pa.float64())), batch.column(1).slice(lo, hi - lo)], names=["a", "y"])

    apart = sample.where("fold = 0").select("text", "y").mapInArrow(logits, "a array<double>, y int").collect()  # a tenth of sample_rows
    model = Model(languages, idf, w.astype(np.float32))
    if apart:
        a, y = np.array([r["a"] for r in apart]), np.array([r["y"] for r in apart])
        loss = lambda t: -np.log(np.maximum(softmax(a / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.02, 5, 120), key=loss))
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the calibrated probability) added."""
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*model.languages, "und"], dtype=object)
        for column in texts:
            best, score = [], []
            for _, _, data, off in blocks(column):
                x, has = features(data, off, model.idf)
                p = softmax((x @ model.weights[:-1] + model.weights[-1]) / model.temperature)
                best.append(np.where(has, p.argmax(1), len(names) - 1))
                score.append(np.where(has, p.max(1), 0.0))
            which = np.concatenate(best) if best else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays([pa.array(names[which].tolist(), pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], names=["lang_pred", "score"])

    out = docs.withColumn("__p", F.arrow_udf(run, "lang_pred string, score double")(F.col(text_col).cast("string")))
    return out.withColumn("lang_pred", F.col("__p.lang_pred")).withColumn("score", F.col("__p.score")).drop("__p")
