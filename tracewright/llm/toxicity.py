"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, length normalisation, exceptions.

Folding maps each character on its own: lower case, look-alike letters of other scripts to Latin ones,
digits to the letters they stand for, l and 1 both to i, invisible characters away, all else that is
no letter to a blank. A lexicon entry is a blank and the first letters of a word, or a blank, a whole
word and a blank; so a match begins at a word.

`fit` learns the entries from labelled rows: document counts of words and word beginnings by label, a
G-test and log-odds weights. At most `sample_rows` rows a class (in expectation) are used, drawn by a hash of
the id; of rows that share their least shingle hash (near copies, mostly) one counts. Entries met in harmless rows give exception phrases (the entry's word with a neighbour) that
occur at least `exception_docs` times there and never in a toxic row. A logistic model of three figures
(matched weight, weight by the root of the length, distinct entries) turns matches into a score.

Defined results: null and empty texts score as texts without a match. Rows are kept one to one.
Labelled rows with a null id or label are not learned from; without rows of both labels every text scores as one without a
match under the default coefficients (nearly 0). An empty table gives an empty one. A column named as the score is replaced,
others are kept whatever their names. Repeated rows and ties score alike.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.minhash import shingles
from tracewright.llm.textarrays import chunks

# Look-alikes of Latin letters in Cyrillic and Greek, and digits as letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ⅼ": "i", "l": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SHORTEST, LONGEST = 4, 12
#: Counts that a task holds before it hands them on.
HELD = 300_000


@lru_cache(1)
def table() -> np.ndarray:
    """By code point: its folded code point, a blank, or 0 for what vanishes."""
    t = np.full(0x110000, ord(" "), np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        k = unicodedata.category(ch)
        if k[0] == "L":
            flat = unicodedata.normalize("NFKC", ch).lower()
            flat = flat if len(flat) == 1 else ch.lower()
            t[c] = ord(HOMOGLYPHS.get(flat, flat)[0])
        elif k in ("Cf", "Mn"):
            t[c] = 0
        elif k == "Nd":
            t[c] = ord(DIGITS.get(str(unicodedata.digit(ch)), " "))
    return t


def fold(text: str | None) -> str:
    """The folded text, a blank before and after it."""
    cp = table()[np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")]
    return f" {cp[cp != 0].tobytes().decode('utf-32-le')} "


def entries(text: str) -> set[str]:
    out = set()
    for w in set(text.split()):
        if len(w) >= SHORTEST:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, -40.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return (self.weights, self.exceptions, self.coefficients)

    def __setstate__(self, state):
        self.weights, self.exceptions, self.coefficients = state
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for k, w in self.weights.items():
                a.add_word(k, (k, w))
            if self.weights:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, text: str) -> dict[int, tuple[str, float]]:
        """By the place where a word begins: its heaviest entry, unless an exception phrase holds the word."""
        found: dict[int, tuple[str, float]] = {}
        if not self.weights:
            return found
        for end, (k, w) in self.automaton().iter(text):
            at = end - len(k) + 1
            if w > found.get(at, ("", -math.inf))[1]:
                found[at] = (k, w)
        return {at: x for at, x in found.items() if not (self.exceptions and any(p in self.exceptions for p in phrases(text, at)))}

    def figures(self, text: str) -> tuple[float, float, float]:
        found = self.matches(text)
        if not found:
            return 0.0, 0.0, 0.0
        total = sum(w for _, w in found.values())
        return math.log1p(total), total / math.sqrt(10 + text.count(" ")), math.log1p(len({k for k, _ in found.values()}))

    def score(self, text: str | None) -> float:
        *c, b = self.coefficients
        z = b + sum(x * y for x, y in zip(c, self.figures(fold(text)), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def phrases(text: str, at: int) -> tuple[str, str, str]:
    """The word that begins after `at`, alone, with the word before and with the word after."""
    end = text.find(" ", at + 1)
    word = text[at + 1 : end]
    before = text[:at].rstrip(" ")
    before = before[before.rfind(" ") + 1 :]
    after = ""
    if end >= 0:
        begin = end
        while begin < len(text) and text[begin] == " ":
            begin += 1
        stop = text.find(" ", begin)
        after = text[begin:] if stop < 0 else text[begin:stop]
    return f"{word}", f"{before} {word}", f"{word} {after}"


def tally(rows: DataFrame, of) -> DataFrame:
    """(x, toxic, harmless): in how many rows of each label each x of of(folded text) is. rows: (text, label)."""

    def flush(counts: dict[int, Counter]) -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[y][k] for k in keys], pa.int64()) for y in (1, 0))], names=["x", "toxic", "harmless"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[label].update(of(fold(text.as_py())))
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield flush(counts)
                    counts = {0: Counter(), 1: Counter()}
        yield flush(counts)

    return rows.mapInArrow(run, "x string, toxic long, harmless long").groupBy("x").agg(F.sum("toxic").alias("toxic"), F.sum("harmless").alias("harmless"))


def least_shingle(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        out = []
        for lo, hi, data, off in chunks(column):
            h, at = shingles(data, off, 5)
            low = np.zeros(hi - lo, np.int64)
            full = np.flatnonzero(np.diff(at))
            low[full] = h[at[full]].view(np.int64)
            out.append(low)
        yield pa.array(np.concatenate(out) if out else [], pa.int64())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, least_g: float = 20.0, least_weight: float = 2.5, exception_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the rows of docs that labels (id, 0 or 1) covers.

    sample_rows bounds, in expectation, the rows of each label that are learned from.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    n = {r["label"]: r["count"] for r in y.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model({})
    share = {k: min(1.0, sample_rows / v) for k, v in n.items()}
    drawn = F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(1_000_000)) < F.when(F.col("label") == 1, share[1] * 1e6).otherwise(share[0] * 1e6)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(y.where(drawn)), id_col).select("text", "label")
    # Near copies share their least shingle and count once; a text without one is its own. Which text stands for them is settled by order.
    least = F.arrow_udf(least_shingle, "long")("text")
    rows = rows.withColumn("least", F.when(least == 0, F.xxhash64("text")).otherwise(least)).groupBy("least", "label").agg(F.min("text").alias("text")).select("text", "label").persist()
    try:
        have = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        t, h = have.get(1, 0), have.get(0, 0)
        if not t or not h:
            return Model({})
        p, q = F.col("toxic"), F.col("harmless")
        weight = F.log((p + 0.5) / (t + 1)) - F.log((q + 0.5) / (h + 1))
        # Signed G-test of the entry's rows against the share of toxic rows.
        at, ah = (p + q) * (t / (t + h)), (p + q) * (h / (t + h))
        g = 2 * (p * F.log(p / at) + F.when(q > 0, q * F.log(q / ah)).otherwise(0.0))
        found = tally(rows, entries).where(p > 0).withColumns({"weight": weight, "g": g}).where((F.col("weight") >= least_weight) & (F.col("g") >= least_g))
        learned = {r["x"]: (r["weight"], r["toxic"]) for r in found.select("x", "weight", "toxic").collect()}
        kept: dict[str, float] = {}
        for k in sorted(learned, key=lambda k: (len(k), k)):
            # A shorter entry that is nearly as heavy stands for all that begin with it.
            if not any(k[:i] in kept and kept[k[:i]] >= learned[k][0] - 1.0 for i in range(SHORTEST + 1, len(k))):
                kept[k] = learned[k][0]
        model = Model(kept)
        if not kept:
            return model
        near = tally(rows, lambda text: {x for at in model.matches(text) for x in phrases(text, at)})
        model.exceptions = frozenset(r["x"] for r in near.where((q >= exception_docs) & (p == 0)).select("x").collect())

        def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f = [model.figures(fold(x.as_py())) for x in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in f], pa.float64()) for i in range(3)] + [batch.column(1)], names=["a", "b", "c", "label"])

        # At most about 2 * sample_rows rows of four numbers.
        data = np.array([list(r) for r in rows.mapInArrow(figures, "a double, b double, c double, label int").collect()], float)
    finally:
        rows.unpersist()
    model.coefficients = logistic(data[:, :3], data[:, 3], np.where(data[:, 3] == 1, n[1] / t, n[0] / h))
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Coefficients and intercept by Newton's method, rows weighted to the labels' true shares."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.mean()
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * b * len(x)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with the score of every whole text added."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([model.score(x.as_py()) for x in column], pa.float64())

    return docs.withColumn(to, F.arrow_udf(run, "double")(F.col(text_col).cast("string")))
