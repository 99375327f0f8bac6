"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over whole texts: word shingles as 64-bit hashes, the distinct set's size, a 128-bit
   digest of the set and a MinHash signature. Equal sets collapse to the smallest id.
2. Signatures are cut into bands. Every member of a band's bucket is paired with one hub of the
   bucket only, so candidates stay linear in a bucket's size.
3. A pair's signatures are compared in batches. After each, the posterior of its similarity (uniform
   prior, binomial likelihood) decides: once P(similarity >= threshold) falls below `miss`, the pair
   goes. Survivors are verified on their full sets, exactly.
4. Confirmed links make components. Buckets that still hold several components are dealt out in
   blocks of rows, and block pairs compare across components only; what survives is verified on full
   sets, block against block.
   So no link is lost but with the stated probability of the bands and of the pruning, and a group of
   near copies that has already come together costs nothing more.

Defined results: null and empty texts, or texts without words, have an empty set and are linked with
nothing; with fewer words than a shingle has, the whole sequence is one shingle. Repeated rows of an
id give repeated result rows; a null id belongs to no component (component null, kept true). Extra
columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.linking import connect
from tracewright.llm.shared import cut, discard
from tracewright.llm.textarrays import U, chunks, mix, prefix_hash, span_hash, words

BANDS, ROWS = 24, 4
#: Values of a signature; one pair in 10^5.5 of similarity 0.8 shares no band.
K = BANDS * ROWS
#: Signature values compared between two looks at the posterior.
BATCH = 16


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * K + 1, dtype=U) * U(0xA24BAED4963EE407))
    return seed[:K] | U(1), seed[K:]


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets): the distinct shingles of each row, in order of their hashes."""
    start, end, row = words(data, off)
    n = len(off) - 1
    if not len(start):
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    h = span_hash(prefix_hash(data, fold_case=True), start, end)
    per = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(per)])
    width = np.minimum(per, size)
    made = np.where(per > 0, per - width + 1, 0)
    at = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(n), made)
    begin = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], made)
    s = np.zeros(len(begin), U)
    for i in range(size):
        more = i < width[owner]
        s = np.where(more, mix(s * U(0x9FB21C651E98DF25) + h[np.minimum(begin + i, len(h) - 1)]), s)
    out, sizes = [], np.zeros(n, np.int64)
    for i in np.flatnonzero(made):
        out.append(u := np.unique(s[at[i] : at[i + 1]]))
        sizes[i] = len(u)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of K 32-bit minima for each non-empty set."""
    starts = off[:-1][off[:-1] < off[1:]]
    out = np.empty((len(starts), K), np.uint32)
    a, b = _functions()
    for k in range(K if len(starts) else 0):
        out[:, k] = np.minimum.reduceat(((sets * a[k] + b[k]) >> U(32)).astype(np.uint32), starts)
    return out


def sketch(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, d1, d2 (digest of the set) and the signature, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                s, at = shingles(data, off, size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                d1, d2 = np.zeros(len(n), U), np.zeros(len(n), U)
                if len(full):
                    d1[full], d2[full] = np.add.reduceat(mix(s), at[full]), np.add.reduceat(mix(s ^ U(0x5851F42D4C957F2D)), at[full])
                sig: list[bytes | None] = [None] * len(n)
                for i, x in zip(full, signatures(s, at), strict=True):
                    sig[i] = x.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sig, pa.binary())], names=["id", "n_shingles", "d1", "d2", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__t")).mapInArrow(run, f"id {kind}, n_shingles long, d1 long, d2 long, sig binary")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each signature."""
    sig = sig.reshape(-1, BANDS, ROWS).astype(U)
    h = np.zeros(sig.shape[:2], U) + np.arange(BANDS, dtype=U)
    for r in range(ROWS):
        h = mix(h * U(0x9FB21C651E98DF25) + sig[:, :, r])
    return h.view(np.int64)


def banded(reps: DataFrame) -> DataFrame:
    """(key, id): a row for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = band_keys(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1)), batch.column(0).take(pa.array(np.repeat(np.arange(len(h)), BANDS)))], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, f"key long, id {reps.schema['id'].dataType.simpleString()}")


@lru_cache(4)
def least_matches(threshold: float, miss: float) -> np.ndarray:
    """By the number of batches compared: the least matches with which a pair stays.

    With m of n equal values and a uniform prior the similarity is Beta(m+1, n-m+1) distributed;
    P(similarity >= t) is then P(Binomial(n+1, t) <= m), and equal values at similarity s are taken
    as binomial. The pair goes when that probability is under `miss`.
    """
    out = []
    for n in range(BATCH, K + 1, BATCH):
        tail, m = 0.0, -1
        while True:
            tail += math.comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            if tail >= miss:
                break
            m += 1
        out.append(m + 1)
    return np.array(out)


def survivors(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which of the pairs (x[left], y[right]) stay after all batches; a pair that goes is not looked at again."""
    alive, m = np.arange(len(left)), np.zeros(len(left), np.int64)
    for i, least in enumerate(least_matches(threshold, miss)):
        c = slice(i * BATCH, (i + 1) * BATCH)
        m[alive] += (x[left[alive], c] == y[right[alive], c]).sum(1)
        alive = alive[m[alive] >= least]
        if not len(alive):
            break
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def full_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, content): the full sets of the documents (id, text) of distinct ids that ids names, as bytes in order."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                s, at = shingles(data, off, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "content"])

    return docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(sets, f"id {ids.schema['id'].dataType.simpleString()}, content binary")


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union."""
    kind = pairs.schema["a"].dataType.simpleString()
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    full = cut(full_sets(ids, docs, size), "sets")
    joined = pairs.join(full.select(F.col("id").alias("a"), F.col("content").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("content").alias("sb")), "b")
    links = cut(joined.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}"), "links")
    discard(full)
    return links


def linked_sets(x: list[bytes], y: list[bytes], mask: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, None]:
    """The pairs of the mask with 100 * intersection >= percent * union. Counts by products of incidence matrices."""
    sets = [np.frombuffer(s, U) for s in x + y]
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[col] > 1
    row, col = row[several], np.unique(col[several], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        common += m[: len(x)] @ m[len(x) :].T
    return *np.nonzero(mask & (100 * common >= percent * (n[: len(x), None] + n[None, len(x) :] - common))), None


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id linked through others) and kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of distinct
    shingles. miss: the posterior probability of a link under which a candidate is given up.
    """
    threshold = percent / 100
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = cut(sketch(docs, shingle_words, "id"), "sketch")
    full = sketched.where("n_shingles > 0 and id is not null")
    reps = cut(full.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.min_by("sig", "id").alias("sig")), "reps")
    source = docs.join(reps.select("id"), "id", "left_semi").dropDuplicates(["id"])
    stay = partial(survivors, threshold=threshold, miss=miss)
    comp = connect(banded(reps), reps.select("id", "sig"), _matrix, stay, band_keys, lambda pairs: verify(pairs, source, shingle_words, percent), lambda ids: full_sets(ids, source, shingle_words), partial(linked_sets, percent=percent)).select(F.col("id").alias("rep"), "component")
    member = reps.select("d1", "d2", F.col("id").alias("rep")).join(comp, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("c"))
    found = sketched.join(member, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
