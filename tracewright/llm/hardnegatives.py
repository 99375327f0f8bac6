"""Hard negatives of anchors by exact inner-product search with coordinate pruning.

Two searches run over whole-number vectors: for each anchor its best rows of the same label (the positives),
and for each of those its best rows of other labels whose score lies in the positive's window. A search deals
rows and anchors into shards of bounded size, and each shard of rows meets each shard of anchors in one task. There
the rows stand in buckets by falling length. An anchor's weakest score that still counts, divided by the lengths,
is the least cosine that a row of a bucket must reach: a bucket too short for it is passed over with all that
follow. In the others, the anchor's largest coordinates are its focus: only a range of values in each is
feasible, the range is cut out of the bucket's sorted list of that coordinate, the ranges are intersected, and the rows left
are scored exactly. Where the narrowest range holds little of a bucket it is cut out of the list and the other ranges are tested on it; where
it holds most, the ranges of many anchors are intersected together, by the rows' places in the lists.
Rounding only ever widens the ranges; scores are exact.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of
different lengths never meet. Rows that share an id count as one, the first by label and the bytes of its whole numbers. Equal scores go by the
smaller id. An anchor without others of its label has no rows, nor has a positive without rows in its window (so none
with a negative score). An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.shared import cut
from tracewright.llm.vectors import quantised, stacked

#: Rows and anchors of a shard, on average, and rows of a bucket.
ROWS, ANCHORS, BUCKET = 1 << 16, 1 << 12, 1024
#: Rows that are worth a task of their own while cores are idle.
LEAST = 2048
#: Coordinates in focus; share of a bucket from which ranges are intersected for many anchors together, and how many these are.
FOCUS, DENSE, TOGETHER = 4, 0.5, 256
NONE = -np.inf


class Best:
    """The k best (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.least = k, np.full(slots, NONE)
        self.slot, self.score, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(begin, np.diff(begin, append=len(slot)))
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least[slot[full]] = score[full]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("nd,nd->n", x, x))


def search(ids: np.ndarray, vecs: np.ndarray, labels: np.ndarray, own: np.ndarray, asked: np.ndarray, theirs: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool) -> Best:
    """The k best rows (ids, vecs, labels) of each slot of anchors (own ids, asked vectors, theirs labels).

    lo and hi (anchors by slots, NaN where a slot is not used) bound the scores; slot numbers run through them row by row. With
    `same` rows of the anchor's label other than itself count, else rows of other labels.
    """
    if vecs.shape[1] * float(np.abs(vecs).max(initial=0)) * float(np.abs(asked).max(initial=0)) >= 2.0**53:
        raise ValueError("scores are too large to be exact")
    x, q = vecs.astype(np.float64), asked.astype(np.float64)
    long = lengths(x)
    order = np.lexsort((ids, -long))
    x, ids, labels, long = x[order], ids[order], labels[order], long[order]
    qlong = lengths(q)
    unit_q = q / np.where(qlong > 0, qlong, 1)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1, kind="stable")[:, :FOCUS]
    slots = lo.shape[1]
    best = Best(lo.size, k)
    used = ~np.isnan(lo)

    def offer(a: np.ndarray, r: np.ndarray, score: np.ndarray, candidates: np.ndarray | bool = True) -> None:
        """Scores of anchors a by rows r, to every slot, where they are candidates."""
        ok = (labels[r][None, :] == theirs[a][:, None]) & (ids[r][None, :] != own[a][:, None]) if same else labels[r][None, :] != theirs[a][:, None]
        ok = ok & candidates
        for s in range(slots):
            floor = np.maximum(lo[a, s], best.least[a * slots + s])[:, None]
            fits = np.where(ok & (score >= floor) & (score <= hi[a, s][:, None]), score, NONE)  # NaN fits nothing
            if len(r) > k:
                fits = np.where(fits >= np.partition(fits, len(r) - k, axis=1)[:, len(r) - k, None], fits, NONE)
            i, j = np.nonzero(fits > NONE)
            if len(i):
                best.add(a[i] * slots + s, fits[i, j], ids[r[j]])

    for begin in range(0, len(x), BUCKET):
        rows = np.arange(begin, min(begin + BUCKET, len(x)))
        # What an anchor's weakest slot still asks for.
        need = np.where(used, np.maximum(np.where(used, lo, np.inf), best.least.reshape(lo.shape)), np.inf).min(1, initial=np.inf)
        live = np.flatnonzero((need < np.inf) & (need <= qlong * long[begin] * (1 + 1e-9)))
        if not len(live):
            if (need > 0).all():
                break  # the buckets that follow are shorter still
            continue
        unit = x[rows] / np.where(long[rows] > 0, long[rows], 1)[:, None]
        # Only a positive need prunes: dividing it by the bucket's greatest length bounds the cosines of all its rows.
        angle = np.full(len(live), np.pi)
        up = need[live] > 0
        angle[up] = np.arccos(np.clip(need[live][up] / (qlong[live][up] * long[begin]), -1, 1)) + 1e-6
        f = focus[live]
        middle = np.arccos(np.clip(np.take_along_axis(unit_q[live], f, 1), -1, 1))
        low = np.cos(np.minimum(np.pi, middle + angle[:, None])) - 1e-9
        high = np.cos(np.maximum(0, middle - angle[:, None])) + 1e-9
        first, last, lists = np.zeros(f.shape, np.int64), np.full(f.shape, len(rows)), {}
        for c in np.unique(f[up]):
            lists[c] = np.argsort(unit[:, c], kind="stable")
            value = unit[lists[c], c]
            at = (f == c) & up[:, None]
            first[at], last[at] = np.searchsorted(value, low[at], "left"), np.searchsorted(value, high[at], "right")
        width = last - first
        whole = width.min(1, initial=len(rows)) > DENSE * len(rows)
        wide = np.flatnonzero(whole)
        for begin_at in range(0, len(wide), TOGETHER):
            these = wide[begin_at : begin_at + TOGETHER]
            fits = np.ones((len(these), len(rows)), bool)
            for j in range(f.shape[1]):
                cuts = np.flatnonzero(width[these, j] < len(rows))
                for c in np.unique(f[these[cuts], j]):
                    at = cuts[f[these[cuts], j] == c]
                    place = np.empty(len(rows), np.int64)
                    place[lists[c]] = np.arange(len(rows))
                    fits[at] &= (place >= first[these[at], j, None]) & (place < last[these[at], j, None])
            found = np.flatnonzero(fits.any(0))
            if len(found):
                a, r = live[these], rows[found]
                offer(a, r, q[a] @ x[r].T, fits[:, found])
        for i in np.flatnonzero(~whole):
            c = int(width[i].argmin())
            found = lists[f[i, c]][first[i, c] : last[i, c]]
            for j in range(f.shape[1]):
                if j != c and len(found):
                    value = unit[found, f[i, j]]
                    found = found[(value >= low[i, j]) & (value <= high[i, j])]
            if len(found):
                a, r = live[i : i + 1], rows[found]
                offer(a, r, q[a] @ x[r].T)
    return best


def spread(rows: DataFrame, anchors: DataFrame, cores: int) -> tuple[DataFrame, DataFrame]:
    """rows and anchors (group, id, ...) with shard and part: each shard of a group's rows meets each part of its anchors."""
    most = F.least(F.lit(cores), F.ceil(F.col("n") / LEAST)) if cores else F.lit(1)
    n = rows.groupBy("group").agg(F.count("id").alias("n")).select("group", F.greatest(F.ceil(F.col("n") / ROWS), most).cast("int").alias("shards"))
    m = anchors.groupBy("group").agg(F.ceil(F.count("id") / ANCHORS).cast("int").alias("parts"))
    sizes = cut(n.join(m, "group"), "shards")
    number, every = lambda of: F.pmod(F.xxhash64("id"), of).cast("int"), lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    a = rows.join(sizes, "group").withColumn("shard", number("shards")).withColumn("part", every("parts"))
    b = anchors.join(sizes, "group").withColumn("part", number("parts")).withColumn("shard", every("shards"))
    return a.drop("shards", "parts"), b.drop("shards", "parts")


def best_rows(rows: DataFrame, anchors: DataFrame, k: int, same: bool, cores: int = 0, low: int = 0, high: int = 100) -> DataFrame:
    """(anchor, slot, id, score) of the k best rows of each slot, from each shard.

    rows: (group, id, label, vec); anchors the same and `scores`, the positives' (array): a slot each, for scores from low to high
    per cent of it; null for one slot without bounds.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns([c.removeprefix("of_") for c in right.column_names])
        theirs = [None if x is None else np.array(x, np.int64) for x in right["scores"].to_pylist()]
        slots = max((1 if x is None else len(x) for x in theirs), default=0)
        lo, hi = np.full((len(theirs), slots), np.nan), np.full((len(theirs), slots), np.nan)
        for i, p in enumerate(theirs):
            if p is None:
                lo[i, 0], hi[i, 0] = NONE, np.inf
            else:  # the least and the greatest whole numbers within, without overflow
                lo[i, : len(p)] = low * (p // 100) + (low * (p % 100) + 99) // 100
                hi[i, : len(p)] = high * (p // 100) + high * (p % 100) // 100
        names = np.unique([*left["label"].to_pylist(), *right["label"].to_pylist()], return_inverse=True)[1]
        best = search(left["id"].to_numpy(), stacked(left["vec"]), names[: left.num_rows], right["id"].to_numpy(), stacked(right["vec"]), names[left.num_rows :], lo, hi, k, same) if left.num_rows and right.num_rows else Best(0, k)
        ids = right["id"].to_numpy()
        return pa.table({"anchor": ids[best.slot // max(1, slots)], "slot": pa.array(best.slot % max(1, slots), pa.int32()), "id": best.id, "score": pa.array(best.score.astype(np.int64))})

    a, b = spread(rows.select("group", "id", F.col("label").cast("string").alias("label"), "vec"), anchors.select("group", "id", F.col("label").cast("string").alias("label"), "vec", "scores"), cores)
    keys = ["group", "shard", "part"]
    b = b.select([F.col(c).alias(f"of_{c}") for c in b.columns])  # both may come from one table
    return a.groupBy(*keys).cogroup(b.groupBy(*(f"of_{c}" for c in keys))).applyInArrow(run, "anchor long, slot int, id long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on the columns of vectors. An anchor's positives are its best rows of the same label by whole-number
    inner product; a positive's negatives are the best rows of other labels that score from low to high per cent of it.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vec_col).alias("v")).where("id is not null and label is not null")
    one = quantised(read, "v", scale).groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("x"))
    rows = cut(one.select("id", "x.label", "x.vec", "x.anchor").withColumn("dim", F.length("vec")), "vectors")
    top = lambda df, keys, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    by_label = rows.withColumn("group", F.struct("dim", "label"))
    anchors = by_label.where("anchor").withColumn("scores", F.lit(None).cast("array<long>"))
    found = cut(top(best_rows(by_label, anchors, positives, True), ["anchor"], positives), "positives")

    windows = found.where("score >= 0").groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))  # some few of each anchor
    by_dim = rows.withColumn("group", F.col("dim"))
    hard = best_rows(by_dim, by_dim.where("anchor").drop("anchor").join(windows.withColumnRenamed("anchor", "id"), "id"), negatives, False, cores, low, high)
    hard = top(hard, ["anchor", "slot"], negatives)
    # Scores fall with rank, so that those from 0 up are a positive's first ranks: slot 0 is rank 1.
    positive = found.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(positive, ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
