"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Vectors are compared within a label. Equal vectors collapse first. Each of m tables draws some sign
projections, which split a label into cells of a few dozen vectors (their number follows the label's
size), and one more projection, by which a cell is sorted. Two vectors collide in a table when they
share the cell and the later one lies in the window of half-width W centred on the earlier. A pair is
verified, by cosine in double precision, at its c-th collision, in the table where that happens;
every task can tell, as all tables follow from the vectors. m is the least number with which a pair at
the threshold collides less than c times with probability `miss` at most.

A task hands on link counts and local roots per vector, not pairs. Crowded cells are split into
blocks, and each pair of blocks is a group of its own; so a group of near copies of any size is
spread, and its links are all counted.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, or have a
null label or id, link with nothing. Vectors of different lengths never meet. Repeated rows count as
vectors of their own. Extra columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import components, cut

COUNT = 2
#: Half-width of the windows, in chords at the threshold (a projection's standard deviation for such a pair).
WIDTH = 2.5
#: Vectors of a cell to aim at, and of a block of a crowded cell.
CELL, BLOCK = 32, 1024


def tables(bits: int, threshold: float, miss: float) -> int:
    p = (1 - math.acos(threshold) / math.pi) ** bits * math.erf(WIDTH / math.sqrt(2))
    m = COUNT
    while sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(COUNT)) > miss:
        m += 1
    return m


@lru_cache(16)
def directions(dim: int, bits: int, m: int) -> np.ndarray:
    return np.random.default_rng([dim, bits, 20_011]).standard_normal((dim, m, bits + 1))


def project(x: np.ndarray, bits: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, place) of unit vectors in each table."""
    p = np.einsum("nd,dtb->ntb", x, directions(x.shape[1], bits, m), optimize=True)
    return ((p[:, :, :bits] > 0) << np.arange(bits)).sum(2).astype(np.int64), p[:, :, bits]


def clean(vectors: DataFrame) -> DataFrame:
    """(id, label, vec): vec holds the components as bytes of doubles, or null where they can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    a = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if np.isfinite(a).all() and a.any():
                        x = a.tobytes()
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])

    return vectors.mapInArrow(run, f"id long, label {vectors.schema['label'].dataType.simpleString()}, vec binary")


def spread(reps: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(key, table, place, id, weight, bits, vec): a row for each table of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bits = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            size = np.array([len(x) for x in raw])
            for b, n in {*zip(bits.tolist(), size.tolist(), strict=True)}:
                at = np.flatnonzero((bits == b) & (size == n))
                m = tables(b, threshold, miss)
                x = np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1)
                cell, place = project(x / np.linalg.norm(x, axis=1, keepdims=True), b, m)
                rows = pa.array(np.repeat(at, m))
                part = batch.take(rows)
                cells = pa.array(cell.reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column(4), part.column(5), pa.array(np.tile(np.arange(m, dtype=np.int32), len(at))), cells, pa.array(place.reshape(-1)), *(part.column(i) for i in (0, 1, 3, 2))], names=["label", "dim", "table", "cell", "place", "id", "weight", "bits", "vec"])

    kind = reps.schema["label"].dataType.simpleString()
    wide = reps.select("id", "weight", "vec", "bits", "label", F.length("vec").alias("dim")).mapInArrow(run, f"label {kind}, dim int, table int, cell long, place double, id long, weight long, bits int, vec binary")
    return wide.withColumn("key", F.xxhash64("label", "dim", "table", "cell")).select("key", "table", "place", "id", "weight", "bits", "vec")


def links(dealt: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Rows sorted by (group, place) to (id, n, root): links found per vector, and one of its local component."""
    chord = math.sqrt(2 - 2 * threshold)

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        group, table, place, ids, weight, bits, side = (t[c].to_numpy() for c in ("group", "table", "place", "id", "weight", "bits", "side"))
        raw = t["vec"].to_pylist()
        n = len(group)
        size = np.array([len(x) for x in raw])
        # A group has one label and length of vector; its vectors' collisions in all tables are needed.
        count, root = np.zeros(n, np.int64), np.arange(n)
        edges: list[np.ndarray] = []
        for b, d in {*zip(bits.tolist(), size.tolist(), strict=True)}:
            m = tables(b, threshold, miss)
            own = np.flatnonzero((bits == b) & (size == d))
            x = np.frombuffer(b"".join(raw[i] for i in own)).reshape(len(own), -1)
            norm = np.linalg.norm(x, axis=1)
            cell, spot = project(x / norm[:, None], b, m)
            g, p, tab, s = group[own], place[own], table[own], side[own]
            live, step = np.arange(len(own)), 1
            while len(live := live[live + step < len(own)]):
                live = live[(g[live + step] == g[live]) & (p[live + step] - p[live] <= WIDTH * chord)]
                for lo in range(0, len(live), 20_000):
                    i = live[lo : lo + 20_000]
                    j = i + step
                    ok = ((s[i] == 0) | (s[i] != s[j])) & (ids[own[i]] != ids[own[j]])
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    hit = (cell[i] == cell[j]) & (np.abs(spot[i] - spot[j]) <= WIDTH * chord)
                    due = np.cumsum(hit, axis=1)[np.arange(len(i)), tab[i]] == COUNT
                    i, j = i[due], j[due]
                    near = np.einsum("nd,nd->n", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
                    i, j = own[i[near]], own[j[near]]
                    np.add.at(count, i, weight[j])
                    np.add.at(count, j, weight[i])
                    edges.append(np.column_stack([i, j]))
                step += 1
        if not edges or not len(e := np.concatenate(edges)):
            return None
        while True:
            low = np.minimum(root[e[:, 0]], root[e[:, 1]])
            new = root.copy()
            np.minimum.at(new, e[:, 0], low)
            np.minimum.at(new, e[:, 1], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(count[at]), pa.array(ids[root[at]])], names=["id", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2 * BLOCK):
                part = batch.slice(lo, 2 * BLOCK)
                g = part.column(0).to_numpy()
                if rows >= 2 * BLOCK:
                    # up to the last change of group, what is held is complete
                    last = held[-1].column(0)[-1].as_py()
                    new = int(np.argmax(g != last)) if (g != last).any() else len(g)
                    held.append(part.slice(0, new))
                    if new < len(g):
                        if out := solve(pa.Table.from_batches(held)):
                            yield out
                        held, rows = [], 0
                    part = part.slice(new)
                if part.num_rows:
                    held.append(part)
                rows = sum(x.num_rows for x in held)
        if held and (out := solve(pa.Table.from_batches(held))):
            yield out

    return dealt.select("group", "table", "place", "id", "weight", "bits", "side", "vec").mapInArrow(run, "id long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-7, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id and kept."""
    base = cut(clean(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))), "vectors")
    usable = base.where("vec is not null and label is not null and id is not null")
    reps = cut(usable.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("id").alias("weight")), "reps")
    many = reps.groupBy("label").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("id") / CELL))).cast("int").alias("bits"))
    wide = cut(spread(reps.join(cut(many, "labels"), "label"), threshold, miss), "tables")
    cells = cut(wide.groupBy("key").agg(F.count("id").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "cells")
    w = wide.join(cells.select("key", "blocks"), "key").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(3)), "blocks"))
    # A row goes to each pair of blocks that its block is in; side 0: one block with itself, 1 and 2: the lower and the higher of two.
    w = w.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    w = w.withColumn("side", side).withColumn("group", F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))))
    found = cut(links(w.repartition("group").sortWithinPartitions("group", "place"), threshold, miss), "links")
    comp = components(found.select("id", "root"), "id", "root")
    total = found.groupBy("id").agg(F.sum("n").alias("n"))
    about = reps.join(total, "id", "left").join(comp, "id", "left").select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = base.join(about, ["label", "vec"], "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
