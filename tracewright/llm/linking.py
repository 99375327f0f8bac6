"""Connected groups from buckets of candidates, without all pairs of a bucket.

Every member of a bucket is first paired with one hub of it. Confirmed pairs make components; only
buckets that still hold several components go on: their members are dealt into blocks of bounded size,
and block pairs compare signatures across components. Members of pairs that may be linked are dealt
out once more with their contents, which block pairs compare in full. Every pair of one bucket is thus either
inside one component already or looked at, whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import components, cut, discard

#: Members of a block of a mixed bucket, on average.
BLOCK = 256
#: Members of small blocks taken together, and pairs of them looked at at a time.
MEMBERS, PAIRS = 1 << 15, 1 << 18
#: Pairs of two blocks, for each of their members, up to which they are handed on as pairs.
FEW = 4

Parse = Callable[[pa.Array], np.ndarray]
Stay = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Of the contents of two blocks and a mask of pairs: the pairs that are, or may be, linked, and what confirms one (None: all are).
Linked = Callable[[list[bytes], list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, Callable[[int, int], bool] | None]]


def prune(pairs: DataFrame, parse: Parse, stay: Stay) -> DataFrame:
    """pairs (a, b, sig_a, sig_b) that stay by their signatures, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = np.arange(batch.num_rows)
            keep = pa.array(stay(parse(batch.column(2)), parse(batch.column(3)), i, i), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}")


def across(blocks: DataFrame, kind: str, parse: Parse, stay: Stay, keys: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """Block pairs (key, same, x, y: arrays of (id, component, sig)) to (key, id): members of the pairs of
    different components that stay. A pair that shares several buckets counts in the first of them only.

    Without keys the rows are (key, id, other): the pairs themselves, if few of a block pair stay, else its members, whose other is null.
    """

    def side(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, comp, sig = column.flatten().flatten()
        return column.value_lengths().to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False), comp.to_numpy(zero_copy_only=False), parse(sig)

    def compare(rows: pa.RecordBatch) -> Iterator[pa.Table]:
        key, same = (rows.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        (nx, ia, ca, sa), (ny, ib, cb, sb) = side(rows.column(2)), side(rows.column(3))
        ka, kb = (keys(sa), keys(sb)) if keys else (None, None)
        many = nx.astype(np.int64) * ny
        end, x0, y0 = np.cumsum(many), np.cumsum(nx) - nx, np.cumsum(ny) - ny
        for lo in range(0, int(end[-1]), PAIRS):
            p = np.arange(lo, min(lo + PAIRS, int(end[-1])))
            r = np.searchsorted(end, p, "right")
            p -= (end - many)[r]
            la, lb = x0[r] + p // ny[r], y0[r] + p % ny[r]
            apart = np.flatnonzero((ca[la] != cb[lb]) & (~same[r] | (ia[la] < ib[lb])))
            r, la, lb = r[apart], la[apart], lb[apart]
            keep = stay(sa, sb, la, lb)
            r, la, lb = r[keep], la[keep], lb[keep]
            if keys:
                first = (ka[la] == kb[lb]).argmax(1)
                here = ka[la, first] == key[r]
                r, la, lb = r[here], la[here], lb[here]
                yield pa.table({"key": np.tile(key[r], 2), "id": np.concatenate([ia[la], ib[lb]])})
                continue
            few = np.bincount(r, minlength=len(nx))[r] <= FEW * (nx + ny)[r]
            f, d = np.flatnonzero(few), np.flatnonzero(~few)
            other = pa.array(np.maximum(ia[la[f]], ib[lb[f]]))
            yield pa.table({"key": key[r[f]], "id": np.minimum(ia[la[f]], ib[lb[f]]), "other": other})
            yield pa.table({"key": np.tile(key[r[d]], 2), "id": np.concatenate([ia[la[d]], ib[lb[d]]]), "other": pa.nulls(2 * len(d), other.type)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = sum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            group = np.cumsum(members) // MEMBERS
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                found = list(compare(batch.slice(lo, hi - lo))) if hi > lo else []
                if found:
                    yield from pa.concat_tables(found).group_by(found[0].column_names).aggregate([]).combine_chunks().to_batches()

    return blocks.select("key", "same", "x", "y").mapInArrow(run, f"key long, id {kind}" + ("" if keys else f", other {kind}"))


def settle(blocks: DataFrame, kind: str, linked: Linked) -> DataFrame:
    """Block pairs (same, x, y: arrays of (id, component, content)) to links (a, b) that join different
    components: per block pair a forest of them, however many links there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, same = [], [], batch.column(0).to_pylist()
            for r in range(batch.num_rows):
                (ia, ca, xa), (ib, cb, xb) = ((v.field(0).to_pylist(), v.field(1).to_pylist(), v.field(2).to_pylist()) for v in (batch.column(c).slice(r, 1).flatten() for c in (1, 2)))
                over: dict = {}

                def top(c, over=over):
                    while (d := over.get(c, c)) != c:
                        over[c] = over.get(d, d)
                        c = d
                    return c

                mask = np.array(ca)[:, None] != np.array(cb)[None, :]
                i, j, confirm = linked(xa, xb, np.triu(mask) if same[r] else mask)
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    if (s := top(ca[p])) != (t := top(cb[q])) and (confirm is None or confirm(p, q)):
                        over[max(s, t)] = min(s, t)
                        a.append(ia[p])
                        b.append(ib[q])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.select("same", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def dealt(rows: DataFrame, size: int, what: str) -> DataFrame:
    """rows (key, id, component, what) in blocks: every pair of a key's blocks, as (key, same, x, y)."""
    n = rows.groupBy("key").agg(F.count("id").alias("n"))
    rows = rows.join(cut(n, "sizes"), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / size)))
    x = cut(rows.groupBy("key", "block").agg(F.collect_list(F.struct("id", "component", what)).alias("x")), "blocks")
    y = x.select("key", F.col("block").alias("block2"), F.col("x").alias("y"))
    return x.join(y, "key").where("block <= block2").select("key", (F.col("block") == F.col("block2")).alias("same"), "x", "y")


def connect_met(met: DataFrame, sig: DataFrame, heads: list[tuple[int, Parse]], stay: Stay, verify: Callable[[DataFrame], DataFrame], contents: Callable[[DataFrame], DataFrame], linked: Linked) -> DataFrame:
    """connect() for buckets whose members have met: (key, hub, id, two, mark) for each member but the hub, two telling a pair besides which nothing is to be looked at.
    A member that cannot be linked to the hub is its own. mark is what belongs to a member in this bucket: it follows its signature where pairs of the bucket are looked at.

    heads: how many bytes of a signature are looked at first, and then, and what parses them. Few pairs of a mixed bucket's
    blocks go to verify, as the hubs' pairs do; the contents of blocks are dealt out only where many pairs stay. Signatures are dealt to
    mixed buckets in turns, in each to about as many members as there are signatures.
    """
    kind = sig.schema["id"].dataType.simpleString()
    met = cut(met, "met")
    brief = lambda n: sig.select("id", F.substring("sig", 1, n).alias("sig"))
    pairs, tables = met.where("hub != id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), []
    for n, parse in heads:
        pairs = pairs.join(brief(n).select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(brief(n).select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        pairs = cut(prune(pairs, parse, stay), "survivors")
        discard(*tables)
        tables = [pairs]
    links = verify(pairs)
    discard(*tables)
    if met.where("not two").isEmpty():
        discard(met)
        return components(links, "a", "b")
    of = cut(met.where("not two").select("key", "id", "mark").join(components(links, "a", "b"), "id", "left").select("key", "id", "mark", F.coalesce("component", "id").alias("component")), "of")
    discard(met)
    mixed = cut(of.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("id").alias("n")).where("c1 != c2").select("key", "n"), "mixed")
    n, parse = heads[-1]
    turns = -(-(mixed.agg(F.sum("n")).first()[0] or 0) // max(sig.count(), BLOCK)) or 1
    late = []
    for turn in range(turns):
        here = mixed.where(F.pmod(F.xxhash64("key"), F.lit(turns)) == turn) if turns > 1 else mixed
        rows = lambda these, here=here: of.join(here.where(these).select("key"), "key").join(brief(n), "id").withColumn("sig", F.concat("sig", "mark"))
        blocks = rows(F.col("n") <= BLOCK).groupBy("key").agg(F.collect_list(F.struct("id", "component", "sig")).alias("x")).select("key", F.lit(True).alias("same"), "x", F.col("x").alias("y"))
        if not here.where(F.col("n") > BLOCK).isEmpty():
            blocks = blocks.unionByName(dealt(rows(F.col("n") > BLOCK), BLOCK, "sig"))
        late.append(cut(across(blocks, kind, parse, stay, None), "late"))
    late = reduce(DataFrame.unionByName, late)
    links = links.unionByName(verify(cut(late.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), "survivors")))
    many = late.where("other is null").select("key", "id").distinct()
    if not many.isEmpty():
        many = cut(many.join(of, ["key", "id"]), "maybe")
        full = contents(many.select("id").distinct())
        links = links.unionByName(cut(settle(dealt(many.join(full, "id"), BLOCK, "content"), kind, linked), "links"))
        discard(many)
    discard(of, mixed, late)
    return components(links, "a", "b")


def connect(keyed: DataFrame, sig: DataFrame, parse: Parse, stay: Stay, keys: Callable[[np.ndarray], np.ndarray], verify: Callable[[DataFrame], DataFrame], contents: Callable[[DataFrame], DataFrame], linked: Linked) -> DataFrame:
    """(id, component) of the ids that have a link, by the smallest id reachable.

    keyed: (key, id) rows, one for each bucket that an id is in, cheap to make twice; sig: (id, sig) with distinct ids.
    parse turns a column of signatures into an array; stay gives the indices of the pairs that may be
    linked; keys gives the bucket keys of signatures; verify confirms pairs (a, b) and writes them; contents gives (id, content) for
    ids and linked compares the contents of two blocks.
    """
    kind = sig.schema["id"].dataType.simpleString()
    keyed = keyed.select("key", "id")
    # The hub is the least member: the same one in all buckets of a small group.
    buckets = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("id").alias("n")).where("n > 1"), "buckets")
    # A hub's pairs are all looked at here, so that only the other members go on.
    crowded = cut(keyed.join(buckets.where("n > 2").select("key", "hub"), "key").where("id != hub"), "crowded")
    hubs = crowded.select(F.col("hub").alias("a"), F.col("id").alias("b")).unionByName(buckets.where("n = 2 and hub != top").select(F.col("hub").alias("a"), F.col("top").alias("b"))).distinct()
    hubs = hubs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = cut(prune(hubs, parse, stay), "survivors")
    links = verify(pairs)
    discard(pairs)
    # Buckets whose other members are of several components go on.
    of = cut(crowded.join(components(links, "a", "b"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "of")
    discard(buckets, crowded)
    mixed = cut(of.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("key"), "mixed")
    maybe = across(dealt(of.join(mixed, "key").join(sig, "id"), BLOCK, "sig"), kind, parse, stay, keys)
    maybe = cut(maybe.distinct().join(of, ["key", "id"]), "maybe")
    full = contents(maybe.select("id").distinct())
    late = settle(dealt(maybe.join(full, "id"), BLOCK, "content"), kind, linked)
    late = cut(late, "links")
    discard(of, mixed, maybe)
    return components(links.unionByName(late), "a", "b")
