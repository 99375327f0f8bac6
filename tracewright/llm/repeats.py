"""Repeated passages across documents: a run-compressed BWT with sampled run ends, built in parts.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

Dealing out. Each window of `length` bytes picks its least-hashed k-gram as anchor, so equal windows
pick equal anchors at equal places, in whichever document. Runs of windows with one anchor make a
segment (at most 2 * length - k bytes and less). A window holds, beside its anchor, half of the other bytes at least
on one side of it; so a segment goes on only if another document has the same anchor with the same half window to its left, or
to its right (`repeated`). Segments that go on are made distinct (with the smallest document id that holds them) and
dealt to index parts by their anchor: all equal windows meet in one part.

Index part. The part's segments, each with a terminator, are suffix-sorted; their BWT is kept as runs
(head, start, LF start). Runs are also cut where the first `length` bytes of the sorted suffixes
change, so that the rows of one string are whole runs. The sample that a run keeps is the smallest document of its rows
(not the position at its end: a document is all that is asked for), and a string's is the smallest of its runs.
Matching: every segment is streamed backward through the runs by LF steps from its last `length` bytes on, all segments
of a part at once; each step is a full match and reads its string's document. Longer matches are not told apart.

Marking. Segments take the answers back to their occurrences; windows whose smallest document is
smaller than their own become spans, which are united per document.

Defined results: null texts count as empty. Rows of one id are one document to each other: neither is
smaller. Rows with a null id neither lose bytes nor count as a source. Equal texts are settled by
their digest: all but those of the smallest id go whole (if they have `length` bytes). Extra columns are not read;
an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import cut, discard
from tracewright.llm.textarrays import U, chunks, mix, powers, prefix_hash, span_hash

K = 16
#: Distinct segments of an index part, on average.
PART = 10_000
#: Windows looked at together.
SLICE = 1 << 20


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, windows, anchor, its hash): the segments of each row; start and anchor are places in data."""
    w = length - K + 1
    out = []
    for a in range(0, max(0, len(data) - length + 1), SLICE):
        part = data[a : a + SLICE + length - 1]
        n = len(part)
        s = prefix_hash(part)
        h = mix((s[K:] - s[:-K]) * powers(n)[1][: n - K + 1])
        m = (h & ~U((1 << 24) - 1)) | np.arange(len(h), dtype=U)
        span = 1
        while span * 2 <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
        at = np.arange(len(m)) + a
        row = np.searchsorted(off, at, "right") - 1
        inside = at + length <= off[row + 1]
        at, row, pick = at[inside], row[inside], (m[inside] & U((1 << 24) - 1)).astype(np.int64)
        if not len(at):
            continue
        first = np.ones(len(at), bool)
        first[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(first)
        out.append((row[begin], at[begin], np.diff(np.append(begin, len(at))), pick[begin] + a, h[pick[begin]]))
    if not out:
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchored(texts: DataFrame, length: int) -> DataFrame:
    """(h, doc, place, sides) of all segments of texts (doc, ord, text).

    place: ord, start and number of windows in one number. sides: 32 bits each of the anchor with half a window to its
    left and to its right; where the text ends before that, the place itself, which nothing else has.
    """
    half = (length - K + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column(1).to_numpy().astype(np.int64)
            for lo, hi, data, off in chunks(batch.column(2)):
                row, start, windows, at, h = anchors(data, off, length)
                s = prefix_hash(data)
                alone = mix(h + at.astype(U))
                left, right = at - half, at + K + half
                # A side counts only if one of the segment's windows holds it.
                inside = (left >= off[row]) & (start <= left), (right <= off[row + 1]) & (start + windows - 1 + length >= right)
                sides = [np.where(i, span_hash(s, np.where(i, x, at), np.where(i, y, at)), alone) for i, x, y in ((inside[0], left, at + K), (inside[1], at, right))]
                both = sides[0] >> U(32) << U(32) | sides[1] >> U(32)
                place = order[lo:hi][row] << 40 | (start - off[row]) << 8 | windows
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(place), pa.array(both.view(np.int64))], names=["h", "doc", "place", "sides"])

    return texts.select("doc", "ord", "text").mapInArrow(run, "h long, doc long, place long, sides long")


#: Rows of one anchor that are looked at together; a larger group is handed on as it is.
GROUP = 1 << 21


def in_several(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows have a key that a row of another document has, too."""
    order = np.argsort(key)
    new = np.ones(len(doc), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    d = doc[order]
    out = np.empty(len(doc), bool)
    out[order] = (np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first))[np.cumsum(new) - 1]
    return out


def repeated(rows: DataFrame) -> DataFrame:
    """Rows of anchored() to (h, doc, place): those whose anchor and one side another document has, too (and perhaps some more)."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        h, doc, place, sides = (t[c].to_numpy() for c in ("h", "doc", "place", "sides"))
        # Rows come sorted by anchor.
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        some = np.flatnonzero(np.repeat(several, np.diff(np.append(first, len(h)))))
        if len(some):
            h, doc, place, sides = h[some], doc[some], place[some], sides[some]
            # One number for anchor and side; two that are alike by chance only go on to the index.
            keep = in_several(doc, mix(h.view(U)) + (sides.view(U) >> U(32))) | in_several(doc, mix(h.view(U)) + (sides.view(U) & U(0xFFFFFFFF)))
            h, doc, place = h[keep], doc[keep], place[keep]
        else:
            h, doc, place = h[:0], doc[:0], place[:0]
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(place)], names=["h", "doc", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, large = 0, None
        for batch in batches:
            h = batch.column(0).to_numpy()
            if large is not None:
                more = int(np.searchsorted(h, large, "right"))
                yield batch.slice(0, more).select(["h", "doc", "place"])
                if more == len(h):
                    continue
                batch, h, large = batch.slice(more), h[more:], None
            held.append(batch)
            n += len(h)
            if n < GROUP // 8:
                continue
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            last = int(np.searchsorted(h, h[-1], "left"))
            if last:
                yield solve(t.slice(0, last))
            held, n = t.slice(last).to_batches(), len(h) - last
            if n >= GROUP:
                large = h[-1]
                yield from (x.select(["h", "doc", "place"]) for x in held)
                held, n = [], 0
        if n:
            yield solve(pa.Table.from_batches(held))

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, doc long, place long")


def segments(texts: DataFrame, length: int) -> DataFrame:
    """(s1, s2, h, doc, ord, start, windows, seg): texts (doc, ord, text, at: array of (place, h)) to the segments named in at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for lo, hi, data, off in chunks(batch.column(2)):
                part = lists.slice(lo, hi - lo)
                n = np.diff(part.offsets.to_numpy())
                place, h = (x.to_numpy(zero_copy_only=False) for x in part.flatten().flatten())
                start, windows = place >> 8 & 0xFFFFFFFF, (place & 255).astype(np.int32)
                row = np.repeat(np.arange(hi - lo), n)
                begin = off[row] + start
                end = begin + windows + length - 1
                s = prefix_hash(data)
                s1 = span_hash(s, begin, end)
                s2 = mix(s1 ^ span_hash(s, begin, begin + length) * U(0x9FB21C651E98DF25) ^ span_hash(s, end - length, end))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(h), *(batch.column(c).slice(lo, hi - lo).take(pa.array(row)) for c in (0, 1)), pa.array(start), pa.array(windows), pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())], names=["s1", "s2", "h", "doc", "ord", "start", "windows", "seg"])

    return texts.select("doc", "ord", "text", "at").mapInArrow(run, "s1 long, s2 long, h long, doc long, ord int, start long, windows int, seg binary")


class RunIndex:
    """A run-compressed BWT of segments, runs cut where the first `length` bytes of the suffixes change."""

    def __init__(self, segs: list[bytes], doc: np.ndarray, length: int):
        size = np.array([len(x) for x in segs], np.int64)
        self.size, self.length = size, length
        self.at = np.cumsum(size + 1) - size - 1  # start of each segment; its terminator stands at start + size
        n = int((size + 1).sum())
        data = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8)
        code = data.astype(np.int64) + 1
        code[self.at + size] = 0
        owner = np.repeat(np.arange(len(segs)), size + 1)
        left = (self.at + size)[owner] - np.arange(n)  # bytes up to the terminator
        # As many bytes at once as fit a number, by the part's own alphabet.
        used = np.bincount(code, minlength=257) > 0
        small, base = np.cumsum(used) - 1, int(used.sum()) + 1
        step, key, padded = 0, np.zeros(n, np.int64), np.append(small[code], np.zeros(64, np.int64))
        while base ** (step + 1) < 1 << 63:
            key = key * base + np.where(step < left, padded[step : step + n], 0)
            step += 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        while step < int(size.max()):
            then = np.where(step <= left, rank[np.minimum(np.arange(n) + step, n - 1)], -1)
            rank = np.unique(rank * (n + 1) + then + 1, return_inverse=True)[1].astype(np.int64)
            step *= 2
        order = np.argsort(rank * n + np.arange(n))  # equal suffixes in the order of their segments
        before = np.where(order == self.at[owner[order]], 0, code[order - 1])
        s = prefix_hash(data)
        full = left[order] >= length
        string = np.zeros(n, U)
        string[full] = span_hash(s, order[full], order[full] + length)
        fresh = np.ones(n, bool)
        fresh[1:] = (string[1:] != string[:-1]) | (full[1:] != full[:-1])
        cut_ = fresh.copy()
        cut_[1:] |= before[1:] != before[:-1]
        self.start = np.flatnonzero(cut_)
        self.head = before[self.start]
        lengths = np.diff(np.append(self.start, n))
        sample = np.minimum.reduceat(doc[owner[order]], self.start)
        group = np.flatnonzero(fresh[self.start])
        self.least = np.minimum.reduceat(sample, group)[np.cumsum(fresh[self.start]) - 1]
        by_head = np.argsort(self.head * len(self.head) + np.arange(len(self.head)))
        self.lf = np.empty(len(self.start), np.int64)
        self.lf[by_head] = np.cumsum(lengths[by_head]) - lengths[by_head]
        # Where the last `length` bytes of each segment are sorted: streaming begins there.
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.entry = row[self.at + size - length]

    def stream(self) -> np.ndarray:
        """By position of the concatenation: the smallest document of the string that starts there (-1: no full string)."""
        out = np.full(int((self.size + 1).sum()), -1, np.int64)
        todo = np.argsort(-self.size, kind="stable")
        row, sizes = self.entry[todo], self.size[todo]
        for t in range(self.length, int(self.size.max()) + 1):
            alive = int(np.searchsorted(-sizes, -t, "right"))
            todo, row, sizes = todo[:alive], row[:alive], sizes[:alive]
            run = np.searchsorted(self.start, row, "right") - 1
            out[self.at[todo] + sizes - t] = self.least[run]
            row = self.lf[run] + row - self.start[run]
        return out


def index_part(distinct: pa.Table, length: int) -> pa.Table:
    """(s1, s2, marks): per segment the runs of windows with one smallest document, as (first window, document) int64 pairs."""
    distinct = distinct.sort_by([("doc", "ascending"), ("s1", "ascending"), ("s2", "ascending")])
    doc = distinct["doc"].to_numpy()
    index = RunIndex(distinct["seg"].to_pylist(), doc, length)
    least = index.stream()
    at = np.flatnonzero(least >= 0)
    value = least[at]
    first = np.ones(len(at), bool)
    first[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    seg = np.searchsorted(index.at, at[first], "right") - 1
    pairs = np.column_stack([at[first] - index.at[seg], value[first]]).astype(np.int64)
    edge = np.searchsorted(seg, np.arange(len(doc) + 1)) * 16
    marks = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(pairs.tobytes())])
    # A segment of one document, all of whose windows start there first, has nothing to tell.
    at = np.flatnonzero((np.bincount(seg[value[first] < distinct["most"].to_numpy()[seg]], minlength=len(doc)) > 0) | (distinct["most"].to_numpy() > doc))
    return pa.table({"s1": distinct["s1"], "s2": distinct["s2"], "marks": marks}).take(pa.array(at))


def marked(found: DataFrame) -> DataFrame:
    """(doc, ord, start, windows, marks) to (doc, ord, a, b): the windows a..b-1 that also start in a smaller document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, order, start, windows = (batch.column(i).to_numpy() for i in range(4))
            raw = batch.column(4)
            n = np.array([len(x.as_buffer()) // 16 for x in raw], np.int64)
            pairs = np.frombuffer(b"".join(raw.to_pylist()), np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(batch.num_rows), n)
            to = np.append(pairs[1:, 0], 0)
            last = np.cumsum(n) - 1
            to[last] = windows
            smaller = pairs[:, 1] < doc[row]
            r = row[smaller]
            yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(order[r]), pa.array(start[r] + pairs[smaller, 0]), pa.array(start[r] + to[smaller])], names=["doc", "ord", "a", "b"])

    return found.select("doc", "ord", "start", "windows", "marks").mapInArrow(run, "doc long, ord int, a long, b long")


def spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of a..b-1 as rows (start, end)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    end = np.flatnonzero(np.append(new[1:], True))
    return np.column_stack([a[new], b[end]])


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """Of texts (doc, ord, text): (doc, ord, spans: array of (a, b)), the windows that start in a text of a smaller doc, too."""
    places = cut(repeated(anchored(texts, length)).withColumn("ord", F.shiftright("place", 40).cast("int")).groupBy("doc", "ord").agg(F.collect_list(F.struct("place", "h")).alias("at")), "places")
    found = cut(segments(texts.join(places, ["doc", "ord"]), length), "segments")
    discard(places)
    distinct = cut(found.groupBy("s1", "s2").agg(F.min("doc").alias("doc"), F.max("doc").alias("most"), F.min("h").alias("h"), F.min("seg").alias("seg")), "distinct")
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, distinct.count() // PART + 1)
    marks = cut(distinct.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts))).groupBy("part").applyInArrow(lambda t: index_part(t, length), "s1 long, s2 long, marks binary"), "marks")
    hit = marked(found.select("s1", "s2", "doc", "ord", "start", "windows").join(marks, ["s1", "s2"]))
    out = cut(hit.groupBy("doc", "ord").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    discard(found, distinct, marks)
    return out


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    The ids are taken as long. Of equal texts only the one of the smallest id is searched.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.sha2("text", 256))
    known = cut(base.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length)).select("doc", "digest").distinct(), "digests")
    least = cut(known.groupBy("digest").agg(F.min("doc").alias("least")), "chosen")
    # Texts that share an id are told apart by their order within it.
    chosen = cut(least.groupBy(F.col("least").alias("doc")).agg(F.sort_array(F.collect_list("digest")).alias("d")).select("doc", F.posexplode("d").alias("ord", "digest")), "order")
    texts = cut(base.select("doc", "digest", "text").join(chosen, ["doc", "digest"]).dropDuplicates(["doc", "ord"]).select("doc", "ord", "text"), "texts")
    gone = repeated_spans(texts, length)
    discard(texts)
    gone = gone.join(chosen, ["doc", "ord"]).select("doc", "digest", "spans", F.lit(False).alias("whole"))
    copies = known.join(least, "digest").where("least < doc").select("doc", "digest", F.lit(None).cast(gone.schema["spans"].dataType).alias("spans"), F.lit(True).alias("whole"))
    joined = base.join(cut(gone.unionByName(copies), "gone"), ["doc", "digest"], "left").select("id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, whole, s in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = text.as_buffer().to_pybytes()
                if whole:
                    cuts = np.array([[0, len(raw)]])
                elif s.is_valid and len(s.values):
                    a, b = (x.to_numpy() for x in s.values.flatten())
                    cuts = spans(a, b + length - 1)
                else:
                    cuts = np.zeros((0, 2), np.int64)
                edge = [0, *cuts.reshape(-1).tolist(), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(edge[::2], edge[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(cuts), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
