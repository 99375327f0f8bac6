"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become codepoint-class arrays. Where a token starts follows from scans whose steps are either
the identity or a constant (the composition of two such transition functions is the later constant),
so each scan is one running maximum over positions; no regular expression runs. The resulting byte
slices are hashed, made distinct, looked up in a bounded cache, and only unseen slices go through
pair merging, which is itself vectorised over all unseen slices but the longest, merged by a heap each. Decoding concatenates the tokens'
bytes from an offset table, so that each document's bytes are found again by its token offsets.

Nulls count as empty texts; an empty text has no tokens. Rows are kept one to one, repeated rows and
ties included, and other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.textarrays import CHUNK, U, chunks, mix, prefix_hash, span_hash

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Slices whose ids one worker keeps; beyond it the cache starts anew.
CACHE = 400_000
#: Slices of more bytes are merged one by one, the others many at once.
ALONE = 1_000


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            t[c] = LETTER if k == "L" else NUMBER
    # Code points with the Unicode property White_Space.
    t[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return t


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    if len(at) == len(data):
        return lead, at
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    b1, b2, b3 = (padded[at + i].astype(np.uint32) & 0x3F for i in (1, 2, 3))
    two, three, four = ((lead & 0x1F) << 6) | b1, ((lead & 0x0F) << 12) | (b1 << 6) | b2, ((lead & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3
    return np.where(lead < 0x80, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))), at


def boundaries(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions at which a pre-token starts, in order; rows are never bridged.

    Equals the matches of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    cp, at = codepoints(data)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    k = classes()[cp]
    first = np.zeros(n + 1, bool)  # of its row
    first[np.searchsorted(at, off)] = True
    change = first[:-1].copy()
    change[1:] |= k[1:] != k[:-1]
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, change[1:]
    ends_row = first[1:].copy()
    ends_row[-1] = True
    space = k == SPACE
    # A run of white space gives its last character to what follows: as a token of its own, or, if that is a blank, as the next token's first character.
    apart = space & last & ~ends_row
    start = change | apart
    blank = apart & (cp == 0x20)
    start[1:] &= ~blank[:-1]
    # An apostrophe that opens its run, with no blank before it, takes the letters of a contraction along.
    quote = np.flatnonzero((cp == 0x27) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[change[quote + 1] & ~first[quote + 1] & (k[quote + 1] == LETTER)]
    if len(quote):
        c1 = cp[quote + 1]
        c2 = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        took = one | two
        start[quote[took] + 1] = False
        behind = quote[took] + np.where(one[took], 2, 3)
        behind = behind[behind < n]
        start[behind] = True
    return at[start]


class Vocabulary:
    """Ranks of byte strings, the pairs that may merge, and a cache of encoded slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(rank.values()) + 1)
        for t, r in rank.items():
            self.tokens[r] = t
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        left, right, to = [], [], []
        for t, r in rank.items():
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(r)
        key = (np.array(left, U) << U(32)) | np.array(right, U)
        self.bits = max(4, (4 * len(key)).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, ~U(0), U), np.full(1 << self.bits, -1, np.int64)
        slot, value = self.slot(key), np.array(to, np.int64)
        while len(key):
            free = self.keys[slot] == ~U(0)
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]], self.merged[slot[put]] = key[put], value[put]
            left_over = np.ones(len(key), bool)
            left_over[put] = False
            key, value, slot = key[left_over], value[left_over], (slot[left_over] + 1) & ((1 << self.bits) - 1)
        self.empty_cache()

    def empty_cache(self) -> None:
        self.known: dict[int, int] = {}
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.n = 0
        self.flat, self.size, self.at = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) >> U(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What a and b merge into, or the largest int64."""
        key = (a.astype(U) << U(32)) | b.astype(U)
        slot, out = self.slot(key), np.full(len(key), np.iinfo(np.int64).max)
        todo = np.arange(len(key))
        while len(todo):
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.merged[slot[hit]]
            go = ~hit & (found != ~U(0))
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each slice): in every slice the lowest-ranked pair merges until none can."""
        size = end - start
        order = np.argsort(size, kind="stable")
        sizes, parts, owners = np.empty(len(size), np.int64), [], []
        lo = 0
        while lo < len(order):
            # slices of like length side by side, about a million cells at a time
            hi = lo + 1
            longest = int(size[order[lo]])
            if longest > ALONE:
                ids = self._merge_alone(data[start[order[lo]] : end[order[lo]]])
                sizes[order[lo]] = len(ids)
                parts.append(ids)
                owners.append(np.repeat(order[lo], len(ids)))
                lo = hi
                continue
            hi = min(len(order), lo + max(1, 300_000 // max(1, longest)))
            hi = lo + int(np.searchsorted(size[order[lo:hi]], min(ALONE, max(longest + 4, longest * 5 // 4)), "right"))
            rows = order[lo:hi]
            lo = hi
            ids, n = self._merge(data, start[rows], size[rows])
            sizes[rows] = n
            parts.append(ids)
            owners.append(np.repeat(rows, n))
        owner, ids = np.concatenate(owners), np.concatenate(parts)
        return ids[np.argsort(owner, kind="stable")].astype(np.int32), sizes

    def _merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none, width = np.iinfo(np.int64).max, int(size.max())
        if width == 1:
            return self.single[data[start]], np.ones(len(start), np.int64)
        cols = np.arange(width)
        inside = cols[None, :] < size[:, None]
        ids = np.where(inside, self.single[data[np.minimum(start[:, None] + cols, len(data) - 1)]], -1)
        rank = np.full((len(start), width), none)
        r, c = np.nonzero(inside[:, 1:])
        rank[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        nxt, prv = np.tile(cols + 1, (len(start), 1)), np.tile(cols - 1, (len(start), 1))
        live = np.arange(len(start))
        while len(live):
            best = rank[live].argmin(1)
            low = rank[live, best]
            on = low != none
            live, best, low = live[on], best[on], low[on]
            if not len(live):
                break
            gone = nxt[live, best]
            after, before = nxt[live, gone], prv[live, best]
            ids[live, best] = low
            ids[live, gone] = -1
            rank[live, gone] = none
            nxt[live, best] = after
            rank[live, best] = none
            has = after < size[live]
            prv[live[has], after[has]] = best[has]
            rank[live[has], best[has]] = self.rank(low[has], ids[live[has], after[has]])
            has = before >= 0
            rank[live[has], before[has]] = self.rank(ids[live[has], before[has]], low[has])
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """What a pair of ids, the first of them shifted, merges into."""
        held = self.keys != ~U(0)
        return dict(zip(self.keys[held].tolist(), self.merged[held].tolist(), strict=True))

    def _merge_alone(self, data: np.ndarray) -> np.ndarray:
        """The ids of one long slice by a heap of its pairs: n log n steps instead of a look at all pairs for each merge."""
        first = self.single[data]
        ids, n, none, pairs = first.tolist(), len(first), np.iinfo(np.int64).max, self.pairs
        rank = [*self.rank(first[:-1], first[1:]).tolist(), none]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, r in enumerate(rank) if r != none]
        heapify(heap)
        while heap:
            low = heappop(heap)
            i = low & 0xFFFFFFFF
            if rank[i] != low >> 32:
                continue  # of a pair that has changed since
            gone = after[i]
            ids[i], ids[gone], rank[gone] = rank[i], -1, none
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for at in (i, before[i]):
                if at >= 0:
                    rank[at] = pairs.get(ids[at] << 32 | ids[after[at]], none) if after[at] < n else none
                    if rank[at] != none:
                        heappush(heap, rank[at] << 32 | at)
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets into them)."""
        start = boundaries(data, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(data))
        key, one, which = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
        if self.n > CACHE:
            self.empty_cache()
        known = self.known
        place = np.array([known.get(x, -1) for x in key.tolist()], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            ids, size = self.merge(data, start[one[new]], end[one[new]])
            place[new] = np.arange(self.n, self.n + len(new))
            known.update(zip(key[new].tolist(), place[new].tolist(), strict=True))
            self.n += len(new)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
            self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        place = place[which]
        out = gather(self.flat, self.at[place], self.size[place])
        before = np.concatenate([[0], np.cumsum(self.size[place])])
        return out, before[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.start[ids], self.length[ids])


def gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of values[at[i] : at[i] + size[i]]."""
    total = int(size.sum())
    if not total:
        return values[:0]
    shift = at - (np.cumsum(size) - size)
    return values[np.repeat(shift, size) + np.arange(total)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", hashes_only: bool = False) -> DataFrame:
    """One row per row of df: id, n_tokens, token ids (array<int>), byte offset of each token.

    With hashes_only the ids stay in the task and ids_sha256 (little-endian unsigned 32-bit) and
    decoded_sha256 (of the bytes that decoding gives back) leave instead. The vocabulary file is
    read by each worker from vocabulary_path, which every machine must hold.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" if hashes_only else "n_tokens long, ids array<int>, offsets array<long>, decoded binary"
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1), CHUNK):
                ids, at = v.encode(data, off)
                back = v.decode(ids)
                ends = np.concatenate([[0], np.cumsum(v.length[ids])])
                n = np.diff(at)
                if hashes_only:
                    raw = ids.astype("<u4")
                    cols = [[hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(ends[at[:-1]], ends[at[1:]], strict=True)]]
                else:
                    begin = ends[:-1] - np.repeat(ends[at[:-1]], n)
                    cols = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(begin, pa.int64())), [back[a:b].tobytes() for a, b in zip(ends[at[:-1]], ends[at[1:]], strict=True)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *(c if isinstance(c, pa.Array) else pa.array(c) for c in cols)], names=[id_col, *names])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {fields}")


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of df: id and the bytes of its token ids; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in batches:
            out = [v.decode(np.array(x or [], np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return df.select(F.col(id_col), F.col(ids_col).alias("__ids")).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded binary")
