"""Benchmark decontamination: SimHash fingerprints of item-sized windows, then exact similarity.

DataFrame functions only; no Python runs on the executors.

1. Benchmark items become words (lower-cased, split at 20 and 09-0D) and weighted shingles of five
   words: weight = occurrences in the item x inverse document frequency among the items. An item with
   fewer words is one shingle.
2. An item-sized window of a document can reach the threshold only if it holds one of the item's
   disjoint five-word tiles unbroken (each broken tile costs at least one changed word, and with every
   tile broken over half of the shingles are gone). Hashes of a document's runs of five words are unrolled, and those
   that a tile has fix a window's start, so that windows overlap the item word for word. No row carries a text along.
3. Each window gets a 64-bit SimHash of its weighted shingles. `radius + 1` blocks of the fingerprint
   are joined by equality: by the pigeonhole principle every pair within the Hamming radius shares a
   block. Pairs beyond the radius go.
4. Survivors are verified by exact weighted Jaccard similarity of window and item.

Defined results: null or empty texts and items match nothing; repeated rows of a document give one
result per item and id; of items that share an id one counts; other columns are not read, whatever their names. Tiles and
items are broadcast only while their measured bytes are under BROADCAST_BYTES; beyond that they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import cut

SHINGLE = 5
BITS = 64
BROADCAST_BYTES = 32 << 20


def split_words(text: Column) -> Column:
    """Lower-cased words of a text; empty for null and blank texts."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def hashed_shingles(words: Column) -> Column:
    """Shingle hashes of an array of words, in order; the whole sequence where it is shorter."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - F.lit(SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, SHINGLE)))))


def simhash(hashes: Column, weights: Column) -> Column:
    """64-bit SimHash of hashes under like-long weights."""
    pairs = F.arrays_zip(hashes.alias("h"), weights.alias("w"))
    bit = lambda b: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when(F.getbit(p["h"], b) == 1, p["w"]).otherwise(-p["w"])) > 0
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda s, b: F.when(bit(b), s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))).otherwise(s))


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 (block number, value) pairs that together cover all bits."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint")).alias("value")) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))))


def prepare_items(items: DataFrame, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words, n (their number), shingles (distinct: hash, weight), fingerprint."""
    base = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), split_words(F.col(text_col)).alias("words")).where(F.size("words") > 0).dropDuplicates(["item_id"])
    each = base.select("item_id", F.explode(hashed_shingles(F.col("words"))).alias("h")).groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("c"))
    total = base.agg(F.count(F.lit(1)).alias("total"))
    idf = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("h", F.log1p(F.col("total") / F.col("df")).alias("idf"))
    bags = each.join(idf, "h").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("h", (F.col("c") * F.col("idf")).alias("w"), "idf"))).alias("shingles"))
    return base.join(bags, "item_id").withColumn("n", F.size("words")).withColumn("fingerprint", simhash(F.col("shingles.h"), F.col("shingles.w")))


def run_hash(words: Column, at: Column, size: int = SHINGLE) -> Column:
    """Hash of the `size` words from place `at` on, or of those that there are."""
    return F.xxhash64(*(F.get(words, at + i) for i in range(size)))


def tiles(items: DataFrame) -> DataFrame:
    """item_id, n, p (first word of the tile), size (its words), h (their hash)."""
    t = items.select("item_id", "n", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - F.least("n", F.lit(SHINGLE)), F.lit(0)), F.lit(SHINGLE))).alias("p"))
    return t.select("item_id", "n", "p", F.least("n", F.lit(SHINGLE)).alias("size"), run_hash(F.col("words"), F.col("p")).alias("h"))


def hinted(side: DataFrame, width: Column) -> DataFrame:
    """side, to be broadcast if its rows, of `width` bytes each, are under BROADCAST_BYTES in all."""
    return F.broadcast(side) if (side.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else side


def windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (doc_id, item_id, start, window): item-sized windows that hold one of the item's tiles."""
    sought = tiles(items)
    sizes = sorted(r[0] for r in sought.select("size").distinct().collect())  # 1 to 5 at most
    sought = hinted(sought, F.octet_length(F.col("item_id").cast("string")) + 40)
    w = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), split_words(F.col(text_col)).alias("doc_words"))
    each = w.select("doc_id", "doc_words", F.posexplode("doc_words").alias("q", "word"))
    by_size = [F.struct(F.lit(m).alias("size"), run_hash(F.col("doc_words"), F.col("q"), m).alias("h")) for m in sizes or [1]]
    each = each.select("doc_id", "q", by_size[0].alias("x")) if len(by_size) == 1 else each.select("doc_id", "q", F.explode(F.array(*by_size)).alias("x"))
    each = each.select("doc_id", "q", "x.size", "x.h")
    hit = each.join(sought, ["size", "h"]).select("doc_id", "item_id", (F.col("q") - F.col("p")).alias("start"), "n").distinct()
    at = cut(hit.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "start", "n")).alias("at")), "hits")
    # A window that would begin before the text or end after it is cut to the text.
    found = w.join(at, "doc_id").select("doc_id", "doc_words", F.inline("at"))
    window = F.slice("doc_words", F.greatest("start", F.lit(0)) + 1, F.col("n") + F.least("start", F.lit(0)))
    return found.select("doc_id", "item_id", "start", window.alias("window")).dropDuplicates(["doc_id", "item_id", "start"])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = 19, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start (word), hamming, similarity: each document's best window per item it holds."""
    known = cut(prepare_items(items, item_id, item_text), "items")
    found = windows(docs, known, id_col=id_col, text_col=text_col)
    bag = found.withColumn("hashes", hashed_shingles(F.col("window"))).drop("window")
    item = known.select("item_id", "shingles", F.col("fingerprint").alias("item_fingerprint"))
    idf = F.map_from_arrays(F.col("shingles.h"), F.col("shingles.idf"))
    # Shingles that the item lacks weigh as the rarest do.
    rare = F.array_max(F.col("shingles.idf"))
    bag = bag.join(hinted(item, 64 + 32 * F.size("shingles")), "item_id").withColumn("weights", F.transform("hashes", lambda h: F.coalesce(F.try_element_at(idf, h), rare)))
    bag = bag.withColumn("fingerprint", simhash(F.col("hashes"), F.col("weights")))
    bag = cut(bag.select("doc_id", "item_id", "start", "hashes", "weights", "fingerprint"), "windows")
    left = bag.select("doc_id", "item_id", "start", "fingerprint", F.explode(blocks(F.col("fingerprint"), radius)).alias("b"))
    right = known.select("item_id", F.col("fingerprint").alias("item_fingerprint"), F.explode(blocks(F.col("fingerprint"), radius)).alias("b"))
    near = left.join(right, ["item_id", "b"]).withColumn("hamming", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))).where(F.col("hamming") <= radius).groupBy("doc_id", "item_id", "start").agg(F.first("hamming").alias("hamming"))
    both = near.join(bag.drop("fingerprint"), ["doc_id", "item_id", "start"]).join(known.select("item_id", "shingles"), "item_id")
    # sum of minima; the sum of maxima is the sum of both less that.
    count = lambda h: F.size(F.filter("hashes", lambda x: x == h))
    low = F.aggregate("shingles", F.lit(0.0), lambda s, p: s + F.least(p["w"], count(p["h"]) * p["idf"]))
    total = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x) + F.aggregate("shingles", F.lit(0.0), lambda s, p: s + p["w"])
    scored = both.withColumn("low", low).withColumn("similarity", F.col("low") / (total - F.col("low"))).where(F.col("similarity") >= threshold - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "hamming"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("x")).select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_id), (-F.col("x.s")).alias("start"), F.col("x.hamming").alias("hamming"), F.col("x.similarity").alias("similarity"))
