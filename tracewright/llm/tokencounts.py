"""Token counts through a cache of digests.

A text is known by the SHA-256 of its normalised form, a tokenizer by a digest of its file, library and
normalisation. The cache is a Parquet table (tokenizer, digest, n_tokens), partitioned by tokenizer. The
digests of a table are made distinct and joined to it; of each that it lacks, one row's text is encoded, and
the counts are appended. What is shuffled per row is an id and a digest; texts move only to be encoded, one
for each digest that is missing.

Normalisation must not change a count. The default turns null into the empty text and nothing else; one
for a tokenizer that lower-cases, say, may do so as well. Its name is part of the tokenizer's digest.

Two runs may append the same digest: their counts are equal, and readers take one. A run that fails appends
nothing, as Spark commits a table's files together.

Defined results: null counts as empty (0 bytes, 0 tokens); repeated rows are kept, each with its count; rows of
one id with different texts are told apart; an empty table gives an empty result and appends nothing. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib import metadata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.shared import cut, discard

SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: Bytes of text that a tokenizer gets at a time.
BATCH = 1 << 20


def same(text: Column) -> Column:
    """The text as it is, null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def version(path: str, normalise: Callable[[Column], Column] = same) -> str:
    """Digest of a tokenizer: its file's bytes, its library with version, and the name of the normalisation."""
    with open(path, "rb") as f:
        file = hashlib.file_digest(f, "sha256").hexdigest()
    lib = library(path)
    return hashlib.sha256("\x1f".join((file, lib, metadata.version(lib), normalise.__name__)).encode()).hexdigest()


@lru_cache(2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Texts to their numbers of tokens, without begin, end or added tokens, as the tokenizer's library does by default."""
    if library(path) == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer; a digest may occur more than once."""
    try:
        stored = spark.read.schema(SCHEMA).parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], SCHEMA)
    return stored.where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")


def encode_texts(rows: DataFrame, path: str) -> DataFrame:
    """rows (digest, text) to (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            first = pa.array(sorted({d: i for i, d in reversed(list(enumerate(batch.column(0).to_pylist())))}.values()), pa.int64())
            out, held, size = [], [], 0
            for text in batch.column(1).take(first):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= BATCH:
                    out += count(held)
                    held, size = [], 0
            out += count(held)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), pa.array(out, pa.int64())], names=["digest", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache: str, normalise: Callable[[Column], Column] = same, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes of the text in UTF-8, n_tokens and over_limit (n_tokens > limit).

    path is the tokenizer's file, which every machine must hold; cache the folder of the digest table, shared by
    all machines, made if absent and appended to.
    """
    spark = docs.sparkSession
    tokenizer = version(path, normalise)
    text = normalise(F.col(text_col))
    digest = F.unhex(F.sha2(text, 256))
    # The row of a digest whose text is taken, by the hash of its id, which may be null.
    seat = F.xxhash64(F.col(id_col))
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long")
    keyed = cut(docs.select(F.col(id_col).alias("id"), seat.alias("seat"), digest.alias("digest"), size.alias("n_bytes")), "digests")
    wanted = keyed.groupBy("digest").agg(F.min("seat").alias("seat"))
    stored = read_cache(spark, cache, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("stored"))
    known = cut(wanted.join(stored, "digest", "left"), "known")
    missing = known.where("stored is null").select("digest", "seat")
    texts = docs.select(digest.alias("digest"), seat.alias("seat"), text.alias("text")).join(missing.hint("shuffle_hash"), ["digest", "seat"], "left_semi")
    # Rows repeated whole are one digest more than once.
    fresh = cut(encode_texts(texts, path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    fresh.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = cut(known.where("stored is not null").select("digest", F.col("stored").alias("n_tokens")).unionByName(fresh), "by-digest")
    discard(known, fresh)
    out = keyed.join(counts, "digest")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
