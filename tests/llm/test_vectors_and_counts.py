"""Hard negatives, token counts and centroid clustering: brute force, odd rows, recovery of what is stored."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import clustering, hardnegatives, tokencounts, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
#: Extra columns whose names clash with results and inner columns.
VEC = "vec_id long, embedding array<double>, label int, cluster string, id int, vec string, score int, group int, shard int, distance string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, y, "c", 1, "v", 2, 3, 4, "d") for i, e, y in rows], VEC)


def random_rows(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    rows = [(i, (0.3 * centre[rng.integers(6)] + 0.2 * rng.normal(size=dim) * rng.choice([0.2, 1, 3])).tolist(), int(rng.integers(labels))) for i in range(n)]
    for i in range(0, n, 9):
        rows[i] = (i, rows[n // 2][1], rows[i][2])  # equal vectors, so ties
    return rows


def odd_rows(dim):
    return [(9001, None, 1), (9002, [None] * dim, 1), (9003, [float("nan")] * dim, 1), (9004, [float("inf")] + [0.0] * (dim - 1), 0), (9005, [], 0), (9006, [0.1] * (dim - 1), 0), (9007, [0.0] * dim, 2)]


def whole(e):
    return [math.floor(256 * x) for x in e]


def usable(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def mined(rows, anchors, positives=5, negatives=3, low=50, high=95):
    first = {}
    for i, e, y in rows:
        if i is not None and y is not None and usable(e):
            key = lambda x: (x[0], np.array(x[1], "<i4").tobytes())
            first[i] = min(first.get(i, (y, whole(e))), (y, whole(e)), key=key)
    out = set()
    for a in sorted(x for x in first if anchors(x)):
        y, v = first[a]
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z == y) for i, (z, w) in first.items() if i != a and len(w) == len(v))
        for p, i, _ in [x for x in scored if x[2]][:positives]:
            fits = [(n, j) for n, j, same in scored if not same and low * -p <= 100 * -n <= high * -p][:negatives]
            out |= {(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(fits)}
    return out


@pytest.mark.parametrize("dim", [3, 16])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dim):
    """Small shards and buckets, so that rows and anchors meet in many tasks and buckets are cut short."""
    for name, n in (("ROWS", 60), ("ANCHORS", 7), ("BUCKET", 16), ("LEAST", 20)):
        monkeypatch.setattr(hardnegatives, name, n)
    rows = random_rows(240, dim, dim) + odd_rows(dim)
    rows += [rows[3], (6, rows[40][1], 2), (None, rows[5][1], 1), (9008, rows[5][1], None)]  # a repeated row, an id of two rows, nulls
    got = hardnegatives.hard_negatives(table(spark, rows), F.col("vec_id") % 6 == 0)
    assert got.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    have = [tuple(r) for r in got.collect()]
    want = mined(rows, lambda i: i % 6 == 0)
    assert len(have) == len(want) > 100 and set(have) == want


def test_coordinate_ranges_prune_without_loss():
    """Long and short vectors in two dimensions: the search looks at few rows and loses none."""
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(4000, 2)) * 200 * rng.choice([0.1, 1, 5], size=(4000, 1))).astype(np.int64)
    ids, q = np.arange(4000), x[:20]
    looked = 0
    original = np.nonzero

    def counted(mask):
        nonlocal looked
        looked += mask.size
        return original(mask)

    lo, hi = np.full((20, 1), -np.inf), np.full((20, 1), np.inf)
    np.nonzero = counted
    try:
        best = hardnegatives.search(ids, x, np.zeros(4000, int), ids[:20], q, np.zeros(20, int), lo, hi, 5, True)
    finally:
        np.nonzero = original
    for a in range(20):
        s = sorted((-int(x[a] @ x[i]), i) for i in range(4000) if i != a)[:5]
        at = best.slot == a
        assert sorted(zip((-best.score[at]).astype(int).tolist(), best.id[at].tolist(), strict=True)) == s
    assert looked < 20 * 4000 / 2


def test_hard_negatives_of_nothing(spark):
    assert hardnegatives.hard_negatives(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert hardnegatives.hard_negatives(table(spark, odd_rows(4)[:4]), F.lit(True)).count() == 0
    alone = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [-1.0, 0.0], 1)]  # no other label
    assert hardnegatives.hard_negatives(table(spark, alone), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        hardnegatives.search(np.arange(2), np.full((2, 4), vectors.BOUND), np.zeros(2), np.arange(1), np.full((1, 4), vectors.BOUND), np.zeros(1), np.zeros((1, 1)), np.ones((1, 1)), 1, True)


def clustered(rows, k, rounds, dim):
    kept = [(i, whole(e)) for i, e, _ in rows if usable(e) and len(e) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (j, _) in zip(kept, at, strict=True) if j == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    inertia = [sum(d for j, d in at if j == c) for c in range(len(centroids))]
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, inertia[c], sum(inertia), told[c]) for (i, _), (c, d) in zip(kept, at, strict=True))


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_clusters_equal_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(clustering, "CHUNK", 37)
    rows = random_rows(150, 7, 3) + odd_rows(7)
    rows += [rows[3], rows[3], (6, rows[40][1], 2), (None, rows[5][1], None)]
    got = clustering.centroid_clusters(table(spark, rows).repartition(3), k=9, rounds=4, dim=7, width=width)
    assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in got.collect()) == clustered(rows, 9, 4, 7)


def test_clusters_of_few_and_of_nothing(spark):
    assert clustering.centroid_clusters(table(spark, [])).count() == 0
    assert clustering.centroid_clusters(table(spark, odd_rows(64)[:6])).count() == 0
    rows = [(i, [float(i)] * 3, None) for i in range(4)]
    got = clustering.centroid_clusters(table(spark, rows), k=40, dim=3).collect()
    assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in got) == clustered(rows, 40, 5, 3) and len({r.cluster for r in got}) == 4


def test_components_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        clustering.centroid_clusters(table(spark, [(1, [1e7] * 64, 1)])).collect()


DOCS = "doc_id long, text string, n_tokens string, digest string, tokenizer int, seat int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "n", "d", 1, 2) for i, t in rows], DOCS)


ROWS = [(1, "Hello there"), (2, None), (3, ""), (4, "naïve ☃ 日本語"), (5, "Hello there"), (5, "Hello there"), (6, "a<|endoftext|>b"), (7, "w " * 1024), (8, "x" * 200_000), (None, "no id"), (None, "no id"), (9, " \n\t"), (4, "another text of an id")]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        count = lambda t, m=SentencePieceProcessor(model_file=path): len(m.encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, m=Tokenizer.from_file(path): len(m.encode(t, add_special_tokens=False))
    rows = ROWS if not name.endswith(".model") else [r for r in ROWS if r[0] != 8]
    got = tokencounts.count_tokens(texts(spark, rows).repartition(3), path, str(tmp_path / "cache"))
    want = sorted((str(i), len((t or "").encode()), n := count(t or ""), n > 1024) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want


def test_only_missing_digests_are_encoded(spark, tmp_path, monkeypatch):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    asked = []
    original = tokencounts.encode_texts
    monkeypatch.setattr(tokencounts, "encode_texts", lambda rows, p: (asked.append(sorted(r.text for r in rows.select("text").distinct().collect())), original(rows, p))[1])
    run = lambda rows: {(str(r.doc_id), r.n_tokens) for r in tokencounts.count_tokens(texts(spark, rows), path, cache).collect()}
    first = run([(1, "one text"), (2, "two texts"), (3, "one text")])
    again = run([(7, "two texts"), (8, "three"), (9, None), (1, "one text")])
    assert asked == [["one text", "two texts"], ["", "three"]]
    assert {n for i, n in again if i == "7"} == {n for i, n in first if i == "2"} and ("9", 0) in again
    assert spark.read.parquet(cache).count() == 4
    # What another run has appended meanwhile is taken once.
    spark.read.schema(tokencounts.SCHEMA).parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert run([(1, "one text"), (1, "one text")]) == {x for x in first if x[0] == "1"} and asked[-1] == []


def test_another_tokenizer_or_normalisation_counts_anew(spark, tmp_path):
    cache, path = str(tmp_path / "cache"), public_tokenizers.path("word_bpe_49k.json")

    def lowered(text):
        return F.lower(tokencounts.same(text))

    rows = texts(spark, [(1, "Loud WORDS"), (2, "loud words"), (3, None)])
    plain = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(rows, path, cache).collect()}
    folded = {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(rows, path, cache, lowered).collect()}
    assert plain == folded  # this tokenizer lower-cases
    by = {r.tokenizer: r.n for r in spark.read.parquet(cache).groupBy("tokenizer").agg(F.count("digest").alias("n")).collect()}
    assert by == {tokencounts.version(path): 3, tokencounts.version(path, lowered): 2}
    other = tokencounts.count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json"), cache)
    assert {r.doc_id: r.n_bytes for r in other.collect()} == {1: 10, 2: 10, 3: 0}


def test_token_counts_of_nothing(spark, tmp_path):
    assert tokencounts.count_tokens(texts(spark, []), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")).count() == 0
