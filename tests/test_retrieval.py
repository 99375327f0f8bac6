"""Best matches against all pairs, with few documents and questions to a shard."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tracewright.operators import retrieval


def world(seed, n_docs, n_queries):
    """Terms of very unlike frequency, hot ones in most documents, ties and repeated texts."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(120)]
    pick = lambda n: " ".join(words[min(119, int(rng.expovariate(0.06)))] for _ in range(n))
    docs = [(i, pick(rng.randint(1, 60))) for i in range(n_docs)] + [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, "word1 " * 3000)]
    docs += [(n_docs + 3 + i, docs[0][1]) for i in range(20)]
    queries = [(i, pick(rng.randint(1, 20))) for i in range(n_queries)] + [(n_queries, None), (n_queries + 1, "of to"), (n_queries + 2, "nowhere seen"), (n_queries + 3, "word0")]
    return docs, queries


def all_pairs(docs, queries, k):
    words = lambda t: {w for w in (t or "").lower().split() if len(w) > 2 and w not in retrieval.AUDIT_STOP}
    sets, out = [(i, words(t)) for i, t in docs], set()
    for q, t in queries:
        asked = words(t)
        scored = sorted((-len(asked & s) / len(asked), i) for i, s in sets if asked & s) if asked else []
        out |= {(q, i, -n, r + 1) for r, (n, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("k", "small"), [(1, False), (5, True), (7, False)])
def test_best_matches_equal_all_pairs(spark, monkeypatch, k, small):
    if small:
        for name, n in (("DOCUMENTS", 50), ("QUESTIONS", 9), ("LEAST", 20)):
            monkeypatch.setattr(retrieval, name, n)
    docs, queries = world(k, 300, 40)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = [tuple(r) for r in retrieval.best_matches(q, d, k).select("query_id", "doc_id", "score", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(docs, queries, k)


def test_best_matches_stay_within_their_group(spark):
    docs, queries = world(3, 60, 12)
    d = spark.createDataFrame([(g, f"{g}-{i:04}", t) for g in "ab" for i, t in docs[ord(g) % 2 :]], "repo string, doc_id string, text string")
    q = spark.createDataFrame([(g, i, t) for g in "abc" for i, t in queries], "repo string, query_id long, text string")
    got = {tuple(r) for r in retrieval.best_matches(q, d, 5, on=("repo",)).select("repo", "query_id", "doc_id", "score", "rank").collect()}
    want = {(g, q, f"{g}-{i:04}", n, r) for g in "ab" for q, i, n, r in all_pairs(docs[ord(g) % 2 :], queries, 5)}
    assert got == want


def test_best_matches_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "some question")], "query_id long, text string")
    assert retrieval.best_matches(q, d, 5).count() == 0
    assert retrieval.best_matches(q.limit(0), spark.createDataFrame([(1, "some text")], "doc_id long, text string"), 5).count() == 0


def test_common_terms_add_no_documents():
    """Terms that come after the rare ones have settled the k-th best change no choice."""
    postings = [np.arange(10_000), np.arange(5), np.arange(5), np.arange(5)]
    _, found, shared = retrieval.matches([np.array([0, 1, 2, 3])], postings, 10_000, 5)
    assert found.tolist() == [0, 1, 2, 3, 4] and shared.tolist() == [4] * 5


@pytest.mark.parametrize(("longest", "flagged", "entries"), [(3, 2, 1), (20, 5, 50), (64, 1000, 10_000)])
def test_matches_equal_counts_of_all_pairs(monkeypatch, longest, flagged, entries):
    """Whatever bounds a count, is flagged or looked at together."""
    for name, n in (("LONGEST", longest), ("FLAGGED", flagged), ("ENTRIES", entries)):
        monkeypatch.setattr(retrieval, name, n)
    rng = np.random.default_rng(longest)
    held = rng.random((50, 60)) < rng.random((50, 1)) ** 3  # term, document
    asked = [rng.choice(50, rng.integers(0, 20), replace=False) for _ in range(40)]
    got = list(zip(*(x.tolist() for x in retrieval.matches(asked, [np.flatnonzero(h) for h in held], 60, 5)), strict=True))
    counts = [sorted((-int(held[t, d].sum()), d) for d in range(60)) for t in asked]
    assert got == [(q, d, -n) for q, c in enumerate(counts) for n, d in c[:5] if n]


def test_only_documents_of_rare_terms_are_taken_up(monkeypatch):
    """Long documents hold most of the terms, so that the documents of the common ones need not be gone through."""
    taken, spread = [], retrieval.spread
    monkeypatch.setattr(retrieval, "spread", lambda first, n: (taken.append(int(n.sum())), spread(first, n))[1])
    postings = [np.arange(600), *(np.unique(np.append(np.arange(600), np.arange(600 + i, 20_000, 2))) for i in range(9))]
    retrieval.matches([np.arange(10)], postings, 20_000, 5)
    assert taken[-1] == 600 and sum(taken) < 10_000


def test_shards_do_not_grow_with_the_documents(spark):
    """Beyond some thousand documents a shard holds as many as before: its share of 40,000 is no more than DOCUMENTS."""
    d = spark.range(40_000).selectExpr("id doc_id", "'word' text")
    seen = retrieval.best_matches(spark.createDataFrame([(1, "word")], "query_id long, text string"), d, 40_000).count()
    assert seen == 40_000 and retrieval.DOCUMENTS <= 1 << 14
