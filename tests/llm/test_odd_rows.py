"""Empty tables, columns of clashing names, very long texts, ties, repeated rows and hubs, by operator."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_llm_operators import WORDS, docs, groups

from tracewright.llm import byte_bpe, decontaminate, embeddings, languageid, linededup, minhash, quality, repeats, shared, toxicity, warc


def bpe_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


ITEMS = "item_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
NO_MODEL = toxicity.Model({})

EMPTY = {
    "toxicity": lambda s: toxicity.score(docs(s, []), NO_MODEL),
    "repeats": lambda s: repeats.remove_repeats(docs(s, []), 50),
    "quality": lambda s: quality.score(docs(s, []).withColumn("source", F.lit("h")).withColumn("lang", F.lit("en")), s.createDataFrame([], "doc_id long, quality int")),
    "embeddings": lambda s: embeddings.near_duplicates(s.createDataFrame([], VECTORS)),
    "language": lambda s: languageid.predict(docs(s, []), languageid.fit(docs(s, []).withColumn("lang", F.lit("en")), docs(s, []).withColumn("lang", F.lit("en")))),
    "bpe": lambda s: byte_bpe.encode(docs(s, []), bpe_path()),
    "lines": lambda s: linededup.dedup_lines(docs(s, [])),
    "decontamination": lambda s: decontaminate.contaminated(docs(s, []), s.createDataFrame([(1, "a b c d e f")], ITEMS)),
    "minhash": lambda s: minhash.near_duplicates(docs(s, [])),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables(spark, name):
    assert EMPTY[name](spark).collect() == []


def test_archive_of_no_pages(spark, tmp_path):
    warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.records(spark, str(tmp_path / "w")).collect() == []


def test_models_of_nothing_learned(spark):
    d, none = docs(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, none)).collect()} == {NO_MODEL.score(None)}
    assert {(r.lang_pred, r.score) for r in languageid.predict(d, None).collect()} == {("und", 0.0)}


def test_clashing_columns(spark):
    """Columns that bear the names of results are replaced; others stay as they are."""
    text = " ".join(WORDS[:40])
    names = ["score", "lang_pred", "n_lines", "n_removed", "evidence", "host_posterior", "path_posterior", "n_tokens", "a", "id", "key", "label", "bins"]
    d = docs(spark, [(1, f"{text}\nown line of one"), (2, f"{text}\nown line of two")]).withColumn("source", F.lit("h")).withColumn("lang", F.lit("en"))
    d = d.select("*", *(F.lit(f"clash {n}").alias(n) for n in names))
    y = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for got in (toxicity.score(d, NO_MODEL), quality.score(d.drop("text").withColumn("text", F.lit(text)), y), languageid.predict(d, None)):
        rows = got.collect()
        assert len(rows) == 2 and len(set(got.columns)) == len(got.columns)
        assert all(isinstance(r.score, float) and r.key == "clash key" and r.label == "clash label" for r in rows)
    lines = {r.doc_id: (r.n_lines, r.n_removed, r.text, r.key) for r in linededup.dedup_lines(d).collect()}
    assert lines == {1: (2, 0, f"{text}\nown line of one", "clash key"), 2: (2, 1, "own line of two", "clash key")}
    assert {(r.doc_id, r.n_removed) for r in repeats.remove_repeats(d, 50).collect()} == {(1, 0), (2, len(text) + len("\nown line of "))}


def test_very_long_texts(spark):
    """A million and more characters: one line, and many lines."""
    line = " ".join(f"{w}x{i}" for i, w in enumerate(WORDS * 300))
    many = "\n".join(hashlib.sha512(b"%d" % i).hexdigest() for i in range(8_000))
    texts = [(1, line), (2, "front " + line), (3, many), (4, many + "\nlast line here"), (5, "short")]
    d = docs(spark, texts)
    assert min(len(line), len(many)) > 1_000_000
    cut = {r.doc_id: r.n_removed for r in repeats.remove_repeats(d, 50).collect()}
    assert cut == {1: 0, 2: len(line), 3: 0, 4: len(many), 5: 0}
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(d, min_words=1).collect()}
    assert kept == {1: line, 2: "", 3: many, 4: "last line here", 5: "short"}
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(d).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    item = " ".join(line.split()[50_000:50_060])
    got = decontaminate.contaminated(d, spark.createDataFrame([(7, item)], ITEMS)).collect()
    assert {(r.doc_id, r.start) for r in got} == {(1, 50_000), (2, 50_001)}
    assert toxicity.score(d, toxicity.Model({" front ": 4.0}, frozenset(), (1.0, 1.0, 1.0, -1.0))).where("score > 0.5").count() == 1


def test_ties_and_repeated_rows(spark):
    same = [(i, [1.0, 2.0, 3.0], 0) for i in (5, 3, 9)] + [(4, [2.0, 4.0, 6.0], 0), (6, [1.0, 2.0, 3.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(same, VECTORS)).collect()}
    assert got == {3: (3, 3, True), 4: (3, 3, False), 5: (3, 3, False), 9: (3, 3, False), 6: (0, 6, True)}
    d = docs(spark, [(1, "ab ab"), (1, "ab ab"), (2, "ba ba")]).withColumn("lang", F.when(F.col("doc_id") == 1, "aa").otherwise("bb"))
    rows = languageid.predict(d, languageid.fit(d, d)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2] and len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1
    d = d.withColumn("source", F.lit(None).cast("string"))
    rows = quality.score(d, spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2] and len({r.score for r in rows if r.doc_id == 1}) == 1


def test_components_of_a_star_and_of_long_chains(spark):
    """One node with 100,000 neighbours, the largest id of all, beside chains that cross it nowhere."""
    star = spark.range(1, 100_001).select(F.lit(1_000_000).cast("long").alias("a"), F.col("id").alias("b"))
    chains = [(2_000_000 + 1000 * k + i, 2_000_000 + 1000 * k + i + 1) for k in range(3) for i in range(200)]
    edges = star.unionByName(spark.createDataFrame(chains, "a long, b long"))
    got = shared.components(edges, "a", "b")
    assert got.where("component = 1").count() == 100_001
    want = groups(chains, sorted({x for e in chains for x in e}))
    assert {r.id: r.component for r in got.where("id >= 2000000").collect()} == want
