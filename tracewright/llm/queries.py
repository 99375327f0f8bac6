"""The registered queries opN_<name> over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import byte_bpe, clustering, decontaminate, embeddings, hardnegatives, languageid, linededup, minhash, quality, repeats, tokencounts, toxicity, warc
from tracewright.llm.shared import cut, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def held_out(modulus: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the text that stays."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, hamming, similarity of the benchmark items that documents hold."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "archives")
    warc.archive_pages(table(spark, sf_dir, "pages"), path)
    r = warc.records(spark, path, cut(warc.read(spark, path), "records"))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    r = r.select(page(F.col("record_id")).alias("page_id"), "record_type", page(F.col("refers_to")).alias("refers_to"), F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"), F.col("content_length"))
    full = r.where("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("content_length").alias("full")).dropDuplicates(["of"])
    r = r.join(full, r["refers_to"] == full["of"], "left")
    return r.select("page_id", F.coalesce("full", "content_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 50).drop("kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (its label was not learned from), evidence, host_posterior, path_posterior, score, kept (score >= 0.5)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = quality.score(docs, table(spark, sf_dir, "labels").where(~held_out(5, 1)))
    return out.select("doc_id", F.coalesce(held_out(5, 1), F.lit(False)).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languageid.fit(docs, docs.where(~held_out(4, 2)))
    return languageid.predict(docs, model).select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), byte_bpe_path(), hashes_only=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from a cache of its own that starts empty; a user keeps one folder over all runs."""
    import public_tokenizers

    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-cache"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_quality": op5_quality,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_centroid_clustering": op13_centroid_clustering,
}

#: The usable vectors as whole numbers; {} is a further condition.
WHOLE = """
whole AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND {}
)"""


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Assignment (a), then new centroids (c), round by round, one component a row."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (SELECT r, k, CAST(sum((x - v) * (x - v)) AS BIGINT) AS d FROM part JOIN c{i} USING (i) GROUP BY r, k),
a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT k, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS v FROM a{i} JOIN part USING (r) GROUP BY k, i),
c{i + 1} AS MATERIALIZED (SELECT k, i, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (k, i))""")
    return f"""
WITH {WHOLE.format("len(embedding) = 64")},
part AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(list_transform(e, lambda x: CAST(x AS BIGINT))) AS x FROM whole),
seeds AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS k FROM whole QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT k, i, x AS v FROM seeds JOIN part USING (r)), {",".join(steps)},
told AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM whole JOIN a{rounds} USING (r) JOIN told USING (k)
"""


SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS x FROM t
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
pair AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
""",
    "op4_repeated_passages": """
WITH t AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 49)) AS p, unnest(list_transform(range(1, n - 48), lambda i: b[i : i + 49])) AS s FROM t WHERE n >= 50),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS f FROM w) WHERE f < doc_id),
step AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM step),
span AS MATERIALIZED (SELECT doc_id, k, min(p) AS lo, max(p) + 50 AS hi FROM run GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS z FROM span
  UNION ALL
  SELECT doc_id, max(hi), any_value(n) FROM span JOIN t USING (doc_id) GROUP BY doc_id
), kept AS (SELECT doc_id, unhex(string_agg(CASE WHEN z > a THEN hex(b[a + 1 : z]) ELSE '' END, '' ORDER BY a)) AS kept FROM gap JOIN t USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, b)) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op11_hard_negatives": f"""
WITH {WHOLE.format("vec_id IS NOT NULL AND label IS NOT NULL")},
one AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, e FROM whole QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM one a JOIN one b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
neg AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM pos JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT * FROM neg WHERE rank <= 3
""",
    "op13_centroid_clustering": clusters_sql(),
    "op6_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS len FROM v
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, CAST((SELECT count(*) FROM pair p WHERE p.a = v.vec_id) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id)
""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS chief FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.chief <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.chief <> d.page_id THEN m.chief END AS refers_to
FROM d LEFT JOIN m ON d.payload_bytes >= 1000 AND d.payload_digest = m.payload_digest
""",
}
