"""Grounded retrieval: best lexical matches, answers and citation checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import AUDIT_STOP, QUOTED, RETRIEVAL_STOP, answer, asks_for_recent_changes, terms


def overlaps(queries: DataFrame, docs: DataFrame, stop: tuple[str, ...] = AUDIT_STOP, on: tuple[str, ...] = ()) -> DataFrame:
    """on, query_id, doc_id, score: shared terms by the query's terms, of pairs that share one.

    queries: (on, query_id, text), docs: (on, doc_id, text). Terms are exploded and joined by equality;
    never a cross join. The smaller side is broadcast by Spark when it is under its threshold.
    """
    q = queries.select(*on, "query_id", terms(F.col("text"), stop).alias("t")).withColumn("n_terms", F.greatest(F.lit(1), F.size("t")))
    q = q.select(*on, "query_id", "n_terms", F.explode("t").alias("term"))
    wanted = q.select(*on, "term").distinct()
    d = docs.select(*on, "doc_id", F.explode(terms(F.col("text"), stop)).alias("term")).join(wanted, [*on, "term"], "left_semi")
    hits = q.join(d, [*on, "term"]).groupBy(*on, "query_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"), F.first("n_terms").alias("n_terms"))
    return hits.select(*on, "query_id", "doc_id", (F.col("shared") / F.col("n_terms")).alias("score"))


#: Documents and questions of a shard, on average.
DOCUMENTS, QUESTIONS = 1 << 14, 1 << 18
#: Documents that are worth a task of their own while cores are idle.
LEAST = 1 << 13
#: Documents of a shard that bound each question's k-th best count, terms whose documents are held as flags, and entries that are looked at together.
LONGEST, FLAGGED, ENTRIES = 512, 1 << 13, 1 << 16


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place) of the n[i] places from first[i] on, of every i."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def runs(work: np.ndarray) -> list[tuple[int, int]]:
    """Neighbours whose work is ENTRIES at most together; at least one each."""
    total, out, begin = np.cumsum(work), [], 0
    while begin < len(work):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + ENTRIES, "right")))
        out.append((begin, end))
        begin = end
    return out


def matches(asked: list[np.ndarray], postings: list[np.ndarray], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, document, shared terms) of the k documents that share most terms with each question; ties by document.

    asked: a question's terms; postings: a term's documents, ascending. The k-th best count among the documents with most terms
    bounds that among all from below. A document that reaches it lacks so few of a question's n terms that it holds one of the
    n - bound + 1 rarest: only those terms' documents are taken up, and looked for under the other terms while they can still reach
    the bound. Questions go through this many at a time.
    """
    size, df = np.array([len(x) for x in asked], np.int64), np.array([len(x) for x in postings], np.int64)
    if not df.sum() or not size.sum():
        return (np.empty(0, np.int64),) * 3
    question, term = np.repeat(np.arange(len(size)), size), np.concatenate(asked).astype(np.int64)
    term = term[np.lexsort((df[term], question))]
    at, first = np.cumsum(size) - size, np.cumsum(df) - df
    doc, of_term = np.concatenate(postings), np.repeat(np.arange(len(df), dtype=np.int32), df)
    per_question = lambda x: np.bincount(question, x, len(size)).astype(np.int64)

    # The bound: counts of all of the longest documents.
    n_long = min(LONGEST, n_docs)
    number = np.full(n_docs, -1)
    number[np.argpartition(-np.bincount(doc, minlength=n_docs), n_long - 1)[:n_long]] = np.arange(n_long)
    among = number[doc] >= 0
    long_doc, long_df = number[doc[among]], np.bincount(of_term[among], minlength=len(df))
    long_first, least = np.cumsum(long_df) - long_df, np.ones(len(size), np.int64)
    for b, e in runs(per_question(long_df[term]) + n_long) if n_long >= k else ():
        mine = slice(at[b], at[e - 1] + size[e - 1])
        i, place = spread(long_first[term[mine]], long_df[term[mine]])
        counts = np.bincount((question[mine][i] - b) * n_long + long_doc[place], minlength=(e - b) * n_long).reshape(-1, n_long)
        least[b:e] = np.maximum(1, np.partition(counts, n_long - k, axis=1)[:, n_long - k])

    # Flags, a bit each, of the terms with most documents; other terms are looked up in order.
    keys, flagged = np.int64(n_docs) * of_term + doc, np.full(len(df), -1)
    top_terms = np.sort(np.argsort(-df, kind="stable")[:FLAGGED])
    flagged[top_terms] = np.arange(len(top_terms))
    seen = flagged[of_term] >= 0
    bit = flagged[of_term[seen]] * n_docs + doc[seen]  # ascending, as terms and their documents are
    flags, begin = np.zeros(len(top_terms) * n_docs // 8 + 1, np.uint8), np.flatnonzero(np.diff(bit >> 3, prepend=-1))
    flags[bit[begin] >> 3] = np.add.reduceat(np.left_shift(1, bit & 7).astype(np.uint8), begin)

    def holds(terms_of: np.ndarray, docs_of: np.ndarray) -> np.ndarray:
        out, slot = np.zeros(len(docs_of), bool), flagged[terms_of]
        bit = (slot * n_docs + docs_of)[slot >= 0]
        out[slot >= 0] = flags[bit >> 3] >> (bit & 7) & 1
        wanted = (terms_of * n_docs + docs_of)[slot < 0]
        out[slot < 0] = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
        return out

    head, found = size - least + 1, []
    rare = np.arange(len(term)) - at[question] < head[question]
    for b, e in runs(per_question(np.where(rare, df[term], 0)) + 1):
        mine = np.arange(at[b], at[e - 1] + size[e - 1])
        mine = mine[rare[mine]]
        i, place = spread(first[term[mine]], df[term[mine]])
        met = (question[mine][i] - b) * n_docs + doc[place]
        met.sort()
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(met)), bool), met[1:] != met[:-1]]))
        count, met = np.diff(np.append(begin, len(met))), met[begin]
        q, d = met // n_docs + b, met % n_docs
        for step in range(int((size - head)[b:e].max(initial=0)) + 1):
            left = np.maximum(0, size[q] - head[q] - step)
            stay = count + left >= least[q]
            q, d, count, left = q[stay], d[stay], count[stay], left[stay]
            more = np.flatnonzero(left)
            if not len(more):
                break
            count[more] += holds(term[at[q[more]] + head[q[more]] + step], d[more])
        best = np.lexsort((d, -count, q))
        q, d, count = q[best], d[best], count[best]
        stay = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[stay], d[stay], count[stay]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best_matches(queries: DataFrame, docs: DataFrame, k: int, stop: tuple[str, ...] = AUDIT_STOP, on: tuple[str, ...] = ()) -> DataFrame:
    """on, query_id, doc_id, score, rank: the k documents that share most of a query's terms, by score (share of its terms), then doc_id.

    queries: (on, query_id, text), docs: (on, doc_id, text); a document that shares no term does not count. Documents and
    queries are dealt into shards of bounded size. In a task one shard of documents, indexed by term, meets one of queries, and k
    matches of each query leave it: there is no table of pairs.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    q = queries.select(*on, "query_id", terms(F.col("text"), stop).alias("terms")).where(F.size("terms") > 0)
    d = docs.select(*on, "doc_id", "text")
    sizes = d.groupBy(*on).agg(F.count("doc_id").alias("n")).withColumn("shards", F.greatest(F.ceil(F.col("n") / DOCUMENTS), F.least(F.lit(cores), F.ceil(F.col("n") / LEAST))).cast("int"))
    parts = queries.groupBy(*on).agg(F.greatest(F.lit(1), F.ceil(F.count("query_id") / QUESTIONS)).cast("int").alias("parts"))
    both = sizes.join(parts, list(on)) if on else sizes.crossJoin(F.broadcast(parts))  # one row with one row
    both = both.select(*on, "shards", "parts")
    with_sizes = lambda df: df.join(both, list(on)) if on else df.crossJoin(F.broadcast(both))  # one row
    deal = lambda column, of: F.pmod(F.xxhash64(column), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    d = with_sizes(d).select(*on, "doc_id", terms(F.col("text"), stop).alias("terms"), deal("doc_id", "shards").alias("shard"), "parts")
    left = d.select(*on, "doc_id", "terms", "shard", every("parts").alias("part"))
    right = with_sizes(q).select(*on, "query_id", "terms", every("shards").alias("shard"), deal("query_id", "parts").alias("part"))

    def run(documents: pa.Table, questions: pa.Table) -> pa.Table:
        questions = questions.rename_columns([c.removeprefix("of_") for c in questions.column_names])
        size = np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in questions["terms"].chunks)]).astype(np.int64)
        words = pc.list_flatten(questions["terms"]).combine_chunks().dictionary_encode()
        asked = np.split(words.indices.to_numpy(zero_copy_only=False), np.cumsum(size)[:-1]) if len(size) else []
        # Documents are numbered in order of their ids; of their terms those that are asked for are kept, as numbers.
        order = pc.sort_indices(documents["doc_id"])
        number = np.empty(len(order), np.int32)
        number[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        rows, held, begin = [np.empty(0, np.int32)], [np.empty(0, np.int32)], 0
        for chunk in documents["terms"].chunks:
            term = pc.index_in(chunk.flatten(), value_set=words.dictionary)
            row = np.repeat(number[begin : begin + len(chunk)], chunk.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            rows.append(row[term.is_valid().to_numpy(zero_copy_only=False)])
            held.append(term.drop_null().to_numpy(zero_copy_only=False).astype(np.int32))
            begin += len(chunk)
        key = np.concatenate(held).astype(np.int64) << 32 | np.concatenate(rows)
        key.sort()
        postings = np.split((key & 0xFFFFFFFF).astype(np.int32), np.cumsum(np.bincount(key >> 32, minlength=len(words.dictionary)))[:-1]) if len(words.dictionary) else []
        a, b, n = matches(asked, postings, documents.num_rows, k)
        out = {c: questions[c].take(pa.array(a)) for c in (*on, "query_id")}
        return pa.table(out | {"doc_id": documents["doc_id"].take(order.take(pa.array(b))), "score": n / size[a]})

    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema.fields, *docs.schema.fields)}
    keys = [*on, "shard", "part"]
    right = right.select([F.col(c).alias(f"of_{c}") for c in right.columns])  # both may come from one table
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in on), f"query_id {kinds['query_id']}", f"doc_id {kinds['doc_id']}", "score double"])
    found = left.groupBy(*keys).cogroup(right.groupBy(*(f"of_{c}" for c in keys))).applyInArrow(run, schema)
    return top(found, k, (*on, "query_id"))


def top(scored: DataFrame, k: int = 5, keys: tuple[str, ...] = ("query_id",), order: list[Column] | None = None) -> DataFrame:
    """The first k rows of each key, with rank; by score, then doc_id."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.desc("score"), F.col("doc_id")]))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieval_documents(modules: DataFrame, hotspots: DataFrame, commits: DataFrame, newest: int = 200, part: tuple[str, ...] = ()) -> DataFrame:
    """part, doc_id, kind, text, at of modules (module, description), hotspots (path, commit_count) and the newest commits (commit, message, authored_at)."""
    none = F.lit(None).cast("timestamp_ntz")
    m = modules.select(*part, F.concat(F.lit("module:"), "module").alias("doc_id"), F.lit("module").alias("kind"), F.format_string("Module %s: %s", "module", "description").alias("text"), none.alias("at"))
    h = hotspots.select(*part, F.concat(F.lit("hotspot:"), "path").alias("doc_id"), F.lit("hotspot").alias("kind"), F.format_string("File %s is a relative hotspot with %d commits.", "path", "commit_count").alias("text"), none.alias("at"))
    w = Window.partitionBy(*(part or (F.lit(0),))).orderBy(F.desc("authored_at"), "commit")
    recent = commits.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= newest) if part else commits.orderBy(F.desc("authored_at"), "commit").limit(newest)
    c = recent.select(*part, F.concat(F.lit("commit:"), "commit").alias("doc_id"), F.lit("commit").alias("kind"), F.col("message").alias("text"), F.col("authored_at").cast("timestamp_ntz").alias("at"))
    return m.unionByName(h).unionByName(c)


def answers(questions: DataFrame, docs: DataFrame, k: int = 5, on: tuple[str, ...] = ()) -> DataFrame:
    """on, query_id, answer, evidence (array of doc_id) for every question; the refusal where nothing matches.

    Questions for recent changes take the newest documents of kind commit instead of the best matches.
    docs: (on, doc_id, kind, text, at).
    """
    asked = questions.withColumn("recent", F.coalesce(asks_for_recent_changes(F.col("text")), F.lit(False)))
    best = best_matches(asked.where("not recent"), docs, k, RETRIEVAL_STOP, on)
    newest = docs.where("kind = 'commit'")
    newest = top(newest, k, on, [F.desc("at"), F.col("doc_id")]) if on else newest.orderBy(F.desc("at"), "doc_id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("at"), "doc_id")))
    lately = asked.where("recent").select(*on, "query_id")
    lately = (lately.join(newest, list(on)) if on else lately.crossJoin(F.broadcast(newest))).select(*on, "query_id", "doc_id", "rank")  # k rows
    picked = best.select(*on, "query_id", "doc_id", "rank").unionByName(lately)
    # An answer quotes the beginning of a document: no more of it is shuffled.
    texts = picked.join(docs.select(*on, "doc_id", F.substring("text", 1, QUOTED).alias("text")), [*on, "doc_id"])
    found = texts.groupBy(*on, "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("x"))
    out = questions.select(*on, "query_id").join(found, [*on, "query_id"], "left")
    return out.select(*on, "query_id", answer(F.col("x.text")).alias("answer"), F.coalesce("x.doc_id", F.array().cast(found.select("x.doc_id").schema[0].dataType)).alias("evidence"))


def check_citations(cited: DataFrame) -> DataFrame:
    """cited (answer, cited, allowed) with n_cited (distinct) and valid: nothing but allowed ids, at least one, 1 to 6000 characters."""
    distinct = F.array_distinct("cited")
    ok = (F.size(F.array_except("cited", "allowed")) == 0) & (F.size("cited") > 0) & F.length(F.trim("answer")).between(1, 6000)
    return cited.withColumn("n_cited", F.size(distinct).cast("long")).withColumn("valid", F.coalesce(ok, F.lit(False)))
