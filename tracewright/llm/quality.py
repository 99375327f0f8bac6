"""Document quality by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes log-likelihood ratio over binned figures of its whole text,
counted from labelled rows by a grouped aggregation and tempered by one learned factor. Sites add what
their documents tell: labelled rows count by their label, the others by the evidence's posterior, at
half weight. A host's share of good documents is shrunk to the global one, a path's to its host's, with strengths
estimated by moments from the spread between sites; so a sparse site stays near its parent. The score
joins the path's posterior (as prior odds) and the document's evidence.

Defined results: null and empty texts have the figures of an empty text; null hosts or paths are sites
of their own. Without labelled rows of both classes the evidence is 0 and scores are the global share (0.5 if none).
Rows are kept one to one; extra columns are kept, whatever their names, but for the four that are added: these are replaced.
Repeated rows count as often as they occur; of differing labels of one id the greater counts. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.shared import cut
from tracewright.llm.textarrays import chunks, words

FIGURES = ("length", "symbols", "digits", "capitals", "word_length", "line_repeats", "word_variety")
#: Weight of a document without a label in its sites' counts.
SOFT = 0.5


def _table(*ranges: str) -> np.ndarray:
    t = np.zeros(256, bool)
    for r in ranges:
        t[ord(r[0]) : ord(r[1]) + 1] = True
    return t


DIGIT, CAPITAL, LETTER = _table("09"), _table("AZ"), _table("AZ", "az", "\x80\xff")
PLAIN = LETTER | DIGIT
PLAIN[[ord(c) for c in " \n\t.,;:'\"-?()"]] = True


def binned(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A small integer for each figure of each text."""
    n = np.maximum(np.diff(off), 1)
    sums = lambda t: np.diff(np.concatenate([[0], np.cumsum(t[data])])[off])
    start, end, row = words(data, off)
    count = np.bincount(row, minlength=len(off) - 1)
    mean = np.bincount(row, (end - start).astype(float), minlength=len(off) - 1) / np.maximum(count, 1)
    repeats, variety = np.zeros(len(n)), np.zeros(len(n))
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        text = raw[a:b]
        lines = text.split(b"\n")
        repeats[i] = 1 - len(set(lines)) / len(lines)
        w = text.split()
        variety[i] = len(set(w)) / max(1, len(w)) * np.log2(2 + len(w)) / 6
    share = lambda x: np.ceil(np.log2(1 + 256 * x / n))
    cols = [np.log2(n), share(sums(~PLAIN)), share(sums(DIGIT)), np.minimum(9, 10 * sums(CAPITAL) / np.maximum(1, sums(LETTER))), np.minimum(mean, 15), np.ceil(repeats * 8), np.minimum(15, variety * 8)]
    return np.column_stack(cols).astype(np.int32)


def with_figures(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with `bins`, an array of the binned figures."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [binned(data, off) for _, _, data, off in chunks(column)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FIGURES)), np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FIGURES)), pa.int32()), pa.array(x.reshape(-1)))

    return docs.withColumn("bins", F.arrow_udf(run, "array<int>")(F.col(text_col).cast("string")))


def ratios(rows: DataFrame) -> dict[tuple[int, int], float]:
    """Log-likelihood ratio of each (figure, bin), from rows (bins, label); a few dozen rows reach the driver."""
    each = rows.select("label", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("poor")).collect()
    out = {}
    for f in range(len(FIGURES)):
        own = [r for r in each if r["f"] == f]
        g, p, k = sum(r["good"] for r in own), sum(r["poor"] for r in own), len(own)
        out |= {(f, r["b"]): float(np.log((r["good"] + 1) / (g + k)) - np.log((r["poor"] + 1) / (p + k))) for r in own}
    return out


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def shrunk(sites: DataFrame, parent: Column) -> Column:
    """Posterior share of sites (good, n) round their parent's share, with one strength s for all: (good + s * parent) / (n + s).

    By moments: the variance between sites beyond the sampling variance v = m(1-m)/n is m(1-m)/(s+1).
    """
    m = sites.agg((F.sum("good") / F.sum("n")).alias("m"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - parent, 2)).alias("q")).first()
    mean, k, n, q = (float(m[i] or 0) for i in range(4))
    v = mean * (1 - mean)
    # E[q] is about k v + n v / (s + 1)
    between = max(1e-4, min(0.5, (q - k * v) / (n * v))) if n * v > 0 else 1e-4
    s = 1 / between - 1
    return (F.col("good") + s * parent) / (F.col("n") + s)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """docs with evidence, host_posterior, path_posterior and score (probability of good quality) added.

    labels (id, 0 or 1) may cover any part of docs. A path is a host's part: (host_col, path_col).
    """
    added = ("evidence", "host_posterior", "path_posterior", "score")
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    # What is worked with stands apart from the columns of docs, which go along as one.
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in added))
    base = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"), F.col(host_col).alias("__host"), F.col(path_col).alias("__path"), rest.alias("__rest"))
    base = cut(with_figures(base, "__text").drop("__text"), "figures").join(y, F.col("__key") == F.col("__id"), "left").drop("__id")
    known = base.where("label is not null").select("bins", "label")
    share = known.agg(F.avg("label").alias("m"), F.count("label").alias("n")).first()
    prior = share["m"] if share["n"] else 0.5
    if 0 < prior < 1 and share["n"]:
        r = ratios(known)
        table = F.create_map(*(F.lit(x) for (f, b), v in r.items() for x in (f * 1000 + b, v)))
        raw = F.aggregate(F.transform("bins", lambda b, i: F.coalesce(F.try_element_at(table, i * 1000 + b), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        base = base.withColumn("raw", raw)
        # Naive Bayes counts dependent figures twice; one factor tempers it: the best of a grid by likelihood on the labelled rows.
        grid = [0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0]
        fit = lambda t: F.avg(F.log(F.greatest(F.when(F.col("label") == 1, sigmoid(logit(F.lit(prior)) + t * F.col("raw"))).otherwise(1 - sigmoid(logit(F.lit(prior)) + t * F.col("raw"))), F.lit(1e-9)))).alias(f"t{t}")
        likelihood = base.where("label is not null").agg(*map(fit, grid)).first()
        temper = max(zip(likelihood, grid, strict=True))[1]
        base = base.withColumn("evidence", temper * F.col("raw")).drop("raw")
    else:
        base = base.withColumn("evidence", F.lit(0.0))
    weight = F.when(F.col("label").isNotNull(), 1.0).otherwise(SOFT)
    good = F.coalesce(F.col("label").cast("double"), sigmoid(logit(F.lit(prior)) + F.col("evidence")))
    paths = cut(base.groupBy(F.col("__host").alias("h"), F.col("__path").alias("p")).agg(F.sum(weight * good).alias("good"), F.sum(weight).alias("n")), "paths")
    hosts = paths.groupBy("h").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good") / F.sum("n")).first()[0] or prior
    hosts = cut(hosts.withColumn("host_posterior", shrunk(hosts, F.lit(float(total)))), "hosts")
    paths = paths.join(hosts.select(F.col("h").alias("h2"), "host_posterior"), F.col("h").eqNullSafe(F.col("h2"))).drop("h2")
    paths = cut(paths.withColumn("path_posterior", shrunk(paths, F.col("host_posterior"))).select("h", "p", "host_posterior", "path_posterior"), "sites")
    out = base.join(paths, F.col("__host").eqNullSafe(F.col("h")) & F.col("__path").eqNullSafe(F.col("p")), "left")
    return out.select("__rest.*", "evidence", "host_posterior", "path_posterior", sigmoid(logit(F.col("path_posterior")) + F.col("evidence")).alias("score"))
