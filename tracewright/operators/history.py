"""History mining: per-file statistics, hotspots, co-change pairs and module candidates.

Input `changes` has one row per (part..., commit, path) with authored_at and commit_churn; `part` names the
partition columns (repository, snapshot), () for a single repository. Ratios are unrounded. `tasks` deals the rows over
so many tasks (functions.dealing.tasks_for), so that a task of any step holds a bounded share of them; None leaves that to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.dealing import dealt
from tracewright.functions.paths import module_key

EVIDENCE = 20


def split_churn(changes: DataFrame, part: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """Distinct (part, commit, path) with churn: the commit's churn in equal whole shares, at least 1. Rows that are dealt by commit are made distinct where they are."""
    distinct = changes.groupBy(*part, "commit", "path").agg(F.min("authored_at").alias("authored_at"), F.max("commit_churn").alias("commit_churn"))
    distinct = dealt(distinct, tasks, *part, "commit")  # apart from the step before, as each table of a task takes memory of its own
    sizes = distinct.groupBy(*part, "commit").agg(F.count(F.lit(1)).alias("n_files"))
    share = F.greatest(F.lit(1), F.floor(F.col("commit_churn") / F.col("n_files"))).cast("long")
    return distinct.join(sizes.hint("merge") if tasks else sizes, [*part, "commit"]).withColumn("churn", share).drop("commit_churn")


def file_stats(changes: DataFrame, part: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """part, path, commit_count, churn."""
    return dealt(changes, tasks, *part, "path").groupBy(*part, "path").agg(F.count(F.lit(1)).alias("commit_count"), F.sum("churn").cast("long").alias("churn"))


def with_max(df: DataFrame, part: tuple[str, ...], **columns: str) -> DataFrame:
    """df with group maxima: a small aggregate joined back, rather than a window over whole groups."""
    top = df.groupBy(*part).agg(*(F.max(c).alias(name) for name, c in columns.items()))
    return df.join(top, list(part)) if part else df.crossJoin(F.broadcast(top))  # one row


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def hotspots(stats: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """stats with score = 0.7 commits / most commits + 0.3 churn / most churn."""
    both = with_max(stats, part, mc="commit_count", mh="churn")
    score = F.coalesce(F.try_divide(F.lit(0.7) * F.col("commit_count"), F.col("mc")), F.lit(0.0)) + F.coalesce(F.try_divide(F.lit(0.3) * F.col("churn"), F.col("mh")), F.lit(0.0))
    return both.withColumn("score", score).drop("mc", "mh")


#: Files of a block of a large commit, on average.
BLOCK = 512


def file_pairs(rows: DataFrame, part: tuple[str, ...] = (), right: tuple[str, ...] = (), left: tuple[str, ...] = (), tasks: int | None = None, about: DataFrame | None = None) -> DataFrame:
    """part, commit, left_path, right_path and the columns `left` and `right` of the two rows: the pairs of files, in order, of each commit.

    A commit's files are dealt into blocks of bounded size, and each pair of blocks is a key of the join, so that the pairs of a
    commit of any size are made by many tasks. Most commits are one block. A name both in `left` and `right` gets the suffix _left or _right.
    `about` (part, path, columns) is joined to the rows by path; it is dealt, too, as Spark would else deal the rows over as few tasks as it has. Rows that are dealt by commit are sized where they are.
    """
    keys = [*part, "commit"]
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BLOCK)
    sized = rows.join(large, keys, "left").withColumn("__blocks", F.coalesce(F.ceil(F.col("__n") / BLOCK), F.lit(1)))
    block = sized.withColumn("__own", F.pmod(F.xxhash64("path"), "__blocks")).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    block = block.withColumn("__lo", F.least("__own", "__other")).withColumn("__hi", F.greatest("__own", "__other"))
    at = [*keys, "__lo", "__hi"]
    if about is not None:
        block = dealt(block, tasks, *part, "path").join(dealt(about, tasks, *part, "path"), [*part, "path"])
    block = dealt(block.select(*at, "path", "__own", *dict.fromkeys((*left, *right))), tasks, *at)
    name = lambda c, side: f"{c}_{side}" if c in left and c in right else c
    a = block.select(*at, F.col("path").alias("left_path"), F.col("__own").alias("__left"), *(F.col(c).alias(name(c, "left")) for c in left))
    b = block.select(*at, F.col("path").alias("right_path"), F.col("__own").alias("__right"), *(F.col(c).alias(name(c, "right")) for c in right))
    # Two files of one block meet under that block's own key only.
    met = a.join(b, at).where("left_path < right_path and (__lo = __hi) = (__left = __right)")
    return met.select(*keys, "left_path", "right_path", *(name(c, "left") for c in left), *(name(c, "right") for c in right))


def co_changes(changes: DataFrame, part: tuple[str, ...] = (), support: int = 2, max_files: int | None = None, tasks: int | None = None) -> DataFrame:
    """part, left_path, right_path, commit_count, confidence (Jaccard, by counts) of pairs seen in `support` commits.

    max_files leaves out commits with more files (off by default). A file's number of commits goes with its rows into the pairs, which
    are many more than the files and are not joined again.
    """
    rows = dealt(changes.select(*part, "commit", "path"), tasks, *part, "commit").distinct()
    n = rows.groupBy(*part, "path").agg(F.count(F.lit(1)).alias("n"))
    paired = rows
    if max_files:
        small = rows.groupBy(*part, "commit").count().where(F.col("count") <= max_files).select(*part, "commit")
        paired = rows.join(small, [*part, "commit"], "left_semi")
    pairs = dealt(file_pairs(paired, part, ("n",), ("n",), tasks, n), tasks, *part, "left_path", "right_path").groupBy(*part, "left_path", "right_path")
    pairs = pairs.agg(F.count(F.lit(1)).alias("commit_count"), F.max("n_left").alias("n_left"), F.max("n_right").alias("n_right")).where(F.col("commit_count") >= support)
    union = F.col("n_left") + F.col("n_right") - F.col("commit_count")
    return pairs.select(*part, "left_path", "right_path", "commit_count", (F.col("commit_count") / union).alias("confidence"))


def first_evidence(rows: DataFrame, keys: list[str], value: str, order: list[Column], most: int = EVIDENCE, to: str = "evidence", tasks: int | None = None) -> DataFrame:
    """keys, array of the first `most` distinct values by order; capped before it is collected.

    With `tasks` the values of a key are dealt by hash and cut to `most` in each share, before the shares of a key meet.
    """
    of = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("__o", value))
    if tasks:
        rows = dealt(rows.withColumn("__share", F.pmod(F.xxhash64(value), F.lit(tasks))), tasks, *keys, "__share")
        first = rows.groupBy(*keys, "__share", value).agg(F.min(F.struct(*order)).alias("__o"))
        first = dealt(first.withColumn("__r", of(*keys, "__share")).where(F.col("__r") <= most).drop("__r", "__share"), tasks, *keys)
    else:
        first = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("__o"))
    ranked = first.withColumn("__r", of(*keys)).where(F.col("__r") <= most)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", value))), lambda x: x[value]).alias(to))


def file_evidence(changes: DataFrame, part: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """part, path, evidence: the first commits of each file, in (authored_at, commit) order."""
    return first_evidence(changes, [*part, "path"], "commit", [F.col("authored_at"), F.col("commit")], tasks=tasks)


def pair_evidence(changes: DataFrame, pairs: DataFrame, part: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """pairs with the first commits that hold both files."""
    keys = [*part, "left_path", "right_path"]
    met = dealt(file_pairs(changes.select(*part, "commit", "path", "authored_at"), part, ("authored_at",), tasks=tasks), tasks, *keys)
    rows = met.join(dealt(pairs.select(*keys), tasks, *keys), keys, "left_semi")
    return dealt(pairs, tasks, *keys).join(first_evidence(rows, keys, "commit", [F.col("authored_at"), F.col("commit")], tasks=tasks), keys)


def modules(current_files: DataFrame, changes: DataFrame, part: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """part, module, files, n_files, changed_files, confidence, description, inferred of current files (part, path)."""
    seen = dealt(changes.select(*part, "path"), tasks, *part, "path").distinct().withColumn("seen", F.lit(1))
    files = dealt(current_files.select(*part, "path"), tasks, *part, "path").distinct().join(seen, [*part, "path"], "left").withColumn("module", module_key(F.col("path")))
    out = files.groupBy(*part, "module").agg(F.sort_array(F.collect_list("path")).alias("files"), F.count(F.lit(1)).alias("n_files"), F.count("seen").alias("changed_files"))
    text = F.format_string("Inferred directory module containing %d current files; %d have observed commit evidence.", "n_files", "changed_files")
    return out.withColumn("confidence", F.lit(0.5) + F.lit(0.5) * F.col("changed_files") / F.col("n_files")).withColumn("description", text).withColumn("inferred", F.lit(True))


def module_evidence(current_files: DataFrame, changes: DataFrame, part: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """part, module, evidence: first distinct commits in (path, commit) order."""
    files = dealt(current_files.select(*part, "path"), tasks, *part, "path").distinct()
    rows = files.join(dealt(changes.select(*part, "path", "commit", "authored_at"), tasks, *part, "path"), [*part, "path"]).withColumn("module", module_key(F.col("path")))
    return first_evidence(rows, [*part, "module"], "commit", [F.col("path"), F.col("authored_at"), F.col("commit")], tasks=tasks)


def evolution(changes: DataFrame, current_files: DataFrame, part: tuple[str, ...] = (), tasks: int | None = None) -> dict[str, DataFrame]:
    """co_changes, hotspots and modules with their evidence arrays."""
    ch = split_churn(changes, part, tasks)
    pairs = pair_evidence(ch, co_changes(ch, part, tasks=tasks), part, tasks)
    hot = hotspots(file_stats(ch, part, tasks), part).join(file_evidence(ch, part, tasks), [*part, "path"])
    mods = modules(current_files, ch, part, tasks).join(module_evidence(current_files, ch, part, tasks), [*part, "module"], "left")
    return {"co_changes": pairs, "hotspots": hot, "modules": mods.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))}
