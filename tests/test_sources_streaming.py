from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewright.sources import buckets, readers, sinks, snapshots
from tracewright.streaming import jobs

A, B = "a" * 40, "b" * 40
T0 = dt.datetime(2024, 1, 1)


def test_commit_dump(spark, tmp_path):
    rec = lambda *f: "\x00".join(f) + "\x1e"
    text = rec(A, B, "Ann", "a@x", "2024-01-01T10:00:00+02:00", " fix \nmore ") + rec("nope", "", "", "", "", "") + rec(B, "", "x" * 600, "e", "2024-01-02T00:00:00Z", "")
    (tmp_path / "log.txt").write_text(text)
    good, bad = readers.read_commit_dump(spark, str(tmp_path / "log.txt"))
    rows = {r.commit: r for r in good.collect()}
    assert rows[A].parent_shas == [B] and rows[A].message == "fix \nmore" and rows[A].authored_at == dt.datetime(2024, 1, 1, 8)
    assert len(rows[B].author) == 500 and rows[B].parent_shas == [] and bad.count() == 1


def test_manifest_refs_and_guards(spark):
    lines = [f"100644 blob {A} 12\tsrc/a.ts", f"120000 blob {A} 3\tsrc/link.ts", f"040000 tree {B} -\tsrc", f"100644 blob {B} 2000000\tbig.js", "junk", f"100644 blob {A} 5\tREADME.md"]
    good, bad = readers.read_manifest(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert good.count() == 4 and bad.count() == 1
    chosen, skipped = readers.select_sources(good)
    assert [r.path for r in chosen.collect()] == ["src/a.ts"] and [r.path for r in skipped.collect()] == ["big.js"]
    guard = readers.volume_guard(good.withColumn("repo", F.lit("r")), ("repo",), most_files=3).first()
    assert guard.over and guard.n_files == 4
    marked = {r.path: r.analyzed for r in readers.with_analyzed(good, chosen).collect()}
    assert marked["src/a.ts"] and not marked["README.md"]
    refs, bad = readers.read_refs(spark.createDataFrame([(f"{B} main",), (f"{A} dev",), (f"{A} bad..name",)], "value string"))
    assert [r.name for r in refs.collect()] == ["dev", "main"] and bad.count() == 1


def test_read_sources(spark, tmp_path):
    (tmp_path / "a.ts").write_bytes(b"let a")
    (tmp_path / "b.md").write_bytes(b"x")
    rows = readers.read_sources(spark, str(tmp_path), "*.ts").collect()
    assert len(rows) == 1 and bytes(rows[0].content) == b"let a"


def test_commit_changes(spark):
    stat = spark.createDataFrame([("c1", "old.ts", "new.ts", 3, 1), ("c1", "b.ts", None, None, 2), ("m", "a", "a", 9, 9)], "commit string, old_path string, new_path string, added int, deleted int")
    commits = spark.createDataFrame([("c1", ["p"], T0), ("m", ["p", "q"], T0), ("e", [], T0)], "commit string, parent_shas array<string>, authored_at timestamp")
    rows = {r.commit: r for r in readers.commit_changes(stat, commits).collect()}
    assert rows["c1"].files == ["b.ts", "new.ts"] and rows["c1"].churn == 6 and rows["e"].files == [] and "m" not in rows
    assert readers.exploded(readers.commit_changes(stat, commits)).count() == 2


def test_snapshots_are_seen_only_when_published(spark, tmp_path):
    root = str(tmp_path / "store")
    t = spark.createDataFrame([("a.ts",)], "path string")
    assert snapshots.publish_snapshot(spark, root, "R", "s1", "aa", {"files": t}, F.lit(T0))
    assert not snapshots.publish_snapshot(spark, root, "R", "s9", "aa", {"files": t})
    t.withColumns({"repository_id": F.lit("R"), "snapshot_id": F.lit("half"), "attempt": F.lit("x")}).write.mode("append").partitionBy("repository_id", "snapshot_id", "attempt").parquet(f"{root}/files")
    assert snapshots.read_snapshot(spark, root, "files").count() == 1
    assert snapshots.publish_snapshot(spark, root, "R", "s2", "bb", {"files": t.union(t)}, F.lit(T0 + dt.timedelta(1)))
    assert snapshots.read_snapshot(spark, root, "files").count() == 2 and snapshots.read_snapshot(spark, root, "files", "aa").count() == 1


def test_one_of_two_publishers_wins(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    frame = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    original = snapshots.create

    def overtaken(spark, path, text):
        """Another writer publishes the commit just before."""
        monkeypatch.setattr(snapshots, "create", original)
        assert snapshots.publish_snapshot(spark, root, "R", "other", "aa", {"files": frame("theirs")}, F.lit(T0))
        return original(spark, path, text)

    monkeypatch.setattr(snapshots, "create", overtaken)
    assert not snapshots.publish_snapshot(spark, root, "R", "mine", "aa", {"files": frame("mine 1", "mine 2")}, F.lit(T0))
    assert [r.path for r in snapshots.read_snapshot(spark, root, "files").collect()] == ["theirs"] and snapshots.manifest(spark, root).count() == 1


def test_a_crash_before_the_manifest_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    t = spark.createDataFrame([("a",)], "path string")
    assert snapshots.publish_snapshot(spark, root, "R", "s0", "00", {"files": t}, F.lit(T0))
    monkeypatch.setattr(snapshots, "create", lambda *_: 1 / 0)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            snapshots.publish_snapshot(spark, root, "R", "s1", "aa", {"files": t.union(t)}, F.lit(T0 + dt.timedelta(1)))
    monkeypatch.undo()
    assert snapshots.read_snapshot(spark, root, "files").count() == 1
    with open(f"{root}/snapshots/half.json", "w") as f:
        f.write('{"repository_id": "R", "snapshot_id": "s1", "commit_')
    assert snapshots.read_snapshot(spark, root, "files").count() == 1
    assert snapshots.publish_snapshot(spark, root, "R", "s1", "aa", {"files": t.union(t)}, F.lit(T0 + dt.timedelta(1)))
    assert snapshots.read_snapshot(spark, root, "files").count() == 2


def test_counts_are_taken_while_writing(spark, tmp_path):
    df = spark.createDataFrame([("r", 1), ("r", 2), ("s", None)], "repo string, size long")
    got = sinks.write_counted(df, str(tmp_path / "t"), {"bytes": F.sum("size")}, {"rows": 2, "bytes": 3})
    assert got == {"rows": 3, "bytes": 3, "over": True} and spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert sinks.write_counted(df.limit(0), str(tmp_path / "e")) == {"rows": 0, "over": False}


def test_sinks(spark, tmp_path):
    ev = spark.createDataFrame([(1, "=x", T0), (2, "ok", T0 + dt.timedelta(1))], "id int, action string, created_at timestamp")
    sinks.export_audit(ev, str(tmp_path / "csv"), "csv", 5)
    assert "'=x" in {r.action for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    sinks.export_audit(ev, str(tmp_path / "json"), "json", 1)
    assert [r.id for r in spark.read.json(str(tmp_path / "json")).collect()] == [2]
    sinks.write_reports(spark.createDataFrame([("r1", "# a\nb")], "report_id string, body string"), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first().value.startswith("# a\nb")


def parts(spark, tmp_path, rows, schema):
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streams(spark, tmp_path):
    schema = "k string, at timestamp, v int"
    rows = [("a", T0, 1), ("a", T0 + dt.timedelta(hours=1), 2), ("b", T0, 3)]
    stream = parts(spark, tmp_path, rows, schema)
    jobs.append_stream(stream, str(tmp_path / "t1"), str(tmp_path / "c1"), ["k"]).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t1")).collect()) == ["a", "b"]
    jobs.upsert_stream(stream, str(tmp_path / "t2"), str(tmp_path / "c2"), ["k"], "at", "v").awaitTermination()
    assert {(r.k, r.v) for r in buckets.newest(spark, str(tmp_path / "t2")).collect()} == {("a", 2), ("b", 3)}
    q = jobs.dedup_commits(stream, ["k"], "at").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def files(root):
    return {p.name: p.parent.name for p in root.rglob("rows/**/*.parquet")}


def test_an_upsert_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    root = tmp_path / "t"
    frame = lambda rows: spark.createDataFrame(rows, "k long, at timestamp, v int, m map<string,int>")
    rows = [(k, T0, k, {"a": k}) for k in range(200)] + [(None, T0, -1, None), (3, T0 - dt.timedelta(1), 0, None)]
    assert len(buckets.upsert(str(root), frame(rows), ["k"], "at", "v", 0, 8)) == 8
    before = files(root)
    changed = buckets.upsert(str(root), frame([(7, T0 + dt.timedelta(1), 70, {"b": 1}), (7, None, 71, None)]), ["k"], "at", "v", 1, 8)
    after = files(root)
    new = {b for f, b in after.items() if f not in before}
    assert len(changed) == 1 and new == {f"bucket={changed[0]}"} and before.items() <= after.items()  # the last version stays for its readers
    got = {r.k: r.v for r in buckets.newest(spark, str(root)).collect()}
    assert len(got) == 201 and got[7] == 70 and got[3] == 3 and got[None] == -1
    assert buckets.upsert(str(root), frame([(7, T0 + dt.timedelta(9), 99, None)]), ["k"], "at", "v", 1, 8) == []  # a batch that is run again
    assert buckets.upsert(str(root), frame([]), ["k"], "at", "v", 2, 8) == []
    # The rows of version 0 that version 1 replaced go with version 2.
    buckets.upsert(str(root), frame([(8, T0 + dt.timedelta(1), 80, None)]), ["k"], "at", "v", 2, 8)
    left = files(root)
    assert {f for f, b in before.items() if b == f"bucket={changed[0]}"}.isdisjoint(left) and buckets.versions(spark, str(root)) == [1, 2]


def test_a_failed_upsert_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k string, at timestamp, v int")
    buckets.upsert(root, frame([("a", T0, 1)]), ["k"], "at", "v", 0, 4)
    frame([("a", T0, 9)]).write.parquet(f"{root}/rows/v=1/bucket=0")  # rows, but no manifest
    (tmp_path / "t" / "manifest" / "v=1").mkdir()
    assert [r.v for r in buckets.newest(spark, root).collect()] == [1]
    buckets.upsert(root, frame([("a", T0 + dt.timedelta(1), 2)]), ["k"], "at", "v", 1, 4)
    assert [r.v for r in buckets.newest(spark, root).collect()] == [2]
