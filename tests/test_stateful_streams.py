"""Streams with state: any cut into batches and any order of arrival give what the batch operators give."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tracewright.operators import governance
from tracewright.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user string, ts timestamp, id long, fp string, res string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Runs:
    """A stream over a folder that is fed and run again and again from one checkpoint."""

    def __init__(self, spark, tmp_path, build):
        self.spark, self.dir = spark, str(tmp_path)
        spark.createDataFrame([], SCHEMA).write.parquet(f"{self.dir}/in")
        self.stream = build(spark.readStream.schema(SCHEMA).parquet(f"{self.dir}/in"))

    def feed(self, rows, once=False):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.dir}/in")
        stateful.append_to(self.stream, f"{self.dir}/out", f"{self.dir}/checkpoint", once)
        return self.rows()

    def rows(self):
        return self.spark.read.parquet(f"{self.dir}/out").collect()


def events(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("abc"), at(rng.randrange(0, 3000) / 2), i, rng.choice("fg"), f"r{i}") for i in range(n)]


def late(rows, seed, parts=3):
    """rows in batches by time, some of them one batch late, and a last row that lets the watermark pass all others."""
    rng, rows = random.Random(seed), sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // parts)
    batches = [[] for _ in range(parts)]
    for i, r in enumerate(rows):
        batches[min(parts - 1, i // size + (rng.random() < 0.2))].append(r)
    for b in batches:
        rng.shuffle(b)
    batches[-1].append(("end", at(100_000), -1, "f", "r"))
    return batches


def test_admission_equals_batch_with_late_rows(spark, tmp_path):
    rows = events(150, 1)
    run = Runs(spark, tmp_path, lambda s: stateful.admit_stream(s, ["user"], "ts", "id", 2, 60.0, "900 seconds"))
    seen = [len(run.feed(b)) for b in late(rows, 1)]
    want = governance.admit(spark.createDataFrame(rows, SCHEMA), "user", "ts", "id", 2, 60.0)
    assert {(r.user, r.id, r.admitted) for r in run.rows()} == {(r.user, r.id, r.admitted) for r in want.collect()}
    assert seen[-1] == 150 and 0 < seen[1] < 150  # results left the stream on the way


def test_first_writes_equal_batch_with_late_rows(spark, tmp_path):
    rows = events(120, 2)
    run = Runs(spark, tmp_path, lambda s: stateful.first_writes(s, ["user"], "ts", "id", "fp", "res", "900 seconds"))
    for b in late(rows, 2):
        run.feed(b)
    got = {}
    for r in run.rows():
        got.setdefault(r.user, []).append((r.id, r.resource, r.outcome))
    want = governance.idempotent_writes(spark.createDataFrame(rows, SCHEMA), ["user"], ["ts", "id"], "fp", "res").collect()
    assert len(got) == len(want) == 3
    for r in want:
        outcomes = [o for _, _, o in got[r.user]]
        assert {x for _, x, _ in got[r.user]} == {r.first_res}
        assert (outcomes.count("created"), outcomes.count("replayed"), outcomes.count("conflict")) == (1, r.n_replays, r.n_conflicts)


def test_idle_keys_are_forgotten(spark, tmp_path):
    build = lambda s: stateful.first_writes(s, ["user"], "ts", "id", "fp", "res", "0 seconds", retention_seconds=100)
    run = Runs(spark, tmp_path, build)
    run.feed([("a", at(0), 1, "f", "r1"), ("a", at(90), 2, "g", "r2"), ("x", at(150), 3, "f", "r3")])
    run.feed([("a", at(180), 4, "f", "r4"), ("y", at(500), 5, "f", "r5")])  # 90 seconds after the last use
    got = {r.id: (r.resource, r.outcome) for r in run.feed([("a", at(600), 6, "g", "r6"), ("y", at(2000), 7, "f", "r7")])}
    assert got[1] == ("r1", "created") and got[2] == ("r1", "conflict") and got[4] == ("r1", "replayed") and got[6] == ("r6", "created")


def test_too_late_rows_and_rows_without_key_or_time_are_left_out(spark, tmp_path):
    run = Runs(spark, tmp_path, lambda s: stateful.admit_stream(s, ["user"], "ts", "id", 1, 60.0, "10 seconds"))
    run.feed([("a", at(0), 1, "", ""), ("b", at(1000), 2, "", ""), (None, at(5), 8, "", ""), ("a", None, 9, "", "")])
    got = run.feed([("a", at(5), 3, "", ""), ("a", at(995), 4, "", ""), ("b", at(5000), 5, "", "")])
    assert {(r.id, r.admitted) for r in got} == {(1, True), (2, True), (4, True)}


def test_arrival_order(spark, tmp_path):
    run = Runs(spark, tmp_path, lambda s: stateful.first_writes(s, ["user"], "ts", "id", "fp", "res", None))
    run.feed([("a", at(50), 1, "f", "r1")])
    got = {r.id: (r.resource, r.outcome) for r in run.feed([("a", at(0), 2, "f", "r2"), ("b", at(0), 3, None, None)])}
    assert got == {1: ("r1", "created"), 2: ("r1", "replayed"), 3: ("", "created")}


def test_arrivals_expire(spark, tmp_path):
    import time

    run = Runs(spark, tmp_path, lambda s: stateful.first_writes(s, ["user"], "ts", "id", "fp", "res", None, retention_seconds=1))
    run.feed([("a", at(0), 1, "f", "r1")], once=True)
    time.sleep(2)
    assert {r.id: r.outcome for r in run.feed([("a", at(0), 2, "g", "r2")], once=True)}[2] == "created"
