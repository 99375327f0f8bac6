"""Many keys share a bucket's state: each has its own first write and window, also while later rows of others wait."""

from __future__ import annotations

from tests.test_stateful_streams import Runs, at, few_partitions  # noqa: F401
from tracewright.streaming import stateful


def test_keys_of_one_bucket_do_not_mix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    build = lambda s: stateful.first_writes(s, ["user"], "ts", "id", "fp", "res", "10 seconds", retention_seconds=300)
    run = Runs(spark, tmp_path, build)
    run.feed([(f"u{i}", at(i), i, f"f{i % 2}", f"r{i}") for i in range(100)])
    run.feed([(f"u{i}", at(100 + i), 100 + i, f"f{i % 3}", f"x{i}") for i in range(100)])
    got = {r.id: (r.user, r.resource, r.outcome) for r in run.feed([("u3", at(900), 999, "g", "y"), ("end", at(5000), -1, "", "")])}
    for i in range(100):
        assert got[i] == (f"u{i}", f"r{i}", "created")
        assert got[100 + i] == (f"u{i}", f"r{i}", "replayed" if f"f{i % 2}" == f"f{i % 3}" else "conflict")
    assert got[999] == ("u3", "y", "created")  # idle for longer than 300 seconds
