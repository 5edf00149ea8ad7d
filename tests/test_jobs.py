"""Jobs as a stream: stopped and started again, moves checked, silent jobs failed."""

import datetime

import pytest
from pyspark.sql import Row

from corpusloom.steps import shared_dir
from corpusloom.streaming import ingest, jobs

START = datetime.datetime(2024, 1, 1)
SCHEMA = "job long, at timestamp, phase string, total long"


def arrive(spark, folder, rows):
    made = [(job, START + datetime.timedelta(minutes=m), phase, total) for job, m, phase, total in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, **options):
    stream = ingest.read_events(spark, f"{folder}/in", SCHEMA, files=1)
    ingest.run_once(jobs.follow(stream, **options), f"{folder}/out", f"{folder}/checkpoint")
    return [tuple(r) for r in spark.read.schema(jobs.OUT).parquet(f"{folder}/out").collect()]


def ticks(n):
    width = max(1, -(-n // 50))
    return [(k, min((k + 1) * width, n)) for k in range(-(-n // width))]


def test_ticks_go_on_after_a_restart(spark):
    folder = shared_dir(spark)
    arrive(spark, folder, [(1, k, None, None) for k in range(60)] + [(None, 0, "queued", 3)])  # steps before the total
    first = run(spark, folder)
    assert [r for r in first if r[1] == "tick"] == []
    arrive(spark, folder, [(1, 60 + k, None, None) for k in range(67)] + [(1, 0, "queued", 127), (2, 0, "queued", 2), (2, 1, None, None)])
    arrive(spark, folder, [(None, k, None, None) for k in range(5)])
    out = run(spark, folder)
    told = lambda job: sorted((r[3], r[4]) for r in out if r[0] == job and r[1] == "tick")
    assert told(1) == ticks(127) and told(2) == [(0, 1)] and told(None) == ticks(3)
    assert run(spark, folder) == out or sorted(map(str, run(spark, folder))) == sorted(map(str, out))  # nothing new, nothing twice


def test_moves(spark):
    folder = shared_dir(spark)
    arrive(spark, folder, [(1, 0, "queued", None), (1, 1, "parsing", None), (1, 2, "queued", None), (1, 3, "indexing", 0), (1, 4, "other", None), (1, 5, "completed", None), (1, 6, "failed", None), (2, 0, "indexing", None), (2, 1, "failed", None)])
    out = [(r[0], r[1], r[2]) for r in run(spark, folder)]
    assert sorted(out) == sorted(
        [(1, "phase", p) for p in ("queued", "parsing", "indexing", "completed")] + [(1, "refused", p) for p in ("queued", "other", "failed")] + [(2, "refused", "indexing"), (2, "phase", "failed")]
    )


def test_silent_jobs_fail(spark):
    folder = shared_dir(spark)
    arrive(spark, folder, [(1, 0, "queued", 5), (1, 1, None, None), (2, 0, "queued", 1)])
    run(spark, folder, stale_seconds=3600)
    for m in (100, 300, 500):
        arrive(spark, folder, [(3, m, None, None)])
        out = run(spark, folder, stale_seconds=3600)
    stale = sorted((r[0], r[4]) for r in out if r[1] == "stale")
    assert [s for s in stale if s[0] != 3] == [(1, 1), (2, 0)]


@pytest.mark.parametrize("n", [1, 49, 50, 51, 100, 101, 5000])
def test_about_fifty(n):
    assert len(ticks(n)) <= 50 and ticks(n)[-1][1] == n


def test_a_job_costs_two_calls_of_its_state():
    """Rows come and go as they are: no frame is built for a job, and its state is read and written once a batch."""
    calls, kept = [], {}

    class State:
        def get(self):
            calls.append("get")
            return kept.get("job")

        def update(self, value):
            calls.append("update")
            kept["job"] = value

    made = jobs.Jobs(None)
    made.state = State()
    step, begun = Row(ms=1, phase=None, total=None), Row(ms=0, phase="queued", total=3)
    first = list(made.handleInputRows((7,), iter([step, begun, step]), None))
    assert [(r.job, r.kind, r.phase, r.tick, r.processed, r.total) for r in first] == [(7, "phase", "queued", None, 2, 3), (7, "tick", None, 0, 1, 3), (7, "tick", None, 1, 2, 3)]
    assert [r.tick for r in made.handleInputRows((7,), iter([step]), None)] == [2]
    assert calls == ["get", "update"] * 2 and kept["job"] == (0, 3, 3, 3)
