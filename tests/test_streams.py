"""Streams run over files in several micro-batches, against procedural models."""

import random
from datetime import datetime, timedelta

from tracklens.scratch import Scratch
from tracklens.streaming import live, ordered, runs

T0 = datetime(2024, 1, 1)


def appended(spark, scratch, rows, schema, operator):
    """One availableNow run over a new file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(scratch.path("in"))
    stream = spark.readStream.schema(schema).parquet(scratch.path("in"))
    return runs.available(operator(stream), scratch.path("out"), scratch.path("checkpoint"))


def test_blocks_gap_duplicates_and_timer(spark):
    scratch = Scratch(spark, "blocks")
    schema = "job string, seq long, line string, t timestamp"
    at = lambda job, seq, line, s: (job, seq, line, T0 + timedelta(seconds=s))
    go = lambda rows: appended(spark, scratch, rows, schema, lambda x: ordered.stream_blocks(x, "10 seconds", 60_000))
    # a: early, repeated and split lines; b: line 1 never comes, the last block never closes
    go([at("a", 2, "progress=continue", 1), at("a", 0, "fps=1", 0), at("a", 3, "fps= 2", 2), at("b", 0, "x=1", 0), at("b", 2, "progress=continue", 3), at("b", 3, "fps=9", 4)])
    assert spark.read.parquet(scratch.path("out")).count() == 0
    go([at("a", 1, "noise", 5), at("a", 0, "fps=7", 5), at("a", 4, "speed=2x=3", 6)])
    assert [(r.job, r.block, r.kv) for r in spark.read.parquet(scratch.path("out")).collect()] == [("a", 0, {"fps": "1", "progress": "continue"})]
    go([at("a", 5, "progress=end", 200), at("c", 0, "y=1", 200)])
    go([at("c", 1, "progress=end", 201)])
    got = sorted((r.job, r.block, tuple(sorted(r.kv.items())), r.seq, r.closed) for r in spark.read.schema(ordered.BLOCK).parquet(scratch.path("out")).collect())
    assert got == [
        ("a", 0, (("fps", "1"), ("progress", "continue")), 2, True),
        ("a", 1, (("fps", " 2"), ("progress", "end"), ("speed", "2x=3")), 5, True),
        ("b", 0, (("progress", "continue"), ("x", "1")), 2, True),
        ("b", 1, (("fps", "9"),), 3, False),
        ("c", 0, (("progress", "end"), ("y", "1")), 1, True),
    ]


def model(events):
    """History and final states of one queue, step by step."""
    status, progress, waiting, running, out = {}, {}, [], None, []
    for seq, action, job, value in events:
        job = running if action in ("progress", "done", "error") else None if action == "start" else job
        was = status.get(job)
        now = None
        if job is not None and action == "submit" and was is None:
            now = "queued"
            waiting.append(job)
        elif action == "cancel" and was in ("queued", "running"):
            now = "cancelled" if was == "queued" else "cancelling"
        elif action in ("progress", "done", "error") and job is not None:
            now = "cancelled" if was == "cancelling" else "running" if action == "progress" else action
        if now is None:
            out.append((seq, 0, job, was, False))
            continue
        status[job] = now
        progress[job] = 0.0 if now == "queued" else 1.0 if now == "done" else min(1.0, max(0.0, value)) if (action, now) == ("progress", "running") else progress[job]
        out.append((seq, 0, job, now, True))
        if job == running and now in ("done", "error", "cancelled"):
            running = None
        if running is None:
            while waiting and status[waiting[0]] != "queued":
                waiting.pop(0)
            if waiting:
                running = waiting.pop(0)
                status[running] = "running"
                out.append((seq, 1, running, "running", True))
    return out, status, progress


def test_jobs_equal_a_procedural_model(spark):
    rng = random.Random(8)
    events = {}
    for queue in ("p", "q", "r"):
        events[queue] = [(n, rng.choice(["submit", "submit", "progress", "done", "error", "cancel", "start", "bogus"]), str(rng.randrange(30)), rng.uniform(-0.5, 1.5)) for n in range(120)]
    rows = [(q, *e, "why" if e[1] == "error" else None) for q, es in events.items() for e in es]
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "queue string, seq long, action string, job string, value double, error string")
    history = runs.replayed(df, ordered.stream_jobs, n_files=6, files_a_batch=2)
    plans = spark.createDataFrame([("3", "in", "out")], "id string, input string, output string")
    shown = {(r.queue, r.id): r for r in ordered.public_jobs(history, plans).collect()}
    got = history.collect()
    for q, es in events.items():
        want, status, progress = model(es)
        assert sorted((r.seq, r.step, r.job, r.status, r.ok) for r in got if r.queue == q) == sorted(want)
        for job, s in status.items():
            r = shown[q, job]
            assert (r.status, r.progress) == ("running" if s == "cancelling" else s, progress[job]) and (r.error == "why") == (s == "error") and (r.input == "in") == (job == "3")
    assert {r.queue for r in got} == set(events) and len(shown) == sum(len(model(es)[1]) for es in events.values())


def test_sliding_counts_late_rows(spark):
    scratch = Scratch(spark, "late")
    schema = "ts timestamp, value double"
    go = lambda rows: appended(spark, scratch, [(T0 + timedelta(minutes=m), 1.0) for m in rows], schema, lambda x: live.sliding(x, "ts", [], "30 minutes", "10 minutes", "5 minutes"))
    go([1, 12, 44])
    last = go([2, 38, 120])
    dropped = sum(o.numRowsDroppedByWatermark for p in last.recentProgress for o in p.stateOperators)
    got = {(r.start - T0).total_seconds() / 60: r.n for r in spark.read.parquet(scratch.path("out")).collect()}
    # the watermark stands at 39: windows up to 30 are closed when minute 2 comes again, so its third row is late in all
    assert got == {-20: 1, -10: 2, 0: 2, 10: 2, 20: 2, 30: 2, 40: 1} and dropped > 0


def test_follow_runs_by_trigger_and_restores_the_session(spark):
    import time

    scratch = Scratch(spark, "follow")
    spark.createDataFrame([("q", 0, "submit", "j", None, None)], "queue string, seq long, action string, job string, value double, error string").write.parquet(scratch.path("in"))
    stream = spark.readStream.schema("queue string, seq long, action string, job string, value double, error string").parquet(scratch.path("in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    query = runs.follow(ordered.stream_jobs(stream), scratch.path("out"), scratch.path("checkpoint"))
    try:
        for _ in range(60):
            if query.lastProgress and query.lastProgress.numInputRows == 0 or len(query.recentProgress) > 1:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert [r.status for r in spark.read.parquet(scratch.path("out")).orderBy("step").collect()] == ["queued", "running"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_state_is_read_and_written_once_a_call():
    """Calls to states are messages to the JVM: their number follows calls of a key, not its rows, until a queue is long."""
    from pyspark.sql import Row

    calls = []

    class State(dict):
        def get(self):
            calls.append("get")
            return dict.get(self, ())

        def update(self, v):
            calls.append("update")
            self[()] = v

        def getValue(self, k):
            calls.append("getValue")
            return dict.get(self, k)

        def updateValue(self, k, v):
            calls.append("updateValue")
            self[k] = v

        def removeKey(self, k):
            calls.append("removeKey")
            del self[k]

    class Handle:
        def getValueState(self, *_):
            return State()

        getMapState = getValueState

        def registerTimer(self, _):
            calls.append("timer")

    def run(processor, key, rows, batches=4):
        processor.init(Handle())
        step = -(-len(rows) // batches)
        return [x for k in range(batches) for x in processor.handleInputRows((key,), iter(rows[k * step : k * step + step]), None)]

    rng = random.Random(5)
    rows = [Row(seq=n, k="progress" if n % 5 == 4 else f"a{n % 5}", v=str(n), ms=n) for n in range(500)]
    blocks = run(ordered.Blocks(1000), "j", rng.sample(rows, 500))
    assert [b.block for b in blocks] == list(range(100)) and len(calls) == 9
    for n, bound in ((200, 8), (3000, 12_000)):
        calls.clear()
        events = [(k, rng.choice(["submit", "submit", "submit", "progress", "done", "error", "cancel"]), str(rng.randrange(k + 1)), rng.random()) for k in range(n)]
        got = run(ordered.Jobs(), "q", [Row(seq=k, action=a, job=j, value=v, error=None) for k, a, j, v in rng.sample(events, n)])
        assert [(r.seq, r.step, r.job, r.status, r.ok) for r in got] == model(events)[0] and len(calls) <= bound
