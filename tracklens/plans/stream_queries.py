"""Queries that run real streams over rows of the given tables, cut into files and micro-batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import progress
from ..scratch import Scratch
from ..streaming import live, ordered, runs
from .queries import query, rnd, table


def progress_lines(s, d):
    """job, seq, line, t: what an encoder writes, four or five lines an event."""
    e = table(s, d, "events").select(F.col("user_id").alias("job"), "event_id", (F.col("event_id") % 3).alias("kind"), F.floor(F.col("value") * 1e6).cast("long").cast("string").alias("us"), F.col("ts").cast("timestamp").alias("t"))
    lines = F.array(F.when(F.col("kind") == 0, "fps=3.5"), F.when(F.col("kind") != 2, "speed= 1.5x"), F.lit("noise"), F.concat(F.when(F.col("kind") == 1, "out_time_ms=").otherwise("out_time_us="), "us"), F.lit("progress=continue"))
    flat = e.select("job", F.posexplode(lines).alias("k", "line"), "event_id", "t").where("line IS NOT NULL")
    return flat.select("job", (F.row_number().over(Window.partitionBy("job").orderBy("event_id", "k")) - 1).cast("long").alias("seq"), "line", "t")


@query("stream_progress", """WITH e AS (SELECT user_id AS job, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS block, event_id % 3 AS kind, CAST(floor(value * 1e6) AS BIGINT) AS us FROM events),
o AS (SELECT job, block, kind, us / 1e6 AS out FROM e)
SELECT CAST(job AS VARCHAR) AS job, CAST(block AS BIGINT) AS block, round(greatest(0e0, least(1e0, out / 300e0)) * 0.95e0, 6) + 0e0 AS progress, CASE WHEN kind = 0 THEN 3.5e0 END AS fps,
  round(CASE WHEN kind <> 2 THEN greatest(0e0, 300e0 - out) / 1.5e0 WHEN out > 0 THEN 60e0 * (greatest(0e0, 300e0 - out) / out) END, 4) + 0e0 AS eta_s FROM o""")
def _(s, d):
    """Lines of a block in different files and micro-batches, assembled in state, then estimated on the stream."""
    jobs = table(s, d, "events").select(F.col("user_id").cast("string").alias("job")).distinct().select("job", F.lit(300.0).alias("duration_s"), F.lit(60.0).alias("elapsed_s"))
    estimated = lambda lines: progress.estimates(ordered.stream_blocks(lines, "60 days").where("closed"), jobs, 0.0, 0.95)
    got = runs.replayed(progress_lines(s, d), estimated, name="progress")
    return got.select("job", "block", rnd("progress").alias("progress"), "fps", rnd("eta_s", 4).alias("eta_s"))


def job_events(s, d):
    """queue, seq, action, job, value, error: submissions, words of the worker, and cancellations of what came shortly before."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(s, d, "events").select("user_id", "event_id", "event_type", "value").withColumn("seq", n.cast("long"))
    kind = F.col("event_type")
    action = F.when(F.col("event_id") % 9 == 0, "cancel").when(kind.isin("signup", "click"), "submit").when(kind == "view", "progress").when(kind == "purchase", "done").otherwise("error")
    got = e.select(F.col("user_id").alias("queue"), "seq", action.alias("action"), "event_id", "value")
    job = F.when(F.col("action") == "submit", F.col("seq")).when(F.col("action") == "cancel", F.col("seq") - 1 - F.col("event_id") % 7)
    return got.select("queue", "seq", "action", job.cast("string").alias("job"), (F.col("value") / 500).alias("value"), F.when(F.col("action") == "error", "failed").alias("error"))


_ROW = "{'seq': x.seq, 'step': %s, 'job': %s, 'status': %s, 'ok': %s, 'progress': %s}"
#: A fold over each queue's events: running job, whether it is to be cancelled, its progress, waiting jobs, rows so far.
_FOLD = f"""WITH e AS (SELECT user_id AS queue, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, value / 500 AS value,
  CASE WHEN event_id % 9 = 0 THEN 'cancel' WHEN event_type IN ('signup', 'click') THEN 'submit' WHEN event_type = 'view' THEN 'progress' WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END AS act FROM events),
a AS (SELECT queue, list({{'seq': seq, 'act': act, 'job': CASE act WHEN 'submit' THEN seq WHEN 'cancel' THEN seq - 1 - event_id % 7 END, 'value': greatest(0e0, least(1e0, value))}} ORDER BY seq) AS events FROM e GROUP BY queue),
f AS (SELECT queue, list_reduce(events, lambda s, x: {{
  'run': CASE WHEN x.act = 'submit' AND s.run IS NULL THEN x.job WHEN s.run IS NOT NULL AND (x.act IN ('done', 'error') OR x.act = 'progress' AND s.wants) THEN s.q[1] ELSE s.run END,
  'wants': CASE WHEN s.run IS NULL OR x.act IN ('done', 'error') OR x.act = 'progress' AND s.wants THEN false WHEN x.act = 'cancel' AND x.job = s.run THEN true ELSE s.wants END,
  'prog': CASE WHEN s.run IS NULL OR x.act IN ('done', 'error') OR x.act = 'progress' AND s.wants THEN 0e0 WHEN x.act = 'progress' THEN x.value ELSE s.prog END,
  'q': CASE WHEN x.act = 'submit' AND s.run IS NOT NULL THEN list_append(s.q, x.job) WHEN s.run IS NOT NULL AND (x.act IN ('done', 'error') OR x.act = 'progress' AND s.wants) THEN s.q[2:] WHEN x.act = 'cancel' THEN list_filter(s.q, lambda j: j <> x.job) ELSE s.q END,
  'rows': s.rows || CASE
    WHEN x.act = 'submit' AND s.run IS NULL THEN [{_ROW % (0, 'x.job', "'queued'", 'true', '0e0')}, {_ROW % (1, 'x.job', "'running'", 'true', '0e0')}]
    WHEN x.act = 'submit' THEN [{_ROW % (0, 'x.job', "'queued'", 'true', '0e0')}]
    WHEN x.act = 'cancel' AND list_contains(s.q, x.job) THEN [{_ROW % (0, 'x.job', "'cancelled'", 'true', '0e0')}]
    WHEN x.act = 'cancel' AND x.job = s.run AND NOT s.wants THEN [{_ROW % (0, 'x.job', "'cancelling'", 'true', 's.prog')}]
    WHEN x.act = 'cancel' OR s.run IS NULL THEN [{_ROW % (0, "CASE WHEN x.act = 'cancel' THEN x.job END", 'NULL', 'false', 'NULL')}]
    WHEN x.act = 'progress' AND NOT s.wants THEN [{_ROW % (0, 's.run', "'running'", 'true', 'x.value')}]
    WHEN s.q[1] IS NULL THEN [{_ROW % (0, 's.run', "CASE WHEN s.wants THEN 'cancelled' ELSE x.act END", 'true', "CASE WHEN x.act = 'done' AND NOT s.wants THEN 1e0 ELSE s.prog END")}]
    ELSE [{_ROW % (0, 's.run', "CASE WHEN s.wants THEN 'cancelled' ELSE x.act END", 'true', "CASE WHEN x.act = 'done' AND NOT s.wants THEN 1e0 ELSE s.prog END")}, {_ROW % (1, 's.q[1]', "'running'", 'true', '0e0')}] END}},
  CAST({{'run': NULL, 'wants': false, 'prog': 0, 'q': [], 'rows': []}} AS STRUCT(run BIGINT, wants BOOLEAN, prog DOUBLE, q BIGINT[], rows STRUCT(seq BIGINT, step INTEGER, job BIGINT, status VARCHAR, ok BOOLEAN, progress DOUBLE)[]))).rows AS rows FROM a),
h AS (SELECT CAST(queue AS VARCHAR) AS queue, r.seq AS seq, r.step AS step, CAST(r.job AS VARCHAR) AS job, r.status AS status, r.ok AS ok, round(r.progress, 6) + 0e0 AS progress FROM (SELECT queue, unnest(rows) AS r FROM f))"""


def _history(s, d):
    return runs.replayed(job_events(s, d), ordered.stream_jobs, name="jobs")


@query("stream_job_history", f"{_FOLD} SELECT * FROM h")
def _(s, d):
    """Every transition of every job, and every refusal, from events that arrive out of order."""
    return _history(s, d).select("queue", "seq", "step", "job", F.when(F.col("ok"), F.col("status")).alias("status"), "ok", rnd(F.when(F.col("ok"), F.col("progress"))).alias("progress"))


@query("stream_jobs_public", f"""{_FOLD}, l AS (SELECT queue, job, min(seq) AS submitted, arg_max(status, seq * 2 + step) AS st, arg_max(progress, seq * 2 + step) AS progress FROM h WHERE ok GROUP BY queue, job)
SELECT queue, submitted, job AS id, CASE WHEN st = 'cancelling' THEN 'running' ELSE st END AS status, progress, CASE WHEN st = 'done' THEN 0e0 END AS eta_s, CASE WHEN st = 'error' THEN 'failed' END AS error FROM l""")
def _(s, d):
    """Jobs as shown, from the stream's history."""
    plans = table(s, d, "events").select(F.lit("none").alias("id"), F.lit("in").alias("input"), F.lit("out").alias("output")).limit(0)
    return ordered.public_jobs(_history(s, d), plans).select("queue", "submitted", "id", "status", "progress", "eta_s", "error")


_CUT = 1_705_276_800_000_000  # 2024-01-15


@query("stream_sliding_late", f"""WITH e AS (SELECT epoch_us(ts) AS t, event_type, value, event_id % 20 = 0 AND epoch_us(ts) < {_CUT} OR epoch_us(ts) >= {_CUT} AS second FROM events),
m AS (SELECT *, (SELECT max(t) FROM e WHERE NOT second) - 600000000 AS mark1, (SELECT max(t) FROM e) - 600000000 AS mark2 FROM e),
w AS (SELECT event_type, value, t // 900000000 * 900000000 - k * 900000000 AS start_us, second, mark1, mark2 FROM m, unnest(range(0, 4)) AS g(k)),
kept AS (SELECT * FROM w WHERE NOT (second AND start_us + 3600000000 <= mark1 // 1000 * 1000) AND start_us + 3600000000 <= mark2 // 1000 * 1000)
SELECT start_us, event_type, count(*) AS n, round(sum(value), 4) + 0e0 AS total FROM kept GROUP BY ALL""")
def _(s, d):
    """Hourly windows every quarter of an hour. A second run of the stream brings rows that the first one's watermark has passed."""
    scratch = Scratch(s, "sliding")
    e = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    late = (F.unix_micros("ts") >= _CUT) | (F.col("event_id") % 20 == 0)
    for part in (e.where(~late), e.where(late)):
        part.write.mode("append").parquet(scratch.path("in"))
        stream = s.readStream.schema(e.schema).parquet(scratch.path("in"))
        made = live.sliding(stream, "ts", ["event_type"], "1 hour", "15 minutes", "10 minutes")
        runs.available(made, scratch.path("out"), scratch.path("checkpoint"))
    got = s.read.parquet(scratch.path("out"))
    return got.select(F.unix_micros("start").alias("start_us"), "event_type", "n", rnd("total", 4).alias("total"))
