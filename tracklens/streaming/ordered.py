"""Stateful stream operators over numbered rows: progress blocks and the life cycle of queued jobs.

Both take rows of a key in the order of their gapless numbers `seq` (from 0), however micro-batches cut or mix them: what comes
early is held in the key's state until what is missing has come, what comes twice is dropped. A key is a job's output or a queue,
hence one machine's writer; its held rows are those of its own gap.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.progress import pairs


class InOrder(StatefulProcessor):
    """Rows of a key by number. `fields` names and types what a row has besides key and seq.

    Each row of a state is a message to the JVM, far dearer than a row of input. So what a key holds is one value, read once
    and written once a call, and rows are worked on in Python between. `plain` names and types what a processor keeps there
    besides the next number and the rows that came early.
    """

    fields = ""
    plain = ""

    def init(self, handle) -> None:
        self.handle = handle
        held = ", ".join(f.replace(" ", ":") for f in ("seq long, " + self.fields).split(", "))
        self.small = handle.getValueState("small", f"next long, held array<struct<{held}>>, " + self.plain.replace(";", ","))
        self.n_plain = self.plain.count(";") + 1
        self.names = [f.split()[0] for f in self.fields.split(", ")]

    def load(self) -> None:
        """next, held and the plain values of the key whose turn it is; nulls if it is new."""
        got = self.small.get()
        self.at, self.held, *self.own = got if got is not None else (0, [], *[None] * self.n_plain)

    def save(self) -> None:
        self.small.update((self.at, self.held, *self.own))

    def due(self, rows: Iterator[Row], skip_gap: bool = False) -> list[tuple]:
        """(seq, *fields) of all rows whose turn it is, held ones too."""
        at = self.at
        waiting = {h[0]: tuple(h) for h in self.held}
        for r in rows:
            if r.seq >= at:
                waiting.setdefault(r.seq, (r.seq, *(r[n] for n in self.names)))
        if skip_gap and waiting:
            at = min(waiting)
        out = []
        while at in waiting:
            out.append(waiting.pop(at))
            at += 1
        self.at, self.held = at, [waiting[k] for k in sorted(waiting)]
        return out

    def close(self) -> None:
        return


BLOCK = "job string, block long, kv map<string,string>, seq long, closed boolean"


class Blocks(InOrder):
    """Assembles `key=value` lines to blocks. A timer shows what is left of a job that says nothing for `idle_ms` of the
    stream's time: lines behind a gap that never filled, then a block that never closed (closed = false).

    A key has one timer. One that rings while the job has spoken since is set anew, to `idle_ms` behind its last word.
    """

    fields = "k string, v string"
    plain = "block long; latest long; timer long; open map<string,string>"

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def _take(self, job: str, lines: list[tuple]) -> Iterator[Row]:
        n, latest, timer, kv = self.own
        n, kv = n or 0, dict(kv or {})
        for seq, k, v in lines:
            if k is None:
                continue
            kv[k] = v
            if k == "progress":
                yield Row(job=job, block=n, kv=kv, seq=seq, closed=True)
                n, kv = n + 1, {}
        self.own = [n, latest, timer, kv]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.load()
        latest = self.own[1] or 0

        def timed() -> Iterator[Row]:
            nonlocal latest
            for r in rows:
                latest = max(latest, r.ms)
                yield r

        yield from self._take(key[0], self.due(timed()))
        self.own[1] = latest
        if self.own[2] is None:
            self.own[2] = latest + self.idle_ms
            self.handle.registerTimer(self.own[2])
        self.save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.load()
        self.own[2] = None
        if self.own[1] + self.idle_ms > timerValues.getCurrentWatermarkInMs():
            self.own[2] = self.own[1] + self.idle_ms
            self.handle.registerTimer(self.own[2])
            self.save()
            return
        while self.held:
            yield from self._take(key[0], self.due(iter(()), skip_gap=True))
        n, latest, timer, kv = self.own
        if kv:
            yield Row(job=key[0], block=n or 0, kv=dict(kv), seq=self.at - 1, closed=False)
        self.own = [n, latest, timer, {}]
        self.save()


def stream_blocks(lines: DataFrame, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """job, block, kv, seq, closed of a stream of job, seq, line, t. Blocks with closed are those of progress.blocks().

    Lines that come later than `late` behind the stream's time are dropped, as with any watermark; their gap ends by the timer.
    """
    keyed = pairs(lines, "t").select(F.col("job").cast("string").alias("job"), F.col("seq").cast("long").alias("seq"), "k", "v", "t", F.unix_millis("t").alias("ms"))
    return keyed.withWatermark("t", late).groupBy("job").transformWithState(statefulProcessor=Blocks(idle_ms), outputStructType=BLOCK, outputMode="Append", timeMode="EventTime")


#: What an action makes of a job's status. What is not listed is refused and changes nothing.
TRANSITIONS = {
    (None, "submit"): "queued",
    ("queued", "start"): "running",
    ("queued", "cancel"): "cancelled",
    ("running", "progress"): "running",
    ("running", "cancel"): "cancelling",
    ("running", "done"): "done",
    ("running", "error"): "error",
    ("cancelling", "progress"): "cancelled",
    ("cancelling", "done"): "cancelled",
    ("cancelling", "error"): "cancelled",
}
HISTORY = "queue string, seq long, step int, job string, action string, was string, status string, ok boolean, progress double, error string"


class Jobs(InOrder):
    """A queue of one worker: first in, first out by submission. progress, done and error tell of the running job and name
    none; cancel names its job and takes effect on a running one at its next word.
    """

    fields = "action string, job string, value double, error string"
    plain = "head long; tail long; running string; n_stored long; front array<string>; recent map<string,struct<status:string,progress:double>>"
    #: Jobs, and places of the queue's front, that are kept in the key's value; more of them are rows of map states.
    RECENT = 256

    def init(self, handle) -> None:
        super().init(handle)
        self.jobs = handle.getMapState("jobs", "job string", "status string, progress double")
        self.waiting = handle.getMapState("waiting", "place long", "job string")

    def _known(self, job: str) -> tuple | None:
        """A job's status and progress, asked of the map state once a call at most."""
        if job not in self.recent and job not in self.asked:
            self.asked[job] = self.jobs.getValue((job,)) if self.n_stored else None
        return self.recent[job] if job in self.recent else self.asked[job]

    def _move(self, queue: str, seq: int, step: int, job: str | None, action: str, value: float | None, error: str | None) -> Row:
        known = self._known(job) if job is not None else None
        was, progress = (known[0], known[1]) if known else (None, None)
        to = TRANSITIONS.get((was, action)) if job is not None else None
        if to is None:
            return Row(queue=queue, seq=seq, step=step, job=job, action=action, was=was, status=was, ok=False, progress=progress, error=None)
        if to in ("queued", "done"):
            progress = float(to == "done")
        elif action == "progress" and to == "running" and value is not None:
            progress = min(1.0, max(0.0, value))
        self.recent[job] = (to, progress)
        return Row(queue=queue, seq=seq, step=step, job=job, action=action, was=was, status=to, ok=True, progress=progress, error=error if to == "error" else None)

    def _next(self, queue: str, seq: int, step: int) -> Iterator[Row]:
        """Starts the first waiting job that was not cancelled."""
        while self.running is None and (self.front or self.head < self.tail):
            if not self.front:  # the next places come from the map state
                end = min(self.tail, self.head + self.RECENT)
                for place in range(self.head, end):
                    self.front.append(self.waiting.getValue((place,))[0])
                    self.waiting.removeKey((place,))
                self.head = end
            job = self.front.popleft()
            if self._known(job)[0] == "queued":
                self.running = job
                yield self._move(queue, seq, step, job, "start", None, None)

    def _wait(self, job: str) -> None:
        if self.head == self.tail and len(self.front) < self.RECENT:
            self.front.append(job)
        else:
            self.waiting.updateValue((self.tail,), (job,))
            self.tail += 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.load()
        head, tail, self.running, n_stored, front, recent = self.own
        self.head, self.tail, self.n_stored = head or 0, tail or 0, n_stored or 0
        self.front, self.recent, self.asked = deque(front or []), {k: tuple(v) for k, v in (recent or {}).items()}, {}
        for seq, action, job, value, error in self.due(rows):
            if action in ("progress", "done", "error"):
                job = self.running
            elif action == "start":  # the queue's own
                job = None
            got = self._move(key[0], seq, 0, job, action, value, error)
            yield got
            if got.ok and action == "submit":
                self._wait(job)
            elif got.ok and got.status in ("done", "error", "cancelled") and action != "cancel":
                self.running = None
            yield from self._next(key[0], seq, 1)
        if len(self.recent) > self.RECENT:
            for job, known in self.recent.items():
                self.jobs.updateValue((job,), known)
            self.n_stored += len(self.recent)
            self.recent = {}
        self.own = [self.head, self.tail, self.running, self.n_stored, list(self.front), self.recent]
        self.save()


def stream_jobs(events: DataFrame) -> DataFrame:
    """HISTORY: each event's transition, or that it was refused, and the starts it led to. events: queue, seq, action, job, value, error."""
    own = events.select(F.col("queue").cast("string").alias("queue"), F.col("seq").cast("long").alias("seq"), "action", F.col("job").cast("string").alias("job"), F.col("value").cast("double").alias("value"), F.col("error").cast("string").alias("error"))
    return own.groupBy("queue").transformWithState(statefulProcessor=Jobs(), outputStructType=HISTORY, outputMode="Append", timeMode="None")


def public_jobs(history: DataFrame, plans: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """What is shown of a job: id, input, output, status, progress, fps, eta_s, error, in order of submission. A job that is
    being cancelled still shows as running. plans: id, input, output; estimates: job, fps, eta_s.
    """
    at = F.struct("seq", "step")
    last = history.where("ok").groupBy("queue", F.col("job").alias("id")).agg(F.max_by("status", at).alias("status"), F.max_by("progress", at).alias("progress"), F.max_by("error", at).alias("error"), F.min("seq").alias("submitted"))
    seen = last.join(plans.select("id", "input", "output"), "id", "left")
    if estimates is not None:
        seen = seen.join(estimates.select(F.col("job").alias("id"), "fps", "eta_s"), "id", "left")
    else:
        seen = seen.withColumns({"fps": F.lit(None).cast("double"), "eta_s": F.lit(None).cast("double")})
    eta = F.when(F.col("status") == "done", 0.0).when(F.col("status") == "cancelling", F.col("eta_s")).when(F.col("status") == "running", F.col("eta_s"))
    status = F.when(F.col("status") == "cancelling", "running").otherwise(F.col("status"))
    return seen.select("queue", "submitted", "id", "input", "output", status.alias("status"), "progress", F.when(F.col("status") != "done", F.col("fps")).alias("fps"), eta.alias("eta_s"), "error")
