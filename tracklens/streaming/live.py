"""Structured Streaming forms: windows with watermarks, sessions, live gaps, job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def tumbling(events: DataFrame, time: str, key: list[str], width: str, late: str) -> DataFrame:
    """Counts and sums of `value` in fixed windows; rows later than the watermark are dropped."""
    w = F.window(time, width)
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), *key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *key, "n", "total")


def sliding(events: DataFrame, time: str, key: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Counts and sums of `value` in overlapping windows. On a stream a window is shown once the watermark has passed its end,
    and a row counts only in those of its windows that had not been passed when it came.
    """
    marked = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide)
    return marked.groupBy(w.alias("w"), *key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after a gap."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class GapState(StatefulProcessor):
    """Keeps the last time of each key and reports steps longer than the limit. Rows of a batch are sorted first."""

    def __init__(self, longer_than_s: float = 5.0):
        self.limit = longer_than_s

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "t timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat([r["t"] for r in rows]).sort_values(kind="stable")
        if self.last.exists():
            t = pd.concat([pd.Series([pd.Timestamp(self.last.get()[0])]), t])
        t = t.reset_index(drop=True)
        dt = (t.shift(-1) - t).dt.total_seconds()
        at = dt > self.limit
        self.last.update((t.max().to_pydatetime(),))
        yield pd.DataFrame({"key": pd.Series([key[0]] * int(at.sum()), index=t.index[at], dtype=object), "start": t[at], "end": t.shift(-1)[at], "duration_s": dt[at]})

    def close(self) -> None:
        return


def live_gaps(stream: DataFrame, key: str, time: str, longer_than_s: float = 5.0) -> DataFrame:
    """key, start, end, duration_s, as rows arrive."""
    return stream.select(F.col(key).cast("string").alias("key"), F.col(time).alias("t")).groupBy("key").transformWithStateInPandas(statefulProcessor=GapState(longer_than_s), outputStructType="key string, start timestamp, end timestamp, duration_s double", outputMode="Append", timeMode="None")


def job_states(log: DataFrame) -> DataFrame:
    """The latest status of each job of a stream of (job, seq, status), for complete-mode sinks."""
    return log.groupBy("job").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
