"""Run-log monitoring with Structured Streaming: live counts, latest state, progress, stale workers, capped choice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.sinks import append_new

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def live_counts(events: DataFrame, state: str, final: list[str], window: str | None = None, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows by state (and tumbling window, if asked for), and whether the state is final. For update mode."""
    if window:
        events = events.withWatermark(ts, late).groupBy(F.window(ts, window), state).agg(F.count("*").alias("n"))
    else:
        events = events.groupBy(state).agg(F.count("*").alias("n"))
    return events.withColumn("terminal", F.col(state).isin(*final))


def activity(events: DataFrame, job: str, seconds: str, budget: float) -> DataFrame:
    """Active seconds of each job and whether they are over a budget. For update mode."""
    return events.groupBy(job).agg(F.sum(seconds).alias("active")).withColumn("over_budget", F.col("active") > budget)


def stale_jobs(events: DataFrame, job: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of each job that ended because nothing came for longer than the gap: (job, start, end, n). For append mode."""
    s = events.withWatermark(ts, late).groupBy(job, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return s.select(job, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class LatestState(StatefulProcessor):
    """Latest row of each job by (ts, event_id), and how many rows it has had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("latest", "ts timestamp, event_id long, event_type string, attempts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ts, event_id, kind, n = self.held.get() if self.held.exists() else (None, -1, None, 0)
        for part in rows:
            n += len(part)
            last = part.sort_values(["ts", "event_id"]).iloc[-1]
            if ts is None or (last["ts"], last["event_id"]) > (pd.Timestamp(ts), event_id):
                ts, event_id, kind = last["ts"].to_pydatetime(), int(last["event_id"]), last["event_type"]
        self.held.update((ts, event_id, kind, n))
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [event_id], "event_type": [kind], "attempts": [n]})

    def close(self) -> None:
        pass


class Progress(StatefulProcessor):
    """Steps done, and the rest of `total` times the mean of the last five steps. Rows of a key come in order of batches;
    inside a batch they are sorted."""

    def __init__(self, total: int, k: int = 5):
        self.total, self.k = total, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "n long")
        self.recent = handle.getListState("recent", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        n = (self.done.get()[0] if self.done.exists() else 0) + len(part)
        last = ([x[0] for x in self.recent.get()] + part["value"].tolist())[-self.k :]
        self.done.update((n,))
        self.recent.put([(float(x),) for x in last])
        yield pd.DataFrame({"user_id": [key[0]], "done": [n], "remaining": [max(0, self.total - n) * sum(last) / len(last)]})

    def close(self) -> None:
        pass


class CappedChoice(StatefulProcessor):
    """Takes a row unless its choice (event_type) was taken `cap` times or among the last four of its key."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "choice string", "n long")
        self.last = handle.getListState("last", "choice string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last = [x[0] for x in self.last.get()]
        out = []
        for event_id, choice in zip(part["event_id"].tolist(), part["event_type"].tolist()):
            n = self.used.getValue((choice,))[0] if self.used.containsKey((choice,)) else 0
            if n < self.cap and choice not in last:
                self.used.updateValue((choice,), (n + 1,))
                last = [*last, choice][-4:]
                out.append((key[0], event_id, choice))
        if last:
            self.last.put([(x,) for x in last])
        yield pd.DataFrame(out, columns=["user_id", "event_id", "choice"])

    def close(self) -> None:
        pass


def latest_states(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").transformWithStateInPandas(LatestState(), "user_id long, event_id long, event_type string, attempts long", "Update", "None")


def progress(events: DataFrame, total: int) -> DataFrame:
    return events.groupBy("user_id").transformWithStateInPandas(Progress(total), "user_id long, done long, remaining double", "Update", "None")


def capped_choice(events: DataFrame, cap: int) -> DataFrame:
    return events.groupBy("user_id").transformWithStateInPandas(CappedChoice(cap), "user_id long, event_id long, choice string", "Append", "None")


def append_once(stream: DataFrame, path: str, keys: list[str], checkpoint: str, by: str | None = None):
    """Writer that appends each row once by its keys, also when a batch is repeated or the stream starts anew. by: a column,
    such as the day, by which the sink is partitioned and read."""
    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, keys, by)).option("checkpointLocation", checkpoint)
