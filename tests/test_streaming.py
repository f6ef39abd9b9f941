"""Streams give what the batch operators give."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.operators import aggregates as A
from siftwell.operators import windows as W
from siftwell.streaming import runlog as R


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(1)
    start = pd.Timestamp("2024-01-01")
    rows = [(i, (start + pd.Timedelta(minutes=i * 3 + rng.randrange(3))).to_pydatetime(), i % 7, rng.choice(["view", "click", "error", "purchase"]), round(rng.random() * 100, 2), "{}") for i in range(600)]
    d = tmp_path_factory.mktemp("log")
    for k in range(3):
        spark.createDataFrame(rows[200 * k : 200 * k + 200], R.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(d))
    return str(d)


def run(spark, log, make, mode, tmp_path, name):
    stream = spark.readStream.schema(R.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(log)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def last(df, key, order):
    return {r[key]: r for r in sorted(df.collect(), key=lambda r: r[order])}


def test_live_counts(spark, log, tmp_path):
    out = last(run(spark, log, lambda s: R.live_counts(s, "event_type", ["purchase"]), "update", tmp_path, "counts"), "event_type", "n")
    want = {r["event_type"]: (r["n"], r["terminal"]) for r in A.state_counts(spark.read.parquet(log), "event_type", ["purchase"]).collect()}
    assert {k: (r["n"], r["terminal"]) for k, r in out.items()} == want
    windows = run(spark, log, lambda s: R.live_counts(s, "event_type", [], "1 day"), "update", tmp_path, "windows")
    assert windows.groupBy("window", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == 600


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_latest_and_progress(spark, log, tmp_path):
    batch = spark.read.parquet(log)
    out = last(run(spark, log, R.latest_states, "update", tmp_path, "latest"), "user_id", "attempts")
    want = {r["user_id"]: (r["event_id"], r["event_type"]) for r in W.latest(batch, "user_id", ["ts", "event_id"], ["event_id", "event_type"]).collect()}
    assert {k: (r["event_id"], r["event_type"]) for k, r in out.items()} == want
    assert sum(r["attempts"] for r in out.values()) == 600
    out = last(run(spark, log, lambda s: R.progress(s, 200), "update", tmp_path, "progress"), "user_id", "done")
    eta = W.eta(batch, "user_id", ["ts", "event_id"], "value", 200)
    want = {r["user_id"]: r["remaining"] for r in eta.groupBy("user_id").agg(F.max_by("remaining", "done").alias("remaining")).collect()}
    assert {k: pytest.approx(r["remaining"]) for k, r in out.items()} == want


def test_capped_choice_equals_sequential(spark, log, tmp_path):
    got = {r["event_id"] for r in run(spark, log, lambda s: R.capped_choice(s, 2), "append", tmp_path, "choice").collect()}
    used, recent, want = {}, {}, set()
    for r in spark.read.parquet(log).orderBy("event_id").collect():
        key, choice = r["user_id"], r["event_type"]
        if used.get((key, choice), 0) < 2 and choice not in recent.get(key, []):
            used[key, choice] = used.get((key, choice), 0) + 1
            recent[key] = [*recent.get(key, []), choice][-4:]
            want.add(r["event_id"])
    assert got == want


def test_stale_jobs_and_activity(spark, log, tmp_path):
    out = run(spark, log, lambda s: R.stale_jobs(s, "user_id", "ts", "10 minutes", "5 minutes"), "append", tmp_path, "stale").collect()
    sessions, rows = [], sorted((r["user_id"], r["ts"]) for r in spark.read.parquet(log).collect())
    for user, ts in rows:
        if sessions and sessions[-1][0] == user and ts < sessions[-1][2]:
            sessions[-1] = (user, sessions[-1][1], ts + pd.Timedelta(minutes=10), sessions[-1][3] + 1)
        else:
            sessions.append((user, ts, ts + pd.Timedelta(minutes=10), 1))
    ended = max(ts for _, ts in rows) - pd.Timedelta(minutes=5)  # the watermark when all has been read
    assert sorted((r["user_id"], r["start"], r["end"], r["n"]) for r in out) == sorted(x for x in sessions if x[2] <= ended)
    active = last(run(spark, log, lambda s: R.activity(s, "user_id", "value", 3000.0), "update", tmp_path, "active"), "user_id", "active")
    want = {r["user_id"]: r["s"] for r in spark.read.parquet(log).groupBy("user_id").agg(F.sum("value").alias("s")).collect()}
    assert {k: pytest.approx(r["active"]) for k, r in active.items()} == want


def test_append_once(spark, log, tmp_path):
    path = f"{tmp_path}/out"
    for attempt in range(2):  # the second run has lost its checkpoint and sees all rows again
        stream = spark.readStream.schema(R.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(log)
        R.append_once(stream, path, ["event_id"], f"{tmp_path}/c{attempt}").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(path).count() == 600


def test_append_once_by_day(spark, log, tmp_path):
    path = f"{tmp_path}/out"
    for attempt in range(2):
        stream = spark.readStream.schema(R.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(log).withColumn("day", F.to_date("ts"))
        R.append_once(stream, path, ["event_id"], f"{tmp_path}/c{attempt}", by="day").trigger(availableNow=True).start().awaitTermination()
    held = spark.read.parquet(path)
    assert held.count() == 600 and held.where(F.to_date("ts") != F.col("day")).count() == 0
