"""Stream state in the order of events' times, whatever the order of their arrival."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sievework.operators.reconcile import replay_lifecycle
from sievework.streaming import runs as stream

T0 = dt.datetime(2024, 1, 1)
EVENTS = "source_id string, key string, event_id long, ts timestamp, outcome string, status string"


def run(spark, tmp_path, batches, make):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    spark.createDataFrame([], EVENTS).write.parquet(f"{tmp_path}/in")
    made = make(own.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"))
    keep = lambda b, n: b.withColumn("batch", F.lit(n)).write.parquet(f"{tmp_path}/out/version={n:05d}")
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(f"{tmp_path}/in")
        made.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def history(rng, n):
    rows = []
    for i in range(n):
        outcome = rng.choice(["seen", "missed", "missed", "not_modified", "other"])
        rows.append((rng.choice("ab"), rng.choice("xy"), i, T0 + dt.timedelta(minutes=rng.randint(0, 500)), outcome, {"seen": "success", "other": "failed", "missed": "partial"}.get(outcome, outcome)))
    return rows


def test_any_order_of_arrival_gives_the_replay(spark, tmp_path):
    rng = random.Random(5)
    rows = history(rng, 60)
    end = ("end", "end", 999, T0 + dt.timedelta(days=3), "seen", "success")  # time goes on
    late = ("a", "x", 1000, T0, "missed", "failed")
    batches = [rows[:20], rows[20:40], [*rows[40:], end], [late]]
    found = run(spark, tmp_path, batches, lambda e: stream.lifecycle_in_time(e, "1 day", keep="365 days"))
    assert [r["late_event_id"] for r in found.where("late_event_id is not null").collect()] == [1000]
    last = {}
    for r in found.where("late_event_id is null").orderBy("batch").collect():
        last[r["source_id"], r["key"]] = (r["status"], r["consecutive_misses"])
    last.pop(("end", "end"), None)
    replay = replay_lifecycle(spark.createDataFrame(rows, EVENTS).withColumn("id", F.concat_ws("|", "source_id", "key")), "id", ["ts", "event_id"])
    assert last == {tuple(r["id"].split("|")): (r["status"], r["consecutive_misses"]) for r in replay.collect()}


def test_an_old_failure_after_a_clean_run_does_not_count(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[("a", "k", 1, at(10), "", "success"), ("a", "k", 2, at(20), "", "failed")], [("a", "k", 3, at(5), "", "failed"), ("a", "k", 4, at(30), "", "skipped"), ("a", "k", 5, at(15), "", "partial")], [("end", "k", 6, at(5000), "", "success")]]
    found = run(spark, tmp_path, batches, lambda e: stream.streaks_in_time(e, "1 day"))
    assert [r["consecutive_failures"] for r in found.where("source_id = 'a'").orderBy("batch").collect()][-1] == 2


def test_a_key_has_one_timer_for_what_it_holds():
    class Handle:
        timers, values, held = [], None, []
        registerTimer = timers.append
        getListState = lambda self, *_: self
        getValueState = lambda self, *_: type("V", (), {"get": lambda s: None, "update": lambda s, v: None})()
        appendList = held.extend

    row, handle = stream.Row("at", "event_id", "what"), Handle()
    state = stream.OrderedStreak(["source_id", "consecutive_failures", "late_event_id"])
    state.init(handle)
    passed = type("T", (), {"getCurrentWatermarkInMs": lambda s: 0})()
    assert list(state.handleInputRows(("a",), iter([row(at, at, "failed") for at in range(500, 5, -1)]), passed)) == []
    assert handle.timers == [6] and len(handle.held) == 495


def test_quantiles_are_exact(spark):
    from sievework.operators.runs import quantiles

    values = [(i * 7919) % 100_003 for i in range(100_003)] * 2
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    assert quantiles(rows, "v", (1, 2), 3) == [sorted(values)[-(-len(values) * p // 3) - 1] for p in (1, 2)]
    assert quantiles(rows.where("v is null"), "v", (1, 2), 3) == []
    assert quantiles(rows.where("v = 5"), "v", (1, 2), 3) == [5, 5]
