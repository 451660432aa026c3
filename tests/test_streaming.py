"""Streams in several files against the batch operators."""

import random

from pyspark.sql import functions as F

from siftwood import streaming
from siftwood.operators import selectors, state
from siftwood.streaming import state as stream_state


def event_files(spark, folder, n=6):
    rng = random.Random(2)
    rows = [(i, 1_700_000_000 + 600 * i, rng.randrange(4), rng.choice(["error", "view"]), rng.random(), "{}") for i in range(300)]
    for k in range(n):
        part = rows[k * 50 : (k + 1) * 50]
        df = spark.createDataFrame(part, "event_id long, t long, user_id long, event_type string, value double, props string")
        df.select("event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(folder)
    return rows


def test_averages_over_batches(spark, tmp_path):
    folder = str(tmp_path / "e")
    event_files(spark, folder)
    rows = streaming.events(spark, folder)
    told = streaming.drained(spark, stream_state.moving_averages(rows, "user_id", "value", "ts"), "t_averages", "update")
    got = {r["user_id"]: (r["average"], r["n"]) for r in state.latest(told, ["user_id"], [F.desc("n")]).collect()}
    want = {r["user_id"]: (r["average"], r["n"]) for r in state.moving_average(spark.read.parquet(folder), "user_id", ["ts"], "value").collect()}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in got)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    folder, out = str(tmp_path / "e"), str(tmp_path / "out")
    rows = event_files(spark, folder)
    for turn in range(2):  # without a checkpoint of its own, the second run is the first again
        stream_state.admit(spark, streaming.events(spark, folder), out, ["user_id"], "event_type", "ts").option("checkpointLocation", str(tmp_path / f"c{turn}")).start().awaitTermination()
        got = {(r["user_id"], r["event_type"]): r["seen"] for r in stream_state.versions(spark, out, ["user_id"], "event_type").collect()}
        assert sum(got.values()) == len(rows)


def test_selectors():
    page = "<div id=a class='x y'><p>one<p class=z>two</div><ul><li><a href='/q'>three</a></ul><script>no</script>"
    assert selectors.select(page, "#a .z") == ["two"]
    assert selectors.select(page, "li a", "href") == ["/q"]
    assert selectors.select(page, ".x.y") == ["onetwo"]
    assert selectors.select(page, "table") == [] and selectors.select(None, "p") == []
