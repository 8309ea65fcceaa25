"""Streams give what batches give; late rows are dropped; state survives batches."""

import os

from pyspark.sql import functions as F

from webstrata.streaming import metrics as sm
from webstrata.streaming import state


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def put(folder, i, text):
    """A file of the stream; files are read in order of their times."""
    path = folder / f"{i}.json"
    path.write_text(text)
    os.utime(path, (1_700_000_000 + 10 * i,) * 2)


def test_windows_and_late_rows(spark, tmp_path):
    for i, batch in enumerate([["00:00:10", "00:30:00"], ["01:30:00"], ["01:40:00"], ["00:01:00", "03:00:00"], ["06:00:00"]]):
        put(tmp_path, i, "\n".join(f'{{"ts": "2024-01-01T{t}Z", "event_type": "v", "value": 1.0}}' for t in batch))
    s = source(spark, str(tmp_path), "ts timestamp, event_type string, value double")
    got = {r["window"]["start"].hour: r["n"] for r in run(spark, sm.windowed(s, "1 hour", late="10 minutes"), "w1").collect()}
    assert got == {0: 2, 1: 2, 3: 1}
    batch = spark.read.schema("ts timestamp, event_type string, value double").json(str(tmp_path))
    assert sm.windowed(batch, "1 hour").count() == 4 and sm.windowed(batch, "1 hour", "30 minutes").count() > 4
    assert sm.first_seen(batch, ["event_type"]).count() == 1


def test_breaker_state(spark, tmp_path):
    calls = [[(0.0, True), (10.0, False)], [(61.0, True)], [(100.0, False), (122.0, False)]]
    n = 0
    for i, batch in enumerate(calls):
        lines = []
        for at, trip in batch:
            lines.append(f'{{"key": "k", "at": {at}, "event_id": {n}, "trip": {str(trip).lower()}}}')
            n += 1
        put(tmp_path, i, "\n".join(lines))
    s = source(spark, str(tmp_path), "key string, at double, event_id long, trip boolean")
    got = run(spark, state.break_circuits(s, 60.0), "w2").orderBy("event_id").collect()
    assert [r["allowed"] for r in got] == [True, False, True, False, True]


def test_limiter_state(spark, tmp_path):
    for i, (at, status) in enumerate([(0.0, 200), (0.1, 429), (0.2, 200)]):
        put(tmp_path, i, f'{{"key": "k", "at": {at}, "event_id": {i}, "status": {status}, "retry_after": 4.0}}')
    s = source(spark, str(tmp_path), "key string, at double, event_id long, status int, retry_after double")
    got = run(spark, state.limit_rates(s, 0.5), "w3").orderBy("event_id").collect()
    assert [r["granted"] for r in got] == [0.0, 0.5, 4.5]


def test_pairs_in_batch(spark):
    df = spark.sql("select 1 as k, timestamp'2024-01-01 00:00:00' as ts union all select 2, timestamp'2024-01-01 00:00:00'")
    ans = spark.sql("select 1 as k, timestamp'2024-01-01 00:00:01' as ts")
    assert sorted((r["k"], r["elapsed_ms"]) for r in sm.pairs(df, ans, "k").collect()) == [(1, 1000.0), (2, None)]
    assert sm.sessions(df.withColumnRenamed("k", "user_id"), "5 minutes").count() == 2 and F
