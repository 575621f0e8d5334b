"""Streams over files, run until they have read everything, against their batch twins."""

import time

from pyspark.sql import functions as F

from spreadloom.operators.positions import ledger_replay
from spreadloom.streaming import streams


def run(stream, tmp_path, name):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out).collect()


def source(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_bars(spark, tmp_path):
    import datetime as dt

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [("e", "L0", at(1, 5), 1, 0.1), ("e", "L0", at(1, 50), 2, 0.3), ("e", "L0", at(2, 10), 3, 0.4), ("e", "L0", at(9, 0), 4, 0.5)]
    got = run(streams.bars_stream(source(spark, tmp_path, rows, "event_id string, ladder_label string, ts timestamp, seq long, p double")), tmp_path, "bars")
    assert sorted(r["p"] for r in got) == [0.3, 0.4]  # the last bar isn't complete


def test_fills_once(spark, tmp_path):
    import datetime as dt

    rows = [(i % 3, dt.datetime(2024, 1, 1)) for i in range(9)]
    assert len(run(streams.fills_dedup_stream(source(spark, tmp_path, rows, "fill_id long, ts timestamp")), tmp_path, "fills")) == 3


def test_cooldown(spark, tmp_path):
    rows = [("k", b, 1, "BUY", 0.1) for b in (0, 5, 12, 13, 30)] + [("j", 3, 1, "SELL", 0.2)]
    got = run(streams.signal_cooldown_stream(source(spark, tmp_path, rows, "key string, bar long, kind int, direction string, spread double")), tmp_path, "cooldown")
    assert sorted((r["key"], r["bar"]) for r in got) == [("j", 3), ("k", 0), ("k", 12), ("k", 30)]


def test_ledger_equals_its_batch_twin(spark, tmp_path):
    rows = [("k", b, 1, "BUY" if b % 2 else "SELL", 0.01 * b) for b in range(0, 200, 7)] + [("k", b, 0, None, 0.02 * (b % 9)) for b in range(0, 200, 5)]
    schema = "key string, bar long, kind int, direction string, spread double"
    got = run(streams.ledger_stream(source(spark, tmp_path, rows, schema)), tmp_path, "ledger")
    df = spark.createDataFrame(rows, schema)
    want = ledger_replay(df.where("kind = 1").drop("kind"), df.where("kind = 0").select("key", "bar", "spread"), keys=["key"]).where(F.col("status") == "closed").collect()
    assert sorted((r["entry_bar"], r["exit_bar"], round(r["pnl_c"], 4)) for r in got) == sorted((r["entry_bar"], r["exit_bar"], r["pnl_c"]) for r in want) and got


def run_until(stream, tmp_path, name, rows):
    """For a stream that looks for expired states and so never ends: stopped once ``rows`` rows are out."""
    out, end = str(tmp_path / name), time.time() + 60
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").start()
    found = []
    while len(found) < rows and time.time() < end and query.isActive:
        time.sleep(0.5)
        if query.lastProgress:
            found = stream.sparkSession.read.schema(stream.schema).parquet(out).collect()
    query.stop()
    return found


def restarted(spark, tmp_path, make, schema, first, second):
    """Rows that a stream gives for ``first``, and after a stop and a restart from its checkpoint for ``second``."""
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    stream = lambda: make(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    before = run(stream(), tmp_path, "out")
    spark.createDataFrame(second, schema).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    after = run(stream(), tmp_path, "out")
    return before, [r for r in after if r not in before]


EVENTS = "key string, bar long, kind int, direction string, spread double"


def test_cooldown_goes_on_after_a_restart(spark, tmp_path):
    make = lambda s: streams.signal_cooldown_stream(s, cooldown=12)
    first, second = restarted(spark, tmp_path, make, EVENTS, [("k", 0, 1, "BUY", 0.1)], [("k", b, 1, "BUY", 0.1) for b in (5, 11, 14, 20)] + [("j", 1, 1, "SELL", 0.1)])
    assert [(r["key"], r["bar"]) for r in first] == [("k", 0)] and sorted((r["key"], r["bar"]) for r in second) == [("j", 1), ("k", 14)]


def test_cooldown_expires(spark, tmp_path):
    put = lambda i, bar: spark.createDataFrame([("k", bar, 1, "BUY", 0.1)], EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    put(0, 0)
    stream = lambda: streams.signal_cooldown_stream(spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), cooldown=12, ttl_ms=1000)
    assert [r["bar"] for r in run_until(stream(), tmp_path, "out", 1)] == [0]
    time.sleep(2)
    put(1, 5)
    assert sorted(r["bar"] for r in run_until(stream(), tmp_path, "out", 2)) == [0, 5]  # the state of bar 0 is gone


def test_ledger_goes_on_after_a_restart(spark, tmp_path):
    first, second = restarted(spark, tmp_path, streams.ledger_stream, EVENTS, [("k", 0, 1, "SELL", 0.4), ("k", 10, 0, None, 0.1)], [("k", 24, 0, None, 0.3), ("k", 24, 1, "BUY", 0.1), ("k", 60, 0, None, 0.15)])
    assert first == [] and sorted((r["entry_bar"], r["exit_bar"], r["pnl_c"]) for r in second) == [(0, 24, 9.0), (24, 60, 4.0)]


def test_rolling_equals_its_batch_twin(spark, tmp_path):
    from spreadloom.operators.spread import rolling_z

    schema = "event_id string, short_dd string, long_dd string, bar long, spread double"
    rows = [("e", "a", c, b, ((b * 37 + ord(c)) % 11) / 10) for c in "bc" for b in range(60)]
    for i in range(3):
        spark.createDataFrame([r for r in rows if i * 20 <= r[3] < (i + 1) * 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    start = lambda: streams.rolling_stream(stream, str(tmp_path / "history"), str(tmp_path / "out"), window=12, min_obs=5, checkpoint=str(tmp_path / "state")).awaitTermination()
    start()
    key = lambda df: sorted((r["long_dd"], r["bar"], r["z"] and round(r["z"], 9)) for r in df.collect())
    want = key(rolling_z(spark.createDataFrame(rows, schema), window=12, min_obs=5))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want
    (tmp_path / "state" / "commits" / "2").unlink()  # the last batch runs again and replaces what it wrote
    (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
    start()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want
