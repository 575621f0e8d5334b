"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def bars_stream(points: DataFrame, *, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """The last price of each leg and bar of a stream of points (event_id, ladder_label, ts, seq, p); points later than
    ``late`` are dropped and bars come out once they are complete."""
    held = points.where("p is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = held.groupBy("event_id", "ladder_label", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.max_by("p", F.struct("ts", "seq")).alias("p"))
    return bars.select("event_id", "ladder_label", F.col("w.start").alias("bar_start"), "p")


def fills_dedup_stream(fills: DataFrame, *, late: str = "2 hours") -> DataFrame:
    """Each fill once, within the watermark."""
    return fills.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["fill_id"])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Folds each key's rows of a batch in the order of (bar, kind) with ``step(state, row) -> (state, out)``; the state
    is one value, None where there is none. With ``ttl_ms`` a state that isn't renewed for so long expires; such a stream
    runs until it is stopped, one that is to end when it has read all there is must not have it."""

    def __init__(self, step: Callable, state: str, names: list[str], ttl_ms: int | None):
        self.step, self.schema, self.names, self.ttl_ms = step, state, names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", self.schema, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(["bar", "kind"], kind="stable")
        before = self.value.get() if self.value.exists() else None
        now, out = before, []
        for row in batch.itertuples(index=False):
            now, made = self.step(now, row)
            out += [(*key, *made)] if made else []
        if now is None:
            self.value.clear()
        elif now != before:  # writing an unchanged state would renew it
            self.value.update(now)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, step: Callable, state: str, schema: str, ttl_ms: int | None) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # what value states and expiry need
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.groupBy("key").transformWithStateInPandas(Fold(step, state, names, ttl_ms), schema, "append", "processingTime" if ttl_ms else "none")


def signal_cooldown_stream(signals: DataFrame, *, cooldown: int = 12, ttl_ms: int | None = None) -> DataFrame:
    """Signals (key, bar, kind, direction, spread) without repeats of a key within ``cooldown`` bars of the last one let
    through. State is the last bar of a key, kept in RocksDB; with ``ttl_ms``, longer than a cooldown lasts, it expires
    so long after it was written, and the key may signal anew."""

    def step(state, row):
        if state is not None and row.bar - state[0] < cooldown:
            return state, None
        return (int(row.bar),), (int(row.bar), row.direction)

    return _folded(signals, step, "last long", "key string, bar long, direction string", ttl_ms)


def ledger_stream(events: DataFrame, *, hold: int = 24, cost_c: float = 1.0, ttl_ms: int | None = None) -> DataFrame:
    """Closed ledger rows of a stream of marks (kind 0) and signals (kind 1): a key opens once, closes at the first mark
    at least ``hold`` bars later and may open again. State is the open row of a key; with ``ttl_ms`` a row that stays
    open for longer is dropped."""

    def step(state, row):
        if row.kind == 1 and state is None:
            return (int(row.bar), row.direction, float(row.spread)), None
        if row.kind == 0 and state is not None and row.bar - state[0] >= hold:
            sign = 1.0 if state[1] == "BUY" else -1.0
            return None, (state[0], state[1], state[2], int(row.bar), float(row.spread), round(sign * (row.spread - state[2]) * 100 - cost_c, 4))
        return state, None

    schema = "key string, entry_bar long, direction string, entry_spread double, exit_bar long, exit_spread double, pnl_c double"
    return _folded(events, step, "bar long, direction string, spread double", schema, ttl_ms)


def rolling_stream(bars: DataFrame, history: str, sink: str, *, window: int = 48, min_obs: int = 20, checkpoint: str):
    """Statistics of new spread bars, as a stream itself has no frames of rows: each micro-batch reads the last ``window``
    bars of every pair that the one before left in ``history``, and leaves its own.

    Both are written under the batch's number, so a repeated batch replaces what it wrote; ``sink`` is read as one table
    of partitions ``batch``. Bars of a pair come in order; one that comes late takes part from then on.
    """
    from ..operators.spread import PAIR, rolling_z

    columns = [*PAIR, "bar", "spread"]

    def batch(new: DataFrame, number: int) -> None:
        new = new.select(columns).dropDuplicates([*PAIR, "bar"])
        rows = new.withColumn("new", F.lit(True))
        if number:
            past = new.sparkSession.read.schema(new.schema).parquet(f"{history}/batch={number - 1}")
            rows = rows.unionByName(past.join(new, [*PAIR, "bar"], "left_anti").withColumn("new", F.lit(False)))
        rolling_z(rows, window=window, min_obs=min_obs).where("new").drop("new").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        last = Window.partitionBy(*PAIR).orderBy(F.desc("bar"))
        tail = rows.withColumn("k", F.row_number().over(last)).where(F.col("k") <= window).select(columns)
        tail.write.mode("overwrite").parquet(f"{history}/batch={number}")

    return bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
