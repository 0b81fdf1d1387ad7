"""Progress of a running inference: one row a key and beat while results come in, and the exact state at the end.

State is kept per key by the engine (RocksDB, in the checkpoint); a processing-time timer a key says when its next row is due, so that a key with
thousands of fast results writes one row a beat, and a silent one none.  A lost executor or a restart goes on from the checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BEAT_MS = 5_000
STATE = T.StructType([T.StructField(n, k) for n, k in (("attempted", T.LongType()), ("successful", T.LongType()), ("skipped", T.LongType()), ("failed", T.LongType()), ("seconds", T.DoubleType()), ("shortest", T.DoubleType()), ("longest", T.DoubleType()), ("unsaid", T.BooleanType()))])
COUNTS = ("attempted", "successful", "skipped", "failed")
STATE_NAME = "progress"
#: The state store that timers need; set before the stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def output_schema(key: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(key, kind), T.StructField("beat_ms", T.LongType()), *STATE.fields[:-1]])


def _row(key: tuple, now: int, state: tuple, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(key[0], now, *state[:-1])], columns=columns)


class Heartbeat(StatefulProcessor):
    """Adds up results; says so when a beat is due."""

    def __init__(self, key: str, beat_ms: int):
        self.columns = [key, "beat_ms", *STATE.names[:-1]]
        self.beat_ms = beat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState(STATE_NAME, STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.progress.exists()
        state = list(self.progress.get()) if known else [0, 0, 0, 0, 0.0, None, None, False]
        for part in rows:
            state[0] += len(part)
            state[1] += int(part["successful"].sum())
            state[2] += int(part["skipped"].sum())
            state[3] += int((~part["successful"].astype(bool)).sum())
            took = part["seconds"].dropna()
            if len(took):
                state[4] += float(took.sum())
                state[5] = float(took.min()) if state[5] is None else min(state[5], float(took.min()))
                state[6] = float(took.max()) if state[6] is None else max(state[6], float(took.max()))
        if not state[7]:  # no beat is waiting
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.beat_ms)
        state[7] = True
        self.progress.update(tuple(state))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.progress.get()
        self.progress.update((*state[:-1], False))
        yield _row(key, expiredTimerInfo.getExpiryTimeInMs(), state, self.columns)

    def close(self) -> None:
        pass


def beats(results: DataFrame, key: str, *, beat_ms: int = BEAT_MS) -> DataFrame:
    """``key``, beat_ms, counts and times: a row for each key and beat in which results came.

    ``results``: a stream with ``key``, successful and skipped (null counts as false) and seconds (null: not measured).  Skipped results count as successful.  Use output mode
    ``update``, and a processing-time trigger no longer than the beat.
    """
    false = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = results.select(F.col(key), (false("successful") | false("skipped")).alias("successful"), false("skipped").alias("skipped"), F.col("seconds").cast("double").alias("seconds"))
    schema = output_schema(key, own.schema[key].dataType)
    return own.groupBy(key).transformWithStateInPandas(statefulProcessor=Heartbeat(key, beat_ms), outputStructType=schema, outputMode="Update", timeMode="processingTime")


def run_to_end(query: StreamingQuery, poll_s: float = 0.2) -> None:
    """Wait until a batch had nothing left to read, then stop.

    A stream with processing-time timers goes on making empty batches, so that no trigger ends it by itself.
    """
    try:
        while query.isActive and not any(p["numInputRows"] == 0 for p in query.recentProgress):
            time.sleep(poll_s)
        if error := query.exception():
            raise error
    finally:
        query.stop()


def final(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The exact state of every key as of the last finished batch, from the stream's checkpoint, whether or not its beat was due."""
    kept = spark.read.format("statestore").option("stateVarName", STATE_NAME).load(checkpoint)
    return kept.select("key.*", *(F.col(f"value.{n}").alias(n) for n in STATE.names[:-1]))


def aggregate(results: DataFrame, key: str) -> DataFrame:
    """The same of a table, in one aggregation."""
    false = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok = false("successful") | false("skipped")
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("successful"), F.count_if(false("skipped")).alias("skipped"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.min("seconds").alias("shortest"), F.max("seconds").alias("longest"),
    )
