"""Streams that keep state of their own: numbers of calls, and rates over the last rows of a run.

State lies in Spark's state store (RocksDB, set for the start of the query) and is
committed with each micro-batch, so a stream that is stopped, or an executor that
is lost, goes on where the last batch ended.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Within it, streams begin with a store that arbitrary state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that a stream with state has now to a folder of Parquet, and stops; called again, it goes on."""
    with state_store(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


# -- numbers of calls


class _Steps(StatefulProcessor):
    def init(self, handle):
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            frame["step"] = range(n + 1, n + 1 + len(frame))
            n += len(frame)
            yield frame
        self.count.update((n,))

    def close(self):
        pass


def numbered_calls(calls: DataFrame, log: str) -> DataFrame:
    """A stream of calls, a row each, with `step`: the number of the call in its log, from 1, in the order in which calls arrive.

    The count is state, so a stream that is begun again goes on without a gap, and no number comes twice. A null log is a
    log of its own. Within a micro-batch the rows of one log follow each other in one task, in the batches in which they come.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields)
    return calls.groupBy(log).transformWithStateInPandas(_Steps(), f"{fields}, step long", "Append", "None")


def completion_rows(calls: DataFrame, completions: str = "completions") -> DataFrame:
    """Rows of a completion log from numbered calls with an array of completions: each with its place (idx) and its length."""
    rest = [c for c in calls.columns if c != completions]
    each = calls.select(*rest, F.posexplode(completions).alias("idx", "_c"))
    return each.select(*rest, "idx", "_c.*").withColumn("completion_length", F.length(F.coalesce("completion", F.lit(""))).cast("long"))


# -- rows that aren't done yet


#: Groups that keys are dealt to: what is looked up is the key, but a group's rows come together, which costs less than a group for each key.
GROUPS = 1024


class _Once(StatefulProcessor):
    """Columns are taken by their places: where there is an initial state, frames come without names."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle):
        self.seen = handle.getMapState("seen", "k string", "n boolean")

    def handleInitialState(self, key, initialState, timerValues):
        for k in initialState.iloc[:, 0]:
            self.seen.updateValue((k,), (True,))

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            if frame.empty:  # a group that only has rows done before comes without columns
                continue
            first = frame.set_axis(self.names, axis=1).drop_duplicates("_key")
            new = first[[not self.seen.containsKey((k,)) for k in first["_key"]]]
            for k in new["_key"]:
                self.seen.updateValue((k,), (True,))
            yield new.drop(columns=["_key", "_group"])

    def close(self):
        pass


def _keyed(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with their key as text, and the group that it is dealt to; zeros of both signs are one."""
    parts = [(F.col(k) + F.lit(0.0) if t in ("float", "double") else F.col(k)).alias(k) for k, t in rows.select(*key).dtypes]
    return rows.withColumn("_key", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})).withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(GROUPS)))


def not_done(stream: DataFrame, key: list[str], done: DataFrame | None = None) -> DataFrame:
    """The first row of each key that comes, unless it is among those done before the stream began.

    What is done is state, looked up by key, so a micro-batch doesn't read the output again, however large it is; the rows
    done before are read once, as the stream begins. Keys may be null.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    before = None if done is None else _keyed(done.select(*key).distinct(), key).select("_key", "_group").groupBy("_group")
    return _keyed(stream, key).groupBy("_group").transformWithStateInPandas(_Once([*stream.columns, "_key", "_group"]), fields, "Append", "None", initialState=before)


# -- rates of a run


#: Rows of a run that are kept or given out together.
PIECE = 1 << 16


def _pieces(*columns: np.ndarray):
    for at in range(0, len(columns[0]), PIECE):
        yield tuple(c[at : at + PIECE] for c in columns)


class _Rates(StatefulProcessor):
    """Rows wait until the watermark has passed them, and are then taken in order against the last `size` times. They wait as packed columns."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "n long, first long, times array<long>")
        self.waiting = handle.getListState("waiting", "ts binary, id binary")
        self.done = handle.getValueState("done", "ts long")

    def _released(self, key, upto):
        if upto > (self.done.get()[0] if self.done.exists() else -(1 << 62)):
            self.done.update((upto,))
        if not self.waiting.exists():
            return
        held = list(self.waiting.get())
        ts, ids = (np.frombuffer(b"".join(h[i] for h in held), np.int64) for i in (0, 1))
        ready = ts <= upto
        if not ready.any():
            return
        if ready.all():
            self.waiting.clear()
        else:
            self.waiting.put([(t.tobytes(), i.tobytes()) for t, i in _pieces(ts[~ready], ids[~ready])])
        ts, ids = ts[ready], ids[ready]
        order = np.lexsort((ids, ts))
        ts, ids = ts[order], ids[order]
        n, first, times = self.last.get() if self.last.exists() else (0, int(ts[0]), [])
        times = np.concatenate([np.array(times, np.int64), ts])  # the last ones before, and these
        old, size = len(times) - len(ts), self.size
        delta, rate = np.full(len(times), np.nan), np.full(len(times), np.nan)
        delta[1:] = (times[1:] - times[:-1]) / 1e6
        passed = (times[size:] - times[:-size]) / 1e6
        with np.errstate(divide="ignore"):
            rate[size:] = np.where(passed > 0, size / (passed / 60), np.inf)
        self.last.update((n + len(ts), first, times[-size:].tolist()))
        columns = (ids, ts, rate[old:], delta[old:], (ts - first) / 1e6 / 60, np.arange(n + 1, n + 1 + len(ts)))
        for piece in _pieces(*columns):
            made = pd.DataFrame(dict(zip(["id", "ts", "rate", "delta_seconds", "elapsed_minutes", "completed"], piece, strict=True)))
            made.insert(0, "run", pd.Series([key[0]] * len(made)))
            yield made

    def handleInputRows(self, key, rows, timerValues):
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        passed = self.done.get()[0] if self.done.exists() else -(1 << 62)
        latest, held = None, []
        for frame in rows:
            ts, ids = frame["ts"].to_numpy(np.int64), frame["id"].to_numpy(np.int64)
            new = frame["counts"].to_numpy(bool) & (ts > passed)
            if new.any():
                held.append((ts[new].tobytes(), ids[new].tobytes()))
                latest = int(max(ts[new].max(), ts[new].max() if latest is None else latest))
        if held:
            self.waiting.appendList(held)
        if latest is not None and latest > upto:
            self.handle.registerTimer(-(-latest // 1000))
        yield from self._released(key, upto)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._released(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self):
        pass


def stream_rates(log: DataFrame, run: str, ts: str, tie: str, delay: str, size: int = 20) -> DataFrame:
    """(run, id, ts, rate, delta_seconds, elapsed_minutes, completed) of a stream of rows (times before 2262): what completion_rate() and
    inter_arrival() give on a table, with rates null for the first `size` rows of a run.

    Rows of a run are taken in the order of time and `tie`, once the watermark (`delay` behind the newest row) has passed
    them: up to that they wait, so disorder within the delay changes nothing. A row that comes later than that is left
    out, as if it never came. A row with a null tie only moves the time on, as at the end of a log.
    """
    rows = log.filter(F.col(ts).isNotNull()).select(F.col(run).alias("run"), F.col(ts).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("id")).withWatermark("at", delay)
    # a null tie would make a batch's ties floating-point numbers
    rows = rows.withColumn("ts", F.unix_micros("at")).withColumn("counts", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.lit(0)).cast("long"))
    kind = log.schema[run].dataType.simpleString()
    made = rows.groupBy("run").transformWithStateInPandas(_Rates(size), f"run {kind}, id long, ts long, rate double, delta_seconds double, elapsed_minutes double, completed long", "Append", "EventTime")
    return made.withColumn("ts", F.timestamp_micros("ts"))
