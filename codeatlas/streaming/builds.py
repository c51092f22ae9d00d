"""Build events: pairing of starts with command lines, and property overlays.

The batch form is a window over the events of a key; the streaming form keeps, for
each key, the start that waits for its command line.  Both give the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

START, COMMAND = "TargetStarted", "TaskCommandLine"
PAIR = "key long, seq long, start_seq long"
# Fixed value: groups of keys whose events one call pairs; the state of one holds 16 bytes for each of its keys that waits.
KEY_GROUPS = 1_024


def pair_events(events: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(key, seq, start_seq): each command line whose last relevant event before was a start, which it uses up."""
    w = Window.partitionBy("key").orderBy(*order)
    seen = events.filter(F.col("event_type").isin(START, COMMAND)).withColumn("before", F.lag("event_type").over(w)).withColumn("start_seq", F.lag("seq").over(w))
    return seen.filter((F.col("event_type") == COMMAND) & (F.col("before") == START)).select("key", "seq", "start_seq")


def pair_stream(events: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The same over a stream: the state of a key is the one start that waits, for as long as it takes.

    Within a trigger events are put in order; between triggers they must come in order.  Nothing is dropped for its time:
    a command that comes after any number of triggers meets its start.

    A call of a Python function costs far more than a few events, so the keys are dealt into ``KEY_GROUPS`` groups by their
    hash; the state of a group are the keys of it that wait, in rising order, and their starts.  Null is a key, by itself.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, began = (np.frombuffer(bytes(x), "<i8") for x in state.get) if state.exists else (np.empty(0, "<i8"),) * 2
        frame = pd.concat(list(batches)).sort_values(["key", *order])
        keys, seqs, starts = frame["key"].to_numpy("<i8"), frame["seq"].to_numpy("<i8"), (frame["event_type"] == START).to_numpy(bool)
        first = np.append(True, keys[1:] != keys[:-1])
        # The event before each one: that of its row before, or what its key waits with.
        after_start, start = np.append(False, starts[:-1]), np.append(0, seqs[:-1])
        heads = np.flatnonzero(first)
        after_start[heads] = np.isin(keys[heads], held)
        waits = heads[after_start[heads]]
        start[waits] = began[np.searchsorted(held, keys[waits])]
        last = np.append(heads[1:] - 1, len(keys) - 1)
        open_, others = last[starts[last]], ~np.isin(held, keys[heads])
        now, since = np.append(held[others], keys[open_]), np.append(began[others], seqs[open_])
        if len(now):
            by_key = np.argsort(now)
            state.update((now[by_key].astype("<i8").tobytes(), since[by_key].astype("<i8").tobytes()))
        elif state.exists:
            state.remove()
        pairs = ~starts & after_start
        if pairs.any():
            yield pd.DataFrame({"key": [None] * int(pairs.sum()) if group[0] < 0 else keys[pairs], "seq": seqs[pairs], "start_seq": start[pairs]})

    relevant = events.filter(F.col("event_type").isin(START, COMMAND))
    group = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(KEY_GROUPS)).cast("int")).alias("group")
    # Null has a group of its own, where any number stands for it: a null would turn the keys of a batch into floats.
    rows = relevant.select(group, F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("key"), "seq", "event_type", *(c for c in order if c != "seq"))
    return rows.groupBy("group").applyInPandasWithState(step, PAIR, "held binary, began binary", "append", "NoTimeout")


class PairInOrder(StatefulProcessor):
    """Holds the events of a key until the watermark has passed them, and pairs them in the order of their times.

    ``held`` are events (microseconds, number, whether a start), ``waiting`` the start that no command has used up.  A timer
    stands at the first time held; when it fires, all that the watermark has passed is paired, and one is set for the rest.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, seq long, starts boolean")
        self.waiting = handle.getValueState("waiting", "seq long")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        self.held.appendList([(int(at), int(seq), kind == START) for at, seq, kind in zip(frame["at"], frame["seq"], frame["event_type"])])
        self._wake(int(frame["at"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.held.get())
        rest = [r for r in held if r[0] > passed]
        waiting = self.waiting.get()[0] if self.waiting.exists() else None
        pairs = []
        for _, seq, starts in held[: len(held) - len(rest)]:
            if starts:
                waiting = seq
            elif waiting is not None:
                pairs.append((key[0], seq, waiting))
                waiting = None
        if waiting is None:
            self.waiting.clear()
        else:
            self.waiting.update((waiting,))
        if rest:
            self.held.put(rest)
            self._wake(rest[0][0])
        else:
            self.held.clear()
        if pairs:
            yield pd.DataFrame(pairs, columns=["key", "seq", "start_seq"])

    def close(self) -> None:
        pass


def pair_unordered_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The pairs of events that come in any order, up to ``late`` behind the latest one: those of ``pair_events`` by (ts, seq).

    An event is paired once the watermark has passed it, so the last ``late`` of what has come waits for more.  Events that
    come later than that are dropped by the watermark; those without a time
    are left out, those without a key are a key's.  The state of a key are its events of that time and one start.  Needs ``state_in_rocksdb`` around the start of the query.
    """
    relevant = events.filter(F.col("event_type").isin(START, COMMAND) & F.col("ts").isNotNull())
    timed = relevant.select("key", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq", "event_type").withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(PairInOrder(), PAIR, "append", "EventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which processors with timers need; the session's own choice is put back."""
    option = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(option)
    spark.conf.set(option, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(option, before)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with less than ``gap`` between neighbours: (key, start, end, n); a stream forgets a run once ``late`` has passed its end."""
    run = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return run.select("key", F.col("run.start").alias("start"), F.col("run.end").alias("end"), "n")


def commands_of_targets(events: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, start_seq, seq): every command line after a start of its key and ``within`` that time, as a join of two streams.

    The bounds on time let a stream forget what can meet nothing any more.
    """
    starts = events.filter(F.col("event_type") == START).select(F.col("key"), F.col("seq").alias("start_seq"), F.col("ts").alias("start_ts")).withWatermark("start_ts", late)
    lines = events.filter(F.col("event_type") == COMMAND).select(F.col("key").alias("line_key"), "seq", "ts").withWatermark("ts", late)
    met = (F.col("key") == F.col("line_key")) & (F.col("ts") > F.col("start_ts")) & (F.col("ts") <= F.col("start_ts") + F.expr(f"interval {within}"))
    return starts.join(lines, met).select("key", "start_seq", "seq")


def property_overlay(changes: DataFrame, keys: list[str], value: str = "value", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last value of each property; works on batches and, in complete mode, on streams."""
    return changes.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def invocation_properties(instances: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Project instance to its evaluation to that one's properties; either may be missing."""
    maps = evaluations.groupBy("evaluation_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("properties"))
    return instances.join(maps, "evaluation_id", "left")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events by type and time window, with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
