"""Streams with keyed state: budgets of models, and sessions that are stored and asked turn by turn.

Both need the RocksDB state store (``factloom.session`` sets it; :func:`state_store` sets it for a while).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.functions.text import tokens
from factloom.operators.history import History

MINUTE = 60_000_000
#: Minutes of a cell: a model's calls are cut by time, as in the batch form, so that old state goes with its cell.
CELL_MINUTES = 1440
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of the streams started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def waits(at: np.ndarray, amount: np.ndarray, rpm: int, tpm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calls and amounts of the last minute at each call, and seconds until enough of them are a minute old.

    ``at``: sorted microseconds. A minute is closed on both sides, calls of one moment count for each other.
    A call that is too large alone waits a minute, for itself."""
    total = np.r_[0, np.cumsum(amount)]
    low, high = np.searchsorted(at, at - MINUTE, "left"), np.searchsorted(at, at, "right")
    requests, used = high - low, total[high] - total[low]
    # the call that has to leave so that the rest fits, for either bound
    by_requests = np.where(requests > rpm, np.maximum(high - rpm - 1, low), -1)
    by_tokens = np.where(used > tpm, np.minimum(np.searchsorted(total, total[high] - tpm, "left") - 1, high - 1), -1)
    leaving = np.maximum(by_requests, by_tokens)
    return requests, used, np.where(leaving >= 0, (at[leaving] + MINUTE - at) / 1e6, 0.0)


class Budget(StatefulProcessor):
    """Calls of one model and cell of time. One timer waits, for the end of the first minute that is not told;
    it tells all minutes that the watermark has passed. Calls of the last minute stay as the look-back of the
    next, until the watermark is a minute ahead of them."""

    def __init__(self, id_col: str, id_type: T.DataType, rpm: int, tpm: int) -> None:
        self.id_col, self.id_type, self.rpm, self.tpm = id_col, id_type, rpm, tpm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", T.StructType([T.StructField("at", T.LongType()), T.StructField("id", self.id_type), T.StructField("amount", T.LongType()), T.StructField("own", T.BooleanType())]))
        self.next = handle.getValueState("next", "minute long")

    def _wait_for(self, minute: int) -> None:
        """A timer for the end of a minute, unless one waits for an earlier one."""
        if not self.next.exists() or minute < self.next.get()[0]:
            self.next.update((minute,))
            self.handle.registerTimer((minute + 1) * 60_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.calls.appendList(list(zip(frame["at"].tolist(), frame["id"].tolist(), frame["amount"].tolist(), frame["own"].tolist(), strict=True)))
            # a look-back call has no minute here; it waits for the first one of the cell
            self._wait_for(int(np.where(frame["own"], frame["at"] // MINUTE, frame["cell"] * CELL_MINUTES).min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.next.exists() or (self.next.get()[0] + 1) * 60_000 > expiredTimerInfo.getExpiryTimeInMs():
            return
        told, due = self.next.get()[0] * MINUTE, timerValues.getCurrentWatermarkInMs() // 60_000 * MINUTE
        calls = sorted(self.calls.get(), key=lambda c: c[0]) if self.calls.exists() else []
        left = [c for c in calls if c[0] >= due - MINUTE]
        self.calls.put(left) if left else self.calls.clear()
        self.next.clear()
        pending = [c[0] // MINUTE for c in left if c[3] and c[0] >= due]
        if left:
            self._wait_for(min(pending) if pending else (left[-1][0] + MINUTE) // MINUTE)
        at, amount = (np.array([c[i] for c in calls], np.int64) for i in (0, 2))
        requests, used, wait = waits(at, amount, self.rpm, self.tpm)
        rows = [i for i, c in enumerate(calls) if c[3] and told <= c[0] < due]
        if rows:
            allowed = (requests <= self.rpm) & (used <= self.tpm)
            yield pd.DataFrame({self.id_col: [calls[i][1] for i in rows], "requests_60s": requests[rows], "tokens_60s": used[rows], "allowed": allowed[rows], "wait_seconds": wait[rows]})


def budget_stream(stream: DataFrame, key: str, ts: str, id_col: str, amount: str, rpm: int, tpm: int, late: str) -> DataFrame:
    """The calls of a log as :func:`factloom.operators.windows.within_budget` judges them, and the seconds to
    wait: id, requests_60s, tokens_60s, allowed, wait_seconds.

    A call is told when the watermark has passed the end of its minute, so calls that come up to ``late``
    after others count; later ones are dropped. State is what the last minute and the delay hold."""
    at = F.unix_micros(ts)
    cell = F.floor(at / (CELL_MINUTES * MINUTE))
    near = at >= (cell + 1) * (CELL_MINUTES * MINUTE) - MINUTE
    rows = stream.withWatermark(ts, late).withColumn("cell", F.explode(F.when(near, F.array(cell, cell + 1)).otherwise(F.array(cell))))
    rows = rows.select(F.col(key).alias("key"), "cell", ts, at.alias("at"), F.col(id_col).alias("id"), F.col(amount).cast("long").alias("amount"), (F.col("cell") == cell).alias("own"))
    kind = stream.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("requests_60s", T.LongType()), T.StructField("tokens_60s", T.LongType()), T.StructField("allowed", T.BooleanType()), T.StructField("wait_seconds", T.DoubleType())])
    return rows.groupBy("key", "cell").transformWithStateInPandas(Budget(id_col, kind, rpm, tpm), schema, "Append", "EventTime")


class Interleaved(StatefulProcessor):
    """The turns of one session. Each is stored in its place; where it answers an asking turn, that one is
    looked up in what was stored before it. A turn that comes before its predecessors waits for them, or
    until the watermark has passed its time; a session is forgotten when it has been idle for ``idle_ms``."""

    def __init__(self, asking: str, results: int, idle_ms: int) -> None:
        self.asking, self.results, self.idle_ms = asking, results, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        turn = T.StructType([T.StructField("turn", T.LongType()), T.StructField("at", T.LongType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])
        self.handle = handle
        self.turns, self.waiting = handle.getListState("turns", turn), handle.getListState("waiting", turn)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            new += [(int(n), int(at), s, t, list(w)) for n, at, s, t, w in zip(*(frame[c] for c in ("turn", "at", "speaker", "text", "words")), strict=True)]
        yield from self._take(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key, [], timerValues.getCurrentWatermarkInMs())

    def _take(self, key, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        stored = list(self.turns.get()) if self.turns.exists() else []
        waiting = sorted([*(self.waiting.get() if self.waiting.exists() else []), *new], key=lambda t: t[0])
        history, kept, rows = History(), len(stored), []
        for t in stored[:-1]:
            history.add(t[4])
        while waiting:
            place = stored[-1][0] + 1 if stored else 0
            if waiting[0][0] > place and waiting[0][1] > watermark:
                break
            turn = waiting.pop(0)
            if turn[0] < place:
                continue  # told before
            if stored:
                before = stored[-1]
                if before[2] == self.asking:
                    found = history.top(list(before[4]), self.results)
                    rows.append((key[0], before[0], before[3], turn[3], [stored[i][3] for i, _ in found]))
                history.add(before[4])
            stored.append(turn)
        if len(stored) > kept:
            self.turns.appendList([tuple(t) for t in stored[kept:]])
        self.waiting.put([tuple(t) for t in waiting]) if waiting else self.waiting.clear()
        for t in waiting:
            self.handle.registerTimer(max(t[1], watermark + 1))
        last = max((t[1] for t in (*stored[-1:], *waiting)), default=0) + self.idle_ms
        if last <= watermark:
            self.turns.clear()
        elif new:
            self.handle.registerTimer(last)
        if rows:
            yield pd.DataFrame(rows, columns=["session_id", "asked", "query", "expected", "retrieved"])


def interleaved_stream(stream: DataFrame, ts: str, late: str, asking: str = "user", results: int = 3, idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Turns (session_id, turn from 0, speaker, text and a time) stored and asked in order: session_id, asked,
    query, expected, retrieved, as the batch form of turn evaluation finds them, one row for each asking turn
    as soon as its answer is there."""
    rows = stream.withWatermark(ts, late)
    rows = rows.select("session_id", ts, F.col("turn").cast("long").alias("turn"), F.unix_millis(ts).alias("at"), "speaker", "text", tokens(F.col("text")).alias("words"))
    schema = T.StructType([T.StructField("session_id", stream.schema["session_id"].dataType), T.StructField("asked", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("query", "expected")), T.StructField("retrieved", T.ArrayType(T.StringType()))])
    return rows.groupBy("session_id").transformWithStateInPandas(Interleaved(asking, results, idle_ms), schema, "Append", "EventTime")
