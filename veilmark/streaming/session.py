"""A vault kept by session in a stream: start from a stored vault, adopt, reload, end, expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules as R
from .stream import shape_events

#: The state store that keyed state needs; a setting of the session that runs the stream.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("name", T.StringType())])
_TEXT = T.StructType([T.StructField("x", T.StringType())])
_COUNT = T.StructType([T.StructField("n", T.LongType())])


class SessionVault(StatefulProcessor):
    """Of a session: digest to name, name to digest, and how many names came from output; no value is kept.

    Rows of a trigger are taken in order of message and place.  An end wipes all
    entries, then the state itself goes with them; a reload ends nothing.  A
    session that is silent for ``idle_ms`` is wiped by a timer.
    """

    def __init__(self, cap: int = R.ADOPT_CAP, idle_ms: int | None = None):
        self.cap, self.idle_ms = cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", _TEXT, _TEXT)
        self.taken = handle.getMapState("taken", _TEXT, _TEXT)
        self.adopted = handle.getValueState("adopted", _COUNT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        count = self._count()
        for digest, name, from_output in initialState[["digest", "name", "from_output"]].itertuples(index=False):
            if not self.names.containsKey((digest,)):
                self.names.updateValue((digest,), (name,))
            self.taken.updateValue((name,), (digest,))
            count += bool(from_output)
        self.adopted.update((count,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted(((s, p, d, b) for part in rows for s, p, d, b in part[["seq", "start", "digest", "base"]].itertuples(index=False)), key=lambda e: e[:2])
        fresh, count = [], self._count()
        for _, _, digest, base in events:
            if digest is None:
                self._wipe()
                count = 0
            elif count < self.cap and not self.names.containsKey((digest,)):
                name = self._free(base)
                self.names.updateValue((digest,), (name,))
                self.taken.updateValue((name,), (digest,))
                fresh.append((key[0], digest, name))
                count += 1
        if count:
            self.adopted.update((count,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(fresh, columns=OUTPUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._wipe()
        yield pd.DataFrame([], columns=OUTPUT.names)

    def close(self) -> None:
        pass

    def _count(self) -> int:
        return self.adopted.get()[0] if self.adopted.exists() else 0

    def _free(self, base: str) -> str:
        """``base``, or with the first number from 2 on that is free; at most ``cap`` lookups beyond the stored names."""
        name, n = base, 1
        while self.taken.containsKey((name,)):
            n += 1
            name = f"{base}-{n}"
        return name

    def _wipe(self) -> None:
        for state in (self.names, self.taken, self.adopted):
            state.clear()


def session_stream(messages: DataFrame, text_col: str = "text", end_col: str | None = None, reason_col: str | None = None, stored: DataFrame | None = None, cap: int = R.ADOPT_CAP, idle_ms: int | None = None) -> DataFrame:
    """``session_id, digest, name`` of the values that shapes give away, as a stream: each once in a session, ``cap`` from output at most.

    A message whose ``end_col`` holds ends its session, unless its ``reason_col``
    is ``reload``.  ``stored`` (session_id, name, value, source) is the vault that
    sessions start from; it takes part by digests.  The stream needs the setting ``STORE``.
    """
    ended = None
    if end_col is not None:
        ended = F.coalesce(F.col(end_col), F.lit(False))
        if reason_col is not None:
            ended = ended & (F.coalesce(F.col(reason_col), F.lit("")) != "reload")
    rows = messages if ended is None else messages.withColumn("ended", ended)
    events = shape_events(rows, text_col, None if ended is None else "ended")
    start = None
    if stored is not None:
        first = stored.groupBy("session_id", "name").agg(F.min(F.struct(F.sha2("value", 256).alias("digest"), (F.col("source") == "output").alias("from_output"))).alias("v"))
        start = first.select("session_id", "name", "v.digest", "v.from_output").groupBy("session_id")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return events.groupBy("session_id").transformWithStateInPandas(SessionVault(cap, idle_ms), OUTPUT, "Append", mode, initialState=start)
