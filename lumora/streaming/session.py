"""The guards of a camera session as one Structured Streaming operator: value, list and map state, event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumora.operators.session import VERDICT, Guards, Session

_COLUMNS = ["key", "seq", "at_ms", "verdict"]
#: Stands for a value that is not there: the state store's row encoder takes no null.
_NONE = -(1 << 62)


def _frame(key: object, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key, *r) for r in rows], columns=_COLUMNS).astype({"key": "Int64", "seq": "Int64", "at_ms": "Int64"})


class SessionProcessor(StatefulProcessor):
    """One session for each key, taken on from batch to batch and over restarts. The rows of a key in a micro-batch are taken in
    order of ``seq``. An event-time timer ends a quiet session; what was shown too long ago leaves the map as events come."""

    def __init__(self, guards: Guards) -> None:
        self.guards = guards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("session", "newest bigint, taken_at bigint, last_at bigint")
        self.failed = handle.getListState("failed", "at bigint")
        self.shown = handle.getMapState("shown", "item bigint", "at bigint")

    def _load(self) -> Session:
        newest, taken_at, last_at = (None if x == _NONE else x for x in self.value.get()) if self.value.exists() else (None, None, None)
        shown = {k[0]: v[0] for k, v in self.shown.iterator()} if self.shown.exists() else {}
        return Session(newest, taken_at, last_at, [x[0] for x in self.failed.get()] if self.failed.exists() else [], shown)

    def _save(self, s: Session, before: Session) -> None:
        self.value.update(tuple(_NONE if x is None else int(x) for x in (s.newest, s.taken_at, s.last_at)))
        if s.failed != before.failed:
            self.failed.put([(x,) for x in s.failed]) if s.failed else self.failed.clear()
        for item in before.shown.keys() - s.shown.keys():
            self.shown.removeKey((item,))
        for item, at in s.shown.items():
            if before.shown.get(item) != at:
                self.shown.updateValue((item,), (at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, session, out = self._load(), self._load(), []
        pdf = pd.concat(list(rows)).sort_values("seq")
        pdf = pdf[["seq", "at_ms", "kind", "generation", "failed", "item"]]
        for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
            out += session.step(self.guards, *row)
        self._save(session, before)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if session.last_at is not None:
            self.handle.registerTimer(int(session.last_at + self.guards.expiry_ms))
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        session = self._load()
        if session.last_at is not None:
            at = session.last_at + self.guards.expiry_ms
            session.last_at = None
            self._save(session, self._load())
            yield _frame(key[0], [(None, at, "expired")])

    def close(self) -> None:
        pass


def guard_stream(events: DataFrame, guards: Guards) -> DataFrame:
    """Verdicts on a stream of ``EVENT``. Events have to come in the order of their times: the watermark follows the latest one. Needs
    ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider."""
    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "0 seconds")
    return timed.groupBy("key").transformWithStateInPandas(SessionProcessor(guards), outputStructType=VERDICT, outputMode="Append", timeMode="EventTime")
