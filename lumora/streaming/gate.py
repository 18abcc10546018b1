"""The agreement gate as a Structured Streaming operator with keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumora.operators.consensus import DECISION, Policy, Run, State, fold_frames, judged

_COLUMNS = ["stream_id", "seq", "captured_at_ms", "issue", "matched_frames", "observed_count"]


def dump_state(state: State) -> str:
    run = state.run and [state.run.since, state.run.frames, state.run.first.tolist(), state.run.last.tolist()]
    return json.dumps([state.seen_at, run])


def load_state(text: str) -> State:
    seen_at, run = json.loads(text)
    return State(seen_at, run and Run(run[0], run[1], *map(np.array, run[2:])))


class GateProcessor(StatefulProcessor):
    """Keeps a gate's state for each stream. The judged frames of a stream in a micro-batch are taken in order of ``seq``,
    whatever order they come in; they are held together, 50 numbers a frame, so a trigger bounds what is held."""

    def __init__(self, policy: Policy, expire: bool = False) -> None:
        self.policy, self.expire = policy, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = load_state(self.state.get()[0]) if self.state.exists() else State()
        state, got = fold_frames(state, pd.concat(list(rows)).sort_values("seq"), self.policy)
        self.state.update((dump_state(state),))
        if self.expire:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.policy.expiry_ms)
        yield pd.DataFrame([(key[0], *x) for x in got], columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen_at = load_state(self.state.get()[0]).seen_at
        self.state.update((dump_state(State()),))
        yield pd.DataFrame([(key[0], None, seen_at, "stale", 0, 0)], columns=_COLUMNS).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def gate_stream(frames: DataFrame, policy: Policy, *, expire: bool = False) -> DataFrame:
    """Decisions on a stream of frames; with ``expire``, a stale decision when a stream goes quiet (processing time).

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
    """
    return judged(frames, policy).groupBy("stream_id").transformWithStateInPandas(GateProcessor(policy, expire), outputStructType=DECISION, outputMode="Append", timeMode="ProcessingTime" if expire else "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
