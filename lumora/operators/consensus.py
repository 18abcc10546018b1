"""Temporal agreement of frames of detections: when has a row of tiles stood still for long enough?

A frame is judged by column expressions (``FRAME_CHECKS``, the first that fails names the issue), so a frame's quality is a
plain projection. What is left needs order: a fold over the judged frames of a stream, whose state is the time of
the last frame and the run of frames that agree so far. The fold (``advance``) serves a batch over recorded
frames and the streaming operator. Frames are taken in arrival order (``seq``), not by event time: a late frame ends the run
and says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions.geometry import finite, iou

DETECTION = "struct<tile:int,confidence:double,l:double,t:double,r:double,b:double,red_five:boolean>"
FRAME = f"stream_id bigint, seq bigint, captured_at_ms bigint, detections array<{DETECTION}>"
DECISION = "stream_id bigint, seq bigint, captured_at_ms bigint, issue string, matched_frames int, observed_count int"

# Limits of a frame and of the motion between frames.
TILES, COPIES = 34, 4
EDGE_LOW, EDGE_HIGH, LEAST_WIDTH, LEAST_HEIGHT = 0.005, 0.995, 0.008, 0.08
MOST_SPREAD, MOST_OVERLAP = 0.5, 0.15
MOST_DX, MOST_DY, MOST_RESIZE = 0.025, 0.06, 0.3


@dataclass(frozen=True)
class Policy:
    """How many frames must agree, for how long, with what gaps, and when a decision expires."""

    expected_count: int
    required_frames: int = 5
    minimum_span_ms: int = 1200
    maximum_gap_ms: int = 1000
    expiry_ms: int = 1200
    minimum_confidence: float = 0.8

    def __post_init__(self) -> None:
        fine = (2 <= self.expected_count <= 17, self.required_frames >= 2, min(self.minimum_span_ms, self.maximum_gap_ms, self.expiry_ms) >= 1, 0 <= self.minimum_confidence <= 1)
        if not all(fine):
            raise ValueError("invalid stability policy")

    @classmethod
    def live(cls, expected_count: int) -> Policy:
        return cls(expected_count, 3, 700, 3000, 4000)


# --- one frame: columns over its detections, in order of their centres -------------------------------------------------


def by_center(detections: Column) -> Column:
    """Detections from left to right; null is none."""
    def order(x: Column, y: Column) -> Column:
        a, b = x["l"] + x["r"], y["l"] + y["r"]
        return F.when(a < b, -1).when(a > b, 1).otherwise(0)

    return F.array_sort(F.coalesce(detections, F.array().cast(f"array<{DETECTION}>")), order)


def bad_confidence(d: Column, least: float) -> Column:
    return F.exists(d, lambda x: ~F.coalesce(finite(x["confidence"]) & x["confidence"].between(least, 1.0), F.lit(False)))


def _box_issue(x: Column, copies: Column) -> Column:
    inside = (F.least(x["l"], x["t"]) >= EDGE_LOW) & (F.greatest(x["r"], x["b"]) <= EDGE_HIGH) & finite(x["l"]) & finite(x["t"]) & finite(x["r"]) & finite(x["b"])
    large = (x["r"] - x["l"] >= LEAST_WIDTH) & (x["b"] - x["t"] >= LEAST_HEIGHT)
    return F.when(~x["tile"].between(0, TILES - 1) | (copies > COPIES), "physical").when(~F.coalesce(inside & large, F.lit(False)), "arrangement")


def first_box_issue(d: Column) -> Column:
    """The issue of the leftmost detection that has one: an unknown tile or a fifth copy, or a box at the edge or too small."""
    found = F.transform(d, lambda x, i: _box_issue(x, F.size(F.filter(F.slice(d, F.lit(1), i + 1), lambda y: y["tile"] == x["tile"]))))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def spread(d: Column) -> Column:
    """How far apart the centres of a row are, in (upper) median heights."""
    heights, middle = F.array_sort(F.transform(d, lambda x: x["b"] - x["t"])), F.transform(d, lambda x: (x["t"] + x["b"]) / 2)
    return (F.array_max(middle) - F.array_min(middle)) / F.get(heights, F.floor(F.size(d) / 2).cast("int"))


def most_overlap(d: Column) -> Column:
    """The largest IoU of neighbours; null for fewer than two."""
    return F.array_max(F.zip_with(F.slice(d, F.lit(1), F.size(d) - 1), F.slice(d, F.lit(2), F.size(d) - 1), iou))


#: Issues of a frame in the order in which they are looked for: a condition on the detections in order, or the issue itself.
FRAME_CHECKS: tuple[Callable[[Column, Policy], Column], ...] = (
    lambda d, p: F.when(F.size(d) == 0, "empty"),
    lambda d, p: F.when(F.size(d) != p.expected_count, "count"),
    lambda d, p: F.when(bad_confidence(d, p.minimum_confidence), "confidence"),
    lambda d, p: first_box_issue(d),
    lambda d, p: F.when(spread(d) > MOST_SPREAD, "arrangement"),
    lambda d, p: F.when(most_overlap(d) > MOST_OVERLAP, "arrangement"),
)


def frame_issue(d: Column, policy: Policy) -> Column:
    """The first issue of a frame of detections in order of their centres; null for a fine one."""
    return F.coalesce(*[check(d, policy) for check in FRAME_CHECKS])


def can_confirm(d: Column, expected_count: int) -> Column:
    """Whether a person may confirm a frame that the gate still refuses: the expected number of known tiles with a
    confidence in [0, 1], none more than four times. Arrangement, motion and the least confidence don't matter."""
    known = F.forall(d, lambda x: F.coalesce(x["tile"].between(0, TILES - 1) & finite(x["confidence"]) & x["confidence"].between(0.0, 1.0), F.lit(False)))
    copies = F.forall(d, lambda x: F.size(F.filter(d, lambda y: y["tile"] == x["tile"])) <= COPIES)
    return (F.size(d) == expected_count) & known & copies


def judged(frames: DataFrame, policy: Policy) -> DataFrame:
    """Frames as the fold takes them: stream_id, seq, captured_at_ms, refused, n and marks, six numbers a detection
    (tile, red five, centre and size), only of frames that are not refused."""
    rows = frames.select("stream_id", "seq", "captured_at_ms", by_center(F.col("detections")).alias("_d")).withColumn("refused", frame_issue(F.col("_d"), policy))
    mark = F.flatten(F.transform("_d", lambda x: F.array(x["tile"].cast("double"), F.coalesce(x["red_five"], F.lit(False)).cast("double"), (x["l"] + x["r"]) / 2, (x["t"] + x["b"]) / 2, x["r"] - x["l"], x["b"] - x["t"])))
    return rows.select("stream_id", "seq", "captured_at_ms", "refused", F.size("_d").alias("n"), F.when(F.col("refused").isNull(), mark).alias("marks"))


# --- the order of frames: a fold ------------------------------------------------------------------------------------


def stands_still(now: np.ndarray, before: np.ndarray) -> bool:
    """Whether every detection (a row of marks) stands where it stood before."""
    move, size = np.abs(now[:, 2:4] - before[:, 2:4]), np.abs(now[:, 4:] - before[:, 4:]) / before[:, 4:]
    return bool((now[:, :2] == before[:, :2]).all() and (move < (MOST_DX, MOST_DY)).all() and (size < MOST_RESIZE).all())


@dataclass(frozen=True)
class Run:
    """Frames that agree: when the run began, how many there are, the marks of the first and of the last one."""

    since: int
    frames: int
    first: np.ndarray
    last: np.ndarray

    def takes(self, marks: np.ndarray) -> bool:
        return self.first.shape == marks.shape and stands_still(marks, self.last) and stands_still(marks, self.first)


@dataclass(frozen=True)
class State:
    """What a stream is remembered by: the time of its last frame, -1 for none, and the run that frame belongs to."""

    seen_at: int = -1
    run: Run | None = None

    def expired(self, now_ms: int, policy: Policy) -> bool:
        """Whether what was decided is stale at a time."""
        return self.seen_at >= 0 and not 0 <= now_ms - self.seen_at <= policy.expiry_ms


def advance(state: State, at_ms: int, refused: str | None, n: int, marks: np.ndarray | None, policy: Policy) -> tuple[State, tuple[str, int, int]]:
    """The state after one more judged frame, and the decision: issue, frames that agree, detections."""
    if at_ms < 0 or 0 <= at_ms <= state.seen_at:
        return State(), ("stale", 0, 0)
    if refused is not None:
        return State(at_ms), (refused, 0, n)
    marks = np.asarray(marks, float).reshape(n, -1)
    goes_on = state.run is not None and at_ms - state.seen_at <= policy.maximum_gap_ms and state.run.takes(marks)
    run = Run(state.run.since, state.run.frames + 1, state.run.first, marks) if goes_on else Run(at_ms, 1, marks, marks)
    enough = run.frames >= policy.required_frames and at_ms - run.since >= policy.minimum_span_ms
    return State(at_ms, run), ("stable" if enough else "collecting", run.frames, n)


JUDGED = ("seq", "captured_at_ms", "refused", "n", "marks")


def fold_frames(state: State, pdf: pd.DataFrame, policy: Policy) -> tuple[State, list[tuple]]:
    """Advance over judged frames in the order of rows: the last state, and (seq, captured_at_ms, issue, frames, detections) of each."""
    out = []
    for seq, at, refused, n, marks in zip(*[pdf[c] for c in JUDGED], strict=True):
        state, decision = advance(state, int(at), None if pd.isna(refused) else refused, int(n), marks, policy)
        out.append((seq, at, *decision))
    return state, out


def gate_batch(frames: DataFrame, policy: Policy) -> DataFrame:
    """A decision for each recorded frame. Streams are dealt by id and sorted by arrival; one batch of frames at a time is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, State()
        for pdf in batches:
            out: list[tuple] = []
            for stream, part in pdf.groupby("stream_id", sort=False):
                state, got = fold_frames(state if stream == now else State(), part, policy)
                now = stream
                out += [(stream, *x) for x in got]
            yield pd.DataFrame(out, columns=["stream_id", "seq", "captured_at_ms", "issue", "matched_frames", "observed_count"])

    return judged(frames, policy).repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(run, DECISION)


def throttle(rows: DataFrame, *, key: str, order: str, at: str, least_ms: int = 350) -> DataFrame:
    """Rows at least ``least_ms`` after the last accepted row of their key: greedy, so it can't be a tumbling window."""
    schema = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for pdf in batches:
            take = []
            for k, t in zip(pdf[key], pdf[at], strict=True):
                if k != now:
                    now, last = k, None
                take.append(last is None or t - last >= least_ms)
                last = t if take[-1] else last
            yield pdf[take]

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def shed(rows: DataFrame, *, key: str, order: str, at: str, busy: str) -> DataFrame:
    """Rows of each key that are taken while nothing else is at work: a row keeps its key busy for ``busy`` ms from its time on, and
    rows that come meanwhile are dropped, not queued."""
    schema = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, None
        for pdf in batches:
            take = []
            for k, t, work in zip(pdf[key], pdf[at], pdf[busy], strict=True):
                if k != now:
                    now, free = k, None
                take.append(free is None or t >= free)
                free = t + work if take[-1] else free
            yield pdf[take]

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def issue_counts(decisions: DataFrame, *keys: str) -> DataFrame:
    """Frames by issue, and the time of the first stable one."""
    return decisions.groupBy(*keys, "issue").agg(F.count("*").alias("frames"), F.min(F.when(F.col("issue") == "stable", F.col("captured_at_ms"))).alias("first_stable_ms"))
