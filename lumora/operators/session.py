"""The guards of a camera session, one after another, over the events of each key in their order: as a batch fold.

Kinds of events: ``frame`` (with a generation and whether it failed), ``show`` and ``click`` (of an item). Their verdicts:

* any event after ``failures`` failed frames in a row that were taken: ``stopped``;
* a frame of an older generation than the newest so far: ``outdated``; one less than ``least_ms`` after the last one that was taken:
  ``throttled``; another one: ``taken``;
* a click on what was shown at most ``confirm_ms`` before: ``accepted``, else ``refused``; a show: ``shown``;
* where a key is quiet for ``expiry_ms``: a row without ``seq`` at that time, ``expired``.

``fence``, ``confirm`` and ``stop_after`` are the single guards as window expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVENT = "key bigint, seq bigint, at_ms bigint, kind string, generation bigint, failed boolean, item bigint"
VERDICT = "key bigint, seq bigint, at_ms bigint, verdict string"


@dataclass(frozen=True)
class Guards:
    least_ms: int = 350
    failures: int = 3
    confirm_ms: int = 5000
    expiry_ms: int = 1200


@dataclass
class Session:
    """What is known of a key: fixed-size, but for the items shown within ``confirm_ms``."""

    newest: int | None = None
    taken_at: int | None = None
    last_at: int | None = None
    failed: list[int] = field(default_factory=list)
    shown: dict[int, int] = field(default_factory=dict)

    def step(self, g: Guards, seq: int, at: int, kind: str, generation: int | None, failed: bool | None, item: int | None) -> list[tuple[int | None, int, str]]:
        """Verdicts (seq, at_ms, verdict) of one event, and before it of a quiet time that it ends."""
        out: list[tuple[int | None, int, str]] = []
        if self.last_at is not None and at - self.last_at > g.expiry_ms:
            out.append((None, self.last_at + g.expiry_ms, "expired"))
        self.last_at = at
        self.shown = {k: t for k, t in self.shown.items() if at - t <= g.confirm_ms}
        if len(self.failed) >= g.failures:
            verdict = "stopped"
        elif kind == "show":
            self.shown[item] = at
            verdict = "shown"
        elif kind == "click":
            verdict = "accepted" if item in self.shown else "refused"
        elif self.newest is not None and generation < self.newest:
            verdict = "outdated"
        else:
            self.newest = generation
            if self.taken_at is not None and at - self.taken_at < g.least_ms:
                verdict = "throttled"
            else:
                self.taken_at, verdict = at, "taken"
                self.failed = [*self.failed, at] if failed else []
        return [*out, (seq, at, verdict)]


def guard_batch(events: DataFrame, guards: Guards) -> DataFrame:
    """Verdicts on a table of ``EVENT``, each key's events in order of ``seq``, streamed through sorted partitions: one Arrow batch and one
    session are held. A key's last quiet time counts if the table's last event is later still. Null keys are one."""
    last = events.agg(F.max("at_ms")).first()[0]
    names = ["key", "seq", "at_ms", "kind", "generation", "failed", "item"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, session, began = None, Session(), False

        def quiet() -> list[tuple]:
            late = session.last_at is not None and session.last_at + guards.expiry_ms < last
            return [(now, None, session.last_at + guards.expiry_ms, "expired")] if late else []

        for pdf in batches:
            out = []
            for key, seq, at, kind, generation, failed, item in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                if not began or key != now:
                    out += quiet() if began else []
                    now, session, began = key, Session(), True
                out += [(key, *v) for v in session.step(guards, seq, at, kind, generation, failed, item)]
            yield _frame(out)
        if began:
            yield _frame(quiet())

    return events.select(*names).repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, VERDICT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "seq", "at_ms", "verdict"]).astype({"key": "Int64", "seq": "Int64", "at_ms": "Int64"})


def fence(rows: DataFrame, *, key: str, order: str, generation: str) -> DataFrame:
    """Rows of the newest generation of their key so far; those of an older one are dropped."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_newest", F.max(generation).over(w)).where(F.col(generation) == F.col("_newest")).drop("_newest")


def confirm(rows: DataFrame, *, key: str, order: str, at: str, shown: Column, click: Column, within: int) -> DataFrame:
    """Clicks with ``accepted``: whether what the key's row before showed is what this one shows, and not too old."""
    w = Window.partitionBy(key).orderBy(order)
    s = rows.withColumns({"_shown": shown, "_before": F.lag(shown).over(w), "_at": F.lag(at).over(w), "_click": click})
    return s.where("_click").withColumn("accepted", F.coalesce((F.col("_before") == F.col("_shown")) & (F.col(at) - F.col("_at") <= within), F.lit(False))).drop("_shown", "_before", "_at", "_click")


def stop_after(rows: DataFrame, *, key: str, order: str, failed: Column, failures: int = 3) -> DataFrame:
    """The row of each key at which its failures in a row reach a number: key, stopped_at. A success starts the count anew."""
    by = Window.partitionBy(key).orderBy(order)
    g = rows.withColumn("_failed", failed).withColumn("_run", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(by))
    r = g.withColumn("_n", F.count(F.when(F.col("_failed"), 1)).over(Window.partitionBy(key, "_run").orderBy(order)))
    return r.where(F.col("_n") >= failures).groupBy(key).agg(F.min(order).alias("stopped_at"))


def quiet_polls(rows: DataFrame, *, key: str, order: str, at: str, expiry: int, every: int) -> DataFrame:
    """The first poll, every so many ms, that finds a key's row older than ``expiry``, where no other row came before: adds ``poll``."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumns({"_next": following, "poll": (F.floor((F.col(at) + expiry) / every) + 1) * every}).where("_next IS NULL OR _next > poll").drop("_next")
