"""The guards of a session: batch against a plain fold, and the stream over a restart against the batch."""

from __future__ import annotations

import random

from lumora.operators.session import EVENT, Guards, guard_batch
from lumora.streaming.gate import ROCKSDB
from lumora.streaming.session import guard_stream

GUARDS = Guards(least_ms=900, failures=2, confirm_ms=900, expiry_ms=1205)


def events(n, seed):
    rnd, at, out = random.Random(seed), 1000, []
    for seq in range(n):
        at += rnd.choice([50, 100, 400, 1500])
        kind = rnd.choice(["frame", "frame", "frame", "show", "click"])
        out.append((rnd.randrange(4), seq, at, kind, rnd.randrange(4) + seq // 40 if kind == "frame" else None, rnd.random() < 0.15 if kind == "frame" else None, rnd.randrange(3) if kind != "frame" else None))
    return out


def by_hand(rows, g):
    """Verdicts from the rules, each looked up in all that came before."""
    out, final = [], max(r[2] for r in rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        taken, shows = [], []
        for i, (_, seq, at, kind, generation, failed, item) in enumerate(mine):
            if i and at - mine[i - 1][2] > g.expiry_ms:
                out.append((key, None, mine[i - 1][2] + g.expiry_ms, "expired"))
            run = 0
            for _, f in taken:
                run = 0 if run < g.failures and not f else run + 1
            if run >= g.failures:
                out.append((key, seq, at, "stopped"))
            elif kind == "show":
                shows.append((item, at))
                out.append((key, seq, at, "shown"))
            elif kind == "click":
                out.append((key, seq, at, "accepted" if any(k == item and at - t <= g.confirm_ms for k, t in shows) else "refused"))
            elif any(r[3] == "frame" and r[4] > generation for r in mine[:i]):
                out.append((key, seq, at, "outdated"))
            elif taken and at - taken[-1][0] < g.least_ms:
                out.append((key, seq, at, "throttled"))
            else:
                taken.append((at, failed))
                out.append((key, seq, at, "taken"))
        if mine[-1][2] + g.expiry_ms < final:
            out.append((key, None, mine[-1][2] + g.expiry_ms, "expired"))
    return sorted(out, key=str)


def test_batch(spark):
    seen = set()
    for seed in (1, 2, 3):
        rows = events(150, seed)
        got = guard_batch(spark.createDataFrame(rows, EVENT).repartition(5), GUARDS).collect()
        want = by_hand(rows, GUARDS)
        assert sorted(map(tuple, got), key=str) == want
        seen |= {w[3] for w in want}
    assert seen == {"taken", "throttled", "outdated", "stopped", "expired", "shown", "accepted", "refused"}
    assert guard_batch(spark.createDataFrame([], EVENT), GUARDS).collect() == []


def test_stream_over_a_restart(spark, tmp_path):
    rows = events(200, 4)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for part in (rows[:70], rows[70:71], rows[71:]):  # each run goes on where the last one stopped
            spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = guard_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), GUARDS)
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == by_hand(rows, GUARDS)
