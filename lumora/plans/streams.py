"""Queries on ordered streams: the agreement gate, throttling, intervals, sampling and stages of logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.operators.consensus import Policy, by_center, can_confirm, frame_issue, gate_batch, issue_counts, throttle
from lumora.operators.session import Guards, guard_batch
from lumora.operators.shared import cut, forget, shared_dir
from lumora.plans.base import register, table
from lumora.streaming.gate import ROCKSDB, gate_stream
from lumora.streaming.session import guard_stream

QUERIES: dict = {}

_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
# Events of a user as frames of two detections: a frame every second, now and then a gap or a late one; another tile, no second
# box, a fifth copy's worth of unknown tile, a second box that is lower or overlaps the first.
_POLICY = Policy(expected_count=2, required_frames=3, minimum_span_ms=2000, maximum_gap_ms=1500, expiry_ms=1200, minimum_confidence=0.3)
_DETECTIONS = """
WITH f AS (
  SELECT user_id AS stream_id, event_id AS seq, CAST(n * 1000 + CASE WHEN event_id % 11 = 0 THEN 1200 ELSE 0 END - CASE WHEN event_id % 13 = 0 THEN 2500 ELSE 0 END AS BIGINT) AS ms,
         CASE WHEN event_id % 17 = 0 THEN 5 ELSE user_id % 34 END AS tile1, CASE WHEN event_id % 31 = 0 THEN 40 ELSE (user_id + 1) % 34 END AS tile2,
         CAST(event_id % 20 AS DOUBLE) / 20 + CAST(0.1 AS DOUBLE) AS conf, CAST(event_id % 3 AS DOUBLE) / 100 + CAST(0.4 AS DOUBLE) AS x1,
         CAST(event_id % 3 AS DOUBLE) / 100 + CAST(0.4 AS DOUBLE) + CASE WHEN event_id % 23 = 0 THEN CAST(0.02 AS DOUBLE) ELSE CAST(0.06 AS DOUBLE) END AS x2,
         CASE WHEN event_id % 29 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS t2, CASE WHEN event_id % 19 = 0 THEN 0 WHEN event_id % 37 = 0 THEN 1 ELSE 2 END AS boxes
  FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events))"""


def _frames(spark, d):
    rows = spark.sql(_DETECTIONS.replace("FROM events)", "FROM {events})") + " SELECT * FROM f", events=table(spark, d, "events"))

    def box(tile, conf, x, t):
        return F.struct(F.col(tile).cast("int").alias("tile"), conf.alias("confidence"), F.col(x).alias("l"), t.alias("t"), (F.col(x) + 0.05).alias("r"), (t + 0.3).alias("b"), F.lit(False).alias("red_five"))

    both = F.array(box("tile2", F.lit(0.9), "x2", F.col("t2")), box("tile1", F.col("conf"), "x1", F.lit(0.3)))  # not in order
    return rows.select("stream_id", "seq", F.col("ms").alias("captured_at_ms"), F.slice(both, F.when(F.col("boxes") == 1, 2).otherwise(1), F.col("boxes")).alias("detections"))


# Judged frames; of the two boxes the first is the left one.
_JUDGED = _DETECTIONS + """,
m AS (SELECT *, greatest(0, least(x1, x2) + 0.05::DOUBLE - greatest(x1, x2)) * greatest(0, least(0.6::DOUBLE, t2 + 0.3::DOUBLE) - greatest(0.3::DOUBLE, t2)) AS shared FROM f),
q AS (SELECT *, CASE WHEN boxes = 0 THEN 'empty' WHEN boxes <> 2 THEN 'count' WHEN conf < 0.3::DOUBLE OR conf > 1 THEN 'confidence' WHEN tile1 > 33 OR tile2 > 33 THEN 'physical'
        WHEN abs(t2 - 0.3::DOUBLE) > 0.5 * 0.3::DOUBLE THEN 'arrangement' WHEN shared / (2 * 0.05::DOUBLE * 0.3::DOUBLE - shared) > 0.15::DOUBLE THEN 'arrangement' END AS refused,
        row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM m)"""

_GATE_SQL = _JUDGED.replace("WITH f", "WITH RECURSIVE f") + """,
g AS (
  SELECT q.stream_id, 0::BIGINT AS n, 0::BIGINT AS seq, 0::BIGINT AS ms, '' AS issue, 0 AS cnt, 0 AS obs, -1::BIGINT AS last_at, 0::BIGINT AS first_at, NULL::BIGINT AS p1, NULL::BIGINT AS p2, NULL::DOUBLE AS px, NULL::DOUBLE AS ax FROM (SELECT DISTINCT stream_id FROM q) q
  UNION ALL
  SELECT stream_id, n, seq, ms,
    CASE WHEN stale THEN 'stale' WHEN refused IS NOT NULL THEN refused WHEN (CASE WHEN same THEN cnt ELSE 0 END) + 1 >= 3 AND ms - (CASE WHEN same THEN first_at ELSE ms END) >= 2000 THEN 'stable' ELSE 'collecting' END,
    CASE WHEN stale OR refused IS NOT NULL THEN 0 WHEN same THEN cnt + 1 ELSE 1 END, CASE WHEN stale THEN 0 ELSE boxes END,
    CASE WHEN stale THEN -1 ELSE ms END, CASE WHEN stale OR refused IS NOT NULL THEN 0 WHEN same THEN first_at ELSE ms END,
    CASE WHEN stale OR refused IS NOT NULL THEN NULL ELSE tile1 END, CASE WHEN stale OR refused IS NOT NULL THEN NULL ELSE tile2 END,
    CASE WHEN stale OR refused IS NOT NULL THEN NULL ELSE x1 END, CASE WHEN stale OR refused IS NOT NULL THEN NULL WHEN same THEN ax ELSE x1 END
  FROM (SELECT q.*, g.cnt, g.first_at, g.ax, q.ms < 0 OR (g.last_at >= 0 AND q.ms <= g.last_at) AS stale,
          coalesce(g.p1 = q.tile1 AND g.p2 = q.tile2 AND q.ms - g.last_at <= 1500 AND abs(q.x1 - g.px) < 0.025 AND abs(q.x1 - g.ax) < 0.025, false) AS same
        FROM g JOIN q ON q.stream_id = g.stream_id AND q.n = g.n + 1) s),
r AS (SELECT stream_id, seq, ms AS captured_at_ms, issue, CAST(cnt AS INT) AS matched_frames, CAST(obs AS INT) AS observed_count FROM g WHERE n > 0)"""


@register(QUERIES, _JUDGED + " SELECT stream_id, seq, refused, boxes = 2 AND tile1 < 34 AND tile2 < 34 AND conf <= 1 AS can_confirm FROM q")
def frame_quality(spark, d):
    """The first reason to refuse a frame by itself, and whether a person may confirm it."""
    det = by_center(F.col("detections"))
    return _frames(spark, d).withColumn("d", det).select("stream_id", "seq", frame_issue(F.col("d"), _POLICY).alias("refused"), can_confirm(F.col("d"), 2).alias("can_confirm"))


@register(QUERIES, _GATE_SQL + " SELECT * FROM r")
def gate_decisions(spark, d):
    return gate_batch(_frames(spark, d), _POLICY)


@register(QUERIES, _GATE_SQL + " SELECT stream_id, issue, count(*) AS frames, min(CASE WHEN issue = 'stable' THEN captured_at_ms END) AS first_stable_ms FROM r GROUP BY ALL")
def gate_issue_counts(spark, d):
    return issue_counts(gate_batch(_frames(spark, d), _POLICY), "stream_id")


@register(QUERIES, _GATE_SQL + " SELECT * FROM r")
def gate_stream_decisions(spark, d):
    """The same decisions from the streaming operator, replayed from files."""
    folder = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    forget(spark, folder)
    frames = cut(_frames(spark, d), "frames")
    path = frames.inputFiles()[0].rsplit("/", 1)[0]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = gate_stream(spark.readStream.schema(frames.schema).parquet(path), _POLICY)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/out")


@register(QUERIES, """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
t AS (SELECT user_id, event_id, ms, n, ms AS last, true AS taken FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.ms, e.n, CASE WHEN e.ms - t.last >= 3600000 THEN e.ms ELSE t.last END, e.ms - t.last >= 3600000 FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
SELECT user_id, event_id, ms FROM t WHERE taken""")
def throttled_events(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.expr(_MS).alias("ms"))
    return throttle(rows, key="user_id", order="event_id", at="ms", least_ms=3_600_000)


# Half-open intervals of each user: the hour after each purchase.
@register(QUERIES, "SELECT e.event_id FROM events e WHERE e.event_type <> 'purchase' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts AND e.ts < p.ts + INTERVAL 6 HOUR)")
def interval_membership(spark, d):
    """An event is in one of its user's intervals if it is in the latest that began: a window, not a range join."""
    e = table(spark, d, "events")
    begun = F.last(F.when(F.col("event_type") == "purchase", F.col("ts")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
    return e.withColumn("s", begun).where("event_type <> 'purchase' and s is not null and ts < s + interval 6 hours").select("event_id")


@register(QUERIES, "WITH l AS (SELECT user_id, ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events) SELECT user_id, count(CASE WHEN bad THEN 1 END) AS breaks FROM l GROUP BY user_id")
def monotonic_check(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").withColumn("bad", F.col("ts") <= F.lag("ts").over(w)).groupBy("user_id").agg(F.count_if("bad").alias("breaks"))


@register(QUERIES, "WITH k AS (SELECT CAST(floor(range * 25.0::DOUBLE / 2 + 0.5::DOUBLE) AS BIGINT) AS f FROM range((SELECT max(event_id) FROM events) + 1)) SELECT event_id FROM events WHERE event_id IN (SELECT f FROM k)")
def frame_sampling(spark, d):
    """Two frames a second of a 25-frame stream: frame i is taken if it is half-up rounded from some multiple of 12.5."""
    i = F.col("event_id")
    k = F.floor(i * 2 / 25)
    on = lambda n: F.floor(n * 25.0 / 2 + 0.5) == i
    return table(spark, d, "events").where(on(k) | on(k + 1)).select("event_id")


@register(QUERIES, "WITH s AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS stage FROM conversations) SELECT conv_id, stage, count(*) AS lines, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers FROM s GROUP BY ALL")
def log_stage_counts(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "conversations").withColumn("stage", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w))
    return rows.groupBy("conv_id", "stage").agg(F.count("*").alias("lines"), F.count_if(F.col("role") == "assistant").alias("answers"))


@register(QUERIES, r"SELECT conv_id, turn, regexp_extract(text, '^(\S+)\s', 1) AS first_word, len(string_split(text, chr(10))) AS lines FROM conversations")
def log_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract("text", r"^(\S+)\s", 1).alias("first_word"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"))


@register(QUERIES, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id")
def inactivity_sessions(spark, d):
    s = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


# Events of a user as those of a camera session: frames, and what is shown and clicked.
_GUARDS = Guards(least_ms=9000, failures=3, confirm_ms=40_000, expiry_ms=61_235)
_SESSION = """
WITH e AS (SELECT user_id AS key, event_id AS seq, event_id * 130 + 130 AS at_ms, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'show' ELSE 'frame' END AS kind,
  CAST(floor(value) AS BIGINT) % 3 + event_id * 130 // 300000 AS generation, event_type = 'error' OR event_id % 3 = 0 AS failed, event_id % 2 AS item FROM events)"""
_GUARD_SQL = _SESSION.replace("WITH e", "WITH RECURSIVE e") + f""", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, lag(at_ms) OVER (PARTITION BY key ORDER BY seq) AS before, lead(at_ms) OVER (PARTITION BY key ORDER BY seq) AS after, max(at_ms) OVER () AS final FROM e),
f AS (SELECT *, coalesce(generation < max(CASE WHEN kind = 'frame' THEN generation END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS outdated,
  coalesce(at_ms - max(CASE WHEN kind = 'show' THEN at_ms END) OVER (PARTITION BY key, item ORDER BY seq) <= {_GUARDS.confirm_ms}, false) AS seen FROM n),
s AS (SELECT key, 0 AS n, CAST(NULL AS BIGINT) AS taken_at, 0 AS failures, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS at_ms, '' AS verdict FROM (SELECT DISTINCT key FROM f)
  UNION ALL SELECT key, n, CASE WHEN verdict = 'taken' THEN at_ms ELSE taken_at END, CASE WHEN verdict <> 'taken' THEN failures WHEN failed THEN failures + 1 ELSE 0 END, seq, at_ms, verdict FROM (
    SELECT f.*, s.taken_at, s.failures, CASE WHEN s.failures >= {_GUARDS.failures} THEN 'stopped' WHEN kind = 'show' THEN 'shown' WHEN kind = 'click' THEN CASE WHEN seen THEN 'accepted' ELSE 'refused' END WHEN outdated THEN 'outdated'
      WHEN f.at_ms - s.taken_at < {_GUARDS.least_ms} THEN 'throttled' ELSE 'taken' END AS verdict FROM s JOIN f ON f.key = s.key AND f.n = s.n + 1))
SELECT key, seq, at_ms, verdict FROM s WHERE n > 0 UNION ALL SELECT key, NULL, before + {_GUARDS.expiry_ms}, 'expired' FROM n WHERE at_ms - before > {_GUARDS.expiry_ms}
UNION ALL SELECT key, NULL, at_ms + {_GUARDS.expiry_ms}, 'expired' FROM n WHERE after IS NULL AND at_ms + {_GUARDS.expiry_ms} < final"""


def _session_events(spark, d):
    return spark.sql(_SESSION.replace("FROM events)", "FROM {events})").replace("//", "DIV") + " SELECT * FROM e", events=table(spark, d, "events"))


@register(QUERIES, _GUARD_SQL)
def session_verdicts(spark, d):
    """What a session's guards, one after another, say of each event."""
    return guard_batch(_session_events(spark, d), _GUARDS)


@register(QUERIES, _GUARD_SQL)
def session_stream_verdicts(spark, d):
    """The same verdicts from the streaming operator, replayed from files."""
    folder = f"{shared_dir(spark)}/session-{uuid.uuid4().hex}"
    forget(spark, folder)
    events = cut(_session_events(spark, d).coalesce(1), "events")
    path = events.inputFiles()[0].rsplit("/", 1)[0]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = guard_stream(spark.readStream.schema(events.schema).parquet(path), _GUARDS)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/out")
