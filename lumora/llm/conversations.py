"""Repair of the structure of conversations by weighted finite-state composition.

Three machines are composed: the acceptor of a conversation's rows, the edit transducer (keep K 0, rerole to user or
assistant R 3, delete D 4, insert an empty user or assistant turn I 3; a truncated row that stays costs 3 more, blank and
duplicate rows must go) and the acceptor of the role grammar ``(s?(ua)+)?`` over role initials. A state of the composition is
(rows read, grammar state). It is expanded lazily, from the last row back, in topological order; inserts inside one position
are relaxed until nothing falls (two inserts lead back to the same grammar state, so no cheapest path has a cycle). Weights
are ordered by (cost, edits): the arcs of one state carry different labels, so of equal costs the one with the least label
has the least string, and only that label is kept. What one row does to a vector of weights depends on the vector's
differences alone; each such step is built once and remembered.

Rows of a conversation are taken by turn, nulls first, ties by role and text; null conversations are one conversation; null
roles and texts are one space. A role whose first letter is none of ``s``, ``u``, ``a``, or an empty role, can't be kept. Rows
that repeat are duplicates. A conversation of no rows has cost 0, an empty audit and the hash of an empty text. An empty table
gives an empty result. Texts may be of any length. Only the named columns are read, so others may have any name.

Ordinary conversations stream through sorted partitions, one conversation in memory at a time. Those of over ``long_rows``
rows are cut into segments of at most ``2 ** segment_bits`` rows: each segment gives its matrix of costs between grammar states, the
matrices of a conversation are composed from the end, each segment is then solved with its true weights, and the segments'
start states are followed from the front. Only the hash of the repaired text, which is one sequence by definition, streams
through one task, a row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import BROADCAST_IDS, cut, n_shuffle, release_after

#: The role grammar: arcs by role initial, and the states in which a conversation may end.
ARCS: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = frozenset({"su", "ua", "au"})
#: Costs of edits, and of a truncated row that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 40
BLANK_RE, CUT_RE = r"[^\x20\x09-\x0D]", r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
SEGMENT_BITS = 16
#: The arc that an inserted or reroled turn takes from each state: the grammar has one for user and assistant together.
_FORCED = tuple(next((r, to) for r, to in arcs.items() if r in ROLES) for arcs in ARCS)


def _inserts(weights: list[int]) -> list[int]:
    for _ in ARCS:
        weights = [min(w, INSERT + weights[_FORCED[q][1]]) for q, w in enumerate(weights)]
    return weights


def final_weights() -> tuple[int, ...]:
    """Costs from each grammar state to an end, after the last row."""
    return tuple(_inserts([0 if q in FINAL else NEVER for q in range(len(ARCS))]))


@lru_cache(maxsize=1 << 16)
def _step(initial: str, fault: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Weights before a row, given those after it, and the first edit of the best path of each grammar state."""
    extra = TRUNCATED if fault == "T" else 0
    ways = []
    for q, arcs in enumerate(ARCS):
        way = {"D": DELETE + after[q]}
        if fault not in ("B", "U"):
            way["R"] = REROLE + extra + after[_FORCED[q][1]]
            if initial in arcs:
                way["K"] = KEEP + extra + after[arcs[initial]]
        ways.append(way)
    before = _inserts([min(w.values()) for w in ways])
    first = []
    for q, way in enumerate(ways):
        way["I"] = INSERT + before[_FORCED[q][1]]
        first.append(min((cost, label) for label, cost in way.items())[1])
    return tuple(before), "".join(first)


def solve(rows: list[tuple[str, str]], ends: tuple[int, ...] | None = None) -> tuple[tuple[int, ...], list[str]]:
    """Weights before the first of ``rows`` (role initial, fault) and the first edits before each row. ``ends``: weights after them."""
    after = final_weights() if ends is None else tuple(ends)
    low, steps = 0, []
    for initial, fault in reversed(rows):
        least = min(after)
        low += least
        after, first = _step(initial, fault, tuple(min(w - least, NEVER) for w in after))
        steps.append(first)
    return tuple(min(low + w, NEVER) for w in after), steps[::-1]


def follow(rows: list[tuple[str, str]], steps: list[str], q: int = 0) -> tuple[str, int]:
    """The edits from grammar state ``q`` over all rows, and the state after them."""
    out = []
    for (initial, _), first in zip(rows, steps, strict=True):
        while (label := first[q]) == "I":
            out.append(label)
            q = _FORCED[q][1]
        out.append(label)
        q = q if label == "D" else ARCS[q][initial] if label == "K" else _FORCED[q][1]
    return "".join(out), q


def closing(q: int) -> str:
    """The inserts that end a conversation in state ``q``."""
    out = ""
    while q not in FINAL:
        out, q = out + "I", _FORCED[q][1]
    return out


def faults(text: Column) -> Column:
    """B for a text without any other character than white space, T for one whose last such character is none of ``.!?``, else empty."""
    return F.when(~text.rlike(BLANK_RE), "B").when(text.rlike(CUT_RE), "T").otherwise("")


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (``gone``), 1 empties its
    text, 2 removes ``.!?``, 3 repeats it, 4 sets the role user. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(space("text"), ".!?", "")).when(h == 0, "").otherwise(space("text"))
    kept = rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (h == 0).alias("gone"), F.when(h == 3, 2).otherwise(1).alias("_n"))
    return kept.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")


class _Report:
    """What is known of one conversation while its rows pass by."""

    def __init__(self, conv: object, turns: bool) -> None:
        self.conv, self.turns = conv, turns
        self.count = {"B": 0, "U": 0, "T": 0}
        self.illegal = self.cost = self.distinct = self.n = self.q = 0
        self.low = self.high = self.before = None
        self.audit: list[str] = []
        self.hash, self.out = hashlib.sha256(), []

    def _put(self, role: str, text: str, edit: str) -> None:
        self.hash.update((("\n" if self.n else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        if self.turns:
            self.out.append((self.conv, self.n, role, text, edit))
        self.n += 1

    def edits(self, labels: Iterator[str], role: str, text: str, fault: str) -> None:
        """Take from ``labels`` what comes before and at one row, and carry it out."""
        for label in labels:
            self.audit.append(label)
            forced, to = _FORCED[self.q]
            if label == "I":
                self.cost += INSERT
                self._put(ROLES[forced], "", label)
                self.q = to
                continue
            if label == "D":
                self.cost += DELETE
            else:
                self.cost += (KEEP if label == "K" else REROLE) + (TRUNCATED if fault == "T" else 0)
                self._put(role if label == "K" else ROLES[forced], text, label)
                self.q = ARCS[self.q][role[:1]] if label == "K" else to
            return

    def row(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL_PAIRS
        self.before = initial
        if fault:
            self.count[fault] += 1
        if turn is not None:
            self.distinct += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def end(self) -> tuple:
        self.edits(iter(closing(self.q)), "", "", "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, self.count["B"], self.count["U"], self.count["T"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_SUMMARY = ("gaps bigint", "blank bigint", "duplicate bigint", "truncated bigint", "illegal bigint", "cost bigint", "audit string", "repaired_sha256 string")
_TURNS = ("pos bigint", "role string", "text string", "edit string")


def _whole(conv: object, rows: list[tuple], turns: bool) -> _Report:
    """One conversation that fits in memory; rows (turn, role, text, fault) in order."""
    seen, marked = set(), []
    for turn, role, text, fault in rows:
        key = (role, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
        fault = fault if fault == "B" else "U" if key in seen else fault
        seen.add(key)
        marked.append((turn, role, text, fault))
    known = [(role[:1], fault) for _, role, _, fault in marked]
    labels = iter(follow(known, solve(known)[1])[0])
    rep = _Report(conv, turns)
    for turn, role, text, fault in marked:
        rep.row(turn, role, fault)
        rep.edits(labels, role, text, fault)
    return rep


def _stream(conv_type: pa.DataType, turns: bool, long: bool):  # noqa: ANN202
    """The function for ``mapInArrow`` over sorted rows (conv, turn, role, text, fault, gone, edits). ``long``: rows with
    edits come before the rows of their segment, and faults tell duplicates already."""
    schema = pa.schema([("conv_id", conv_type), *((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in (_TURNS if turns else _SUMMARY))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            nonlocal size
            cols = list(zip(*out, strict=True)) if out else [()] * len(schema)
            out.clear()
            size = 0
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def done(rep: _Report) -> None:
            nonlocal size
            summary = rep.end()
            add = rep.out if turns else [summary]
            out.extend(add)
            size += sum(len(x[-2]) for x in add) + 100 * len(add)

        began, conv, rows, rep, labels = False, None, [], None, iter("")
        for b in batches:
            for c, turn, role, text, fault, gone, edits in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not began or c != conv:
                    if began:
                        done(rep if long else _whole(conv, rows, turns))
                    began, conv, rows, rep = True, c, [], _Report(c, turns)
                if edits is not None:
                    labels = iter(edits)
                elif gone:
                    continue
                elif long:
                    rep.row(turn, role, fault)
                    rep.edits(labels, role, text, fault)
                    if turns and len(rep.out) >= 256:
                        out.extend(rep.out)
                        rep.out.clear()
                        yield batch()
                else:
                    rows.append((turn, role, text, fault))
                if size > 1 << 22:
                    yield batch()
        if began:
            done(rep if long else _whole(conv, rows, turns))
        yield batch()

    return release_after(run), schema


def _segments(rows: DataFrame, bits: int) -> DataFrame:
    """Long conversations as the rows that ``_stream`` reads, with the edits of each segment ahead of it."""
    n = n_shuffle(rows.sparkSession)
    none = F.lit("-")
    key = F.when(F.col("conv").isNull(), none).otherwise(F.concat(F.lit("="), F.col("conv").cast("string")))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.where("not gone").repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    table = cut(dealt.withColumns({"at": F.monotonically_increasing_id(), "key": key, "digest": F.sha2("text", 256)}).withColumn("seg", F.shiftright("at", bits)), "turns")
    first = table.groupBy("key", "role", "digest").agg(F.min("at").alias("first"))
    fault = F.when(F.col("fault") == "B", "B").when(F.col("at") > F.col("first"), "U").otherwise(F.col("fault"))
    table = cut(table.join(first, ["key", "role", "digest"]).withColumn("fault", fault).select("key", "seg", "at", "conv", "turn", "role", "text", "fault"), "faults")
    narrow = table.select("key", "seg", "at", F.substring("role", 1, 1).alias("initial"), "fault")

    def known(t: pa.Table) -> list[tuple[str, str]]:
        t = t.sort_by("at")
        return list(zip(t["initial"].to_pylist(), t["fault"].to_pylist(), strict=True))

    def matrix(t: pa.Table) -> pa.Table:
        cols = [solve(known(t), tuple(0 if q == to else NEVER for q in range(len(ARCS))))[0] for to in range(len(ARCS))]
        return pa.table({"key": t["key"][:1], "seg": t["seg"][:1], "costs": pa.array([[w for c in cols for w in c]], pa.list_(pa.int64()))})

    def ends(t: pa.Table) -> pa.Table:
        t = t.sort_by("seg")
        after, out = final_weights(), []
        for costs in reversed(t["costs"].to_pylist()):
            out.append(list(after))
            k = len(ARCS)
            after = tuple(min(min(costs[to * k + q] + after[to] for to in range(k)), NEVER) for q in range(k))
        return pa.table({"key": t["key"], "seg": t["seg"], "ends": pa.array(out[::-1], pa.list_(pa.int64()))})

    def ways(t: pa.Table, e: pa.Table) -> pa.Table:
        rows = known(t)
        steps = solve(rows, tuple(e["ends"][0].as_py()))[1]
        got = [follow(rows, steps, q) for q in range(len(ARCS))]
        return pa.table({"key": pa.array([t["key"][0].as_py()] * len(got)), "seg": pa.array([t["seg"][0].as_py()] * len(got), pa.int64()), "start": pa.array(range(len(got)), pa.int64()), "end": pa.array([q for _, q in got], pa.int64()), "edits": pa.array([s for s, _ in got])})

    def starts(t: pa.Table) -> pa.Table:
        moves = {(s, q): to for s, q, to in zip(*(t[c].to_pylist() for c in ("seg", "start", "end")), strict=True)}
        q, out = 0, []
        for s in sorted({s for s, _ in moves}):
            out.append((s, q))
            q = moves[s, q]
        return pa.table({"key": pa.array([t["key"][0].as_py()] * len(out)), "seg": pa.array([s for s, _ in out], pa.int64()), "start": pa.array([q for _, q in out], pa.int64())})

    after = narrow.groupBy("key", "seg").applyInArrow(matrix, "key string, seg bigint, costs array<bigint>").groupBy("key").applyInArrow(ends, "key string, seg bigint, ends array<bigint>")
    solved = cut(narrow.groupBy("key", "seg").cogroup(after.groupBy("key", "seg")).applyInArrow(ways, "key string, seg bigint, start bigint, end bigint, edits string"), "edits")
    taken = solved.select("key", "seg", "start", "end").groupBy("key").applyInArrow(starts, "key string, seg bigint, start bigint")
    chosen = solved.join(taken, ["key", "seg", "start"]).select("key", "seg", "edits")
    convs = table.groupBy("key").agg(F.first("conv").alias("conv"))
    ahead = chosen.join(convs, "key").select("key", "seg", F.lit(-1).cast("long").alias("at"), "conv", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("fault"), "edits")
    both = table.withColumn("edits", F.lit(None).cast("string")).unionByName(ahead)
    both = both.repartition(n, "key").sortWithinPartitions("key", "seg", "at")
    return both.select("conv", "turn", "role", "text", "fault", F.lit(False).alias("gone"), "edits")


def repair(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None, turns: bool = False, segment_bits: int = SEGMENT_BITS, long_rows: int = 1 << SEGMENT_BITS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with ``turns`` one per
    repaired turn: conv_id, pos (from 0), role, text, edit (K, R or I).

    Rows whose ``gone_col`` is true are no rows of their conversation, but it is returned still (without turns where it has none).
    Runs one job when called, which counts rows per conversation, and more where some have over ``long_rows``.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)).alias("gone"))
    given = given.withColumn("fault", faults(F.col("text")))
    id_type = rows.select(id_col).limit(0).toArrow().schema.field(0).type
    long = cut(given.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("gone")).alias("any")).where((F.col("n") > long_rows) & F.col("any")).select(F.col("conv").alias("long")), "long")
    n_long = long.count()
    long = F.broadcast(long) if n_long <= BROADCAST_IDS else long
    is_long = F.col("conv").eqNullSafe(F.col("long"))

    def out(part: DataFrame, split: bool) -> DataFrame:
        run, schema = _stream(id_type, turns, split)
        ddl = ", ".join([f"conv_id {rows.schema[id_col].dataType.simpleString()}", *(_TURNS if turns else _SUMMARY)])
        return part.mapInArrow(run, ddl)

    short = given.join(long, is_long, "left_anti") if n_long else given
    sorted_rows = short.repartition(n_shuffle(rows.sparkSession), "conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    done = out(sorted_rows.select("conv", "turn", "role", "text", "fault", "gone", F.lit(None).cast("string").alias("edits")), False)
    return done.unionByName(out(_segments(given.join(long, is_long, "left_semi"), segment_bits), True)) if n_long else done


def oracle() -> str:
    """DuckDB SQL of ``op11_conversations``: the damage with its crc32, the faults, and the recursion over rows from the last one
    back with the cost and the whole edit string of each grammar state, compared as (cost, string)."""
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    bit = "lambda c, b: CASE WHEN b < 0 THEN xor(c, -b - 1) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"xor(list_reduce(flatten(list_transform(string_split({key}, ''), lambda x: [-CAST(ascii(x) AS BIGINT) - 1, 0, 0, 0, 0, 0, 0, 0, 0])), {bit}, 4294967295), 4294967295)"
    inf = 1 << 40
    nxt = ("u", "u", "a", "u")
    name = "nsua"  # states: nothing yet, after s, after u, after a
    pen = "CASE WHEN fault = 'T' THEN 3 ELSE 0 END"
    stays = "fault NOT IN ('B', 'U')"

    def weight(cost: str, label: str, state: str) -> str:
        return f"{{'c': {cost} + w.{state}.c, 'e': '{label}' || w.{state}.e}}"

    def never() -> str:
        return f"{{'c': CAST({inf} AS BIGINT), 'e': ''}}"

    own = []
    for i, s in enumerate(name):
        ways = [weight("4", "D", s), f"CASE WHEN {stays} THEN {weight(f'3 + {pen}', 'R', nxt[i])} ELSE {never()} END"]
        ways += [f"CASE WHEN {stays} AND initial = '{r}' THEN {weight(pen, 'K', to)} ELSE {never()} END" for r, to in {"n": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[s].items()]
        own.append(f"list_min([{', '.join(ways)}]) AS {s}")
    ins = lambda src, s, to: f"{{'c': 3 + {src}.{to}.c, 'e': 'I' || {src}.{to}.e}}"
    two = lambda src, s, a, b: f"{{'c': 6 + {src}.{b}.c, 'e': 'II' || {src}.{b}.e}}"
    closed = ", ".join([f"list_min([o.n, {ins('o', 'n', 'u')}, {two('o', 'n', 'u', 'a')}]) AS n", f"list_min([o.s, {ins('o', 's', 'u')}, {two('o', 's', 'u', 'a')}]) AS s", f"list_min([o.u, {ins('o', 'u', 'a')}]) AS u", f"list_min([o.a, {ins('o', 'a', 'u')}]) AS a"])
    return f"""
WITH RECURSIVE hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged),
marked AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'B' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'U' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'T' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, max(i) OVER (PARTITION BY conv_id) AS n FROM placed),
w AS (
  SELECT conv_id, n + 1 AS i, {{'c': CAST(0 AS BIGINT), 'e': ''}} AS n, {{'c': CAST(6 AS BIGINT), 'e': 'II'}} AS s, {{'c': CAST(3 AS BIGINT), 'e': 'I'}} AS u, {{'c': CAST(0 AS BIGINT), 'e': ''}} AS a
  FROM (SELECT DISTINCT conv_id, n FROM marked)
  UNION ALL
  SELECT conv_id, i, {closed} FROM (SELECT m.conv_id, m.i, {', '.join(own)} FROM w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i - 1) o),
best AS (SELECT conv_id, w.n.c AS cost, w.n.e AS audit FROM w WHERE i = 1),
steps AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS spot FROM best),
placed_steps AS (
  SELECT conv_id, spot, substr(audit, spot, 1) AS edit, spot - length(replace(substr(audit, 1, spot), 'I', '')) AS inserts, length(replace(substr(audit, 1, spot), 'D', '')) AS pos FROM steps),
turned AS (
  SELECT p.conv_id, p.spot, p.edit, p.pos, m.role, coalesce(m.text, '') AS text,
    first_value(CASE WHEN p.edit = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id ORDER BY p.spot) AS has_system
  FROM placed_steps p LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND p.edit <> 'I' AND m.i = p.spot - p.inserts WHERE p.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (pos - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS text
  FROM turned GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'U') AS duplicate,
    count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""
