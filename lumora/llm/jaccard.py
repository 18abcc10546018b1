"""N-gram Jaccard join: linked groups of documents by rare-first prefix filtering.

A document's set is its distinct word shingles. Two documents link when ``den * shared >= num * union``.
Steps, each over all documents:

1. One pass hashes the sets and gives each document its size, a 128-bit signature of the set, a profile (how
   many shingles fall in each of 256 classes of the hash) and, from each task, a count sketch of shingles. The
   sketch has a fixed size. It orders shingles rare first; any fixed order gives exact results.
2. Documents with equal sets form a group; its smallest id stands for it.
3. A second pass writes the prefix of each set in that order (as long as needed for two linked sets to share a
   shingle of both prefixes), once for each set and task.
4. Prefix rows are dealt by shingle and sorted by size. Pairs of a bucket pass the length filter and the
   positional filter. In a bucket of up to ``SMALL`` rows all pairs are candidates; in a larger one, the pairs of
   its first rows, and those of the others with its first row.
5. Candidates are mapped to the groups' ids and made distinct, so each pair is verified once. The suffix filter
   drops pairs whose profiles differ too much, before any set is sent.
6. The sets of documents that are left in pairs are hashed again (chosen by a Bloom filter of their ids) and
   compared: the second set of a pair goes to the first, and a first one with many pairs is dealt to several tasks.
7. Links give components. In larger buckets that still hold more than one component, pairs of different
   components that pass all filters are candidates: first one for each row and other component, then, with the
   components these links give, all that are left. Nothing is capped, and pairs inside a component need no check.

Nulls and odd rows: a null or empty text, or one without words, has an empty set and links with nothing. A text
with fewer than ``k`` words has its whole sequence as its one shingle. Rows with a null id link with nothing and
get a null component. Rows may repeat. An id with different texts is one document: each of its texts is compared as a node
of its own, under a number from 2**62 on, and linked with the id; ids are taken to be less than that. Very long texts are
blocks of their own. An empty table gives an empty result. Extra columns are ignored.

What rests on hashes: a shingle is 64 bits and a set's signature 128 bits, so two different shingles or sets are taken for one with
a chance of 2**-64 or 2**-128 a pair; nothing else can make a result differ from the exact one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import BROADCAST_IDS, batch_rows, cut, long_batches, mix, release_after, n_shuffle, small_batches, text_blocks
from lumora.llm.components import components
from lumora.llm.shingles import shingle_sets

SKETCH_BITS = 20
_CHUNKS = 64
SMALL = 16
_RANGES = 256
NARROW_ROWS = 50_000
_BLOCK_MEMBERS = 512
_PAIRS_A_TASK = 512
_SALTS = 16
#: Bits of the Bloom filter: 16 for each id, between these bounds. For more ids the texts are joined with them by a shuffle.
_BLOOM = (1 << 16, 1 << 27)

_PAIR = "a bigint, b bigint, na int, nb int"


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (id, n, s1, s2, profile) and of sketches (chunk, counts) in one table."""
    schema = "id bigint, n int, s1 bigint, s2 bigint, profile binary, chunk int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        out_schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("profile", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])
        with np.errstate(over="ignore"):
            for b in batches:
                sets = [s for _, d, o in text_blocks(b.column(1)) for s in shingle_sets(d, o, k)]
                s1 = np.array([np.add.reduce(mix(s)) for s in sets], np.uint64).view(np.int64)
                s2 = np.array([np.add.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))) for s in sets], np.uint64).view(np.int64)
                profile = [np.minimum(np.bincount((s & np.uint64(_RANGES - 1)).astype(np.int64), minlength=_RANGES), 255).astype(np.uint8).tobytes() for s in sets]
                np.add.at(sketch, _slots(np.concatenate(sets)), 1)
                n = len(sets)
                yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(s1), pa.array(s2), pa.array(profile, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=out_schema)
        parts = [x.tobytes() for x in sketch.reshape(_CHUNKS, -1)]
        none = [pa.nulls(_CHUNKS, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.record_batch([*none, pa.array(range(_CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=out_schema)

    return docs.mapInArrow(release_after(run), schema)


def _sum_sketches(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: each chunk is added up as it streams by, two levels deep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.int32)
                total[c] = total[c] + x if c in total else x.astype(np.int64)
        out = [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    some = rows.select("chunk", "counts").repartition(_CHUNKS, "chunk", F.pmod(F.xxhash64("counts"), F.lit(8))).mapInArrow(release_after(run), kind)
    out = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.int32)
    for r in some.repartition(_CHUNKS // 4, "chunk").mapInArrow(release_after(run), kind).collect():  # 4 MB in all
        out[r["chunk"]] += np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def _prefixes(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held.value
        seen: set[bytes] = set()  # sets of this task: 16 bytes for each of its documents
        for b in batches:
            ids = b.column(0).to_pylist()
            cols: list[list[np.ndarray]] = [[], [], [], []]
            at = 0
            with np.errstate(over="ignore"):
                for _, d, o in text_blocks(b.column(1)):
                    for s in shingle_sets(d, o, k):
                        i, n = ids[at], len(s)
                        at += 1
                        if not n:
                            continue
                        key = np.array([np.add.reduce(mix(s)), np.add.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))]).tobytes()
                        if key in seen:
                            continue
                        seen.add(key)
                        size = n - -(-num * n // den) + 1
                        est = count[_slots(s)]
                        if size < n:
                            cut_at = np.partition(est, size - 1)[size - 1]
                            low = np.flatnonzero(est <= cut_at)
                            first = low[np.lexsort((s[low], est[low]))][:size]
                        else:
                            first = np.lexsort((s, est))
                        cols[0].append(s[first].view(np.int64))
                        cols[1].append(np.full(len(first), i, np.int64))
                        cols[2].append(np.full(len(first), n, np.int32))
                        cols[3].append(np.arange(len(first), dtype=np.int32))
            if cols[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in cols], names=["h", "id", "n", "pos"])

    return docs.mapInArrow(release_after(run), "h bigint, id bigint, n int, pos int")


def _filters(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length and positional filter of pairs that share the shingles at positions ``pa_`` and ``pb``."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (most * (den + num) >= num * (na + nb))


def _first_pairs(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, na, nb), and the rows of larger buckets (h, a their id, na their size, nb their position), from
    rows sorted by shingle and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # the last rows of the batch before: SMALL of them, their ranks and the first row of their bucket
        for b in long_batches(batches, NARROW_ROWS):
            h, i, n, p = (b.column(c).to_numpy() for c in range(4))
            m = len(h)
            new = np.ones(m, bool)
            new[1:] = h[1:] != h[:-1]
            if tail is not None and tail["h"][-1] == h[0]:
                new[0] = False
            starts = np.flatnonzero(new)
            rank = np.arange(m)
            first = np.maximum.accumulate(np.where(new, np.arange(m), -1))
            rank -= np.maximum(first, 0)
            fi, fn, fp = i[np.maximum(first, 0)], n[np.maximum(first, 0)], p[np.maximum(first, 0)]
            open_ = starts[0] if len(starts) else m  # rows that go on with the bucket before
            if open_:
                rank[:open_] += int(tail["rank"][-1]) + 1
                fi[:open_], fn[:open_], fp[:open_] = tail["first"]
            last_first = (fi[-1], fn[-1], fp[-1])
            if tail is not None:
                h2, i2, n2, p2 = (np.concatenate([tail[c], x]) for c, x in zip("hinp", (h, i, n, p), strict=True))
                rank2 = np.concatenate([tail["rank"], rank])
            else:
                h2, i2, n2, p2, rank2 = h, i, n, p, rank
            t = len(h2) - m
            got = []
            for lag in range(1, SMALL):
                x = np.arange(max(t, lag), len(h2))
                x = x[h2[x] == h2[x - lag]]
                if not len(x):
                    break
                x = x[rank2[x] < SMALL]
                y = x - lag
                x, y = (z[_filters(n2[y], p2[y], n2[x], p2[x], num, den)] for z in (x, y))
                got.append((i2[y], i2[x], n2[y], n2[x]))
            far = np.flatnonzero(rank >= SMALL)
            far = far[_filters(fn[far], fp[far], n[far], p[far], num, den)]
            got.append((fi[far], i[far], fn[far], n[far]))
            full = np.flatnonzero(rank2 == SMALL)
            full = full[full >= t]  # a bucket turns out to be larger: its first rows are among the last ones
            large = np.concatenate([(full[:, None] - np.arange(SMALL, 0, -1)[None]).ravel(), np.flatnonzero(rank2 >= SMALL)[np.flatnonzero(rank2 >= SMALL) >= t]]).astype(np.int64)
            cols = [np.concatenate(c) for c in zip(*got, strict=True)]
            pairs = np.unique(np.stack([c.astype(np.int64) for c in cols], 1), axis=0) if len(cols[0]) else np.zeros((0, 4), np.int64)
            rows = [(pairs[:, 0], i2[large]), (pairs[:, 1], np.zeros(len(large), np.int64)), (pairs[:, 2], n2[large]), (pairs[:, 3], p2[large]), (np.zeros(len(pairs), np.int64), h2[large])]
            is_pair = np.concatenate([np.ones(len(pairs), bool), np.zeros(len(large), bool)])
            a, b_, na, nb, hh = (np.concatenate(x) for x in rows)
            yield pa.record_batch([pa.array(a), pa.array(b_, mask=~is_pair), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), pa.array(hh, mask=is_pair)], names=["a", "b", "na", "nb", "h"])
            keep = slice(max(0, len(h2) - SMALL), None)
            tail = {"h": h2[keep], "i": i2[keep], "n": n2[keep], "p": p2[keep], "rank": rank2[keep], "first": last_first}

    dealt = prefixes.repartition(n_shuffle(prefixes.sparkSession), "h").sortWithinPartitions("h", "id")
    return dealt.mapInArrow(release_after(run), f"{_PAIR}, h bigint")


def _canonical(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of groups' ids, a the smaller set's, each once."""
    for c in ("a", "b"):
        pairs = pairs.join(members.select(F.col("id").alias(c), F.col("rep").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    turn = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    pairs = pairs.where("a != b").select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb"))
    return pairs.distinct()


def _apart(x: list[bytes] | np.ndarray, y: list[bytes] | np.ndarray) -> np.ndarray:
    """At least so many shingles are in one set of each pair only, by their profiles."""
    a, b = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, _RANGES) if isinstance(z, list) else z for z in (x, y))
    return np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(1, dtype=np.int64)


def _may_link(apart: np.ndarray, total: np.ndarray, num: int, den: int) -> np.ndarray:
    return apart <= total - 2 * -(-num * total // (den + num))


def _suffix_filter(pairs: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """Sets that link differ in at most na + nb - 2 * needed shingles, and in no fewer than their profiles do."""
    profiles = signatures.select("id", "profile").dropDuplicates(["id"])
    for c in ("a", "b"):
        pairs = pairs.join(profiles.withColumnsRenamed({"id": c, "profile": f"p{c}"}), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                total = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
                yield b.select(["a", "b", "na", "nb"]).filter(pa.array(_may_link(_apart(b.column(4).to_pylist(), b.column(5).to_pylist()), total, num, den)))

    return pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(release_after(run), _PAIR)


def _bloom(ids: DataFrame, n: int) -> np.ndarray:
    bits = min(_BLOOM[1], max(_BLOOM[0], 1 << math.ceil(math.log2(16 * max(1, n)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for x in b.columns:
                if pa.types.is_binary(x.type):  # filters of other tasks
                    for y in x.to_pylist():
                        out |= np.frombuffer(y, np.uint8)
                else:
                    for at in _bloom_bits(x.to_numpy(), bits):
                        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["v"])

    out = np.zeros(bits // 8, np.uint8)
    for r in ids.mapInArrow(release_after(run), "v binary").repartition(8).mapInArrow(run, "v binary").toLocalIterator():
        out |= np.frombuffer(r["v"], np.uint8)
    return out


def _bloom_bits(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED27))
    return [((x >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 32)]


def _sets(docs: DataFrame, k: int, bloom: np.ndarray | None) -> DataFrame:
    """Sets of the documents whose ids the filter holds, or of all without one."""
    held, bits = docs.sparkSession.sparkContext.broadcast(bloom), 8 * len(bloom) if bloom is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            on = np.ones(len(ids), bool)
            for at in _bloom_bits(ids, bits) if bits else ():
                on &= (held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            some = b.filter(pa.array(on))
            if len(some):
                sets = [s.tobytes() for _, d, o in text_blocks(some.column(1)) for s in shingle_sets(d, o, k)]
                yield pa.record_batch([some.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(release_after(run), "id bigint, shingles binary")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of ``pairs`` that link. ``pairs`` is a written table."""
    spark = pairs.sparkSession
    n = pairs.count()
    if not n:
        return spark.createDataFrame([], "u bigint, v bigint")
    if 32 * n <= _BLOOM[1]:
        with batch_rows(spark, NARROW_ROWS):
            bloom = _bloom(pairs.select("a", "b"), 2 * n)
    else:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        docs, bloom = docs.join(ids, "id", "left_semi").select("id", "text"), None
    with batch_rows(spark, 256):
        sets = cut(_sets(docs, k, bloom), "sets")
    many = pairs.groupBy("a").agg(F.count("*").alias("_c")).where(F.col("_c") > _PAIRS_A_TASK).withColumn("_salts", F.ceil(F.col("_c") / _PAIRS_A_TASK).cast("int"))
    salted = pairs.join(many, "a", "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("_salts"))).cast("int")).select("a", "b", "_salt")
    right = salted.join(sets.withColumnRenamed("id", "b").dropDuplicates(["b"]), "b").select("a", "_salt", "b", "shingles")
    left = salted.select("a", "_salt").distinct().join(sets.withColumnRenamed("id", "a").dropDuplicates(["a"]), "a").select("a", "_salt", F.lit(None).cast("bigint").alias("b"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, mine = None, np.empty(0, np.uint64)
        for b in batches:
            u, v = [], []
            for a, second, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint64)
                if second is None:
                    of, mine = a, s
                elif a == of:
                    at = np.searchsorted(mine, s)
                    shared = int((mine[np.minimum(at, len(mine) - 1)] == s).sum())
                    if den * shared >= num * (len(mine) + len(s) - shared):
                        u.append(a)
                        v.append(second)
            if u:
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = left.unionByName(right).repartition(n_shuffle(spark), "a", "_salt").sortWithinPartitions("a", "_salt", F.asc_nulls_first("b"))
    with batch_rows(spark, 1024):
        return cut(dealt.mapInArrow(release_after(run), "u bigint, v bigint"), "verified")


def _large_buckets(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Prefix rows of larger buckets, one for each group of equal sets: h, id, n, pos."""
    rows = rows.join(members, "id", "left").withColumn("id", F.coalesce("rep", "id"))
    return rows.select("h", "id", "n", "pos").dropDuplicates(["h", "id"])


def _later_pairs(large: DataFrame, profiles: DataFrame, roots: DataFrame, num: int, den: int, one_each: bool) -> DataFrame:
    """Pairs of different components in larger buckets that pass all filters, block by block of a bucket.
    ``one_each``: for each row only the first of each other component in a block."""
    rows = large.join(roots.withColumnRenamed("u", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rows.groupBy("h").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("h", F.ceil(F.col("m") / _BLOCK_MEMBERS).cast("int").alias("blocks"))
    rows = rows.join(mixed, "h").join(profiles, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a row goes to each pair of blocks that has its own
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("h", "id", "n", "pos", "root", "profile", "block", other.alias("o")).select("h", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "id", "n", "pos", "root", "profile")

    def pairs_of(parts: list[list]) -> Iterator[pa.RecordBatch]:
        _, x, y, block, i, n, p, root = (np.concatenate([t[c] for t in parts]) for c in range(8))
        if len(i) < 2 or (root == root[0]).all():
            return
        profile = np.frombuffer(b"".join(z for t in parts for z in t[8]), np.uint8).reshape(-1, _RANGES)
        left = np.flatnonzero(block == x)
        out: list[tuple] = []
        for j in np.flatnonzero(block == y):
            with_ = left[(root[left] != root[j]) & ((i[left] < i[j]) if x[j] == y[j] else True)]
            with_ = with_[_filters(n[with_], p[with_], n[j : j + 1], p[j : j + 1], num, den)]
            if len(with_):
                with_ = with_[_may_link(_apart(profile[with_], profile[j : j + 1]), n[with_].astype(np.int64) + n[j], num, den)]
            if one_each and len(with_):
                with_ = with_[np.unique(root[with_], return_index=True)[1]]
            if len(with_):
                m = len(with_)
                out.append((i[with_], np.full(m, i[j]), n[with_], np.full(m, n[j], np.int32)))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "na", "nb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # the rows of one pair of blocks
        for b in batches:
            cols = [*[b.column(c).to_numpy() for c in range(8)], b.column(8).to_pylist()]
            key = np.stack(cols[:3], 1)
            if held and any(held[-1][c][-1] != key[0][c] for c in range(3)):
                yield from pairs_of(held)
                held = []
            at = 0
            for e in [*(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]:
                held.append([c[at:e] for c in cols])
                if e < len(key):
                    yield from pairs_of(held)
                    held = []
                at = e
        if held:
            yield from pairs_of(held)

    dealt = rows.repartition(n_shuffle(rows.sparkSession), "h", "x", "y").sortWithinPartitions("h", "x", "y")
    return dealt.mapInArrow(release_after(run), _PAIR)


def _one_text_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose ids have one text each, and, where an id has several, what numbers ``u`` its texts ``v`` have."""
    h = F.xxhash64("id", F.coalesce("text", F.lit("")))
    odd = cut(docs.where("id IS NOT NULL").groupBy("id").agg(F.min(h).alias("_lo"), F.max(h).alias("_hi")).where("_lo != _hi").select("id"), "odd-ids")
    n = odd.count()
    if not n:
        return docs, None
    marked = docs.join((F.broadcast if n <= BROADCAST_IDS else lambda x: x)(odd.withColumn("_odd", F.lit(True))), "id", "left")
    number = F.when(F.col("_odd"), h.bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)).otherwise(F.col("id"))
    texts_of = cut(marked.where("_odd").select(number.alias("u"), F.col("id").alias("v")).distinct(), "texts-of-ids")
    return marked.select(number.alias("id"), "text"), texts_of


def link_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row for each row of ``documents``: its id, n_shingles and component_id, the smallest id that links reach."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs, texts_of = _one_text_each(docs)
    known = docs.where("id IS NOT NULL")
    table = cut(_signatures(docs, k), "signatures")
    signatures = table.where("chunk IS NULL").select("id", "n", "s1", "s2", "profile")
    with batch_rows(spark, 64):
        sketch = _sum_sketches(table.where("chunk IS NOT NULL"))
    nodes = signatures.where("n > 0 AND id IS NOT NULL")
    groups = nodes.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    members = nodes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).join(groups, ["s1", "s2", "n", "salt"]).where("id != rep").select("id", "rep").distinct()
    members = cut(members, "members")
    found = cut(_first_pairs(_prefixes(known, k, num, den, sketch), num, den), "found")
    profiles = nodes.select("id", "profile").dropDuplicates(["id"])
    with batch_rows(spark, 4096):
        pairs = cut(_suffix_filter(_canonical(found.where("h IS NULL").drop("h"), members), nodes, num, den), "pairs")
    links = _verify(pairs, known, k, num, den)
    rows = found.where("h IS NOT NULL").select("h", F.col("a").alias("id"), F.col("na").alias("n"), F.col("nb").alias("pos"))
    large = cut(_large_buckets(rows, members), "large")
    for one_each in (True, False):
        with batch_rows(spark, 4096):
            later = _canonical(_later_pairs(large, profiles, components(links), num, den, one_each).distinct(), members)
            later = cut(later.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(_verify(later, known, k, num, den))
        pairs = pairs.unionByName(later)
    if texts_of is None:
        roots = components(links)
        own = members.join(roots.withColumnRenamed("u", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("c"))
        all_roots = own.unionByName(roots.join(members.select(F.col("id").alias("u")), "u", "left_anti").select(F.col("u").alias("id"), F.col("root").alias("c")))
        rooted = signatures.select("id", "n").join(all_roots, "id", "left").withColumn("c", F.coalesce("c", "id"))
    else:  # nodes of the same id are linked by it
        roots = components(links.unionByName(members.select(F.col("id").alias("u"), F.col("rep").alias("v"))).unionByName(texts_of.select("u", "v")))
        rooted = signatures.select("id", "n").join(roots.withColumnRenamed("u", "id"), "id", "left").withColumn("c", F.coalesce("root", "id"))
        rooted = rooted.join(texts_of.withColumnRenamed("u", "id"), "id", "left").select(F.coalesce("v", "id").alias("id"), "n", "c")
    return rooted.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.col("c").alias("component_id"))
