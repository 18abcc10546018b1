"""Helpers that the operators of this package share: tables, folds, shared folder, text blocks."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch between the JVM and a Python worker. Spark's default of 10,000
#: would hold gigabytes where texts are long.
TEXT_ROWS_PER_BATCH = 256
#: Texts are handed to array code in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS_PER_BATCH) -> None:
    """Lower the session's Arrow batch length to ``rows``; a lower setting of the caller stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for the jobs that run inside: long batches for narrow rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def give_back() -> None:
    """Return memory that a fit on the driver has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def release_after(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` whose task returns freed memory to the system as it ends: a worker lives on for other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row for sampling: the hash of an id alone is the same for all rows without one."""
    return F.xxhash64(*cols)


def thinned(rows: DataFrame, key: Column, most: int | Column, count: int | Column, *keep: Column | str) -> DataFrame:
    """Some more than ``most`` of ``count`` rows (_u, *keep), those whose keys are under a share of the keys' range; rows
    of one key are one. Where ``count`` is a count of rows, at most some ``1.3 * most + 100`` keys are left."""
    unit = F.pmod(key, F.lit(1 << 40))
    share = F.least(F.lit(1.0), (most * F.lit(1.3) + 100) / F.greatest(F.lit(1), count if isinstance(count, Column) else F.lit(count)))
    return rows.select(unit.alias("_u"), *keep, share.alias("_share")).where(F.col("_u") < F.col("_share") * float(1 << 40)).drop("_share").dropDuplicates(["_u"])


def out_schema(rows: DataFrame, keep: tuple[str, ...], added: dict[str, Column]):  # noqa: ANN201
    """The schema of the columns of ``keep`` and those added, whose names must differ."""
    clash = sorted(set(keep) & set(added))
    if clash:
        raise ValueError(f"the kept columns hold the names of new ones: {clash}; give the new ones other names")
    return rows.select(*keep).withColumns(added).schema


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the hold-out rule of the contracts. A null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % F.lit(mod), F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the checkpoint folder of the context, or
    else one in the default file system's temporary folder, only where Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not path and held.isDefined():
        path = held.get()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"/tmp/lumora-{sc.applicationId}"
    if not held.isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later stages survive lost executors.

    The JVM removes the files when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


_SUM_TASKS = 32


def sum_vectors(rows: DataFrame) -> np.ndarray | None:
    """The sum of float64 vectors in a binary column ``v``; each of a fixed number of tasks adds up what it reads as it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                total = np.frombuffer(x) + (0 if total is None else total)
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["v"])

    if rows.rdd.getNumPartitions() > _SUM_TASKS:
        rows = rows.repartition(_SUM_TASKS).mapInArrow(run, "v binary")
    got = rows.collect()
    return sum(np.frombuffer(r["v"]) for r in got) if got else None


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_batches(batches: Iterator[pa.RecordBatch], rows: int, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows`` rows or ``size`` bytes, but for the last one."""
    held, n, held_bytes = [], 0, 0
    for b in batches:
        held.append(b)
        n += len(b)
        held_bytes += b.nbytes
        if n >= rows or held_bytes >= size:
            yield pa.concat_batches(held)
            held, n, held_bytes = [], 0, 0
    if n:
        yield pa.concat_batches(held)


def text_blocks(col: pa.Array | pa.ChunkedArray, block: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of a string column: (first row, UTF-8 bytes, offsets of the rows in them). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + block, "right")) - 1)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Ids up to this number are broadcast to drop rows (tens of MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def drop_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not in the one-column table ``ids``. The ids are written and counted first."""
    ids = cut(ids.distinct(), "dropped")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, "left_anti")
