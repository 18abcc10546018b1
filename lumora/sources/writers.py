"""Sinks: write-once tables, one list per split, reports, and a replaced history with its unreadable rows kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table that must not exist yet."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, keys sorted; refuses to overwrite."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def write_lists(df: DataFrame, path: str, split: str, value: str) -> None:
    """A text list of values for each split, in folders split=..."""
    df.select(split, F.col(value).cast("string").alias("value")).repartition(split).sortWithinPartitions(split, "value").write.mode("errorifexists").partitionBy(split).text(path)


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder split=... for each split, so that a reader of one split lists no other; refuses to overwrite."""
    df.write.mode("errorifexists").partitionBy(split).parquet(path)


def append_register(ids: DataFrame, path: str) -> None:
    """Add consumed ids to a register that only grows."""
    ids.write.mode("append").parquet(path)


def replace_history(history: DataFrame, path: str, quarantine: str) -> None:
    """Append unreadable rows to the quarantine, then replace the table by the readable ones.

    The new table is written beside the old one, the old one is renamed to ``<path>.old``, the new one takes its place, and
    only then the old one is deleted: a crash at any point leaves a whole table at the path, at ``.old`` or at ``.new``, and
    ``recover_history`` puts it back.
    """
    fs, at = _files(history.sparkSession)
    recover_history(history.sparkSession, path)
    history.where("state = 'unreadable'").write.mode("append").json(quarantine)
    history.where("state <> 'unreadable'").write.mode("overwrite").parquet(f"{path}.new")
    if fs(path).exists(at(path)):
        _rename(history.sparkSession, path, f"{path}.old")
    _rename(history.sparkSession, f"{path}.new", path)
    fs(path).delete(at(f"{path}.old"), True)


def recover_history(spark: SparkSession, path: str) -> None:
    """After a crash in ``replace_history``: a missing table is taken from the copy that was set aside."""
    fs, at = _files(spark)
    if not fs(path).exists(at(path)) and fs(path).exists(at(f"{path}.old")):
        _rename(spark, f"{path}.old", path)


def _files(spark: SparkSession) -> tuple:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return lambda p: at(p).getFileSystem(conf), at


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _files(spark)
    if not fs(old).rename(at(old), at(new)):
        raise OSError(f"could not rename {old} to {new}")
