"""What the query modules share: tables, registration, and inputs derived from the driver's tables.

Derived inputs are lists of expressions that Spark SQL and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(queries: dict, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with its DuckDB SQL."""
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        queries[f.__name__] = (f, sql)
        return f

    return put


def derive(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {a}" for a, e in exprs.items()])


def derive_sql(name: str, exprs: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {a}' for a, e in exprs.items())} FROM {name}"


# Settled hands: players, source and rules from the keys of an order.
WIN = {
    "hand_id": "o_orderkey", "winner": "CAST(o_orderkey % 4 AS INT)", "discarder": "CAST((o_orderkey + 1 + o_custkey % 3) % 4 AS INT)", "dealer": "CAST(o_custkey % 4 AS INT)",
    "continuations": "CAST(o_custkey % 3 AS INT)", "source": "CASE WHEN o_orderkey % 5 < 2 THEN 'selfDraw' WHEN o_orderkey % 5 < 4 THEN 'discard' ELSE 'robKong' END",
    "replacement": "CASE WHEN o_orderkey % 10 = 0 THEN 'kong' ELSE 'none' END", "family": "CASE WHEN o_orderkey % 3 = 0 THEN 'taiwanese' ELSE 'hongKong' END",
    "liable_player": "CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 7 < 3 THEN CAST((o_orderkey + 1 + o_custkey % 3) % 4 AS INT) END",
    "minimum": "CAST(3 AS INT)", "cap": "CAST(10 AS INT)", "base": "CAST(o_custkey % 5 AS INT)", "unit": "CAST(1 + o_custkey % 7 AS INT)",
    "payment": "CASE o_custkey % 3 WHEN 0 THEN 'preset' WHEN 1 THEN 'fullEach' ELSE 'splitTotal' END", "score": "CAST(2 + o_orderkey % 10 AS INT)",
}

# Boxes of images: an order's lines. Coordinates are shares of the image.
_CX, _CY = "(CAST(l_partkey % 30 + 35 AS DOUBLE) / 100)", "(CAST(l_suppkey % 20 + 40 AS DOUBLE) / 100)"
_W, _H = "(CAST(l_quantity % 20 + 10 AS DOUBLE) / 200)", "(CAST(l_linenumber * 3 + 20 AS DOUBLE) / 200)"
BOX = {
    "image_id": "l_orderkey", "anchor": "CAST(l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT)", "cls": "CAST(l_partkey % 3 AS INT)",
    "conf": "CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 100 AS DOUBLE) / 100", "l": f"{_CX} - {_W}", "t": f"{_CY} - {_H}", "r": f"{_CX} + {_W}", "b": f"{_CY} + {_H}",
}
