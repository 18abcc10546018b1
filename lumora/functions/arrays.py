"""Expressions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once. A value that stands in a lambda is otherwise worked out for each element, and
    naming it by a column doesn't help, since projections are merged."""
    return F.get(F.transform(F.array(value), use), 0)
