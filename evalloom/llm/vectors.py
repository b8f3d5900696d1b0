"""Vectors of a table as matrices inside tasks, and sums over tasks by trees."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most partial results that one task, or the driver, merges in a step of a tree.
FAN_IN = 32


def usual_length(vectors: DataFrame, column: str) -> int:
    """The number of entries that most vectors have, the larger one among equals; 0 without vectors."""
    n = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).agg(F.count("*").alias("rows"))
    row = n.orderBy(F.desc("rows"), F.desc("n")).first()
    return row["n"] if row else 0


def scaled(column: pa.Array, dims: int, factor: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of ``dims`` entries that are all there and finite, and floor(factor * entry) of these as int64.

    A vector with an entry that isn't under ``most`` after scaling doesn't fit and is left out as well."""
    column = column.cast(pa.list_(pa.float64()))
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    of_size = np.flatnonzero(length == dims)
    if not dims or not len(of_size):
        return np.empty(0, np.int64), np.empty((0, dims), np.int64)
    values = column.take(pa.array(of_size)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * factor)
        good = (np.abs(values) < most).all(axis=1)
    return of_size[good], values[good].astype(np.int64)


def tree_depth(tasks: int) -> int:
    """Levels of a tree over so many partial results in which no step merges many more than ``FAN_IN``."""
    return max(2, math.ceil(math.log(max(tasks, 2), FAN_IN)))


def tree_sum(partials: DataFrame, first: Callable[[Any], Any], add: Callable[[Any, Any], Any]) -> Any:
    """All rows of ``partials`` (few a task) made values by ``first`` and merged by ``add`` over a tree of tasks; None without rows."""
    rows = partials.rdd

    def both(a: Any, b: Any) -> Any:
        return b if a is None else a if b is None else add(a, b)

    return rows.treeAggregate(None, lambda a, row: both(a, first(row)), both, depth=tree_depth(rows.getNumPartitions()))
