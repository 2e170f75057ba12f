"""Join helpers.

No side is hinted: the planner broadcasts one whose size in bytes is within
``spark.sql.autoBroadcastJoinThreshold``, AQE does so at run time when a side
turns out that small, and splits skewed partitions of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_dim(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Fact-to-dimension equi-join on ``key``.

    A hot key on the fact side is split by AQE's skew-join handling.  Callers
    that aggregate right after the join should aggregate the fact by ``key``
    first (see ``operators.aggregates.avg_cost``) so the shuffle carries one
    row per key and group instead of one per fact row.
    """
    return fact.join(dim, on=key, how=how)
