"""Connected components of an edge table, as DataFrame steps.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every round is two shuffles over the
edges, a node of any degree is reduced by a partial minimum, and the number
of rounds grows with the logarithm of the longest path.  Each round is
written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large-star: neighbours above a node move to the least of its
    neighbourhood.  Small-star: the node and its neighbours below do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge to another one; the
    component is its least node.  Rows with a null end and loops mean nothing."""
    now = stored(edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
                 .filter("u IS NOT NULL AND v IS NOT NULL AND u != v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    for _ in range(MAX_ROUNDS):
        now = stored(_star(_star(now, large=True), large=False), "edges")
        # The same edges twice in a row: stars around the least nodes.
        last, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"no stable components after {MAX_ROUNDS} rounds")
