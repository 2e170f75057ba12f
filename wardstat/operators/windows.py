"""Window functions, ordering and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import cases_by_region_year


def yoy_growth(adm: DataFrame, region: str = "region", year: str = "year") -> DataFrame:
    """Cases by region, year and disease with the previous row's count and
    the difference, ordered by region, disease, year.

    LAG looks at the previous *row* of the (region, disease) partition, so
    a missing year compares across the gap, as the SQL job does.  The
    window runs on the aggregated counts: each partition holds at most one
    row per year, whatever the size or skew of the fact.
    """
    counts = cases_by_region_year(adm, region, year)
    w = Window.partitionBy("region", "disease").orderBy("year")
    prev = F.lag("total_cases", 1).over(w)
    return (counts.withColumn("prev_year_cases", prev)
            .withColumn("yoy_difference", F.col("total_cases") - F.col("prev_year_cases"))
            .orderBy("region", "disease", "year"))


def order_by(df: DataFrame, *cols: Column | str) -> DataFrame:
    """Total order with the given sort keys (a range-partitioned sort)."""
    return df.orderBy(*cols)


_LOCAL_BITS = 33   # monotonically_increasing_id: partition index above bit 33, row index below


def _laid_out(df: DataFrame, order: Sequence[Column | str], num_partitions: int | None) -> DataFrame:
    """Rows range-partitioned on the sort keys (equal keys land in the same
    partition), sorted inside each partition and checkpointed to the shared
    checkpoint folder, so every later read sees the same partitions in the
    same order (also after an executor loss).  On that fixed data
    ``monotonically_increasing_id`` carries each row's partition (``_part``)
    and its index inside it (``_local``)."""
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fixed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    return (fixed.withColumn("_mid", F.monotonically_increasing_id())
            .withColumn("_part", F.shiftrightunsigned("_mid", _LOCAL_BITS))
            .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
            .drop("_mid"))


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position",
                  num_partitions: int | None = None) -> DataFrame:
    """Adds the 1-based position of each row in the given total order,
    without moving all rows into one task.

    A position is the row's index inside its range partition plus the
    partition's offset, the running sum of the row counts of the partitions
    before it -- a window and a broadcast over one row per partition, bounded
    by the partition count.
    """
    tagged = _laid_out(df, order, num_partitions)
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (tagged.join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_offset") + F.col("_local") + F.lit(1)).cast("long"))
            .drop("_part", "_local", "_offset"))


def running_totals(df: DataFrame, order: Sequence[Column | str], totals: dict[str, str],
                   num_partitions: int | None = None) -> DataFrame:
    """Adds, for each ``{name: column}``, the sum of ``column`` over the rows
    before this one in the given order (0 for the first; the order has to be
    total, or ties are cut arbitrarily).

    The running sum is taken inside each range partition, and the partition
    sums before it are added, so no task sees more than its own partition.
    """
    tagged = _laid_out(df, order, num_partitions)
    per = tagged.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_part", *[F.coalesce(F.sum(f"_{n}").over(parts), F.lit(0)).alias(f"_{n}") for n in totals])
    rows = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(F.broadcast(offsets), "_part")
    for n, c in totals.items():
        out = out.withColumn(n, F.coalesce(F.sum(c).over(rows), F.lit(0)) + F.col(f"_{n}"))
    return out.drop("_part", "_local", *[f"_{n}" for n in totals])


def top_n(df: DataFrame, order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """First ``n`` rows in the given order (TakeOrderedAndProject: each task
    keeps its own top ``n``; only those reach the final merge)."""
    return df.orderBy(*order).limit(n)


def preview(df: DataFrame, n: int = 5, order: Sequence[Column | str] | None = None) -> DataFrame:
    """``show(n)`` as a frame; pass ``order`` for a repeatable preview."""
    return (df.orderBy(*order) if order else df).limit(n)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column (partial distinct before the shuffle)."""
    return df.select(col).distinct()


def latest_n(df: DataFrame, ts: str, n: int = 20, keys: Sequence[str] = (),
             tie_breakers: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most recent rows overall, or per key.

    Overall: a top-``n`` (each task keeps ``n`` rows).  Per key:
    ``row_number() <= n`` over the key, which Spark plans with a partial
    WindowGroupLimit before the shuffle, so a hot key sends at most ``n``
    rows per map task instead of all its rows (up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``; for a larger ``n`` all
    rows of a key are sorted in one task, spilling as needed).
    """
    order = [F.col(ts).desc()] + [F.col(c).desc() for c in tie_breakers]
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
