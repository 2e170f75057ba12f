"""Physical-plan shape: pruning, pushdown, partial aggregation, bounded
broadcasts, no cross joins, map-side top-n."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from wardstat.operators import aggregates as A
from wardstat.operators import windows as W
from wardstat.sources import fixtures as fx


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_reads_only_needed_columns_with_partial_agg(spark):
    df = A.readmission_rates(fx.admissions_fact(spark, SF_SMALL))
    p = plan(df)
    assert "ReadSchema: struct<patient_id:string,disease:string,readmitted:string>" in p
    assert p.count("HashAggregate") == 2          # partial before the shuffle, final after
    assert "treatment_cost" not in p


def test_year_filter_prunes_fact_partitions(spark):
    df = fx.admissions_fact(spark, SF_SMALL).where(F.col("year") == 1996).groupBy("disease").count()
    p = plan(df)
    assert "PartitionFilters: [isnotnull(year" in p and "(year#" in p


def _ancestors(tree: list[str], line: int) -> list[str]:
    """The lines above one in a plan's text that it hangs on."""
    depth = lambda text: len(text) - len(text.lstrip(" :+-"))
    out, at = [], depth(tree[line])
    for text in reversed(tree[:line]):
        if depth(text) < at:
            at = depth(text)
            out.append(text)
    return out


def test_view_join_never_builds_on_the_fact(spark):
    """With a threshold that only region and nation fit, as any fixed one is for
    a large fact: every other table is joined by a shuffle, the fact too."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3k")
    try:
        p = plan(fx.admissions(spark, "/root/testdata/sf0.01").groupBy("region").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "PushedFilters" in p
    lines = p.split("\n")
    scan = {t: next(i for i, ln in enumerate(lines) if f"{t}.parquet" in ln) for t in ("lineitem", "orders", "region", "nation")}
    built = {t: any("BroadcastExchange" in ln for ln in _ancestors(lines, i)) for t, i in scan.items()}
    assert built == {"lineitem": False, "orders": False, "region": True, "nation": True}


def test_avg_cost_aggregates_before_the_join(spark):
    df = A.avg_cost(fx.admissions_fact(spark, SF_SMALL), fx.hospitals_dim(spark, SF_SMALL))
    p = final_plan(df)
    join_at = p.index("BroadcastHashJoin")
    # the per-hospital aggregate sits below (after, in tree text) the join
    assert "HashAggregate" in p[join_at:]
    assert "BroadcastExchange" in p


def test_latest_per_key_limits_before_shuffle(spark):
    df = W.latest_n(fx.vitals(spark, SF_SMALL), "ts", 20, keys=["patient_id"], tie_breakers=["event_id"])
    p = plan(df)
    assert "WindowGroupLimit" in p
    assert p.index("Exchange") < p.rindex("WindowGroupLimit")   # a partial limit below the exchange


def test_overall_latest_is_take_ordered(spark):
    p = plan(W.latest_n(fx.vitals(spark, SF_SMALL), "ts", 20))
    assert "TakeOrderedAndProject" in p


@pytest.mark.parametrize("name", sorted(n for n in E.queries()
                                        if not n.startswith(("ml_", "sink_model", "stream_push",
                                                             "stream_latest"))))
def test_no_cross_or_nested_loop_joins(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    p = plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_join_side_is_hinted(spark):
    for df in (fx.admissions(spark, SF_SMALL), E.queries()["join_dim"](spark, SF_SMALL), E.queries()["avg_cost"](spark, SF_SMALL)):
        assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()


def test_pivots_scan_the_rows_once(spark):
    from wardstat.operators import gold as G
    from wardstat.operators import upload as U
    up = U.prepare_upload(fx.admissions_fact(spark, SF_SMALL))
    for df in (G.trends(up), G.rate_matrix(up)):
        p = plan(df)
        assert "FileScan" not in p and "Scan parquet" not in p and "ExistingRDD" in p


def test_warehouse_cost_aggregates_below_the_join(spark):
    p = plan(E.queries()["create_tables"](spark, SF_SMALL))
    join = next(i for i, ln in enumerate(p.split("\n")) if "Join" in ln)
    below = "\n".join(p.split("\n")[join:])
    assert "partial_sum" in below


def test_kpis_single_scan_no_join(spark):
    from wardstat.operators import gold as G
    from wardstat.operators import upload as U
    p = plan(G.kpis(U.prepare_upload(fx.admissions_fact(spark, SF_SMALL))))
    assert "Expand" in p and "Join" not in p
    assert p.count("FileScan") == 1 or p.count("Scan parquet") == 1


def test_sql_lag_written_twice_runs_one_window(spark):
    df = E.queries()["yoy_growth_sql"](spark, SF_SMALL)
    p = plan(df)
    assert p.count("Window [") == 1 or p.count("Window ") == 1
    assert p.count("lag(") >= 1


def test_lake_sql_prunes_columns(spark):
    df = E.queries()["create_tables"](spark, SF_SMALL)
    p = plan(df)
    scan = next(ln for ln in p.split("\n") if "ReadSchema" in ln and "hospital_id" in ln and "disease" in ln)
    assert "patient_id" not in scan and "age_band" not in scan


def test_positions_are_distributed_and_exact(spark):
    from pyspark.sql import Window
    df = spark.range(0, 20000).select((F.col("id") * 7919 % 10007).alias("k"), F.col("id"))
    got = W.with_position(df, [F.desc("k"), "id"], "pos")
    want = df.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("k"), "id")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    p = plan(got)
    assert "ExistingRDD" in p                  # reads the checkpointed, range-sorted rows
    assert "BroadcastExchange" in p            # offsets: one row per partition
    data_windows = [ln for ln in p.split("\n") if "Window [" in ln and "row_number" in ln]
    assert not data_windows                    # no window over the data rows
