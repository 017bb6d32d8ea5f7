"""A hot key holding a third of all rows: results stay exact and the heavy
steps reduce rows map-side before the shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from oracle_check import _rows
from rosterlens import constants as K
from rosterlens.operators import box_stats, flow_by, latest_snapshot
from rosterlens.sources import panel_from_tables

HOT = 999_999


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skew") / "panel")
    p = panel_from_tables(spark, SF_MID)
    hot = F.col(K.SNAPSHOT) % 3 == 0
    p = p.withColumn(K.ID, F.when(hot, F.lit(HOT)).otherwise(F.col(K.ID)))
    p.write.parquet(path)
    return path


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _same(spark, df, sql, path):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW panel AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel = con.sql(sql)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_hot_employee_pick(spark, skewed):
    p = spark.read.parquet(skewed)
    assert p.where(F.col(K.ID) == HOT).count() >= 0.3 * p.count()
    latest = latest_snapshot(p).select(K.ID, K.SNAPSHOT, K.STATUS)
    plan = _plan(latest)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    _same(spark, latest, """
        SELECT EmployeeID, snapshot_id, STATUS FROM (
          SELECT *, row_number() OVER (PARTITION BY EmployeeID ORDER BY length_of_service DESC,
                 recorddate_key, snapshot_id) AS rn FROM panel WHERE length_of_service IS NOT NULL) WHERE rn = 1
    """, skewed)


def test_hot_employee_flow_and_box(spark, skewed):
    p = spark.read.parquet(skewed)
    flow = flow_by(p, [K.BU])
    plan = _plan(flow)
    # one pass: events generated, then de-duplicated map-side (partial distinct) before the shuffle
    assert "Generate inline" in plan and plan.count("functions=[]") >= 2
    _same(spark, flow, """
        SELECT coalesce(h.year, t.year) AS year, coalesce(h.BUSINESS_UNIT, t.BUSINESS_UNIT) AS BUSINESS_UNIT,
               coalesce(h.n, 0) AS hired, coalesce(t.n, 0) AS termed
        FROM (SELECT CAST(year(orighiredate_key) AS INTEGER) AS year, BUSINESS_UNIT, count(DISTINCT EmployeeID) AS n
              FROM panel GROUP BY ALL) h
        FULL OUTER JOIN (SELECT CAST(year(terminationdate_key) AS INTEGER) AS year, BUSINESS_UNIT,
              count(DISTINCT EmployeeID) AS n FROM panel WHERE year(terminationdate_key) <> 1900 GROUP BY ALL) t
        ON h.year IS NOT DISTINCT FROM t.year AND h.BUSINESS_UNIT IS NOT DISTINCT FROM t.BUSINESS_UNIT
    """, skewed)
    box = box_stats(p.withColumn("hot", F.col(K.ID) == HOT), K.AGE, ["hot"]).select("hot", "q1", "median", "q3", "n_out")
    _same(spark, box, """
        WITH r AS (SELECT EmployeeID = 999999 AS hot, age FROM panel WHERE age IS NOT NULL),
        q AS (SELECT hot, quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.5) AS md,
                     quantile_cont(age, 0.75) AS q3 FROM r GROUP BY hot)
        SELECT q.hot, round(any_value(q1), 6) AS q1, round(any_value(md), 6) AS median, round(any_value(q3), 6) AS q3,
               sum(CASE WHEN age < q1 - 1.5 * (q3 - q1) OR age > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS n_out
        FROM r JOIN q ON r.hot = q.hot GROUP BY q.hot
    """, skewed)


def test_hot_customer_split_keeps_panel_whole(spark):
    normal = panel_from_tables(spark, SF_MID)
    # every customer with >= 12 orders is "hot" here (full sample), so both routes carry rows
    split = panel_from_tables(spark, SF_MID, hot_min_rows=12, max_hot_keys=1_000_000, sample_fraction=1.0)
    a = sorted(map(tuple, normal.collect()))
    b = sorted(map(tuple, split.collect()))
    assert len(b) == 15000 and a == b
    plan = _plan(split)
    assert "LeftAnti" in plan and "LeftSemi" in plan and "BroadcastHashJoin" in plan


def test_hot_key_count_is_bounded(spark):
    from rosterlens.operators import sampled_hot_keys

    p = spark.read.parquet(f"{SF_MID}/orders.parquet")
    # a bound of 10 keys holds even with a threshold every customer passes
    assert sampled_hot_keys(p, "o_custkey", fraction=1.0, hot_min_rows=1, max_hot_keys=10).count() <= 10


def test_panel_plan_without_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        p = panel_from_tables(spark, SF_MID)
        plan = _plan(p)
        # nation still broadcast after its row-count check; hot keys removed before the shuffle join
        assert "LeftAnti" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
        assert p.count() == 15000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_hot_customer_route_under_real_skew(spark, tmp_path):
    import duckdb

    from rosterlens.operators import sampled_hot_keys
    from rosterlens.plans.oracle import _PANEL
    from rosterlens.sources import panel_from_frames

    orders = spark.read.parquet(f"{SF_MID}/orders.parquet")
    # a third of all orders move to customer 1
    skewed = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")))
    path = str(tmp_path / "orders_skewed.parquet")
    skewed.write.parquet(path)
    skewed = spark.read.parquet(path)
    hot = sampled_hot_keys(skewed, "o_custkey", fraction=0.5, hot_min_rows=2000, max_hot_keys=100)
    assert [r._hot_key for r in hot.collect()] == [1]

    read = lambda t: spark.read.parquet(f"{SF_MID}/{t}.parquet")
    panel = panel_from_frames(skewed, read("customer"), read("nation"), hot_min_rows=2000, sample_fraction=0.5)
    plan = _plan(panel)
    assert "LeftSemi" in plan and "LeftAnti" in plan
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}/*.parquet')")
    for t in ("customer", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    rel = con.sql(f"WITH {_PANEL.strip()} SELECT * FROM panel")
    assert _rows(panel.columns, [tuple(r) for r in panel.collect()]) == _rows(rel.columns, rel.fetchall())


def test_broadcast_if_small_checks_the_size(spark):
    from rosterlens.operators import broadcast_if_small

    small = spark.range(5).withColumnRenamed("id", "k")
    big = spark.range(100).withColumnRenamed("id", "k")
    fact = spark.range(1000).withColumnRenamed("id", "k")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in _plan(fact.join(broadcast_if_small(small, 10), "k"))
        assert "BroadcastHashJoin" not in _plan(fact.join(broadcast_if_small(big, 10), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_order_rows_are_shuffled_and_sorted_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        lines = re.sub(r"#\d+L?", "", _plan(panel_from_tables(spark, SF_MID))).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    # one repartition of the (cold) order rows by customer ...
    assert sum("REPARTITION_BY_COL" in line for line in lines) == 1
    # ... whose sorted output feeds the helper window and then the customer join directly
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "[o_custkey], [c_custkey]" in line)
    left = [line.strip(" :+-") for line in lines[join + 1: join + 5]]
    assert left[0].startswith("Project") and left[1].startswith("Window")
    assert left[2].startswith("Sort") and left[3].startswith("Exchange") and "REPARTITION_BY_COL" in left[3]
