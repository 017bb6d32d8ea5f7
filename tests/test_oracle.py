"""Every registered query against its DuckDB twin, plus cross-query properties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import compare, duck
from rosterlens.plans import oracle, registered_queries
from rosterlens.plans.oracle import oracle_statements

QUERIES = registered_queries()
SQL = oracle_statements()


def test_every_analysis_has_an_oracle():
    assert set(QUERIES) == set(SQL) and len(QUERIES) >= 107
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_oracle_does_not_read_the_spark_side():
    source = open(oracle.__file__).read()
    assert "plans.service" not in source and "pyspark" not in source


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_duckdb(spark, con, key):
    ok, msg = compare(spark, con, SF_SMALL, key, QUERIES[key], SQL[key])
    assert ok, msg


def _q(spark, key):
    return QUERIES[key](spark, SF_SMALL)


def test_flow_total_is_net_sum(spark):
    rows = _q(spark, "q1_1_flow").collect()
    assert rows[-1].total == sum(r.hired for r in rows) - sum(r.termed for r in rows)


def test_union_is_sum_of_parts(spark):
    assert _q(spark, "q2_age_union").count() == _q(spark, "q2_1_hired_age").count() + _q(spark, "q2_2_termed_age").count()


def test_one_top_and_least_per_reason(spark):
    reasons = _q(spark, "q3_3_reason_bu").select("termreason_desc").distinct().count()
    for key in ("q3_4_top_dept", "q3_4_least_dept", "q3_5_top_city", "q3_6_least_job"):
        df = _q(spark, key)
        assert df.count() == reasons == df.select("termreason_desc").distinct().count()


def test_long_and_short_bracket_the_median(spark):
    base = _q(spark, "q5_term_service")
    median = base.select(F.percentile("service", 0.5)).first()[0]
    assert sum(r.n for r in _q(spark, "q5_2_gender_long").collect()) == base.where(F.col("service") >= base.select(F.percentile("service", 0.9)).first()[0]).count()
    low = base.select(F.percentile("service", 0.1)).first()[0]
    high = base.select(F.percentile("service", 0.9)).first()[0]
    assert low <= median <= high


def test_shares_sum_to_one(spark):
    for key in ("q1_3_gender_action_total", "q2_4_hired_agegroup", "q3_1_reason_gender"):
        assert sum(r.share for r in _q(spark, key).collect()) == pytest.approx(1.0)


def test_result_does_not_depend_on_partition_count(spark):
    from rosterlens.plans import clear_contexts

    before = sorted(tuple(r) for r in _q(spark, "q4_4_top20_job_gender").collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        clear_contexts()
        after = sorted(tuple(r) for r in _q(spark, "q4_4_top20_job_gender").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        clear_contexts()
    assert before == after


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "hired", "termed", "total"]
    assert df.count() > 0


def test_single_partition_exchanges_only_follow_aggregates(spark):
    """No raw rows are funnelled into one task: every SinglePartition exchange
    sits (through projections and filters) on an aggregate's output."""
    import re

    from rosterlens.plans import ANALYSES, workforce
    from rosterlens.sources import panel_from_tables

    w = workforce(spark, SF_SMALL)
    steps = dict(ANALYSES, panel=lambda _: panel_from_tables(spark, SF_SMALL))
    for key, build in steps.items():
        lines = build(w)._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" not in line:
                continue
            j = i + 1
            while re.match(r"^[\s:+-]*(\*\(\d+\) )?(Project|Filter)\b", lines[j]):
                j += 1
            node = lines[j].strip(" :+-")
            assert re.match(r"(\*\(\d+\) )?(HashAggregate|ObjectHashAggregate|SortAggregate)", node), (key, node)


def test_no_window_over_all_rows_but_the_running_total(spark):
    """Thresholds and shares are scalar subqueries; only the running total (one row a
    year) has a window without a key."""
    from rosterlens.plans import ANALYSES, workforce

    w = workforce(spark, SF_SMALL)
    for key, build in ANALYSES.items():
        lines = build(w)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        keyless = [x for x in lines if x.strip(" :+-").startswith("Window [") and "PARTITION BY" not in x.upper() and "windowspecdefinition(year" in x]
        others = [x for x in lines if x.strip(" :+-").startswith("Window [percentile")]
        assert not others, key
        assert not keyless or key in ("q1_1_flow", "q1_1_flow_long"), key


def test_thresholds_and_shares_share_the_aggregate_of_their_table(spark):
    """The subquery and the filtered table use one shuffle: in the final plan one is a reused exchange."""
    from rosterlens.plans import ANALYSES, workforce

    w = workforce(spark, SF_SMALL)
    for key in ("q4_1_top20_job", "q4_4_top20_job_gender", "q5_7_mean_city_best", "q3_1_reason_gender"):
        df = ANALYSES[key](w)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Subquery" in plan and "ReusedExchange" in plan, key


def test_bases_keep_the_parallelism_of_their_input(spark):
    from rosterlens.plans import Workforce
    from rosterlens.sources import panel_from_tables

    w = Workforce(panel_from_tables(spark, SF_SMALL).repartition(6))
    assert w.reasoned.rdd.getNumPartitions() == 6
    assert w.hire_ages.rdd.getNumPartitions() >= 1
    w.release()


def test_service_reports_take_cut_offs_from_the_persisted_row(spark):
    """Q5/Q6 share and summary reports read their cut-off from the persisted
    one-row table of a base's quantiles, not from a new pass over the base."""
    from rosterlens.plans import ANALYSES, workforce

    w = workforce(spark, SF_SMALL)
    for key in ("q5_2_gender_long", "q5_1_age_summary_short", "q6_6_city_long", "q6_15_agegroup_short"):
        lines = ANALYSES[key](w)._jdf.queryExecution().executedPlan().toString().splitlines()
        subqueries = [i for i, line in enumerate(lines) if line.lstrip(" :+-").startswith("Subquery subquery")]
        assert subqueries, key
        for i in subqueries:
            assert any("InMemoryTableScan [q" in line for line in lines[i + 1: i + 6]), (key, lines[i: i + 6])
