import datetime as dt

from pyspark.sql import functions as F

from rosterlens.functions import (
    age_band,
    count_label,
    cross_label,
    not_sentinel_date,
    pair_label,
    parse_mdy_date,
    round_half_even,
    round_up_to,
    years_between,
)


def test_parse_mdy_date(spark):
    df = spark.createDataFrame([("12/31/2006 0:00",), ("1/5/2006",), ("13/40/2006",), ("",), (None,)], "t string")
    got = [r.d for r in df.select(parse_mdy_date("t").alias("d")).collect()]
    assert got == [dt.date(2006, 12, 31), dt.date(2006, 1, 5), None, None, None]


def test_years_between_uses_average_year(spark):
    df = spark.createDataFrame(
        [(dt.date(2001, 3, 1), dt.date(2000, 3, 1)), (dt.date(2000, 3, 1), dt.date(2001, 3, 1)),
         (dt.date(2010, 6, 1), dt.date(1980, 6, 1))],
        "a date, b date",
    )
    got = [r.y for r in df.select(years_between("a", "b").alias("y")).collect()]
    # 365 days / 365.25 -> 0 (not calendar age 1); unsigned;
    # 30 calendar years with 7 leap days = 10957 days / 365.25 = 29.998 -> 29
    assert got == [0, 0, 29]


def test_age_band_edges(spark):
    df = spark.createDataFrame([(v,) for v in [-1, 19, 20, 29, 89, 90, 95, None]], "a int")
    got = [r.b for r in df.select(age_band("a").alias("b")).collect()]
    assert got == ["<20", "<20", "20-29", "20-29", "80-89", None, None, None]


def test_sentinel_filter_is_a_pushable_range(spark, tmp_path):
    rows = [(dt.date(1900, 1, 1),), (dt.date(1900, 12, 31),), (dt.date(1899, 12, 31),), (dt.date(2001, 1, 1),), (None,)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "d date").write.parquet(path)
    df = spark.read.parquet(path).where(not_sentinel_date("d"))
    assert sorted(r.d for r in df.collect()) == [dt.date(1899, 12, 31), dt.date(2001, 1, 1)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(d,1900-01-01)" in plan and "GreaterThanOrEqual(d,1901-01-01)" in plan


def test_labels(spark):
    df = spark.createDataFrame([("HEADOFFICE", "hired", "F", 3), (None, "termed", None, 4)], "a string, b string, g string, n long")
    r = df.select(
        pair_label("a", "b").alias("p"), cross_label("a", "b").alias("c"), count_label("b", "g", "n").alias("l")
    ).collect()
    assert r[0].p == "HEADOFFICE hired" and r[1].p == "NA termed"
    assert r[0].c == "HEADOFFICE\nhired" and r[1].c is None
    assert r[0].l == "hired (F): 3" and r[1].l == "termed (NA): 4"


def test_cross_label_replaces_first_dot_only(spark):
    df = spark.createDataFrame([("A.B", "c")], "a string, b string")
    assert df.select(cross_label("a", "b").alias("c")).first().c == "A\nB.c"


def test_rounding_helpers(spark):
    df = spark.createDataFrame([(2.25, 101)], "x double, y int")
    r = df.select(round_half_even("x", 1).alias("h"), round_up_to("y", 25).alias("u"), F.round("x", 1).alias("hu")).first()
    assert r.h == 2.2 and r.hu == 2.3 and r.u == 125


def test_partition_sizing():
    from rosterlens.session import cluster_settings, shuffle_partitions_for

    assert shuffle_partitions_for(3 << 20, 8) == 4          # sf0.1-sized input on 8 cores
    assert shuffle_partitions_for(64 << 30, 8) == 1024      # 64 GB -> 64 MB partitions
    conf = cluster_settings(3 << 40, 8000)
    assert conf["spark.sql.shuffle.partitions"] == str(3 * 8 * 1024)
    assert conf["spark.rosterlens.panel.storage"] == "table"


def test_years_between_calendar_option(spark):
    rows = [(dt.date(2001, 3, 1), dt.date(2000, 3, 1)), (dt.date(2001, 2, 28), dt.date(2000, 3, 1)),
            (dt.date(2010, 6, 1), dt.date(1980, 6, 1)), (dt.date(1980, 6, 1), dt.date(2010, 5, 31))]
    df = spark.createDataFrame(rows, "a date, b date")
    got = [(r.avg, r.cal) for r in df.select(years_between("a", "b").alias("avg"),
                                             years_between("a", "b", calendar=True).alias("cal")).collect()]
    # the last pair is one day short of 30 years: 29 either way
    assert got == [(0, 1), (0, 0), (29, 30), (29, 29)]
