import datetime as dt

import pytest

from conftest import SF_MID, SF_SMALL
from rosterlens import constants as K
from rosterlens.operators import latest_snapshot
from rosterlens.plans import registered_queries
from rosterlens.sources import PANEL_COLUMNS, panel_from_tables, read_panel, read_panel_csv, write_panel

CSV = """EmployeeID,recorddate_key,birthdate_key,orighiredate_key,terminationdate_key,age,length_of_service,city_name,department_name,job_title,store_name,gender_short,gender_full,termreason_desc,termtype_desc,STATUS_YEAR,STATUS,BUSINESS_UNIT
1318,12/31/2006 0:00,1/3/1954,8/28/1989,1/1/1900,52,17,Vancouver,Executive,CEO,35,M,Male,Not Applicable,Not Applicable,2006,ACTIVE,HEADOFFICE
1318,1/5/2007,1/3/1954,8/28/1989,1/1/1900,53,18,Vancouver,Executive,CEO,35,M,Male,Not Applicable,Not Applicable,2007,ACTIVE,HEADOFFICE
1319,13/40/2006,,8/28/1989,NA,NA,17,NA,Executive,VP Stores,35,F,Female,Layoff,Involuntary,2006,TERMINATED,HEADOFFICE
"""


def test_read_panel_csv(spark, tmp_path):
    path = tmp_path / "employees.csv"
    path.write_text(CSV)
    df = read_panel_csv(spark, str(path))
    assert df.columns == PANEL_COLUMNS
    rows = df.orderBy(K.SNAPSHOT).collect()
    assert rows[0].recorddate_key == dt.date(2006, 12, 31) and rows[1].recorddate_key == dt.date(2007, 1, 5)
    assert rows[2].recorddate_key is None and rows[2].birthdate_key is None and rows[2].terminationdate_key is None
    assert rows[2].age is None and rows[2].city_name is None
    assert rows[0].terminationdate_key == dt.date(1900, 1, 1)
    # snapshot ids follow file order, so "first row wins" ties follow the file
    assert [r.snapshot_id for r in rows] == sorted(r.snapshot_id for r in rows)


@pytest.mark.parametrize(
    "sf_dir, rows, employees, active, terminated",
    [(SF_SMALL, 1500, 150, 120, 28), (SF_MID, 15000, 1500, 1208, 276)],
)
def test_derived_panel_sizes(spark, sf_dir, rows, employees, active, terminated):
    p = panel_from_tables(spark, sf_dir)
    assert p.columns == PANEL_COLUMNS
    assert p.count() == rows == spark.read.parquet(f"{sf_dir}/orders.parquet").count()      # no order is lost
    assert p.select(K.ID).distinct().count() == employees
    q = registered_queries()
    assert q["q6_active_service"](spark, sf_dir).count() == active
    assert q["q5_term_service"](spark, sf_dir).count() == terminated


def test_panel_store_roundtrip(spark, tmp_path):
    p = panel_from_tables(spark, SF_SMALL)
    path = str(tmp_path / "panel")
    write_panel(p, path)
    back = read_panel(spark, path)
    assert back.columns == PANEL_COLUMNS
    assert back.count() == p.count()
    # partition pruning on the status year
    pruned = back.where(back[K.STATUS_YEAR] == 1996)
    assert "PartitionFilters: [isnotnull(STATUS_YEAR" in pruned._jdf.queryExecution().executedPlan().toString()


def test_panel_dates_do_not_depend_on_session_time_zone(spark):
    base = sorted(map(tuple, panel_from_tables(spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert dict(panel_from_tables(spark, SF_SMALL).dtypes)[K.RECORD_DATE] == "date"
        other = sorted(map(tuple, panel_from_tables(spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "true")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert base == other


def test_read_panel_csv_rejects_reordered_header(spark, tmp_path):
    lines = CSV.strip().splitlines()
    cols = lines[0].split(",")
    cols[5], cols[6] = cols[6], cols[5]  # age <-> length_of_service in the header only
    path = tmp_path / "bad.csv"
    path.write_text("\n".join([",".join(cols)] + lines[1:]) + "\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        read_panel_csv(spark, str(path)).collect()


def test_cli_writes_selected_reports(spark, tmp_path):
    from rosterlens.__main__ import main

    out = str(tmp_path / "reports")
    assert main(["--sf-dir", SF_SMALL, "--out", out, "q0_*", "q1_1_flow"]) == 0
    flow = spark.read.parquet(f"{out}/q1_1_flow")
    assert sorted(flow.columns) == ["hired", "termed", "total", "year"] and flow.count() == 16
    assert spark.read.parquet(f"{out}/q0_id_gap").count() == 1
    assert main(["--sf-dir", SF_SMALL, "no_such_key"]) == 2


def test_missing_employee_ids_are_rejected(spark, tmp_path):
    lines = CSV.strip().splitlines()
    path = tmp_path / "ids.csv"
    path.write_text("\n".join(lines[:2] + ["NA" + lines[3][len("1319"):]]) + "\n")
    assert read_panel_csv(spark, str(path), check_ids=False).count() == 2
    with pytest.raises(ValueError, match="EmployeeID"):
        read_panel_csv(spark, str(path))


def test_bad_cells_fail_and_empty_text_stays(spark, tmp_path):
    lines = CSV.strip().splitlines()
    cells = lines[1].split(",")
    (tmp_path / "bad.csv").write_text("\n".join([lines[0], ",".join(cells[:5] + ["abc"] + cells[6:])]) + "\n")
    with pytest.raises(Exception, match="age is not an integer: abc"):
        read_panel_csv(spark, str(tmp_path / "bad.csv"), check_ids=False).collect()
    (tmp_path / "short.csv").write_text("\n".join([lines[0], ",".join(cells[:-1])]) + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_panel_csv(spark, str(tmp_path / "short.csv"), check_ids=False).collect()
    (tmp_path / "empty.csv").write_text("\n".join([lines[0], ",".join(cells[:7] + [""] + cells[8:])]) + "\n")
    assert read_panel_csv(spark, str(tmp_path / "empty.csv")).first().city_name == ""


def test_ids_follow_file_names_not_task_packing(spark, tmp_path):
    lines = CSV.strip().splitlines()
    src = tmp_path / "files"
    src.mkdir()
    (src / "a.csv").write_text("\n".join([lines[0], lines[1].replace("Vancouver", "First")]) + "\n")
    (src / "b.csv").write_text("\n".join([lines[0], *[lines[1].replace("Vancouver", "Second")] * 2000]) + "\n")
    panel = read_panel_csv(spark, str(src))
    assert panel.select(K.SNAPSHOT).distinct().count() == 2001
    assert latest_snapshot(panel).first().city_name == "First"


def test_listing_digest_sees_every_change(spark, tmp_path):
    from rosterlens.sources import listing_digest

    folder, file = tmp_path / "t.parquet", tmp_path / "one.parquet"
    (folder / "y=1").mkdir(parents=True)
    (folder / "a").write_bytes(b"12")
    (folder / "y=1" / "b").write_bytes(b"34")
    file.write_bytes(b"5")
    digest = lambda: listing_digest(spark, [str(folder), str(file)])
    seen = [digest()]
    assert digest() == seen[0]
    (folder / "_SUCCESS").write_bytes(b"")                 # names that readers skip
    (folder / "_temporary").mkdir()
    (folder / "_temporary" / "c").write_bytes(b"x")
    assert digest() == seen[0]
    (folder / "y=1" / "b").write_bytes(b"345")             # rewritten in place
    seen.append(digest())
    (folder / "y=1" / "d").write_bytes(b"")                # added, nested
    seen.append(digest())
    file.unlink()
    file.mkdir()                                           # a file replaced by an empty folder
    seen.append(digest())
    assert len(set(seen)) == 4
