"""Raw CSV files: one scan, no shuffle of raw rows, checks on the way; hot employees in the panel table."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rosterlens import constants as K
from rosterlens.plans import clear_contexts, workforce
from rosterlens.sources import import_panel_csv, panel_from_tables, read_panel, read_panel_csv, write_panel, write_panel_csv
from test_sources import CSV

LINES = CSV.strip().splitlines()


@pytest.fixture
def settings(spark):
    """Set session settings for one test."""
    before = {}

    def put(**conf):
        for key, value in conf.items():
            key = "spark.sql." + key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_is_scanned_once_and_its_rows_are_not_shuffled(spark, tmp_path, settings):
    (tmp_path / "a.csv").write_text(CSV)
    settings(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    plan = _plan(read_panel_csv(spark, str(tmp_path / "a.csv"), check_ids=False))
    assert plan.count("FileScan csv") == 1
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_ids_follow_files_splits_and_rows(spark, tmp_path, settings):
    """Files of several splits, packed into tasks by size, keep (file name, line) order."""
    cells = LINES[1].split(",")
    want = []
    for name, rows in (("c", 40), ("a", 3000), ("b", 1), ("d", 900)):
        texts = [f"{name}{i:05d}" for i in range(rows)]
        (tmp_path / f"{name}.csv").write_text("\n".join([LINES[0], *(",".join([*cells[:7], t, *cells[8:]]) for t in texts)]) + "\n")
        want += texts
    settings(files__maxPartitionBytes="20000", files__openCostInBytes="3000")
    panel = read_panel_csv(spark, str(tmp_path))
    assert panel.rdd.getNumPartitions() > 10
    rows = panel.select(K.SNAPSHOT, K.CITY).collect()
    assert len({r[0] for r in rows}) == len(rows) == len(want)
    assert [r[1] for r in sorted(rows)] == sorted(want)


def test_files_over_the_bound_are_joined_instead(spark, tmp_path, monkeypatch):
    import rosterlens.sources.raw_csv as module

    for name in "abc":
        (tmp_path / f"{name}.csv").write_text("\n".join([LINES[0], LINES[1].replace("Vancouver", name)]) + "\n")
    monkeypatch.setattr(module, "MAX_BROADCAST_FILES", 2)
    assert [r.city_name for r in read_panel_csv(spark, str(tmp_path)).orderBy(K.SNAPSHOT).collect()] == ["a", "b", "c"]


def test_import_counts_and_publishes_whole_panels_only(spark, tmp_path):
    (tmp_path / "good.csv").write_text(CSV)
    out = str(tmp_path / "panel")
    panel, counted = import_panel_csv(spark, str(tmp_path / "good.csv"), out)
    assert panel.count() == counted["rows"] == 3
    assert (counted[K.ID], counted[K.RECORD_DATE], counted[K.BIRTH_DATE], counted[K.HIRE_DATE]) == (0, 1, 1, 0)
    with pytest.raises(FileExistsError):
        import_panel_csv(spark, str(tmp_path / "good.csv"), out)
    cells = LINES[1].split(",")
    bad = {"id": ["NA", *cells[1:]], "cell": [*cells[:5], "abc", *cells[6:]], "short": cells[:-1]}
    for name, row in bad.items():
        (tmp_path / f"{name}.csv").write_text("\n".join([*LINES[:3], ",".join(row)]) + "\n")
        with pytest.raises(Exception, match="(?i)EmployeeID|integer|malformed"):
            import_panel_csv(spark, str(tmp_path / f"{name}.csv"), str(tmp_path / f"out-{name}"))
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["panel"]      # nothing published, nothing left


def test_import_of_no_rows(spark, tmp_path):
    (tmp_path / "none.csv").write_text(LINES[0] + "\n")
    panel = read_panel_csv(spark, str(tmp_path / "none.csv"))
    assert panel.count() == 0


def test_written_csv_reads_back_whole_and_in_order(spark, tmp_path):
    panel = panel_from_tables(spark, SF_SMALL)
    odd = panel.limit(1).withColumns({
        K.SNAPSHOT: F.lit(-1).cast("long"), K.CITY: F.lit('a "quoted", \\ text'), K.DEPT: F.lit(""), K.JOB: F.lit("été")
    })
    panel = panel.unionByName(odd)
    write_panel_csv(panel, str(tmp_path / "csv"))
    back = read_panel_csv(spark, str(tmp_path / "csv"))
    columns = [c for c in panel.columns if c != K.SNAPSHOT]
    assert [tuple(r) for r in back.orderBy(K.SNAPSHOT).select(columns).collect()] == [
        tuple(r) for r in panel.orderBy(K.SNAPSHOT).select(columns).collect()
    ]


def test_a_hot_employee_is_written_by_several_tasks(spark, tmp_path, settings):
    """A third of the rows, all of one year, belong to one employee."""
    settings(adaptive__advisoryPartitionSizeInBytes="1000")
    cold = panel_from_tables(spark, SF_SMALL)
    hot = cold.limit(1).crossJoin(spark.range(750, numPartitions=8)).withColumn(K.SNAPSHOT, F.col("id") + (1 << 40)).drop("id")
    panel = cold.unionByName(hot.withColumns({K.ID: F.lit(7).cast("long"), K.STATUS_YEAR: F.lit(1996)}))
    path = str(tmp_path / "panel")
    write_panel(panel, path)
    back = read_panel(spark, path)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, panel.select(back.columns).collect()))
    files = back.where(F.col(K.ID) == 7).select(F.input_file_name()).distinct().count()
    assert files > 1


def test_a_replaced_context_keeps_what_is_being_read(spark, tmp_path):
    sf_dir = tmp_path / "sf"
    for t in ("orders", "customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{sf_dir}/{t}.parquet")
    spark.conf.set("spark.rosterlens.panel.storage", "table")
    try:
        old = workforce(spark, str(sf_dir))
        panel = old.panel
        spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(1).write.mode("append").parquet(f"{sf_dir}/orders.parquet")
        new = workforce(spark, str(sf_dir))
        assert new is not old
        assert panel.count() == 1500          # its files are still there
        path = old._path
        clear_contexts()
        assert not os.path.exists(path.removeprefix("file:"))
    finally:
        spark.conf.unset("spark.rosterlens.panel.storage")


def test_stream_batches_past_the_old_bound(spark, tmp_path):
    from rosterlens.streaming import _BATCHES, _append_batch
    from rosterlens.sources.raw_csv import READ_OPTIONS, TEXT_SCHEMA, positioned

    (tmp_path / "a.csv").write_text(CSV)
    batch = positioned(spark.read.schema(TEXT_SCHEMA).options(**READ_OPTIONS).csv(str(tmp_path / "a.csv")))
    write = _append_batch(str(tmp_path / "store"))
    for number in (70_000, _BATCHES - 1):
        write(batch, number)
    ids = [r[0] for r in spark.read.parquet(str(tmp_path / "store")).orderBy("ingest_batch", K.SNAPSHOT).select(K.SNAPSHOT).collect()]
    assert ids == sorted(set(ids)) and len(ids) == 6 and ids[0] > 0
    with pytest.raises(OverflowError):
        write(batch, _BATCHES)


def test_written_files_are_sized_by_rows(spark, tmp_path, monkeypatch):
    """A file's rows fit the memory that sorts them, whatever the bytes of their shuffle."""
    from rosterlens.sources import raw_csv

    assert [raw_csv.csv_files(n, 200) for n in (0, 1, 100_000, 100_001, 54_000_000, 1_000_000_000)] == [1, 1, 1, 2, 200, 2000]
    monkeypatch.setattr(raw_csv, "FEW_ROWS", 2)
    (tmp_path / "a.csv").write_text("\n".join([LINES[0], *[",".join(["%d" % i, *LINES[1].split(",")[1:]]) for i in range(40)]]) + "\n")
    panel = read_panel_csv(spark, str(tmp_path / "a.csv"))
    raw_csv.write_panel_csv(panel, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    ids = [int(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
    assert len(files) > 10 and ids == list(range(40))


def test_import_shuffles_without_holding_rows(spark, tmp_path):
    """With more shuffle partitions than that, every task would hold, sort and spill its rows."""
    from rosterlens.sources.store import unsorted_partitions, write_panel

    (tmp_path / "a.csv").write_text(CSV)
    seen = []
    frame = type(spark.range(1))
    hint = frame.hint
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        frame.hint = lambda self, name, *args: seen.append(args) or hint(self, name, *args)
        spark.conf.set("spark.sql.shuffle.partitions", "1000")
        write_panel(read_panel_csv(spark, str(tmp_path / "a.csv")), str(tmp_path / "out"))
    finally:
        frame.hint = hint
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0][0] == unsorted_partitions(spark) == 200
