import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rosterlens import constants as K
from rosterlens.plans import clear_contexts, registered_queries, workforce
from rosterlens.plans.context import STORAGE_CONF
from rosterlens.sources import PANEL_COLUMNS, check_panel_schema, panel_from_tables, read_panel, read_panel_csv
from rosterlens.streaming import INGEST_BATCH, ingest_snapshots
from test_sources import CSV


def test_ingest_snapshots_matches_batch_read(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    lines = CSV.strip().splitlines()
    (src / "a.csv").write_text("\n".join(lines[:3]) + "\n")
    (src / "b.csv").write_text("\n".join([lines[0], lines[3]]) + "\n")
    store = str(tmp_path / "store")
    q = ingest_snapshots(spark, str(src), store, checkpoint=str(tmp_path / "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(120)
    assert spark.read.parquet(store).select(INGEST_BATCH).distinct().count() == 2
    got = read_panel(spark, store)
    assert got.columns == PANEL_COLUMNS
    check_panel_schema(got)
    cols = [c for c in got.columns if c != K.SNAPSHOT]
    batch = read_panel_csv(spark, str(src))
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(map(tuple, batch.select(*cols).collect()), key=str)
    # a replayed run over the same files adds nothing
    q2 = ingest_snapshots(spark, str(src), store, checkpoint=str(tmp_path / "ckpt"))
    q2.awaitTermination(120)
    assert read_panel(spark, store).count() == 3


def test_check_panel_schema_rejects_wrong_types(spark):
    p = panel_from_tables(spark, SF_SMALL)
    check_panel_schema(p)
    with pytest.raises(ValueError, match="age"):
        check_panel_schema(p.withColumn("age", F.col("age").cast("string")))


@pytest.mark.parametrize("mode", ["table", "none"])
def test_storage_modes_give_same_results(spark, mode):
    q = registered_queries()
    keys = ["q1_1_flow", "q5_7_mean_city_best", "q2_4_age_box", "q4_4_top20_job_gender", "q5_service_latest"]
    columns = {k: q[k](spark, SF_SMALL).columns for k in q}
    base = {k: sorted(map(repr, q[k](spark, SF_SMALL).collect())) for k in keys}
    spark.conf.set(STORAGE_CONF, mode)
    try:
        assert {k: q[k](spark, SF_SMALL).columns for k in q} == columns       # all keys, columns in order
        other = {k: sorted(map(repr, q[k](spark, SF_SMALL).collect())) for k in keys}
        path = workforce(spark, SF_SMALL)._path
    finally:
        spark.conf.unset(STORAGE_CONF)
        clear_contexts()
    assert base == other
    assert mode != "table" or not os.path.exists(path.removeprefix("file:"))      # released: deleted


def test_added_orders_are_seen(spark, tmp_path):
    for t in ("orders", "customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    count = lambda: workforce(spark, str(tmp_path)).panel.count()
    before = count()
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(7).withColumn("o_orderkey", F.col("o_orderkey") + 10**9).write.mode(
        "append"
    ).parquet(str(tmp_path / "orders.parquet"))
    assert count() == before + 7


def test_warm_persists_and_release_unpersists_every_base(spark):
    from rosterlens.plans import Workforce

    w = Workforce(panel_from_tables(spark, SF_SMALL))
    assert w.warm() == 1500
    bases = [w.panel, w.latest, w.event_ages, w.reasoned, *w.__dict__["_cut_tables"].values()]
    assert len(bases) == 6 and all(b.storageLevel.useDisk and b.storageLevel.useMemory for b in bases)
    w.release()
    assert all(not b.storageLevel.useMemory and not b.storageLevel.useDisk for b in bases)
