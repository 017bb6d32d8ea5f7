"""The whole catalog on a panel read back from a raw CSV (S1, S3, C1 end to end)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from rosterlens import constants as K
from rosterlens.plans import ANALYSES, Workforce
from rosterlens.sources import check_panel_schema, panel_from_tables, read_panel_csv
from rosterlens.sources.raw_csv import RAW_SCHEMA

DATES = [K.RECORD_DATE, K.BIRTH_DATE, K.HIRE_DATE, K.TERM_DATE]


def _without_snapshot(rows, columns):
    keep = [i for i, c in enumerate(columns) if c != K.SNAPSHOT]
    return sorted(repr(tuple(r[i] for i in keep)) for r in rows)


def test_catalog_on_csv_panel(spark, tmp_path):
    derived = panel_from_tables(spark, SF_SMALL)
    # write the raw form: m/d/yyyy dates with trailing time text, "NA" for nulls, file order = snapshot order
    raw = derived.orderBy(K.SNAPSHOT).select(
        *[
            F.concat(F.date_format(c, "M/d/yyyy"), F.lit(" 0:00")).alias(c) if c in DATES else F.col(c)
            for c in [f.name for f in RAW_SCHEMA.fields]
        ]
    )
    path = str(tmp_path / "raw")
    raw.coalesce(1).write.option("header", True).option("nullValue", "NA").csv(path)

    panel = read_panel_csv(spark, path)
    check_panel_schema(panel)
    a = Workforce(derived)
    b = Workforce(panel)
    try:
        for key, build in ANALYSES.items():
            x, y = build(a), build(b)
            assert sorted(x.columns) == sorted(y.columns), key
            assert _without_snapshot(x.collect(), x.columns) == _without_snapshot(y.collect(), y.columns), key
    finally:
        a.release()
        b.release()
