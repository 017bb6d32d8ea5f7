"""The panel by way of raw CSV files: written, scanned once, checked and numbered on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rosterlens import constants as K
from rosterlens.operators import latest_snapshot
from rosterlens.plans.context import Workforce


def qx_csv_panel(w: Workforce) -> DataFrame:
    """Every row of the panel as it comes back from the files (their numbering is new)."""
    return w.imported.drop(K.SNAPSHOT)


def qx_csv_latest(w: Workforce) -> DataFrame:
    """The latest snapshot per employee; ties follow the order of the files."""
    return latest_snapshot(w.imported).drop(K.SNAPSHOT)


QUERIES = {
    "qx_csv_panel": qx_csv_panel,
    "qx_csv_latest": qx_csv_latest,
}
