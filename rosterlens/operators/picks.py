"""First-row picks with explicit tie-breaks (W2-W5).

``row_number() = 1`` over a partitioned window is planned with a partial
``WindowGroupLimit`` before the shuffle and a final one after it: every map
task keeps at most one row per key, so a key holding a third of the rows
does not reach one reducer whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens import constants as K


def first_row_per(df: DataFrame, keys: list[str], order: list[Column], require: Column | None = None) -> DataFrame:
    """The first row of each ``keys`` group under ``order`` (which must be total)."""
    base = df.where(require) if require is not None else df
    w = Window.partitionBy(*keys).orderBy(*order)
    return base.withColumn("_pick", F.row_number().over(w)).where(F.col("_pick") == 1).drop("_pick")


def _snapshot_order(service_first: Column) -> list[Column]:
    # First row in record order wins a tie on service.
    return [service_first, F.col(K.RECORD_DATE).asc_nulls_last(), F.col(K.SNAPSHOT).asc_nulls_last()]


def latest_snapshot(panel: DataFrame, keys: list[str] = (K.ID,), service: str = K.SERVICE_YEARS) -> DataFrame:
    """One row per employee: the first row with the longest service (NULL service never picked)."""
    return first_row_per(panel, list(keys), _snapshot_order(F.col(service).desc()), F.col(service).isNotNull())


def earliest_snapshot(panel: DataFrame, keys: list[str] = (K.ID,), service: str = K.SERVICE_YEARS) -> DataFrame:
    """One row per ``keys`` group: the first row with the shortest service."""
    return first_row_per(panel, list(keys), _snapshot_order(F.col(service).asc()), F.col(service).isNotNull())


def extreme_member_per(
    counts: DataFrame, group: str, member: str, value: str = "n", largest: bool = True
) -> DataFrame:
    """Per ``group``, the member with the largest (or smallest) ``value``.

    Ties go to the member that sorts first (NULL last), which is the order
    in which the grouped counts are listed.
    """
    v = F.col(value).desc() if largest else F.col(value).asc()
    return first_row_per(counts, [group], [v, F.col(member).asc_nulls_last()], F.col(value).isNotNull())
