"""Shared bases of the analyses, built once per (session, data folder).

Several analyses read the same derived tables: the snapshot panel, the
hire/termination event ages, the latest snapshot per employee, the rows
with a real termination reason, and the service cut-offs of the
terminated and active bases. The context builds each lazily (or all at
once with ``warm()``) and keeps it for the next query:

* ``spark.rosterlens.panel.storage`` = ``cache`` persists the panel with
  MEMORY_AND_DISK (a lost block is recomputed from lineage); ``table``
  writes it as Parquet, partitioned by ``STATUS_YEAR``, under the shared
  ``spark.checkpoint.dir`` folder and reads it back (lineage cut at the
  file; scans then prune columns and push filters); ``none`` recomputes
  per query. Unset, it is ``cache`` on a ``local[...]`` master and
  ``table`` on a cluster, where the panel is as large as ``orders``.
* the derived tables are persisted (MEMORY_AND_DISK) unless the mode is
  ``none``; their partitions are those of the panel, or what AQE makes of a
  shuffle, never fewer by a rule of ours.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.functions import age_band, not_sentinel_date, years_between
from rosterlens.operators import exact_quantiles, group_mean, latest_snapshot
from rosterlens.session import checkpoint_root, master_of, session_key
from rosterlens.sources import import_panel_csv, listing_digest, materialize_panel, panel_from_tables, remove_panel, write_panel_csv

STORAGE_CONF = "spark.rosterlens.panel.storage"
# quantiles of service the Q5/Q6 reports cut at (fixed values of the studied analysis)
SERVICE_QUANTILES = (0.01, 0.1, 0.9, 0.99)
MEAN_QUANTILES = (0.1, 0.9)


class Workforce:
    """The panel plus the tables derived from it that several analyses share."""

    def __init__(self, panel: DataFrame | Callable[[], tuple[DataFrame, str | None]], storage: str = "cache"):
        """``panel``: the table, or what builds it (and its written path) on first use."""
        self.storage, self._source, self._lock = storage, panel, threading.RLock()
        self._path: str | None = None

    @property
    def panel(self) -> DataFrame:
        with self._lock:
            if "_panel" not in self.__dict__:
                panel = self._source
                if callable(panel):
                    panel, self._path = panel()
                # A written table is already cheap to re-read; only a computed panel is persisted.
                self._panel = panel.persist(StorageLevel.MEMORY_AND_DISK) if self.storage == "cache" else panel
            return self._panel

    def _keep(self, df: DataFrame) -> DataFrame:
        """Persisted as it comes: the parallelism of the input, or what AQE makes of the last shuffle's sizes."""
        return df if self.storage == "none" else df.persist(StorageLevel.MEMORY_AND_DISK)

    # -- event ages (Q2) ------------------------------------------------------
    @cached_property
    def event_ages(self) -> DataFrame:
        """Distinct (event year, unit, employee, age at the event, action) rows.

        One pass over the panel: every row yields its hire event and, when
        the termination date is a real one, its termination event; then
        one distinct. ``hire_ages`` / ``term_ages`` are filters of it.
        """
        events = F.inline(
            F.array(
                F.struct(F.lit(K.ACTION_HIRED).alias("action"), F.col(K.HIRE_DATE).alias("_d")),
                F.struct(
                    F.lit(K.ACTION_TERMED).alias("action"),
                    F.when(not_sentinel_date(K.TERM_DATE), F.col(K.TERM_DATE)).alias("_d"),
                ),
            )
        )
        rows = self.panel.select(K.BU, K.ID, K.BIRTH_DATE, events).where(
            (F.col("action") == K.ACTION_HIRED) | F.col("_d").isNotNull()
        )
        ages = rows.select(
            F.year("_d").alias("year"), K.BU, K.ID, years_between("_d", K.BIRTH_DATE).alias(K.AGE), "action"
        ).distinct()
        return self._keep(ages)

    @cached_property
    def hire_ages(self) -> DataFrame:
        """Distinct (hire year, unit, employee, age at hire), action ``hired``."""
        return self.event_ages.where(F.col("action") == K.ACTION_HIRED)

    @cached_property
    def term_ages(self) -> DataFrame:
        """Distinct (termination year, unit, employee, age at termination), action ``termed``."""
        return self.event_ages.where(F.col("action") == K.ACTION_TERMED)

    # -- rows with a real termination reason (Q1-4, Q2-3, Q3) --------------------
    @cached_property
    def reasoned(self) -> DataFrame:
        """Panel rows whose termination reason is a real one.

        Thirteen analyses read only these rows, a small share of the panel
        (one per terminated employee in the derived panel); keeping them
        means the panel is scanned for them once.
        """
        return self._keep(self.panel.where(F.col(K.REASON) != K.NO_REASON))

    # -- service bases (Q5, Q6) ----------------------------------------------
    @cached_property
    def latest(self) -> DataFrame:
        """One row per employee: the first snapshot with the longest service."""
        return self._keep(latest_snapshot(self.panel))

    def _service_base(self, status: str) -> DataFrame:
        return self.latest.where(F.col(K.STATUS) == status).withColumnRenamed(K.SERVICE_YEARS, K.SERVICE)

    @cached_property
    def terminated(self) -> DataFrame:
        """Latest snapshot of employees whose picked row is TERMINATED, ``service`` renamed."""
        return self._service_base(K.STATUS_TERMINATED)

    @cached_property
    def active(self) -> DataFrame:
        """Latest snapshot of employees whose picked row is ACTIVE, ``service`` renamed."""
        return self._service_base(K.STATUS_ACTIVE)

    # -- service cut-offs (Q5, Q6) ----------------------------------------------
    def _cuts(self, base: str) -> DataFrame:
        cache = self.__dict__.setdefault("_cut_tables", {})
        if base not in cache:
            rows = self.terminated if base == "terminated" else self.active
            q = F.percentile(F.col(K.SERVICE), list(SERVICE_QUANTILES))
            cache[base] = self._keep(rows.agg(q.alias("q")))
        return cache[base]

    def service_cut(self, base: str, p: float) -> Column:
        """Quantile ``p`` of ``service`` over the ``terminated`` / ``active`` base.

        All cut-offs of a base come from one aggregate over it, persisted as a
        one-row table; each use is a scalar subquery over that row, so a
        report reads the base once instead of twice.
        """
        return self._cuts(base).select(F.col("q")[SERVICE_QUANTILES.index(p)]).scalar()

    # -- mean service per group (Q5, Q6) -----------------------------------------
    def group_means(self, base: str, dim: str) -> DataFrame:
        """Mean ``service`` per ``dim`` of the ``terminated`` / ``active`` base: one row per group.

        Its listing and its best and worst groups read one table.
        """
        with self._lock:
            cache = self.__dict__.setdefault("_mean_tables", {})
            if (base, dim) not in cache:
                rows = self.terminated if base == "terminated" else self.active
                if dim == K.AGE_BAND:
                    rows = rows.withColumn(dim, age_band(K.AGE))
                cache[base, dim] = self._keep(group_mean(rows, K.SERVICE, [dim]))
            return cache[base, dim]

    def mean_cut(self, base: str, dim: str, p: float) -> Column:
        """Quantile ``p`` of the group means; those of both ends come from one selection, kept as one row."""
        with self._lock:
            cache = self.__dict__.setdefault("_mean_cut_tables", {})
            if (base, dim) not in cache:
                cache[base, dim] = self._keep(exact_quantiles(self.group_means(base, dim), K.SERVICE, MEAN_QUANTILES))
            return cache[base, dim].select(F.col("q")[MEAN_QUANTILES.index(p)]).scalar()

    # -- the panel by way of raw CSV files (S1, S3, S4) ------------------------------
    @property
    def imported(self) -> DataFrame:
        """The panel written as raw CSV files and imported from them as a table, once."""
        with self._lock:
            if "_imported" not in self.__dict__:
                spark = self.panel.sparkSession
                self._import_folder = f"{checkpoint_root(spark)}/rosterlens-import-{uuid.uuid4().hex[:12]}"
                write_panel_csv(self.panel, f"{self._import_folder}/csv")
                self._imported, _ = import_panel_csv(spark, f"{self._import_folder}/csv", f"{self._import_folder}/panel")
            return self._imported

    def warm(self) -> int:
        """Build and persist every shared base now; returns the panel row count."""
        rows = self.panel.count()
        for base in (self.latest, self.event_ages, self.reasoned):
            base.count()
        for name in ("terminated", "active"):
            self._cuts(name).count()
        return rows

    def unpersist(self) -> None:
        """Give up what is persisted; DataFrames in use compute it again."""
        for tables in ("_cut_tables", "_mean_cut_tables", "_mean_tables"):
            for df in self.__dict__.get(tables, {}).values():
                df.unpersist()
        for name in ("event_ages", "latest", "reasoned"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()
        if "_panel" in self.__dict__:
            if self.storage == "cache":
                self._panel.unpersist()

    def release(self) -> None:
        """Also delete what was written: no DataFrame of this context may be in use any more."""
        self.unpersist()
        for path in (self._path, self.__dict__.get("_import_folder")):
            if path:
                remove_panel(self._panel.sparkSession, path)


_CONTEXTS: dict[tuple[str, ...], tuple[str, Workforce]] = {}
_REPLACED: list[Workforce] = []     # their files may still be read; clear_contexts deletes them
_LOCK = threading.Lock()
_TABLES = ("orders", "customer", "nation")


def workforce(spark: SparkSession, sf_dir: str) -> Workforce:
    """The shared context for ``sf_dir`` in this session; its panel is built on first use.

    A context belongs to the files that were there: when files were added,
    removed or rewritten since, a new one takes its place. What the old one wrote stays until
    :func:`clear_contexts`, as queries may be reading it.
    """
    default = "cache" if master_of(spark).startswith("local") else "table"
    storage = spark.conf.get(STORAGE_CONF, None) or default
    sf_dir = sf_dir.rstrip("/")
    # one context per session: DataFrames are bound to the session that made them
    key = (*session_key(spark), sf_dir, storage)
    files = listing_digest(spark, [f"{sf_dir}/{t}.parquet" for t in _TABLES])

    def build() -> tuple[DataFrame, str | None]:
        panel = panel_from_tables(spark, sf_dir)
        return materialize_panel(spark, panel, "|".join([*key[:3], files])) if storage == "table" else (panel, None)

    with _LOCK:  # queries may be started from several threads; nothing runs on the cluster in here
        held = _CONTEXTS.get(key)
        if held is None or held[0] != files:
            _CONTEXTS[key] = (files, Workforce(build, storage=storage))
            if held is not None:
                held[1].unpersist()
                _REPLACED.append(held[1])
        return _CONTEXTS[key][1]


def clear_contexts() -> None:
    """Release every context, replaced ones included, with the files they wrote."""
    with _LOCK:
        for ctx in [*_REPLACED, *(held for _, held in _CONTEXTS.values())]:
            ctx.release()
        _REPLACED.clear()
        _CONTEXTS.clear()
