"""The panel as a Parquet table.

A panel written here is partitioned by ``STATUS_YEAR``, so a query that
filters on the year prunes whole directories, and every other filter and
projection is pushed into the Parquet scan.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens import constants as K
from rosterlens.session import checkpoint_root
from rosterlens.sources.derived import PANEL_COLUMNS


def unsorted_partitions(spark: SparkSession) -> int:
    """Up to so many shuffle partitions a task appends to one file each, without holding or sorting its rows."""
    return max(1, int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200")))


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by year; the rows of a year are spread by employee over a few files.

    A year gets an eighth of the shuffle partitions as files, however many tasks
    the panel comes from; an employee's rows of a year share a file. The shuffle
    is a rebalance: Spark cuts a partition over the advisory size, such as that of
    an employee with very many rows, into several tasks, each with its own file,
    and puts small ones together. Its partitions are few enough that a task appends
    rows to them as they come: with more, Spark holds and sorts them, and spills.
    """
    partitions = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_year = max(1, partitions // 8)
    spread = panel.withColumn("_spread", F.pmod(F.xxhash64(K.ID), F.lit(per_year)))
    spread = spread.hint("rebalance", min(partitions, unsorted_partitions(panel.sparkSession)), K.STATUS_YEAR, "_spread")
    spread.drop("_spread").write.mode(mode).partitionBy(K.STATUS_YEAR).parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """The panel columns in their order; others (such as an ingest batch) are left out."""
    return spark.read.parquet(path).select(*PANEL_COLUMNS)


def _located(spark: SparkSession, path: str):
    """(file system, Hadoop path) of ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.exists(target)


_STATUS = re.compile(r"path=(.*?); isDirectory=(true|false);(.*?)modification_time=(\d+);", re.DOTALL)
_LENGTH = re.compile(r"length=(\d+);")


def listing_digest(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the names, lengths and times of the files under ``paths``, from listings alone.

    No Spark job and no footer is read. A folder's listing comes in one call and is
    folded into the digest at once, so nothing is held for each file. Names
    that Spark's readers skip (a leading ``_`` or ``.``) do not count.
    """
    digest = hashlib.sha256()
    as_text = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString
    for path in paths:
        todo = [path]
        while todo:
            fs, folder = _located(spark, todo.pop())
            found = _STATUS.findall(as_text(fs.listStatus(folder)))
            for name, is_folder, rest, changed in sorted(found):
                if name.rsplit("/", 1)[-1].startswith(("_", ".")):
                    continue
                if is_folder == "true":
                    todo.append(name)
                else:
                    digest.update(repr((name, _LENGTH.findall(rest), changed)).encode())
    return digest.hexdigest()


def remove_panel(spark: SparkSession, path: str) -> None:
    """Delete a written panel."""
    fs, target = _located(spark, path)
    fs.delete(target, True)


def rename_panel(spark: SparkSession, path: str, to: str) -> None:
    """Give a written panel its final name."""
    fs, source = _located(spark, path)
    if not fs.rename(source, _located(spark, to)[1]):
        raise OSError(f"cannot rename {path} to {to}")


def materialize_panel(spark: SparkSession, panel: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``panel`` under the session's shared checkpoint folder and read it back.

    This cuts the lineage back to the source tables: a lost executor then
    re-reads Parquet files instead of recomputing joins. The folder comes
    from ``spark.checkpoint.dir`` (see :func:`rosterlens.session.checkpoint_root`).
    Returns the table and its path.
    """
    key = hashlib.sha1(tag.encode()).hexdigest()[:16]
    path = f"{checkpoint_root(spark)}/rosterlens-panel-{key}"
    write_panel(panel, path)
    return read_panel(spark, path), path
