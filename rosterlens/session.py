"""Session helpers: one place for the configuration the operators assume."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    master: str = "local[*]",
    app_name: str = "rosterlens",
    shuffle_partitions: int = 8,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with adaptive execution on and the UI off.

    On a cluster, leave ``master`` to the launcher and size
    ``shuffle_partitions`` to the data (AQE coalesces small ones).
    """
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # size post-shuffle partitions by bytes (advisoryPartitionSizeInBytes), not by
        # core count: aggregated report tables then run as one small task, not hundreds
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions_for(input_bytes: int, cores: int, target_bytes: int = 64 << 20) -> int:
    """About one shuffle partition per ``target_bytes`` of input, never fewer than half the cores.

    AQE still coalesces small post-shuffle partitions; this sets the upper
    bound so map tasks do not write hundreds of near-empty blocks on small
    inputs, and partitions stay a manageable size on large ones.
    """
    return max(max(1, cores // 2), math.ceil(input_bytes / target_bytes))


def cluster_settings(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Settings for a large run, sized from the bytes of the source tables.

    Shuffle partitions target ~128 MB each for a shuffle as large as the
    input (the panel join moves about that much) and at least two waves of
    tasks; AQE then coalesces the small shuffles of the report queries.
    The panel is written as a table under ``spark.checkpoint.dir``.
    """
    partitions = max(2 * total_cores, math.ceil(input_bytes / (128 << 20)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.rosterlens.panel.storage": "table",
    }


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext
        return None


def master_of(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.master if sc is not None else spark.conf.get("spark.master", "")


def session_key(spark: SparkSession) -> tuple[str, str]:
    """(application id, session id): identifies the session DataFrames are bound to."""
    sc = _context(spark)
    app = sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "")
    return app, str(getattr(spark, "session_id", None) or id(spark))


def checkpoint_root(spark: SparkSession, local_fallback: bool = True) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir``; only when it is unset on a
    ``local[...]`` master (local runs and tests) a fresh scratch folder is
    made and set on the session. On a cluster an unset value is an error:
    a machine-local folder is not visible to the other executors.
    """
    sc = _context(spark)
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if sc is not None:
        current = sc.getCheckpointDir() or current or sc.getConf().get(CHECKPOINT_CONF, None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not (local_fallback and master_of(spark).startswith("local")):
        raise RuntimeError(f"{CHECKPOINT_CONF} is not set; point it at a folder all executors share")
    path = tempfile.mkdtemp(prefix="rosterlens-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir().rstrip("/")
    spark.conf.set(CHECKPOINT_CONF, path)
    return path
