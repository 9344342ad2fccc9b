"""Session helpers: local sessions for tests/bench and checkpoint handling."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "roadflow") -> SparkSession:
    """A local session tuned for small scale factors (tests, bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this names a shared folder and is used as is.  Without one, a
    cluster session is refused: a private folder would be on one machine's disk.
    Only a local master (tests, bench), where driver and executors are one
    process, gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="roadflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured) if _settable(spark) else None
    sc.setCheckpointDir(configured)
    return configured


def _settable(spark: SparkSession) -> bool:
    try:
        return spark.conf.isModifiable("spark.checkpoint.dir")
    except Exception:  # pragma: no cover - older APIs
        return False


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(spark: SparkSession, calls: list[Callable]) -> list:
    """Results of ``calls`` in their order; each runs its jobs from a thread of its own, as MLlib's tuning does."""
    if len(calls) < 2:
        return [call() for call in calls]
    with ThreadPoolExecutor(len(calls)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
    return [b.result() for b in begun]
