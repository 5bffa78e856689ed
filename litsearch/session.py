"""Spark session helpers.

Library code never builds its own session; it takes the caller's. These
helpers exist for tests, the bench and the driver entry point, plus one
function that resolves the shared scratch folder for lineage cuts.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000   # of a few narrow columns; a larger table is joined by a shuffle
CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "litsearch") -> SparkSession:
    """A local session for tests and the bench (AQE on, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir``, if any."""
    value = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not value:
        try:
            value = spark.conf.get(CHECKPOINT_CONF, None)
        except Exception:  # pragma: no cover - conf not readable in some modes
            value = None
    return value or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for checkpoints and scratch tables.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is. Only when it is unset (local tests) a fresh folder under
    the system temp directory is registered.
    """
    sc = spark.sparkContext
    root = checkpoint_root(spark)
    if root is None:
        root = getattr(sc, "_litsearch_scratch", None)
        if root is None:
            if not (sc.master or "").startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="litsearch-ckpt-")
            sc._litsearch_scratch = root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write to the shared checkpoint folder and read back (lineage cut, no schema inference)."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Store a narrow table and count it. Up to ``rows`` rows it is marked to be sent whole to the tasks, so
    that a join with it does not shuffle the other side; beyond, it is joined as any other table."""
    stored = materialize(df, name)
    small = stored.count() <= rows
    return (F.broadcast(stored) if small else stored), small


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
