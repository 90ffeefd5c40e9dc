"""Session helpers: executors must be able to import this package."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Put the repository on the Python path of executors that run on machines where it is checked out."""
    path = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))


#: Rows of a stated set (queries, methods) up to which it is broadcast.
BROADCAST_ROWS = 100_000


def against(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """Every row with every member of a stated set: the set is broadcast if it is small, which is counted; else it is
    dealt into blocks of that size, and each row meets the blocks one after the other."""
    n = stated.count()
    if n <= BROADCAST_ROWS:
        return rows.crossJoin(F.broadcast(stated))
    blocks = -(-n // BROADCAST_ROWS)
    dealt = stated.withColumn("block_", F.pmod(F.xxhash64(*stated.columns), F.lit(blocks)))
    sent = rows.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return sent.join(dealt, "block_").drop("block_")


def spread(scan: DataFrame, key: str, waves: int = 2) -> DataFrame:
    """A scan whose files make fewer partitions than `waves` times the cores, dealt out by a key; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= waves * cores else scan.repartition(2 * cores, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset and
    all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")
