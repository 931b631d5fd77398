"""Session set-up and the few places where the engine looks at the session itself."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        # finished checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for cut lineage, which all executors must share.

    Only a local master, whose executors live in this process, gets a temporary one if none is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^-]|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


# Shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_one_writer = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries begun inside are removed at their end. One thread at a time, as it is a setting of the session."""
    with _one_writer:
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, cleanup: bool = False, **options: str) -> DataFrame:
    """``df`` written to the checkpoint folder and read again: lineage is cut, and the planner knows
    the size of the files, so it broadcasts them where its threshold allows and only there.

    With ``cleanup`` the shuffle files of the plan that wrote it are removed at once. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    with shuffles_removed(spark) if cleanup else nullcontext():
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
