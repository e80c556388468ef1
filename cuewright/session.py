"""SparkSession factory with the settings the engine assumes (UTC, AQE)."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def build_session(app: str = "cuewright", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that spark-submit gives."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores or os.cpu_count() or 1}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores or 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names, which driver and executors share, read again.

    Cuts the plan where steps build on each other, and computes once what is used often. A folder of our own is
    made only where a local session names none. The table is removed when the process ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cuewright-')}"
        spark.sparkContext.setCheckpointDir(folder)
        _made.append(folder)
    path = f"{folder.rstrip('/')}/cuewright-kept-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for path in _made:
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
