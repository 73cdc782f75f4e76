"""Session helpers: one place for the settings that results depend on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "tidewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution; on a cluster pass no master."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """The session of tests and of bench.py: few shuffle partitions, no UI."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return get_session(
        master=f"local[{n}]",
        **({
            "spark.sql.shuffle.partitions": str(n),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        } | conf),
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one of ``spark.checkpoint.dir``. Only on a
    local master, where it may be unset, a new local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")
