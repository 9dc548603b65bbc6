"""Session defaults shared by the tests, the bench and the command line."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword arguments override any setting.

    cores: for tests and the bench, a local master with so many threads and shuffle partitions. Without it the master,
    memory and partitions are those of spark-submit and the cluster.
    """
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
        settings |= {
            "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"),
        }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    return builder.config(map=settings).getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did.

    On a cluster the package is installed or passed with --py-files; a path that isn't there does no harm.
    """
    home = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, home])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store works."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
