"""Session settings the jobs rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Runtime settings every job sets on the session it is given.  Results depend on
#: the time zone; the others only change how plans run.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",  # the last of repeated keys counts
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply `RUNTIME_CONF` to a session made elsewhere, and let its Python workers find this package.

    Workers on other machines have the package installed or get it with the job; there the added path does nothing.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "pinchgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the same settings; `master` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    if master and master.startswith("local"):
        builder = (
            builder.config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
            .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
        )
    return builder.getOrCreate()
