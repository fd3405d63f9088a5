"""Session defaults: UTC, adaptive execution, Arrow; a cluster's own settings are left as they are."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    if master and master.startswith("local"):
        defaults["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
