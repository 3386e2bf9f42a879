"""A session with the settings that results rely on; memory and parallelism are the caller's, by `conf` or the cluster's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str = "local[8]", name: str = "typeloom", **conf: str) -> SparkSession:
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    return SparkSession.builder.master(master).appName(name).config(map=settings | conf).getOrCreate()
