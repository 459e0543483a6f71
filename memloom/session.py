"""The Spark session of tests, benchmarks and local use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "memloom", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given by name replace the defaults (``_`` for ``.``)."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.unionOutputPartitioning": "false",  # see sources.state.plain_unions
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
