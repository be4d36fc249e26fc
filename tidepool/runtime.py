"""Session settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tidepool import __version__


def version() -> str:
    return __version__


def cores(mb_per_core: int = 512) -> int:
    """Cores that this machine's memory suffices for."""
    mb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 20
    return max(1, min(os.cpu_count() or 1, mb // mb_per_core))


def session(name: str = "tidepool", n: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the operators are made for; on a cluster use its own."""
    builder = SparkSession.builder.master(f"local[{n or cores()}]").appName(name)
    defaults = {"spark.sql.shuffle.partitions": str(n or cores()), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def init_logging(spark: SparkSession, level: str = "WARN") -> None:
    spark.sparkContext.setLogLevel(level.upper())
