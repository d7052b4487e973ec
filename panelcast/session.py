"""A Spark session with the settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "panelcast", shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Adaptive execution with skew handling; ``shuffle_partitions`` is for small local runs only.

    On a cluster leave it unset: the cluster's own value, coalesced at run time, fits the data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Recording the Python line of every Column costs more than building the plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
