"""Session defaults shared by the command line, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "seqloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `master` is set for local runs only.

    On a cluster the submitter's own settings (master, shuffle partitions, checkpoint folder) win.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
