"""The session that the operators expect."""

from pyspark.sql import SparkSession


def session(name: str = "polystrata", **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution, last value wins in maps; more settings by keyword with dots as double underscores."""
    b = SparkSession.builder.appName(name)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
