"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one; keyword names have _ for the dots of setting names."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
