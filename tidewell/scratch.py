"""Tables that cut the lineage of a frame, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, that are sent to all tasks at most; beyond that both sides are shuffled.
MOST_SENT, SENT_BYTES = 1_000_000, 32 << 20


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this process in local mode, as in tests, and an error on a cluster, whose executors would write to their own discs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or _own()).rstrip("/")


def staged(frame: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: it outlives executors."""
    spark = frame.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def released(frame: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more; those of other tables stay."""
    spark = frame.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        home = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark)).toUri().getPath()
        if path.toUri().getPath().startswith(f"{home}/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sent(small: DataFrame, rows: int, width: int = 16) -> DataFrame:
    """Sent to all tasks if its counted rows, of about `width` bytes each, are few."""
    return F.broadcast(small) if rows <= MOST_SENT and rows * width <= SENT_BYTES else small
