"""Records that others push as JSON lines, and the table that holds them."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest

SCHEMA = "workspace_id string, source_kind string, source_id string, title string, body string, created_at timestamp, updated_at timestamp, metadata map<string,string>, uri string, status string, corrupt string"
REQUIRED = ("source_kind", "source_id", "body")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): a line that is no JSON object, or lacks a required field, is an error."""
    rows = spark.read.json(path, schema=SCHEMA, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    checked = rows.withColumn("missing", missing)
    bad = F.col("corrupt").isNotNull() | (F.size("missing") > 0)
    error = F.when(F.col("corrupt").isNotNull(), F.lit("not a JSON object")).otherwise(F.concat(F.lit("missing: "), F.array_join("missing", ", ")))
    good = checked.where(~bad).drop("corrupt", "missing").withColumn("storage_key", F.concat_ws("|", F.coalesce("workspace_id", F.lit("")), "source_kind", "source_id"))
    return good, checked.where(bad).select("source_id", error.alias("error"))


class Table:
    """Rows by key in a folder of appended changes: the last change of a key holds. All batches, of streams and others, are
    numbered in one order as they first come. A batch that is written again takes its own place, so a stream that runs
    again changes nothing, and neither undoes what came after it. `compacted` begins a new folder with what holds."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str]):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _changes(self) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", True).option("basePath", self.folder).parquet(f"{self.folder}/batch=*")
        except AnalysisException:
            return None

    @staticmethod
    def _order() -> Column:
        """Batches in order; those without a number, of before, come first."""
        name = F.col("batch").cast("string")
        return F.when(name.rlike(r"^\d{20}-"), name).otherwise(F.concat(F.lit("0" * 20 + "-"), name))

    def _named(self, batch: str | None) -> str:
        """The place of a batch: its own if it was written before, else the next."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch=*")
        listed = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        names = [f.getPath().getName()[len("batch=") :] for f in listed or []]
        if batch is not None and (own := [n for n in names if n == batch or n[21:] == batch]):
            return own[0]
        last = max((int(n[:20]) for n in names if n[:20].isdigit() and n[20:21] == "-"), default=0)
        return f"{last + 1:020d}-{batch or uuid.uuid4().hex}"

    def version(self) -> str | None:
        """The name of the last batch; readers that hold another are to read again. None if nothing was ever written."""
        rows = self._changes()
        return None if rows is None else rows.agg(F.max(self._order())).first()[0]

    def read(self) -> DataFrame | None:
        """The rows that hold; None if nothing was ever written."""
        rows = self._changes()
        if rows is None:
            return None
        return latest(rows.withColumn("batch", self._order()), self.key, ["batch"]).where("not _deleted").drop("_deleted", "batch")

    def _write(self, rows: DataFrame, batch: str | None) -> str:
        batch = self._named(batch)
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return batch

    def change(self, rows: DataFrame, deleted: Column, batch: str | None = None) -> str:
        """Rows, each key once: those for which `deleted` holds go, the others are put in place of what their keys had."""
        return self._write(rows.withColumn("_deleted", F.coalesce(deleted, F.lit(False))), batch)

    def upsert(self, rows: DataFrame, batch: str | None = None) -> str:
        return self.change(rows, F.lit(False), batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> str:
        return self.change(keys.select(*self.key).distinct(), F.lit(True), batch)

    def compacted(self, folder: str) -> Table:
        out = Table(self.spark, folder, self.key)
        if (rows := self.read()) is not None:
            out.upsert(rows)
        return out
