"""Event, observation and snapshot stores: JSON lines and parquet, with replace and ignore semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenfold.schema import OBSERVATIONS, RAW_OBSERVATIONS, SNAPSHOTS
from evenfold.sources.files import exists

#: A store's tables with their schemas.
TABLES = {"raw_observations": RAW_OBSERVATIONS, "snapshots": SNAPSHOTS, "observations": OBSERVATIONS}


class Store:
    """The tables under a folder. Opening makes what isn't there, empty; what is there stays. A table that lacks a column of its schema is an error."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        for name, schema in TABLES.items():
            if not exists(spark, f"{root}/{name}"):
                spark.createDataFrame([], schema).write.mode("append").parquet(f"{root}/{name}")
            lost = {f.name for f in StructType.fromDDL(schema)} - set(self.read(name).columns)
            if lost:
                raise ValueError(f"{root}/{name} lacks {', '.join(sorted(lost))}")

    def read(self, name: str) -> DataFrame:
        """All rows of a table, those of repeated runs as well."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        append(rows.select(*(f.name for f in StructType.fromDDL(TABLES[name]))), f"{self.root}/{name}")

    def latest_snapshots(self, document_id: str | None = None) -> DataFrame:
        """The snapshot created last of every document, or of one."""
        rows = self.read("snapshots")
        return latest(rows.where(F.col("document_id") == document_id) if document_id else rows, "document_id", ["created_at", "snapshot_id"])


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a JSON lines file or folder; a missing path is empty, blank lines are passed over, a malformed line fails the read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def latest(rows: DataFrame, key: str | None, order: list[str]) -> DataFrame:
    """The row with the greatest order, of each key or of all. The last column of order should settle ties (file order, sequence)."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    got = rows.groupBy(key).agg(best) if key else rows.agg(best).where("r is not null")
    return got.select("r.*")


def replace_into(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All keys; new rows take the place of old ones, and of new rows with one key the last by order. Old rows are taken as they are."""
    last = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), F.struct(*order)).alias("r")).select("r.*")
    return old.join(last, key, "left_anti").select(*new.columns).unionByName(last)


def ignore_into(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All keys; old rows stay, and of new rows with a new key the first by order comes in."""
    first = new.groupBy(*key).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("r")).select("r.*")
    return old.select(*new.columns).unionByName(first.join(old, key, "left_anti").select(*new.columns))


def events_after(events: DataFrame, seconds: int) -> DataFrame:
    """Events later than a second; the filter reaches the scan."""
    return events.where(F.col("timestamp") > max(0, seconds))


def with_lines(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """Snapshot heads with their lines in order (null without any), joined by snapshot_id."""
    got = lines.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("lines"))  # of one snapshot
    return heads.join(got, "snapshot_id", "left")


def duplicate_positions(lines: DataFrame, by: list[str]) -> DataFrame:
    return lines.groupBy(*by, "page", "line").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
