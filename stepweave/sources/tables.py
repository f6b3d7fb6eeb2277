"""Reading and writing the tables of the library."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave import schema
from stepweave.functions.text import check_date
from stepweave.operators.rules import Rule
from stepweave.operators.sessions import TIME, time_chunk


def read_events(
    spark: SparkSession,
    path: str,
    start: dt.date | str,
    end: dt.date | str,
    columns: Sequence[str] | None = None,
    event_schema: T.StructType = schema.HITS,
) -> DataFrame:
    """Hits of whole days ``start`` ... ``end``; only those partitions are read."""
    days = F.col("event_date").between(F.to_date(F.lit(str(start))), F.to_date(F.lit(str(end))))
    events = spark.read.schema(event_schema).parquet(path).where(days)
    return events.select(*columns) if columns else events


def write_events(events: DataFrame, path: str) -> None:
    """Write hits partitioned by day; a day written again replaces the old one.

    Rebalanced by day: Spark sizes the tasks, so a big day is written by many and a small one by one.
    """
    rebalanced = events.sparkSession.sql("SELECT /*+ REBALANCE(event_date) */ * FROM {events}", events=events)
    (
        rebalanced.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )


def _read_table(spark: SparkSession, name: str) -> DataFrame:
    is_path = "/" in name or "\\" in name
    return spark.read.parquet(name) if is_path else spark.read.table(name)


def read_journeys(spark: SparkSession, name: str, date: str | None = None) -> DataFrame:
    """A journey table by name or path; with a date, that snapshot only."""
    if date is None:
        return _read_table(spark, name)
    day = F.to_date(F.lit(check_date(date)))
    return _read_table(spark, name).where(F.col("date") == day)


def write_snapshot(journeys: DataFrame, path: str, date: str) -> None:
    """Add a dated snapshot; writing the same date again replaces it."""
    (
        journeys.withColumn("date", F.to_date(F.lit(check_date(date))))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def read_journeys_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.JOURNEYS).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers. An empty text is read back as NULL."""
    df.write.mode("overwrite").option("header", True).csv(path)


def pick_conversion(journeys: DataFrame, converted: bool) -> DataFrame:
    return journeys.where(F.col("conversion_flg") == F.lit(converted))


def read_categories(spark: SparkSession, path: str, legacy_regex: bool = False) -> DataFrame:
    """Category dimension: item_category, sessions, content_group, enabled.

    The totals row, which has no category, is dropped. An empty label stays an empty text: it is a
    step without a name, not a missing one. ``legacy_regex`` disables the categories that a regular
    expression made of the name cannot match: those with ``$`` or parentheses, and those outside ASCII.
    """
    rows = (
        spark.read.schema(schema.CATEGORY_FILE)
        .option("header", True)
        .option("enforceSchema", True)
        .csv(path)
        .where(F.col("item_category").isNotNull())
    )
    unmatched = F.col("item_category").rlike(r"[$()]|[^\x00-\x7F]")
    return rows.select(
        "item_category",
        "sessions",
        F.coalesce("content_group", F.lit("")).alias("content_group"),
        (~unmatched if legacy_regex else F.lit(True)).alias("enabled"),
    )


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from a CSV with the columns of ``schema.RULES``, in order of priority.

    Rules become one expression, so they come to the driver; the file must be small.
    """
    rows = spark.read.schema(schema.RULES).option("header", True).csv(path)
    rows = rows.orderBy("priority").collect()
    return [
        Rule(
            label=row.label or "",
            pattern=row.pattern,
            match=row["match"],
            event=row.event_name,
            field=row.field or "page_location",
            enabled=row.enabled is not False,
        )
        for row in rows
    ]


def store_hits(
    hits: DataFrame,
    table: str,
    buckets: int,
    by: Sequence[str] = ("key", "chunk"),
    chunk_seconds: int | None = 600,
) -> None:
    """Store labelled hits as a table laid out by key, for journey queries that run over them again and again.

    Files are buckets of the columns ``by``, so those queries need no shuffle by them: ``("key", "chunk")`` spares that
    of the hits and spreads a giant session over buckets; ``("key",)`` spares that of its parts too, and
    is for hits without such a session. Chunks are those of the settings that the queries use. The table must
    not exist; its files lie below the session's warehouse.
    """
    by = list(by)
    if not set(by) <= {"key", "chunk"} or "key" not in by:
        raise ValueError(f"hits are laid out by key, or key and chunk: {by!r}")
    hits = hits.withColumn("chunk", time_chunk(chunk_seconds))
    spread = hits.repartition(buckets, *by)  # one file a bucket
    spread.write.bucketBy(buckets, *by).sortBy("key", "chunk", TIME).saveAsTable(table)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name below the session's checkpoint folder, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/stepweave-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store a table in the shared folder and read it back, so that it is computed once."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
