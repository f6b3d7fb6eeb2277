"""Check of the content groups: which address and event falls in which group, by volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def qc_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("content_group", "page_location", "event_name").agg(
        F.count("*").alias("p_count")
    )


def qc_group_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("content_group").agg(F.count("*").alias("record_count"))


def where_group(hits: DataFrame, label: str) -> DataFrame:
    return hits.where(F.col("content_group") == label)


def sort_qc(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("p_count"), "content_group", "page_location", "event_name")
