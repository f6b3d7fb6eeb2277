"""Cut the long tail of rare journeys and report what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators.ordering import bucket_sizes, count_histogram, histogram_of_sizes, with_running
from stepweave.sources.tables import cut_lineage


def total(df: DataFrame, count_col: str = "counts") -> DataFrame:
    return df.agg(F.sum(count_col).alias("total"))


def share_of_total(df: DataFrame, count_col: str = "counts") -> DataFrame:
    """Attach ``count_percent``, the share of the grand total."""
    grand = total(df, count_col).scalar()
    return df.withColumn("count_percent", F.col(count_col).cast("double") / grand)


def running_share(
    df: DataFrame,
    count_col: str = "counts",
    min_count: int | None = None,
    tie_cols: Sequence[str] = ("journey",),
    buckets: DataFrame | None = None,
) -> DataFrame:
    """Attach the share and the running share, most frequent first, for counts of at least the minimum.

    ``tie_cols`` identify a row; add the conversion flag for a table that holds both kinds.
    """
    ranked = with_running(df, count_col, tie_cols, min_count, buckets=buckets)
    return (
        ranked.withColumn("count_percent", F.col(count_col).cast("double") / F.col("total"))
        .withColumn("count_percent_cum", F.col("running").cast("double") / F.col("total"))
        .drop("position", "running", "total")
    )


def coverage(df: DataFrame, count_col: str = "counts", min_count: int = 4) -> DataFrame:
    """Share of the total in rows of at least the minimum; 0 if there are none."""
    kept = F.coalesce(F.sum(F.when(F.col(count_col) >= min_count, F.col(count_col))), F.lit(0))
    return df.agg((kept.cast("double") / F.sum(count_col)).alias("coverage"))


def suggest_min_count(df: DataFrame, min_share: float, count_col: str = "counts") -> DataFrame:
    """Largest minimum count that still keeps the share."""
    reached = F.col("sum_to").cast("double") / F.col("total") >= min_share
    return count_histogram(df, count_col).agg(F.max(F.when(reached, F.col("c"))).alias("suggested_min_count"))


def long_tail(
    df: DataFrame,
    count_col: str = "counts",
    min_share: float = 0.9,
    min_count: int = 4,
    tie_cols: Sequence[str] = ("journey",),
) -> tuple[DataFrame, DataFrame]:
    """Journeys of at least the minimum count with their shares, and a one-row report.

    The rows are returned whether or not they reach the share; the report says so in ``ok`` and
    suggests the largest minimum that would. Both come from one table of how many rows have each count, stored in
    the shared folder; the rows are read once for it and once to be returned.
    """
    buckets = cut_lineage(bucket_sizes(df, count_col, tie_cols))
    kept = running_share(df, count_col, min_count, tie_cols, buckets)
    share = F.col("sum_to").cast("double") / F.col("total")
    report = histogram_of_sizes(buckets).agg(
        F.coalesce(F.max(F.when(F.col("c") >= min_count, share)), F.lit(0.0)).alias("coverage"),
        F.max(F.when(share >= min_share, F.col("c"))).alias("suggested_min_count"),
    )
    return kept, report.select(
        "coverage", (F.col("coverage") >= min_share).alias("ok"), "suggested_min_count"
    )
