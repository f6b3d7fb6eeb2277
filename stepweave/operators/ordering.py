"""Positions and running sums over a whole table by descending count, without a one-task window.

The order is: count descending, then the MD5 of the first tie column, then the tie columns, which
together identify a row; a missing value has the MD5 of the empty text and comes before it. Any order among
equal counts is as good as another; this one cuts a run of equal counts, however long, into even
buckets by the first digits of the MD5.

The work splits into a small table of (count, bucket) sizes, whose running sums give every bucket its
base, and a window inside each bucket. d different positive counts need a total of at least
d * (d + 1) / 2, so even a total of 10**10 has under 142,000 of them: only that table of different
counts is ever ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

BUCKET_DIGITS = 3


def _hash(tie_col: str) -> Column:
    return F.md5(F.coalesce(F.col(tie_col).cast("string"), F.lit("")).cast("binary"))


def require_counts(df: DataFrame, count_col: str) -> None:
    """The scheme rests on whole-number counts."""
    if not isinstance(df.schema[count_col].dataType, T.IntegralType):
        raise TypeError(f"{count_col} must hold whole numbers: {df.schema[count_col].dataType}")


def count_histogram(df: DataFrame, count_col: str) -> DataFrame:
    """Different counts, with rows and sum at the count and above: count, n, n_to, sum_to, total."""
    require_counts(df, count_col)
    sizes = (
        df.where(F.col(count_col).isNotNull())
        .groupBy(F.col(count_col).cast("bigint").alias("c"))
        .agg(F.count("*").alias("n"))
    )
    return _with_running(sizes)


def bucket_sizes(
    df: DataFrame, count_col: str, tie_cols: Sequence[str], bucket_digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Rows of each (count, bucket): c, b, n. All that ``with_running`` and reports need to know of a table."""
    require_counts(df, count_col)
    bucket = F.substring(_hash(tie_cols[0]), 1, bucket_digits)
    return (
        df.where(F.col(count_col).isNotNull())
        .groupBy(F.col(count_col).cast("bigint").alias("c"), bucket.alias("b"))
        .agg(F.count("*").alias("n"))
    )


def histogram_of_sizes(buckets: DataFrame) -> DataFrame:
    """``count_histogram`` from the sizes of buckets."""
    return _with_running(buckets.groupBy("c").agg(F.sum("n").alias("n")))


def _with_running(sizes: DataFrame) -> DataFrame:
    down = W.orderBy(F.desc("c"))
    upto = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    value = F.col("c") * F.col("n")
    return (
        sizes.withColumn("n_to", F.sum("n").over(upto))
        .withColumn("sum_to", F.sum(value).over(upto))
        .withColumn("total", F.sum(value).over(whole))
    )


def with_running(
    df: DataFrame,
    count_col: str,
    tie_cols: Sequence[str],
    min_count: int | None = None,
    bucket_digits: int = BUCKET_DIGITS,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """Attach ``position`` (from 0), ``running`` (sum up to the row) and ``total`` (of all rows).

    Rows below ``min_count`` come last in the order, so they are left out without touching the
    others; they still count in the total. A run of equal counts is cut into 16 ** ``bucket_digits`` buckets;
    ``buckets``, their sizes, may be given where they are known.
    """
    require_counts(df, count_col)
    bucket = F.substring(_hash(tie_cols[0]), 1, bucket_digits)
    if buckets is None:
        buckets = bucket_sizes(df, count_col, tie_cols, bucket_digits)
    # A partition of this window holds the buckets of one count.
    earlier = W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    parts = buckets.select("c", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    bases = histogram_of_sizes(buckets)
    if min_count is not None:
        bases = bases.where(F.col("c") >= min_count)
        df = df.where(F.col(count_col) >= min_count)
    bases = bases.join(parts, "c").select(
        F.col("c").alias("__c"),
        F.col("b").alias("__b"),
        (F.col("n_to") - F.col("n")).alias("__n_above"),
        (F.col("sum_to") - F.col("c") * F.col("n")).alias("__sum_above"),
        "total",
        "__before",
    )

    rows = df.withColumn("__count", F.col(count_col).cast("bigint")).withColumn("__bucket", bucket)
    inside = W.partitionBy("__count", "__bucket").orderBy(_hash(tie_cols[0]), *tie_cols)
    ahead = F.col("__before") + F.row_number().over(inside)
    return (
        rows.join(bases, (F.col("__count") == F.col("__c")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("__ahead", ahead)
        .withColumn("position", F.col("__n_above") + F.col("__ahead") - 1)
        .withColumn("running", F.col("__sum_above") + F.col("__ahead") * F.col("__count"))
        .select(*df.columns, "position", "running", "total")
    )
