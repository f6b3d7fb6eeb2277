"""Journeys: steps joined in time order, and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.params import sql_text
from stepweave.functions.text import STEP_SEPARATOR, journey_length


def journeys_from_steps(
    steps: DataFrame,
    separator: str = STEP_SEPARATOR,
    order: Sequence[str] = ("event_timestamp", "event_id"),
) -> DataFrame:
    """One journey per key from one row per step, for keys known to be short: key, journey, conversion_flg."""
    by = ", ".join(f"`{column}`" for column in order)
    joined = F.expr(f"listagg(content_group, {sql_text(separator)}) within group (order by {by})")
    return steps.groupBy("key").agg(
        joined.alias("journey"), F.max("conversion_flg").alias("conversion_flg")
    )


def count_journeys(journeys: DataFrame) -> DataFrame:
    """Keys per (journey, flag). The input has one row per key, so no distinct is needed."""
    return journeys.groupBy("journey", "conversion_flg").agg(F.count("key").alias("counts"))


def where_converted(journeys: DataFrame, flag: bool | None) -> DataFrame:
    return journeys if flag is None else journeys.where(F.col("conversion_flg") == F.lit(flag))


def where_nonempty(journeys: DataFrame) -> DataFrame:
    return journeys.where(F.col("journey") != "")


def where_journey_matches(journeys: DataFrame, pattern: str) -> DataFrame:
    """Journeys whose lower-cased text contains a match of the pattern."""
    return journeys.where(F.lower("journey").rlike(pattern))


def with_journey_length(journeys: DataFrame, separator: str = STEP_SEPARATOR) -> DataFrame:
    return journeys.withColumn("journey_length", journey_length(F.col("journey"), separator))


def where_length(
    journeys: DataFrame, lo: int | None = None, hi: int | None = None, column: str = "journey_length"
) -> DataFrame:
    """Lengths in ``lo`` ... ``hi``, both ends included; an open end is None."""
    if lo is not None:
        journeys = journeys.where(F.col(column) >= lo)
    if hi is not None:
        journeys = journeys.where(F.col(column) <= hi)
    return journeys


def sort_journeys(journeys: DataFrame, by_flag: bool = False) -> DataFrame:
    """Most frequent first; ties by journey."""
    order: list[Column] = [F.desc("conversion_flg")] if by_flag else []
    return journeys.orderBy(*order, F.desc("counts"), F.asc("journey"))


def sessions_by(hits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct keys for each combination of the columns."""
    return hits.groupBy(*columns).agg(F.countDistinct("key").alias("sessions"))


def session_total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.countDistinct("key").alias("sessions"))
