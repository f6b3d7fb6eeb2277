"""Steps of journeys to the weighted nodes and edges of a flow chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.text import (
    PALETTE,
    STEP_SEPARATOR,
    hex_to_rgba,
    palette_color,
    split_steps,
    with_end_step,
)
from stepweave.operators.ordering import with_running


def add_journey_end(
    df: DataFrame,
    journey_col: str = "journey",
    conversion_label: str = "Conversion",
    separator: str = STEP_SEPARATOR,
) -> DataFrame:
    """Append the end step to journeys that do not end with the conversion label."""
    return df.withColumn(journey_col, with_end_step(F.col(journey_col), conversion_label, separator))


def with_steps(
    df: DataFrame,
    max_steps: int | None = None,
    separator: str = STEP_SEPARATOR,
    journey_col: str = "journey",
) -> DataFrame:
    """Attach ``steps``, all steps or the first ``max_steps`` as an array. A missing journey is an empty one."""
    return df.withColumn("steps", split_steps(F.col(journey_col), separator, max_steps))


def parse_steps(
    df: DataFrame,
    separator: str = STEP_SEPARATOR,
    max_steps: int = 10,
    prefix: str = "step_",
    rest: str | None = None,
) -> DataFrame:
    """Attach the columns step_1 ... step_n, n being ``max_steps``; missing steps are NULL.

    Later steps are cut, or, with ``rest``, stay together in an array column of that name. So the table is never wider than asked
    for, however long a journey is.
    """
    stepped = with_steps(df, None if rest else max_steps, separator)
    wide = [F.get("steps", i).alias(f"{prefix}{i + 1}") for i in range(max_steps)]
    beyond = F.slice("steps", F.lit(max_steps + 1), F.greatest(F.size("steps") - max_steps, F.lit(0)))
    return stepped.select(*df.columns, *wide, *([beyond.alias(rest)] if rest else []))


def step_columns(df: DataFrame, prefix: str = "step_") -> list[str]:
    """The step columns, checked to be step_1, step_2, ... in order and without gaps."""
    found = [name for name in df.columns if prefix in name]
    expected = [f"{prefix}{i}" for i in range(1, len(found) + 1)]
    if not found or found != expected:
        raise ValueError(f"step columns should be {expected} but are {found}")
    return found


def steps_of_columns(df: DataFrame, prefix: str = "step_", rest: str | None = None) -> DataFrame:
    """Step columns, and the array of later steps, back to ``steps``; a step after a missing one stays."""
    columns = F.array(*step_columns(df.drop(rest) if rest else df, prefix))
    return df.withColumn("steps", F.array_compact(F.concat(columns, rest) if rest else columns))


def step_pairs(df: DataFrame, count_col: str = "counts") -> DataFrame:
    """One row per adjacent pair of steps: source, target, count."""
    pairs = F.transform(
        F.slice("steps", 2, F.size("steps")),
        lambda step, i: F.struct(F.get("steps", i).alias("source"), step.alias("target")),
    )
    return df.select(F.inline(pairs), count_col)


def melt_steps(df: DataFrame, count_col: str = "counts") -> DataFrame:
    """One row per step at any position: value, count."""
    return df.select(F.explode("steps").alias("value"), count_col)


def edges(df: DataFrame, count_col: str = "counts") -> DataFrame:
    """Weight of each (source, target), over all positions."""
    return step_pairs(df, count_col).groupBy("source", "target").agg(F.sum(count_col).alias(count_col))


def nodes(df: DataFrame, count_col: str = "counts") -> DataFrame:
    """Weight of each step label, over all positions."""
    return melt_steps(df, count_col).groupBy("value").agg(F.sum(count_col).alias(count_col))


def index_nodes(node_weights: DataFrame, count_col: str = "counts") -> DataFrame:
    """Attach ``value_index`` from 0 by descending weight; equal weights by the MD5 of the label."""
    ranked = with_running(node_weights, count_col, ["value"])
    return ranked.withColumnRenamed("position", "value_index").drop("running", "total")


def color_nodes(
    indexed: DataFrame, opacity: float = 0.9, palette: Sequence[str] = PALETTE
) -> DataFrame:
    color = palette_color(F.col("value_index"), tuple(palette))
    return indexed.withColumn("color", hex_to_rgba(color, opacity))


def index_edges(edge_weights: DataFrame, indexed: DataFrame, count_col: str = "counts") -> DataFrame:
    """Attach the source's index and colour and the target's index.

    Plain joins: Spark broadcasts the nodes after checking their size.
    """
    sources = indexed.select(
        F.col("value").alias("source"), F.col("value_index").alias("source_index"), "color"
    )
    targets = indexed.select(F.col("value").alias("target"), F.col("value_index").alias("target_index"))
    return (
        edge_weights.join(sources, "source", "left")
        .join(targets, "target", "left")
        .select("source", "target", count_col, "source_index", "color", "target_index")
    )


def link_color(
    edges_with_index: DataFrame, opacity: float = 0.3, palette: Sequence[str] = PALETTE
) -> DataFrame:
    """Attach ``link_color``: the source's colour at another opacity."""
    color = palette_color(F.col("source_index"), tuple(palette))
    return edges_with_index.withColumn("link_color", hex_to_rgba(color, opacity))


def transitions(df: DataFrame, count_col: str = "counts") -> DataFrame:
    """Edges, and each first step as a target of no source, in one pass over the journeys.

    Every step is the target of one row, so the node weights are sums over this small table.
    """
    starts = F.array(
        F.struct(F.lit(None).cast("string").alias("source"), F.get("steps", 0).alias("target"))
    )
    pairs = F.transform(
        F.slice("steps", 2, F.size("steps")),
        lambda step, i: F.struct(F.get("steps", i).alias("source"), step.alias("target")),
    )
    rows = df.where(F.size("steps") > 0).select(F.inline(F.concat(starts, pairs)), count_col)
    return rows.groupBy("source", "target").agg(F.sum(count_col).alias(count_col))
