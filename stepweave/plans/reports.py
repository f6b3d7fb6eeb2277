"""Reports over a journey table: profile and flow chart."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.text import STEP_SEPARATOR
from stepweave.operators import graph, paths, profile
from stepweave.sources.tables import cut_lineage, pick_conversion


@dataclass(frozen=True)
class FlowSettings:
    """Which journeys a flow chart shows: their kind, lengths, number, and steps drawn; all unless set.

    The length is taken before the end step is added and does not count it. A missing journey is an empty one.
    """

    converted: bool | None = None
    min_length: int | None = None
    max_length: int | None = None
    top: int | None = None
    max_steps: int | None = None
    node_opacity: float = 0.9
    link_opacity: float = 0.3
    conversion_label: str = "Conversion"
    separator: str = STEP_SEPARATOR


# The three charts of the notebooks.
APP_CONVERTERS = FlowSettings(converted=True, min_length=1, max_length=6, top=10, max_steps=10)
APP_NON_CONVERTERS = dataclasses.replace(APP_CONVERTERS, converted=False, top=100)
WEB_NON_CONVERTERS = FlowSettings(converted=False, min_length=6, max_length=9, top=10, max_steps=5)


def profile_journeys(
    journeys: DataFrame,
    converted: bool | None = None,
    length_bins: int = 8,
    count_bins: int = 30,
    separator: str = STEP_SEPARATOR,
) -> dict[str, DataFrame]:
    """Tables of a journey profile: rows with length, numbers, two histograms, shape.

    The journeys are read once, for a table of how many have each count and length; it is stored in the shared
    folder, and the other four tables come from it.
    """
    if converted is not None:
        journeys = pick_conversion(journeys, converted)
    measured = paths.with_journey_length(journeys, separator)
    joint = cut_lineage(profile.joint_frequencies(measured, ["counts", "journey_length"]))
    several = paths.where_length(joint, lo=2)
    return {
        "journeys": measured,
        "numbers": profile.describe_joint(joint, ["counts", "journey_length"]),
        "lengths": profile.histogram(joint, "journey_length", length_bins, more_than=0, weight="n"),
        "counts": profile.histogram(several, "counts", count_bins, weight="n"),
        "shape": profile.shape(joint, "n", len(measured.columns)),
    }


def flow_journeys(journeys: DataFrame, settings: FlowSettings) -> DataFrame:
    """The journeys of a flow chart, with end step, length and step array."""
    if settings.converted is not None:
        journeys = pick_conversion(journeys, settings.converted)
    chosen = paths.with_journey_length(journeys, settings.separator)
    chosen = paths.where_length(chosen, settings.min_length, settings.max_length)
    chosen = graph.add_journey_end(chosen, "journey", settings.conversion_label, settings.separator)
    if settings.top is not None:
        chosen = profile.top_journeys(chosen, settings.top)
    return graph.with_steps(chosen, settings.max_steps, settings.separator)


def flow_tables(journeys: DataFrame, settings: FlowSettings = FlowSettings()) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a flow chart of journeys."""
    return flow_of_steps(flow_journeys(journeys, settings), settings)


def flow_of_steps(stepped: DataFrame, settings: FlowSettings = FlowSettings()) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a flow chart of any table with ``steps`` and ``counts``, also ``steps_of_columns``.

    The journeys are read once and summed to a table of transitions, of the order of the number of
    labels squared. It is stored in the shared folder, where the cluster's retention removes it; edges and nodes
    are read from there, and the order of the nodes is the same for both.
    """
    moves = cut_lineage(graph.transitions(stepped))
    weights = moves.groupBy(F.col("target").alias("value")).agg(F.sum("counts").alias("counts"))
    indexed = graph.color_nodes(graph.index_nodes(weights), settings.node_opacity)
    edge_weights = moves.where(F.col("source").isNotNull())
    linked = graph.link_color(graph.index_edges(edge_weights, indexed), settings.link_opacity)
    return linked, indexed
