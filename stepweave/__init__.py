"""User-journey analytics on Spark DataFrames."""

from stepweave.config import Conversion, JourneyConfig, Sessions
from stepweave.operators.longtail import long_tail
from stepweave.operators.rules import Rule
from stepweave.plans.journeys import APP, WEB, app_journeys, content_group_qc, web_journeys, with_streams
from stepweave.plans.reports import FlowSettings, flow_tables, profile_journeys

__all__ = [
    "APP",
    "WEB",
    "Conversion",
    "FlowSettings",
    "JourneyConfig",
    "Rule",
    "Sessions",
    "app_journeys",
    "content_group_qc",
    "flow_tables",
    "long_tail",
    "profile_journeys",
    "web_journeys",
    "with_streams",
]
