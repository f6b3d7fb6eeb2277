"""Journey queries: website, app, and the check of content groups."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.config import Conversion, JourneyConfig, Sessions
from stepweave.functions.params import contains_pattern, label_if, param_on
from stepweave.operators import paths, qc, sessions
from stepweave.operators.blocks import (
    events_that_count,
    journeys_of_segments,
    link_blocks,
    segments,
    session_blocks,
)
from stepweave.operators.rules import (
    Rule,
    content_group,
    content_group_by_event,
    events_of_rules,
    live_rules,
    map_category,
    with_label,
    with_label_by_dictionary,
)

# Events, texts and labels of the two products.
WEB_CONVERSION = Conversion(
    event="purchase", param="page_title", cutoff_pattern="Order: Checkout", flag_value="Order: Checkout"
)
WEB_EVENTS = ("page_view", "add_to_cart", "purchase", "user_engagement", "Dynamic Click", "first_visit")
QC_EVENTS = ("page_view", "add_to_cart", "user_engagement")
APP_CHECKOUT = "CheckoutViewController|CheckoutActivity"
APP_CONVERSION = Conversion(
    event="ecommerce_purchase",
    param="firebase_screen_class",
    cutoff_pattern=APP_CHECKOUT,
    flag_pattern=APP_CHECKOUT,
)
APP_EVENTS = (
    "view_item",
    "view_item_list",
    "ecommerce_purchase",
    "start_new_order",
    "add_to_cart",
    "begin_checkout",
    "view_favorite_store",
    "view_nearby_store",
    "screen_view",
)
APP_LABELS_BY_EVENT = {
    "add_to_cart": "product_added_to_cart",
    "view_favorite_store": "view_favorite_store",
    "screen_view": "quick_reorder",
    "ecommerce_purchase": "order_conversion",
}
# Branches that can be switched on: they label the hit with the raw parameter.
APP_MORE_BY_EVENT = {
    "view_item_list": "app_view_itemlist",
    "view_item": "viewed_item_name",
    "start_new_order": "order_time_controller",
    "view_nearby_store": "view_nearby_store",
}

WEB = JourneyConfig(
    conversion=WEB_CONVERSION,
    events=WEB_EVENTS,
    first_visit_scope="converters",
    converted=False,
)
APP = JourneyConfig(
    conversion=APP_CONVERSION,
    events=APP_EVENTS,
    sessions=Sessions(separator=""),
    converted=True,
    drop_empty=True,
)


def with_streams(
    config: JourneyConfig, conversion_streams: Sequence[str], hit_streams: Sequence[str] | None = None
) -> JourneyConfig:
    """The settings with data streams; the cutoff and the hits have a filter each."""
    conversion = dataclasses.replace(config.conversion, streams=tuple(conversion_streams))
    hits = None if hit_streams is None else tuple(hit_streams)
    return dataclasses.replace(config, conversion=conversion, hit_streams=hits)


def web_columns(strict: bool = False) -> dict[str, Column]:
    """Parameters that the website rules look at; those that no live rule uses are pruned."""
    return {
        "page_location": param_on("page_view", "page_location", strict=strict),
        "page_location_when_added_to_cart": param_on("add_to_cart", "page_location", strict=strict),
        "logged_in_status": param_on("user_engagement", "logged_in", strict=strict),
        "dynamic_click_logged_in_status": param_on("Dynamic Click", "logged_in", strict=strict),
    }


def app_columns(strict: bool = False) -> dict[str, Column]:
    """Parameters and labels that the app query looks at."""

    def screen(event: str) -> Column:
        return param_on(event, "firebase_screen_class", strict=strict)

    return {
        "app_view_itemlist": param_on("view_item_list", "item_category", strict=strict),
        "product_added_to_cart": label_if(
            param_on("add_to_cart", "item_name", strict=strict).isNotNull(), "added_item"
        ),
        "quick_reorder": label_if(
            contains_pattern(screen("screen_view"), "QuickReorderViewController"), "Quick_Reorder"
        ),
        "view_favorite_store": label_if(
            contains_pattern(screen("view_favorite_store"), "StoreTableViewController"),
            "viewed_favourite_store",
        ),
        "order_time_controller": screen("start_new_order"),
        "view_nearby_store": screen("view_nearby_store"),
        "viewed_item_name": param_on("view_item", "item_name", strict=strict),
    }


def label_hits(hits: DataFrame, group: Column, dictionary: Sequence[str] | None = None) -> DataFrame:
    """Attach the content group and the conversion flag; rows that are not hits get no group.

    ``dictionary`` names the columns that the group depends on: it is then found once for each of their values."""
    flagged = hits.withColumn("conversion_flg", sessions.conversion_flg())
    group = F.when(F.col("is_hit"), group)
    if dictionary is None:
        return with_label(flagged, group)
    return with_label_by_dictionary(flagged, group, ["is_hit", *dictionary])


def web_hits(
    events: DataFrame,
    rules: Sequence[Rule],
    config: JourneyConfig = WEB,
    only_events: Sequence[str] | None = None,
    dictionary: bool = False,
) -> DataFrame:
    """Labelled hits of the website query; with ``dictionary`` each different address is labelled once."""
    hits = sessions.session_hits(events, config, web_columns(config.strict_params), only_events)
    used = ["event_name", *sorted({rule.field for rule in live_rules(rules) if rule.match != "any"})]
    return label_hits(hits, content_group(rules), used if dictionary else None)


def app_hits(
    events: DataFrame,
    categories: DataFrame,
    config: JourneyConfig = APP,
    by_event: Mapping[str, str] = APP_LABELS_BY_EVENT,
    only_events: Sequence[str] | None = None,
) -> DataFrame:
    """Labelled hits of the app query: the category's group, else the value chosen by event."""
    hits = sessions.session_hits(events, config, app_columns(config.strict_params), only_events)
    hits = map_category(hits, categories, "app_view_itemlist")
    return label_hits(hits, F.coalesce(F.col("category_group"), content_group_by_event(by_event)))


def session_steps(hits: DataFrame, config: JourneyConfig) -> DataFrame:
    """Labelled hits to linked blocks of steps, cut at conversion and without repeats."""
    return link_blocks(session_blocks(hits, config), config)


def journeys(hits: DataFrame, config: JourneyConfig) -> DataFrame:
    """Labelled hits to one journey per key."""
    parts = segments(hits, config, config.step_separator)
    return journeys_of_segments(parts, config, config.step_separator)


def journey_counts(hits: DataFrame, config: JourneyConfig) -> DataFrame:
    """Labelled hits to sessions per journey, filtered as the settings say; no order."""
    by_key = paths.where_converted(journeys(hits, config), config.converted)
    if config.drop_empty:
        by_key = paths.where_nonempty(by_key)
    return paths.count_journeys(by_key)


def web_journeys(events: DataFrame, rules: Sequence[Rule], config: JourneyConfig = WEB) -> DataFrame:
    """Website journeys and their session counts; by default of non-converters, last 8 days."""
    only = events_that_count(config, events_of_rules(rules))
    return journey_counts(web_hits(events, rules, config, only), config)


def app_journeys(
    events: DataFrame,
    categories: DataFrame,
    config: JourneyConfig = APP,
    by_event: Mapping[str, str] = APP_LABELS_BY_EVENT,
) -> DataFrame:
    """App journeys and their session counts; by default of converters, last 8 days."""
    only = events_that_count(config, {"view_item_list", *by_event})
    return journey_counts(app_hits(events, categories, config, by_event, only), config)


def qc_hits(
    events: DataFrame,
    rules: Sequence[Rule],
    conversion: Conversion = WEB_CONVERSION,
    event_names: Sequence[str] = QC_EVENTS,
    days: int | None = 2,
    as_of=None,
    streams: Sequence[str] | None = None,
    device: str | None = None,
    dictionary: bool = False,
) -> DataFrame:
    """Hits of the check query with their content group; those that match no rule are ``Other``.

    With ``dictionary`` each different combination of event and addresses is labelled once."""
    if days is not None:
        events = events.where(sessions.trailing_days(days, as_of))
    kept = events.where(
        sessions.where_stream(streams)
        & sessions.where_device(device)
        & sessions.where_events(event_names, conversion)
    )
    hits = kept.select("event_name", *[c.alias(name) for name, c in web_columns().items()])
    group = content_group(rules, default="Other")
    return with_label_by_dictionary(hits, group, hits.columns) if dictionary else with_label(hits, group)


def content_group_qc(events: DataFrame, rules: Sequence[Rule], **settings) -> DataFrame:
    """Hits per content group, address and event; settings as for ``qc_hits``. No order."""
    return qc.qc_counts(qc_hits(events, rules, **settings))
