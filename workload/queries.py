"""Registered queries: every operator over the whole test tables.

The trailing-day windows are part of the journey and check queries; all others read all days.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.params import any_param_equals, max_param_matching, param, param_on
from stepweave.operators import graph, longtail, paths, profile, qc, sessions
from stepweave.operators.blocks import steps_long
from stepweave.operators.rules import Rule, content_group, content_group_by_event, map_category
from stepweave.plans import journeys as plans
from stepweave.plans import reports
from stepweave.rulesets import website_qc_rules, website_rules
from stepweave.sources import (
    cut_lineage,
    read_categories,
    read_events,
    read_journeys,
    read_journeys_csv,
    shared_folder,
    store_hits,
    write_csv,
    write_events,
    write_snapshot,
)
from workload import fixtures as fx
from workload.oracles import MIN_COUNT, MIN_SHARE, SWITCHED_ON

Query = Callable[[SparkSession, str], DataFrame]

RULES = website_rules(fx.HOME_URLS, fx.MORE_ENTREES)
QC_RULES = website_qc_rules(fx.HOME_URLS, fx.MORE_ENTREES)
WEB = dataclasses.replace(plans.with_streams(plans.WEB, ["s1"]), as_of=fx.AS_OF)
WEB_ALL = dataclasses.replace(WEB, days=None, converted=None)
APP = dataclasses.replace(plans.with_streams(plans.APP, ["s1"], ["s1"]), as_of=fx.AS_OF)
APP_ALL = dataclasses.replace(APP, days=None, converted=None, drop_empty=False)


def web_journeys(config=WEB) -> Query:
    return lambda spark, d: plans.web_journeys(fx.web_events(spark, d), RULES, config)


def app_journeys(config=APP) -> Query:
    return lambda spark, d: plans.app_journeys(fx.app_events(spark, d), fx.categories(spark), config)


def web_journeys_many_platforms(spark: SparkSession, d: str) -> DataFrame:
    """With platforms that no setting names, a few hundred of them, and hits without one."""
    device = F.concat(F.col("platform"), F.lit("-"), F.pmod(F.col("event_id"), F.lit(300)).cast("string"))
    events = fx.web_events(spark, d).withColumn("platform", F.when(F.pmod(F.col("event_id"), F.lit(7)) > 0, device))
    return plans.web_journeys(events, RULES, WEB_ALL)


def web_journeys_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Each different address labelled once."""
    return plans.journey_counts(plans.web_hits(fx.web_events(spark, d), RULES, WEB_ALL, dictionary=True), WEB_ALL)


def web_journeys_stored_hits(spark: SparkSession, d: str) -> DataFrame:
    """From hits that are laid out by key and time chunk."""
    name = f"hits_{uuid.uuid4().hex}"
    store_hits(web_hits(spark, d), name, buckets=8, chunk_seconds=WEB_ALL.sessions.chunk_seconds)
    return plans.journey_counts(spark.table(name), WEB_ALL)


def web_hits(spark: SparkSession, d: str) -> DataFrame:
    return plans.web_hits(fx.web_events(spark, d), RULES, WEB_ALL)


def web_table(spark: SparkSession, d: str) -> DataFrame:
    """All web journeys, stored: the table that reports read several times."""
    return cut_lineage(web_journeys(WEB_ALL)(spark, d))


def web_profiled(spark: SparkSession, d: str) -> DataFrame:
    return paths.with_journey_length(web_journeys(WEB_ALL)(spark, d))


def with_long_length(df: DataFrame) -> DataFrame:
    return df.withColumn("journey_length", F.col("journey_length").cast("bigint"))


def scan_trailing_days(spark, d):
    events = fx.web_events(spark, d).where(sessions.trailing_days(8, fx.AS_OF))
    return events.select("event_id", F.col("event_date").cast("string").alias("event_date"), "event_name")


def param_extract(spark, d):
    return fx.web_events(spark, d).select(
        "event_id",
        param("ga_session_id", "int_value").alias("session_id"),
        param("page_location").alias("page_location_any"),
        param_on("page_view", "page_location").alias("page_location"),
        param_on("add_to_cart", "page_location").alias("page_location_when_added_to_cart"),
        param_on("user_engagement", "logged_in").alias("logged_in_status"),
    )


def param_any_match(spark, d):
    web = fx.web_events(spark, d).select(
        "event_id", any_param_equals("purchase", "Order: Checkout").alias("any_equals")
    )
    app = fx.app_events(spark, d).select(
        "event_id", max_param_matching("ecommerce_purchase", plans.APP_CHECKOUT).alias("max_matching")
    )
    return web.join(app, "event_id")


def session_keys(spark, d):
    return fx.web_events(spark, d).select(
        "event_id", sessions.session_key(".").alias("web_key"), sessions.session_key("").alias("app_key")
    )


def stream_event_filter(spark, d):
    events = fx.web_events(spark, d)
    kept = sessions.where_stream(["s1"]) & sessions.where_events(plans.QC_EVENTS, plans.WEB_CONVERSION)
    return events.where(kept).select("event_id", "event_name", "stream_id")


def device_filter(spark, d):
    return fx.web_events(spark, d).where(sessions.where_device("desktop")).select("event_id", "event_name")


def content_group_rules(spark, d):
    hits = fx.web_events(spark, d).select(
        "event_id", "event_name", *[c.alias(n) for n, c in plans.web_columns().items()]
    )
    return hits.select(
        "event_id",
        content_group(RULES).alias("content_group"),
        content_group(QC_RULES, default="Other").alias("qc_group"),
    )


def content_group_switched_on(spark, d):
    hits = fx.web_events(spark, d).select(
        "event_id", "event_name", *[c.alias(n) for n, c in plans.web_columns().items()]
    )
    return hits.select("event_id", content_group(RULES, enable=SWITCHED_ON).alias("content_group"))


PAGE_RULES = [
    Rule("English page", "/en/[0-9]+$", field="url"),
    Rule("English other", "/en/", field="url"),
    Rule("Other language", "/de/|/fr/|/es/", field="url"),
]


def url_groups_pages(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("url")
    grouped = pages.withColumn("content_group", content_group(PAGE_RULES))
    return grouped.groupBy("content_group").agg(F.count("*").alias("p_count"))


def app_flat(spark, d):
    config = dataclasses.replace(
        APP_ALL, hit_streams=None, sessions=dataclasses.replace(APP.sessions, keep_null_keys=True)
    )
    return sessions.session_hits(fx.app_events(spark, d), config, plans.app_columns())


def category_map(spark, d):
    categories = fx.categories(spark)
    plain = ~F.col("item_category").rlike(r"[$()]|[^\x00-\x7F]")
    hits = map_category(app_flat(spark, d), categories, "app_view_itemlist")
    hits = map_category(hits, categories.withColumn("enabled", plain), "app_view_itemlist", "legacy_group")
    return hits.select("event_id", "app_view_itemlist", "category_group", "legacy_group")


def category_contains(spark, d):
    """Item texts that hold one listed name, two, or none."""
    other = fx.pick(fx.ITEM_CATEGORIES, F.pmod(F.col("event_id"), F.lit(len(fx.ITEM_CATEGORIES))))
    text = F.concat(F.lit("To go: "), other, F.lit(" & "), F.col("app_view_itemlist"))
    hits = app_flat(spark, d).withColumn("item_text", text)
    hits = map_category(hits, fx.categories(spark), "item_text", match="contains")
    name = F.col("item_category")
    hits = map_category(hits, fx.categories(spark), "item_text", "last_group", match="contains", priority=F.col("sessions"))
    shortest = F.struct(F.char_length(name).alias("n"), name.alias("name"))
    hits = map_category(hits, fx.categories(spark), "item_text", "short_group", match="contains", priority=shortest)
    return hits.select("event_id", "item_text", "category_group", "last_group", "short_group")


def event_fallthrough(spark, d):
    group = content_group_by_event(plans.APP_LABELS_BY_EVENT).alias("event_group")
    return app_flat(spark, d).select("event_id", "event_name", group)


def event_fallthrough_more(spark, d):
    group = content_group_by_event({**plans.APP_MORE_BY_EVENT, **plans.APP_LABELS_BY_EVENT})
    return app_flat(spark, d).select("event_id", group.alias("event_group"))


def converters(spark, d):
    return sessions.converters(web_hits(spark, d))


def first_visit_lookup(spark, d):
    lookup = sessions.first_visit_lookup(web_hits(spark, d))
    return lookup.withColumn("first_visit", F.col("first_visit").cast("bigint"))


def cutoff_hits(spark, d):
    hits = sessions.cut_at_conversion(sessions.with_cutoff(web_hits(spark, d)))
    return hits.select("event_id", "key", "event_name", "cutoff")


def first_visit_hits(spark, d):
    hits = sessions.with_first_visit(web_hits(spark, d)).where(sessions.first_visit_condition("all"))
    return hits.select("event_id", "key", "has_first_visit", "has_other_hit")


def repeat_removal(spark, d):
    return steps_long(plans.session_steps(web_hits(spark, d), WEB_ALL))


def previous_group(spark, d):
    hits = sessions.with_previous(web_hits(spark, d))
    return hits.select("key", "event_id", "content_group", "previous_group")


def journeys_by_key(spark, d):
    return plans.journeys(web_hits(spark, d), WEB_ALL)


def nonempty_converted(spark, d):
    journeys = paths.where_converted(app_journeys(APP_ALL)(spark, d), True)
    return paths.where_nonempty(journeys)


def journeys_matching(spark, d):
    return paths.where_journey_matches(web_journeys(WEB_ALL)(spark, d), ">|^cart")


def journey_length_range(spark, d):
    return with_long_length(paths.where_length(web_profiled(spark, d), 2, 6))


def sessions_by_group(spark, d):
    columns = ["app_view_itemlist", "product_added_to_cart", "view_favorite_store", "order_conversion"]
    return paths.sessions_by(app_flat(spark, d), columns)


def session_total(spark, d):
    return paths.session_total(app_flat(spark, d))


def describe_numeric(spark, d):
    numbers = profile.describe_numeric(web_profiled(spark, d), ["counts", "journey_length"])
    return numbers.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def describe_values(spark, d):
    """Of columns with about as many different values as rows."""
    events = spark.read.parquet(f"{d}/events.parquet")
    odd = F.when(F.col("event_id") % 5 > 0, F.col("value") / (F.col("user_id") + 1))
    numbers = profile.describe_numeric(events.withColumn("odd", odd), ["value", "event_id", "odd"])
    return numbers.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


def _rounded_bins(bins: DataFrame) -> DataFrame:
    return bins.select(
        F.col("bin").cast("bigint").alias("bin"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n"
    )


def length_histogram(spark, d):
    tables = reports.profile_journeys(web_journeys(WEB_ALL)(spark, d))
    return _rounded_bins(tables["lengths"])


def count_histogram(spark, d):
    tables = reports.profile_journeys(web_journeys(WEB_ALL)(spark, d))
    return _rounded_bins(tables["counts"])


def profile_numbers(spark, d):
    numbers = reports.profile_journeys(web_journeys(WEB_ALL)(spark, d))["numbers"]
    return numbers.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def shape(spark, d):
    return reports.profile_journeys(web_journeys(WEB_ALL)(spark, d))["shape"]


def top_journeys(spark, d):
    return with_long_length(profile.top_journeys(paths.where_length(web_profiled(spark, d), 1, 6), 100))


def nth_journey(spark, d):
    return profile.nth_journey(web_journeys(WEB_ALL)(spark, d), 1)


def preview_journeys(spark, d):
    order = [F.desc("conversion_flg"), F.desc("counts"), "journey"]
    return profile.preview(web_journeys(WEB_ALL)(spark, d), 25, order)


TIES = ("journey", "conversion_flg")


def _rounded_shares(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in df.columns if c.startswith(("count_percent", "coverage"))})


def running_share(spark, d):
    return _rounded_shares(longtail.running_share(web_table(spark, d), tie_cols=TIES))


def long_tail(spark, d):
    kept, _ = longtail.long_tail(web_table(spark, d), min_share=MIN_SHARE, min_count=MIN_COUNT, tie_cols=TIES)
    return _rounded_shares(kept)


def long_tail_report(spark, d):
    _, report = longtail.long_tail(web_journeys(WEB_ALL)(spark, d), min_share=MIN_SHARE, min_count=MIN_COUNT)
    return _rounded_shares(report)


def coverage(spark, d):
    table = web_table(spark, d)
    covered = longtail.coverage(table, min_count=MIN_COUNT)
    return _rounded_shares(covered).withColumn("total", longtail.total(table).scalar())


def suggest_min_count(spark, d):
    return longtail.suggest_min_count(web_journeys(WEB_ALL)(spark, d), MIN_SHARE)


def share_of_total(spark, d):
    return _rounded_shares(longtail.share_of_total(web_table(spark, d)))


def journey_end(spark, d):
    return graph.add_journey_end(web_journeys(WEB_ALL)(spark, d), conversion_label="Purchase")


def parse_steps(spark, d):
    return graph.parse_steps(web_journeys(WEB_ALL)(spark, d), max_steps=10)


def uneven_table(spark, d):
    """The web journeys and an empty one, which CSV reads back as missing, in the middle of the counts."""
    table = web_journeys(WEB_ALL)(spark, d)
    empty = table.agg(
        F.lit("").alias("journey"), F.lit(False).alias("conversion_flg"), (F.sum("counts") % 7 + 5).alias("counts")
    )
    folder = shared_folder(spark)
    write_csv(table.union(empty), folder)
    return read_journeys_csv(spark, folder)


def long_tail_null_journey(spark, d):
    kept, _ = longtail.long_tail(uneven_table(spark, d), min_share=MIN_SHARE, min_count=MIN_COUNT, tie_cols=TIES)
    return _rounded_shares(kept)


def sankey_of_columns(spark, d):
    """From step columns, and later steps beside them, to the edges of a flow of all of them."""
    wide = graph.parse_steps(web_journeys(WEB_ALL)(spark, d), max_steps=10, rest="later_steps")
    return reports.flow_of_steps(graph.steps_of_columns(wide, rest="later_steps"))[0]


def events_by_day(spark, d):
    folder = shared_folder(spark)
    write_events(fx.web_events(spark, d), folder)
    events = read_events(spark, folder, "2024-01-23", "2024-01-30")
    return plans.web_journeys(events, RULES, WEB)


def step_pairs(spark, d):
    pairs = graph.step_pairs(graph.with_steps(web_journeys(WEB_ALL)(spark, d)))
    return pairs.groupBy("source", "target").agg(
        F.sum("counts").alias("counts"), F.count("*").alias("pairs")
    )


def melted_steps(spark, d):
    return graph.nodes(graph.with_steps(web_journeys(WEB_ALL)(spark, d)))


def flow(journeys: Query, settings: reports.FlowSettings, which: int) -> Query:
    return lambda spark, d: reports.flow_tables(journeys(spark, d), settings)[which]


def snapshot_roundtrip(spark, d):
    folder = shared_folder(spark)
    journeys = web_journeys(WEB_ALL)(spark, d)
    write_snapshot(journeys, folder, "2024-01-24")
    write_snapshot(journeys, folder, fx.AS_OF)
    write_snapshot(journeys, folder, fx.AS_OF)
    return read_journeys(spark, folder, fx.AS_OF).withColumn("date", F.col("date").cast("string"))


def csv_roundtrip(spark, d):
    folder = shared_folder(spark)
    write_csv(web_journeys(WEB_ALL)(spark, d), folder)
    return with_long_length(paths.with_journey_length(read_journeys_csv(spark, folder)))


def category_csv(spark, d):
    folder = shared_folder(spark)
    hits = app_flat(spark, d).where(F.col("app_view_itemlist").isNotNull())
    counted = paths.sessions_by(hits, ["app_view_itemlist"])
    labelled = map_category(counted, fx.categories(spark), "app_view_itemlist")
    blank = F.lit(None).cast("string")
    rows = labelled.select(
        F.col("app_view_itemlist").alias("item_category"),
        "sessions",
        F.col("category_group").alias("content_group"),
        blank.alias("blank"),
        blank.alias("generated"),
    )
    write_csv(rows, folder)
    return read_categories(spark, folder, legacy_regex=True)


def build() -> dict[str, Query]:
    replace = dataclasses.replace
    app_all = app_journeys(APP_ALL)
    return {
        "web_journeys_nonconverters": web_journeys(),
        "web_journeys_converters": web_journeys(replace(WEB, converted=True)),
        "web_journeys_all_days": web_journeys(WEB_ALL),
        "web_journeys_first_visit_excluded": web_journeys(replace(WEB_ALL, first_visit_scope="exclude")),
        "app_journeys_converters": app_journeys(),
        "app_journeys_all_days": app_all,
        "content_group_qc": lambda spark, d: plans.content_group_qc(
            fx.web_events(spark, d), QC_RULES, as_of=fx.AS_OF, streams=["s1"]
        ),
        "qc_group_counts": lambda spark, d: qc.qc_group_counts(
            plans.qc_hits(fx.web_events(spark, d), QC_RULES, days=None)
        ),
        "qc_other_only": lambda spark, d: qc.sort_qc(
            qc.qc_counts(qc.where_group(plans.qc_hits(fx.web_events(spark, d), QC_RULES, days=None), "Other"))
        ),
        "scan_trailing_days": scan_trailing_days,
        "param_extract": param_extract,
        "param_any_match": param_any_match,
        "session_keys": session_keys,
        "stream_event_filter": stream_event_filter,
        "device_filter": device_filter,
        "content_group_rules": content_group_rules,
        "content_group_switched_on": content_group_switched_on,
        "url_groups_pages": url_groups_pages,
        "category_map": category_map,
        "category_contains": category_contains,
        "event_fallthrough": event_fallthrough,
        "event_fallthrough_more": event_fallthrough_more,
        "converters": converters,
        "first_visit_lookup": first_visit_lookup,
        "cutoff_hits": cutoff_hits,
        "first_visit_hits": first_visit_hits,
        "repeat_removal": repeat_removal,
        "previous_group": previous_group,
        "journeys_by_key": journeys_by_key,
        "journey_counts": lambda spark, d: paths.sort_journeys(app_all(spark, d), by_flag=True),
        "nonempty_converted": nonempty_converted,
        "journeys_matching": journeys_matching,
        "journey_length_range": journey_length_range,
        "sessions_by_group": sessions_by_group,
        "session_total": session_total,
        "describe_numeric": describe_numeric,
        "describe_values": describe_values,
        "profile_numbers": profile_numbers,
        "length_histogram": length_histogram,
        "count_histogram": count_histogram,
        "shape": shape,
        "top_journeys": top_journeys,
        "nth_journey": nth_journey,
        "preview_journeys": preview_journeys,
        "running_share": running_share,
        "long_tail": long_tail,
        "long_tail_report": long_tail_report,
        "coverage": coverage,
        "suggest_min_count": suggest_min_count,
        "share_of_total": share_of_total,
        "journey_end": journey_end,
        "parse_steps": parse_steps,
        "step_pairs": step_pairs,
        "melted_steps": melted_steps,
        "sankey_edges": flow(app_all, reports.APP_CONVERTERS, 0),
        "sankey_nodes": flow(app_all, reports.APP_CONVERTERS, 1),
        "sankey_edges_app_nonconverters": flow(app_all, reports.APP_NON_CONVERTERS, 0),
        "sankey_nodes_app_nonconverters": flow(app_all, reports.APP_NON_CONVERTERS, 1),
        "sankey_edges_web_nonconverters": flow(web_journeys(WEB_ALL), reports.WEB_NON_CONVERTERS, 0),
        "sankey_nodes_web_nonconverters": flow(web_journeys(WEB_ALL), reports.WEB_NON_CONVERTERS, 1),
        "sankey_edges_all": flow(uneven_table, reports.FlowSettings(), 0),
        "sankey_nodes_all": flow(uneven_table, reports.FlowSettings(), 1),
        "sankey_of_columns": sankey_of_columns,
        "long_tail_null_journey": long_tail_null_journey,
        "events_by_day": events_by_day,
        "web_journeys_any_platform": web_journeys(WEB_ALL),
        "web_journeys_many_platforms": web_journeys_many_platforms,
        "web_journeys_dictionary": web_journeys_dictionary,
        "web_journeys_stored_hits": web_journeys_stored_hits,
        "qc_group_counts_dictionary": lambda spark, d: qc.qc_group_counts(
            plans.qc_hits(fx.web_events(spark, d), QC_RULES, days=None, dictionary=True)
        ),
        "web_journeys_first_visit_all": web_journeys(replace(WEB_ALL, first_visit_scope="all")),
        "web_journeys_strict_params": web_journeys(replace(WEB_ALL, strict_params=True)),
        "snapshot_roundtrip": snapshot_roundtrip,
        "csv_roundtrip": csv_roundtrip,
        "category_csv": category_csv,
    }
