"""Shapes of the physical plans that matter at scale."""

import dataclasses
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stepweave.operators import longtail
from stepweave.operators.sessions import with_previous
from stepweave.plans import journeys as plans
from stepweave.sources import read_categories, read_events, store_hits, write_events
from workload import fixtures as fx
from workload import queries as q

SF_DIR = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hits") / "web")
    write_events(fx.web_events(spark, SF_DIR), path)
    return path


def web(spark, stored, **sessions):
    config = dataclasses.replace(q.WEB, sessions=dataclasses.replace(q.WEB.sessions, **sessions))
    events = read_events(spark, stored, "2024-01-01", "2024-12-31")
    return physical(plans.web_journeys(events, q.RULES, config))


def exchanges(plan):
    return re.findall(r"hashpartitioning\(([^)]*)\)", plan)


def test_one_scan_three_shuffles(spark, stored):
    plan = web(spark, stored)
    keys = [re.sub(r"#\d+L?", "", e) for e in exchanges(plan)]
    assert keys == ["journey, conversion_flg, 8", "key, 8", "key, chunk, 8"]
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_without_chunks_one_shuffle_less(spark, stored):
    keys = [re.sub(r"#\d+L?", "", e) for e in exchanges(web(spark, stored, chunk_seconds=None))]
    assert len(keys) == 2 and keys[0].startswith("journey") and keys[1].startswith("key")


def test_level_one_sorts_once_and_level_two_holds_no_window(spark, stored):
    plan = web(spark, stored)
    assert plan.count("Sort [") == 1
    assert len(re.findall(r"(?<!\w)Window \[", plan)) == 1
    above = plan[: plan.index("hashpartitioning(key")]
    assert "Window" not in above and "event_id" not in above


def test_any_platform_in_one_scan(spark, stored):
    events = read_events(spark, stored, "2024-01-01", "2024-12-31")
    platform = F.concat("platform", F.col("event_id").cast("string"))
    plan = physical(plans.web_journeys(events.withColumn("platform", platform), q.RULES, q.WEB))
    assert plan.count("FileScan") == 1 and len(exchanges(plan)) == 3
    assert "Join" not in plan and "raise_error" not in plan


def test_steps_stay_where_they_are(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_step_plan(spark, stored)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def check_step_plan(spark, stored):
    events = read_events(spark, stored, "2024-01-01", "2024-12-31")
    hits = plans.web_hits(events, q.RULES, q.WEB)
    steps = plans.session_steps(hits, q.WEB)
    plan = physical(steps)
    # Hits for each use of the blocks, alike, so that they are written once; summaries by key, and back.
    keys = Counter(re.sub(r"#\d+L?", "", e) for e in exchanges(plan))
    assert keys == {"key, chunk, 8": 3, "key, 8": 1}
    assert len(re.findall(r"(?<!\w)Window \[", plan)) == 2
    assert plan.count("lambda x_") and len(re.findall(r"filter\(steps", plan)) == 1
    steps.collect()
    final = physical(steps)
    final = final[: final.index("== Initial Plan ==")]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_filters_and_columns_reach_the_scan(spark, stored):
    plan = web(spark, stored)
    assert re.search(r"PartitionFilters: \[isnotnull\(event_date#\d+\), \(event_date#\d+ >= 2024-01-01", plan)
    pushed = re.search(r"PushedFilters: \[([^\n]*)\], ReadSchema", plan).group(1)
    assert "In(event_name, [page_view,purchase])" in pushed
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "device" not in schema and "user_pseudo_id" in schema


def test_scan_to_first_shuffle_is_one_code_span(spark, stored):
    plan = spark._jvm.PythonSQLUtils.explainString(
        plans.web_hits(
            read_events(spark, stored, "2024-01-01", "2024-12-31"), q.RULES, q.WEB, ["page_view", "purchase"]
        )._jdf.queryExecution(),
        "codegen",
    )
    assert "Found 1 WholeStageCodegen subtrees" in plan
    # Larger methods are not compiled to machine code.
    assert int(re.search(r"maxMethodCodeSize:(\d+)", plan).group(1)) < 8000


def test_app_scan_to_first_shuffle_is_generated_code(spark, tmp_path):
    write_events(fx.app_events(spark, SF_DIR), str(tmp_path))
    events = read_events(spark, str(tmp_path), "2024-01-01", "2024-12-31")
    plan = physical(plans.app_journeys(events, fx.categories(spark), q.APP))
    below = plan[plan.index("hashpartitioning(key") :]
    assert "lambda" not in below[below.index("FileScan") - 6000 :] and "regexp_extract_all" in below
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = plans.app_hits(events, fx.categories(spark), q.APP)
        code = spark._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # From the files over the look-up of categories to the label.
    (span,) = [part for part in code.split("== Subtree ") if "Generate inline" in part]
    stage = re.search(r"\*\((\d+)\) Generate", span).group(1)
    tree = span[: span.index("Generated code")]
    for operator in ("Project", "BroadcastHashJoin", "Filter", "ColumnarToRow"):
        assert f"*({stage}) {operator}" in tree
    assert "lambda" not in tree
    assert int(re.search(r"maxMethodCodeSize:(\d+)", span).group(1)) < 8000


def test_running_share_orders_only_the_table_of_counts_in_one_task(spark):
    df = spark.createDataFrame([("a", 1)], "journey string, counts bigint")
    plan = physical(longtail.running_share(df))
    single = plan[plan.index("SinglePartition"):] if "SinglePartition" in plan else ""
    assert plan.count("SinglePartition") == 1
    assert "journey" not in single.split("\n")[0]


def test_filters_do_not_repeat_the_rules(spark, stored):
    events = read_events(spark, stored, "2024-01-01", "2024-12-31")
    plan = physical(with_previous(plans.web_hits(events, q.RULES, q.WEB)))
    # Once for each of the two branches.
    assert plan.count("/en/menu/appetizers") == 2


def test_small_category_map_is_broadcast_and_a_large_one_is_not(spark, tmp_path):
    path = str(tmp_path / "categories")
    fx.categories(spark).selectExpr("item_category", "sessions", "content_group", "'' b", "'' g").write.csv(
        path, header=True
    )
    events = fx.app_events(spark, SF_DIR)
    for categories in (fx.categories(spark), read_categories(spark, path)):
        assert "BroadcastHashJoin" in physical(plans.app_hits(events, categories, q.APP))
    large = spark.range(10**9).selectExpr(
        "cast(id as string) item_category", "id sessions", "'x' content_group", "true enabled"
    )
    assert "SortMergeJoin" in physical(plans.app_hits(events, large, q.APP))


def test_rules_run_below_the_distinct(spark, stored):
    events = read_events(spark, stored, "2024-01-01", "2024-12-31")
    plan = physical(plans.web_hits(events, q.RULES, q.WEB, dictionary=True))
    above, below = plan.split("/en/menu/appetizers")  # once in the plan
    different = r"HashAggregate\(keys=\[[^\]]*page_location"
    assert re.search(different, below) and not re.search(different, above) and "Join" in above


def test_hits_stored_by_key_need_no_shuffle_by_key(spark, stored):
    events = read_events(spark, stored, "2024-01-01", "2024-12-31")
    hits = plans.web_hits(events, q.RULES, q.WEB)
    plain = Counter({(r.journey, r.conversion_flg): r.counts for r in plans.journey_counts(hits, q.WEB).collect()})
    for by, keys in ((("key",), 0), (("key", "chunk"), 1)):
        table = f"hits_{len(by)}"
        store_hits(hits, table, buckets=4, by=by, chunk_seconds=q.WEB.sessions.chunk_seconds)
        try:
            again = plans.journey_counts(spark.table(table), q.WEB)
            found = [re.sub(r"#\d+L?", "", e) for e in exchanges(physical(again))]
            assert [e for e in found if not e.startswith("journey")] == ["key, 8"] * keys
            assert Counter({(r.journey, r.conversion_flg): r.counts for r in again.collect()}) == plain
        finally:
            spark.sql(f"drop table {table}")
