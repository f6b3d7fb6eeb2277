"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from stepweave import Rule, schema
from stepweave.sources import (
    cut_lineage,
    pick_conversion,
    read_categories,
    read_events,
    read_journeys,
    read_journeys_csv,
    read_rules,
    shared_folder,
    write_csv,
    write_events,
    write_snapshot,
)
from workload import fixtures as fx

ROWS = [("A > B", True, 3), ("A, \"quoted\"", False, 2), ("C", False, 1)]


def journeys(spark, rows=ROWS):
    return spark.createDataFrame(rows, schema.JOURNEYS)


def test_events_are_read_by_day(spark, tmp_path):
    path = str(tmp_path / "hits")
    events = fx.web_events(spark, "/root/testdata/sf0.001")
    write_events(events, path)
    part = read_events(spark, path, "2024-01-23", "2024-01-24", ["event_id", "event_name"])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "event_params" not in plan.split("ReadSchema")[1]
    wanted = events.where(F.col("event_date").between("2024-01-23", "2024-01-24"))
    assert sorted(r.event_id for r in part.collect()) == sorted(r.event_id for r in wanted.collect())
    write_events(events.where("event_date = date'2024-01-23'").limit(3), path)
    assert read_events(spark, path, "2024-01-23", "2024-01-23").count() == 3
    assert read_events(spark, path, "2024-01-24", "2024-01-24").count() > 3


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    write_snapshot(journeys(spark), path, "2024-01-01")
    write_snapshot(journeys(spark, ROWS[:1]), path, "2024-02-01")
    write_snapshot(journeys(spark, ROWS[:2]), path, "2024-02-01")
    assert read_journeys(spark, path).count() == 5
    assert read_journeys(spark, path, "2024-02-01").count() == 2
    with pytest.raises(ValueError):
        read_journeys(spark, path, "2024/02/01")
    with pytest.raises(ValueError):
        write_snapshot(journeys(spark), path, "tomorrow")


def test_journeys_by_table_name(spark):
    journeys(spark).createOrReplaceTempView("journey_view")
    assert read_journeys(spark, "journey_view").count() == 3


def test_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_csv(journeys(spark, [*ROWS, ("", False, 1), (None, False, 1)]), path)
    found = read_journeys_csv(spark, path)
    texts = [r.journey for r in found.collect()]
    assert sorted(t for t in texts if t) == sorted(r[0] for r in ROWS)
    assert texts.count(None) == 2
    assert {r.journey for r in pick_conversion(found, True).collect()} == {"A > B"}


def test_categories(spark, tmp_path):
    path = tmp_path / "categories.csv"
    path.write_text(
        "item_category,keys,,,\n"
        "Pasta,5,Menu,,x\n"
        "Trays,4,,,x\n"
        "2 for $25,3,Offers,,x\n"
        "Specials (Mon-Fri),2,Other,,\n"
        "Bowls®,2,Menu,,\n"
        "\"Deals, Drinks\",2,Menu,,\n"
        ",0,Other,,\n",
        encoding="utf-8",
    )
    rows = {r.item_category: r for r in read_categories(spark, str(path)).collect()}
    assert len(rows) == 6 and all(r.enabled for r in rows.values())
    assert rows["Trays"].content_group == "" and rows["Deals, Drinks"].sessions == 2
    legacy = {r.item_category for r in read_categories(spark, str(path), legacy_regex=True).where("enabled").collect()}
    assert legacy == {"Pasta", "Trays", "Deals, Drinks"}


def test_rules_file(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text(
        "priority,field,match,pattern,event_name,label,enabled\n"
        "2,page_location,equals,/home,page_view,Home,true\n"
        "1,page_location,regex,/menu$,page_view,Menu,true\n"
        "3,,any,,purchase,Purchase,false\n"
    )
    assert read_rules(spark, str(path)) == [
        Rule("Menu", "/menu$", event="page_view"),
        Rule("Home", "/home", match="equals", event="page_view"),
        Rule("Purchase", match="any", event="purchase", enabled=False),
    ]


def test_lineage_is_cut_in_the_shared_folder(spark):
    stored = cut_lineage(journeys(spark))
    assert stored.count() == 3
    assert "Scan parquet" in stored._jdf.queryExecution().executedPlan().toString() or stored.inputFiles()
    assert shared_folder(spark) != shared_folder(spark)


def test_every_dollar_is_the_very_end(spark):
    from stepweave.functions.params import at_very_end, contains_pattern

    assert at_very_end("a$") == "a\\z" and at_very_end("/menu$|/zz") == "/menu\\z|/zz"
    assert at_very_end("(/menu$)") == "(/menu\\z)" and at_very_end("a\\\\$") == "a\\\\\\z"
    assert at_very_end("a\\$") == "a\\$" and at_very_end("[$]$") == "[$]\\z" and at_very_end("\\Q$\\E$") == "\\Q$\\E\\z"
    urls = spark.createDataFrame([("x/menu\n",), ("x/menu",)], "u string")
    for pattern in ("/menu$|/zz", "(/menu$)", "/menu$"):
        assert [r.u for r in urls.where(contains_pattern(F.col("u"), pattern)).collect()] == ["x/menu"]
