"""Profile, long tail, steps and flow tables on small journey tables."""

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from stepweave import FlowSettings, Rule, flow_tables, long_tail, profile_journeys
from stepweave.functions import params
from stepweave.functions.text import PALETTE, check_date, hex_to_rgba, palette_color
from stepweave.operators import graph, longtail, ordering, profile, qc
from stepweave.operators.rules import content_group, events_of_rules, map_category, shadowed_rules
from stepweave.plans import reports
from stepweave.plans.journeys import qc_hits
from stepweave.rulesets import website_qc_rules, website_rules
from tests.model import hit, hits_table
from workload import queries

SCHEMA = "journey string, conversion_flg boolean, counts bigint"


def table(spark, *rows):
    return spark.createDataFrame([(j, False, c) for j, c in rows], SCHEMA)


def column(df, name):
    return [row[name] for row in df.collect()]


def test_end_step(spark):
    journeys = ["A > B", "A > Conversion", "A > Conversion\t", "A > PreConversion", "Conversion x"]
    marked = graph.add_journey_end(table(spark, *[(j, i) for i, j in enumerate(journeys)])).orderBy("counts")
    end = " > Journey End"
    assert column(marked, "journey") == [journeys[0] + end, *journeys[1:4], journeys[4] + end]


def test_steps_are_cut_without_a_sign(spark):
    rows = table(spark, ("A > B > C > D > E > F > G", 1))
    wide = graph.parse_steps(rows, max_steps=5)
    assert graph.step_columns(wide) == [f"step_{i}" for i in range(1, 6)]
    assert list(wide.first())[3:] == ["A", "B", "C", "D", "E"]


def test_later_steps_stay_in_an_array(spark):
    long = " > ".join(f"s{i}" for i in range(20_000))
    wide = graph.parse_steps(table(spark, ("A > B", 1), ("C > D > E", 2), (long, 3)), max_steps=2, rest="later")
    assert wide.columns[3:] == ["step_1", "step_2", "later"]
    rows = {tuple(r)[2:5]: r.later for r in wide.collect()}
    assert rows[(1, "A", "B")] == [] and rows[(2, "C", "D")] == ["E"]
    assert rows[(3, "s0", "s1")][::19_997] == ["s2", "s19999"]
    again = graph.steps_of_columns(wide, rest="later").orderBy("counts")
    assert column(again, "steps") == [["A", "B"], ["C", "D", "E"], long.split(" > ")]
    edges, _ = reports.flow_of_steps(graph.steps_of_columns(wide, rest="later"))
    assert edges.count() == 20_002


@pytest.mark.parametrize("names", [("step_1", "step_3"), ("step_2", "step_1"), ("journey",)])
def test_step_columns_must_be_in_line(spark, names):
    with pytest.raises(ValueError):
        graph.step_columns(spark.createDataFrame([tuple("x" for _ in names)], list(names)))


def test_date_text():
    assert check_date("2024-01-31") == "2024-01-31"
    for bad in ("2022/10/03", "22-10-03", "2022-10-03 ", "2022-10-03\n"):
        with pytest.raises(ValueError):
            check_date(bad)


def test_colors(spark):
    row = spark.range(1).select(
        hex_to_rgba(F.lit("#8E8C99"), 0.9).alias("a"),
        palette_color(F.lit(len(PALETTE) + 1)).alias("b"),
        hex_to_rgba(F.lit(None).cast("string"), 0.9).alias("c"),
    ).first()
    assert tuple(row) == ("rgba(142, 140, 153, 0.9)", PALETTE[1], None)
    assert (len(PALETTE), len(set(PALETTE))) == (57, 11)


def test_long_tail(spark):
    rows = table(spark, *[(f"j{c}", c) for c in (50, 30, 10, 5, 3, 2)])
    kept, report = long_tail(rows, min_share=0.9, min_count=10)
    found = [tuple(r) for r in kept.orderBy(F.desc("counts")).select("counts", "count_percent_cum").collect()]
    assert found == [(50, 0.5), (30, 0.8), (10, 0.9)]
    assert tuple(report.first()) == (0.9, True, 10)
    assert tuple(long_tail(rows, min_share=0.95, min_count=10)[1].first()) == (0.9, False, 5)
    assert tuple(long_tail(rows, min_share=0.95, min_count=60)[1].first()) == (0.0, False, 5)
    assert long_tail(rows, min_count=60)[0].count() == 0


def test_running_share_equals_a_plain_sum_with_a_long_run_of_ties(spark):
    rng = random.Random(3)
    counts = [1] * 700 + [2] * 300 + [rng.randint(1, 40) for _ in range(100)]
    rows = table(spark, *[(f"j{i}", c) for i, c in enumerate(counts)])
    import hashlib

    for minimum in (None, 2):
        ranked = ordering.with_running(rows, "counts", ["journey"], minimum).collect()
        ordered = sorted(ranked, key=lambda r: (-r.counts, hashlib.md5(r.journey.encode()).hexdigest()))
        assert [r.position for r in ordered] == list(range(len(ordered)))
        assert len(ordered) == sum(c >= (minimum or 0) for c in counts)
        total = 0
        for r in ordered:
            total += r.counts
            assert r.running == total and r.total == sum(counts)
    shares = longtail.running_share(rows).agg(F.max("count_percent_cum")).first()[0]
    assert math.isclose(shares, 1.0)


def test_running_share_wants_whole_numbers(spark):
    with pytest.raises(TypeError):
        longtail.running_share(table(spark, ("a", 1)).withColumn("counts", F.lit(0.5)))


def test_share_coverage_and_total(spark):
    rows = table(spark, ("a", 6), ("b", 2))
    assert sorted(column(longtail.share_of_total(rows), "count_percent")) == [0.25, 0.75]
    assert longtail.coverage(rows, min_count=4).first()[0] == 0.75
    assert longtail.coverage(rows, min_count=9).first()[0] == 0.0
    assert longtail.total(rows).first()[0] == 8


def test_histograms(spark):
    rows = spark.range(1, 10).withColumnRenamed("id", "x")
    bins = profile.histogram(rows, "x", 8).orderBy("bin").collect()
    assert [r.n for r in bins] == [1, 1, 1, 1, 1, 1, 1, 2]
    assert (bins[0].lo, bins[-1].hi) == (1.0, 9.0)
    same = profile.histogram(spark.range(5).select(F.lit(4).alias("x")), "x", 8).orderBy("bin").collect()
    assert [r.n for r in same] == [0, 0, 0, 0, 5, 0, 0, 0]
    assert (same[0].lo, same[-1].hi) == (3.5, 4.5)
    gaps = profile.histogram(spark.createDataFrame([(0,), (10,)], "x int"), "x", 5).orderBy("bin")
    assert column(gaps, "n") == [1, 0, 0, 0, 1]
    assert profile.histogram(rows, "x", 8, more_than=99).count() == 0


def test_profile(spark):
    rows = spark.createDataFrame(
        [("A", False, 4), ("A > B", False, 2), ("", False, 1), ("C", True, 9)], SCHEMA
    )
    tables = profile_journeys(rows, converted=False)
    assert sorted(column(tables["journeys"], "journey_length")) == [1, 1, 2]
    assert tuple(tables["shape"].first()) == (3, 4)
    numbers = {r.column_name: r for r in tables["numbers"].collect()}
    assert (numbers["counts"].q25, numbers["counts"].q50, numbers["counts"].q75) == (1.5, 2.0, 3.0)
    assert math.isclose(numbers["counts"].std, 1.5275252316519465)
    assert sum(column(tables["lengths"], "n")) == 3 and sum(column(tables["counts"], "n")) == 1


def test_top_nth_preview(spark):
    rows = table(spark, ("b", 2), ("a", 2), ("c", 5), ("d", 1))
    assert column(profile.top_journeys(rows, 3), "journey") == ["c", "a", "b"]
    assert column(profile.nth_journey(rows, 1), "journey") == ["a"]
    assert column(profile.preview(rows, 2, ["journey"]), "journey") == ["a", "b"]


def test_flow_of_a_loop(spark):
    settings = FlowSettings(max_length=None, conversion_label="B")
    edges, nodes = flow_tables(table(spark, ("A > B > A > B", 2)), settings)
    assert {(r.source, r.target): r.counts for r in edges.collect()} == {("A", "B"): 4, ("B", "A"): 2}
    assert {r.value: r.counts for r in nodes.collect()} == {"A": 4, "B": 4}


def test_flow_length_does_not_count_the_end_step(spark):
    rows = table(spark, ("A > B", 3), ("A > B > C", 9))
    edges, nodes = flow_tables(rows, FlowSettings(min_length=2, max_length=2))
    assert {(r.source, r.target) for r in edges.collect()} == {("A", "B"), ("B", "Journey End")}
    assert {r.value for r in nodes.collect()} == {"A", "B", "Journey End"}


def test_flow_weights_add_up(spark):
    rng = random.Random(7)
    labels = [f"g{i}" for i in range(70)]
    rows = {" > ".join(rng.sample(labels, rng.randint(1, 8))): rng.randint(1, 9) for _ in range(200)}
    settings = FlowSettings(top=None, max_length=None, max_steps=6)
    edges, nodes = flow_tables(table(spark, *rows.items()), settings)
    edges, nodes = edges.collect(), nodes.collect()
    shown = {j: min(len(j.split(" > ")) + 1, 6) for j in rows}
    assert sum(e.counts for e in edges) == sum(c * (shown[j] - 1) for j, c in rows.items())
    assert sum(n.counts for n in nodes) == sum(c * shown[j] for j, c in rows.items())
    assert sorted(n.value_index for n in nodes) == list(range(len(nodes)))
    index = {n.value: n.value_index for n in nodes}
    assert len(nodes) > len(PALETTE)
    by_weight = sorted(nodes, key=lambda n: n.value_index)
    assert all(a.counts >= b.counts for a, b in zip(by_weight, by_weight[1:]))
    assert by_weight[57].color == by_weight[0].color
    for e in edges:
        assert (e.source_index, e.target_index) == (index[e.source], index[e.target])
        assert e.link_color == e.color.replace("0.9", "0.3")
    pairs = graph.edges(graph.with_steps(table(spark, ("A > B", 2), ("A > B > C", 1))))
    assert {(r.source, r.target): r.counts for r in pairs.collect()} == {("A", "B"): 3, ("B", "C"): 1}


def test_rule_order_and_lint(spark):
    rules = [
        Rule("First", "/order/cross", event="page_view"),
        Rule("Off", "/order", event="page_view", enabled=False),
        Rule("Never", "/en/order/cross-sell", event="page_view"),
        Rule("Any", "/en/order/cross-sell"),
        Rule("Seen", match="any", event="page_view"),
    ]
    assert [(a.label, b.label) for a, b in shadowed_rules(rules)] == [("Never", "First")]
    df = spark.createDataFrame(
        [("/en/order/cross-sell", "page_view"), ("/en/order/cross-sell", "x"), ("/en/order", "page_view"), (None, "x")],
        "page_location string, event_name string",
    )
    labels = df.select(content_group(rules).alias("a"), content_group(rules, "Other", enable=["Off"]).alias("b"))
    assert [tuple(r) for r in labels.collect()] == [
        ("First", "First"), ("Any", "Any"), ("Seen", "Off"), (None, "Other")
    ]
    assert events_of_rules(rules) is None and events_of_rules(rules[:3]) == {"page_view"}


def test_website_rule_sets():
    home = ["https://shop.example.com/en", "https://stores.example.com/"]
    live = [r for r in website_rules(home) if r.enabled]
    assert len({r.label for r in live}) == 22
    qc_live = [r for r in website_qc_rules(home) if r.enabled]
    assert len({r.label for r in qc_live}) == 23
    assert ("Cross-Sell", "Cross Sell Page") in {(a.label, b.label) for a, b in shadowed_rules(live)}


def test_bad_rules():
    for bad in (
        dict(label="x"), dict(label="x", match="any"), dict(label="x", pattern="p", match="like"),
    ):
        with pytest.raises(ValueError):
            Rule(**bad)


def test_qc_counts_other_and_flagged_hits(spark):
    rows = [
        hit(1, 1, "a", "page_view", page_location="/en/menu/appetizers"),
        hit(2, 2, "a", "page_view", page_location="/else"),
        hit(3, 3, "a", "purchase", page_title="Order: Checkout"),
        hit(4, 4, "a", "purchase", page_title="Order: Other"),
        hit(5, 5, "a", "add_to_cart", page_location="/en/menu/appetizers"),
        hit(6, 6, "a", "page_view", page_location="/en/accounts/cart-sign-in?returnUrl=/en/order/check-out"),
    ]
    hits = qc_hits(hits_table(spark, rows), website_qc_rules(["/home"]), days=None)
    found = {(r.content_group, r.page_location, r.event_name): r.p_count for r in qc.qc_counts(hits).collect()}
    assert found == {
        ("PV: Appetizers", "/en/menu/appetizers", "page_view"): 1,
        ("Other", "/else", "page_view"): 1,
        ("Purchase", None, "purchase"): 1,
        ("Other", None, "add_to_cart"): 1,
        # The unescaped question mark keeps the sign-in rule from matching; a later rule does.
        ("PV: Check Out", "/en/accounts/cart-sign-in?returnUrl=/en/order/check-out", "page_view"): 1,
    }
    ordered = qc.sort_qc(qc.qc_counts(hits)).collect()
    assert [r.p_count for r in ordered] == sorted((r.p_count for r in ordered), reverse=True)
    assert {r.content_group: r.record_count for r in qc.qc_group_counts(hits).collect()}["Other"] == 2
    assert dataclasses.asdict(Rule("a", "b"))["enabled"]


def test_missing_journeys_stay(spark):
    """A missing journey counts and is drawn as an empty one."""
    rows = [(None, False, 40), ("A > B", False, 10), ("", False, 7), ("A", False, 3)]
    table = spark.createDataFrame(rows, "journey string, conversion_flg boolean, counts long")
    kept, report = longtail.long_tail(table, min_share=0.9, min_count=4)
    assert [(r.journey, r.counts) for r in kept.orderBy(F.desc("counts")).collect()] == [(None, 40), ("A > B", 10), ("", 7)]
    assert report.first().coverage == pytest.approx(57 / 60)
    running = longtail.running_share(table).orderBy(F.desc("counts")).collect()
    assert [round(r.count_percent_cum * 60) for r in running] == [40, 50, 57, 60]
    edges, nodes = flow_tables(table)
    assert {r.value: r.counts for r in nodes.collect()} == {"": 47, "A": 13, "B": 10, "Journey End": 60}
    assert {(r.source, r.target): r.counts for r in edges.collect()}[("", "Journey End")] == 47


def test_flow_is_uncut_by_default(spark):
    long = " > ".join(f"s{i}" for i in range(30))
    table = spark.createDataFrame([(long, False, 1)] + [(f"x{i}", True, 1) for i in range(20)], "journey string, conversion_flg boolean, counts long")
    _, nodes = flow_tables(table)
    assert nodes.count() == 30 + 20 + 1


def test_categories_within_texts_equal_a_loop(spark):
    rng = random.Random(4)
    some = "aabé字 $("
    names = {"".join(rng.choices(some, k=rng.choice([0, 1, 2, 3, 4, 6]))) for _ in range(60)} | {"a.b", "(x)"}
    rules = [(name, i % 7, f"g{i}", i % 9 != 0) for i, name in enumerate(sorted(names))]
    rules += [(rules[5][0], 99, "twice", True), (None, 1, "none", True), ("off", 1000, "off", False)]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(150)] + [None, "", "off", "a.b", "acb (x) "]
    texts += ["the hot text aab"] * 200
    hits = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, item string").repartition(4)
    categories = spark.createDataFrame(rules, "item_category string, sessions long, content_group string, enabled boolean")

    def first(text, order):
        held = [r for r in rules if text is not None and r[0] is not None and r[3] and r[0] in text]
        return min(held, key=order)[2] if held else None

    found = map_category(hits, categories, "item", match="contains").collect()
    assert {r.id: r.category_group for r in found} == {i: first(x, lambda r: (-r[1], r[0], r[2])) for i, x in enumerate(texts)}
    longest = F.struct((-F.char_length("item_category")).alias("n"), F.col("item_category").alias("c"), F.col("sessions").alias("s"))
    found = map_category(hits, categories, "item", match="contains", priority=longest).collect()
    assert {r.id: r.category_group for r in found} == {i: first(x, lambda r: (-len(r[0]), r[0], r[1])) for i, x in enumerate(texts)}
    plan = map_category(hits, categories, "item", match="contains")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        map_category(hits, categories, "item", match="regex")
    assert {r.category_group for r in map_category(hits, categories.limit(0), "item", match="contains").collect()} == {None}


def test_numbers_of_any_column(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.normal(size=3000) * 10.0 ** rng.integers(-20, 20, 3000)
    rows = [(float(v), int(k), None, float("nan") if i == 7 else float(i)) for i, (v, k) in enumerate(zip(values, rng.integers(0, 4, 3000)))]
    df = spark.createDataFrame(rows, "spread double, few long, nothing double, odd double").repartition(5)
    got = {r.column_name: r for r in profile.describe_numeric(df, df.columns).collect()}
    for name, own in (("spread", values), ("few", np.array([r[1] for r in rows], float))):
        r = got[name]
        assert r["count"] == 3000 and (r["min"], r["max"]) == (own.min(), own.max())
        assert list(r[5:8]) == pytest.approx(np.percentile(own, [25, 50, 75]).tolist(), rel=1e-12)
        assert (r["mean"], r["std"]) == pytest.approx((own.mean(), own.std(ddof=1)), rel=1e-9)
    assert got["nothing"][1:] == (0, *[None] * 7)
    assert got["odd"].q50 == 1500.5 and math.isnan(got["odd"]["max"]) and math.isnan(got["odd"]["mean"])
    (one,) = profile.describe_numeric(df.limit(1), ["few"]).collect()
    assert one["count"] == 1 and one["std"] is None and one.q25 == one["min"] == one["max"]
    assert [tuple(r)[:2] for r in profile.describe_numeric(df.limit(0), ["few", "odd"]).collect()] == [("few", 0), ("odd", 0)]


def test_joint_numbers_equal_those_of_the_rows(spark):
    rng = random.Random(6)
    rows = [(rng.randint(1, 9) ** 4, rng.choice([None, 1, 2, 5])) for _ in range(400)]
    df = spark.createDataFrame(rows, "counts long, journey_length int")
    joint = profile.joint_frequencies(df, df.columns)
    wanted = [tuple(r) for r in profile.describe_numeric(df, df.columns).collect()]
    for found, expected in zip(profile.describe_joint(joint, df.columns).collect(), wanted, strict=True):
        assert found[0] == expected[0] and tuple(found[1:]) == pytest.approx(expected[1:])
    assert profile.shape(joint, "n", 2).first() == profile.shape(df).first()
    assert profile.histogram(joint, "counts", 7, weight="n").collect() == profile.histogram(df, "counts", 7).collect()
    (empty,) = profile.describe_joint(joint.limit(0), ["counts"]).collect()
    assert tuple(empty)[:3] == ("counts", 0, None)


def test_profile_and_long_tail_read_the_journeys_once(spark, tmp_path):
    path = str(tmp_path / "journeys")
    table(spark, *[(f"J{i} > x", i % 9 + 1) for i in range(200)]).write.parquet(path)
    journeys = spark.read.parquet(path)
    tables = profile_journeys(journeys)
    for name in ("numbers", "lengths", "counts", "shape"):
        assert not any(f.startswith(f"file://{path}") for f in tables[name].inputFiles())
    kept, report = long_tail(journeys, min_share=0.5, min_count=3)
    assert not any(f.startswith(f"file://{path}") for f in report.inputFiles())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [journey") == 1 and plan.count("FileScan") == 3


def test_largest_value_that_matches(spark):
    values = [["x", "a Buy b", None, "Buy\n2", ""], [None], [], None, ["buy"], ["Order", "zOrderz", "Buyer"]]
    entries = [None if v is None else [("k", (x, None)) for x in v] for v in values]
    schema = "event_name string, event_params array<struct<key:string,value:struct<string_value:string,int_value:long>>>"
    df = spark.createDataFrame([("e", e) for e in entries] + [("other", entries[0])], schema)
    plain = params.max_param_matching("e", "Buy|Order")
    by_regex = params.max_param_matching("e", "(Buy|Order)")
    found = df.select(plain.alias("a"), by_regex.alias("b")).collect()
    assert [r.a for r in found] == ["a Buy b", None, None, None, None, "zOrderz", None]
    assert [r.a for r in found] == [r.b for r in found]
