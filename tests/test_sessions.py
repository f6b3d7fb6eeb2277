"""Sessions and journeys: one small table per rule of behaviour, and random tables against the model."""

import dataclasses
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stepweave import APP, WEB, Rule, Sessions, app_journeys, web_journeys, with_streams
from stepweave.operators import sessions as S
from stepweave.operators.blocks import steps_long
from stepweave.operators.paths import count_journeys, journeys_from_steps
from stepweave.plans import journeys as plans
from tests.model import counted, hit, hits_table, journeys

RULES = [
    Rule("Home", "/home", event="page_view"),
    Rule("Menu", "/menu$", event="page_view"),
    Rule("Cart", "/cart", event="page_view"),
    Rule("Purchase", match="any", event="purchase"),
]
BASE = dataclasses.replace(WEB, days=None, converted=None)
BUY = "Order: Checkout"


def label(row):
    page = next((v[0] for k, v in row[7] if k == "page_location"), None)
    if row[3] == "purchase":
        return "Purchase"
    if row[3] != "page_view" or page is None:
        return None
    for group, test in (
        ("Home", "/home" in page), ("Menu", page.endswith("/menu")), ("Cart", "/cart" in page),
    ):
        if test:
            return group
    return None


def view(i, ts, page, user="a", **more):
    return hit(i, ts, user, "page_view", page_location=page, page_title="Shop", **more)


def buy(i, ts, title=BUY, user="a", **more):
    return hit(i, ts, user, "purchase", page_title=title, **more)


def run(spark, rows, config=BASE):
    return counted(web_journeys(hits_table(spark, rows), RULES, config))


def settings(config=BASE, **sessions):
    return dataclasses.replace(config, sessions=dataclasses.replace(config.sessions, **sessions))


def test_repeats_are_dropped(spark):
    pages = ["/home", "/home", "/menu", "/menu", "/home"]
    rows = [view(i, i, page) for i, page in enumerate(pages)]
    assert run(spark, rows) == {("Home > Menu > Home", False): 1}


def test_hits_without_group_do_not_part_repeats(spark):
    rows = [view(1, 1, "/home"), view(2, 2, "/nowhere"), view(3, 3, "/home")]
    assert run(spark, rows) == {("Home", False): 1}


def test_hits_without_session_are_dropped_or_kept_as_one(spark):
    rows = [view(1, 1, "/home", session=None), view(2, 2, "/menu", user=None), view(3, 3, "/cart")]
    assert run(spark, rows) == {("Cart", False): 1}
    kept = run(spark, rows, settings(keep_null_keys=True))
    assert dict(kept) == {("Cart", False): 1, ("Home > Menu", False): 0}


def test_separator_keeps_keys_apart(spark):
    rows = [view(1, 1, "/home", user="a1", session=2), view(2, 2, "/home", user="a", session=12)]
    assert run(spark, rows) == {("Home", False): 2}
    assert run(spark, rows, settings(separator="")) == {("Home", False): 1}


def test_latest_platform_cutoff_counts_and_hits_stay_single(spark):
    rows = [view(i, i, page) for i, page in [(1, "/home"), (3, "/menu"), (4, "/home"), (6, "/cart")]]
    rows += [buy(2, 2, platform="IOS"), buy(5, 5, platform="ANDROID")]
    journey = "Home > Purchase > Menu > Home > Purchase"
    assert run(spark, rows) == {(journey, True): 1}
    later = [buy(8, 8, platform="IOS"), view(7, 7, "/home"), buy(9, 9, platform="ANDROID")]
    assert run(spark, rows + later) == {(journey, True): 1}


def test_any_platform_counts(spark):
    rows = [view(1, 1, "/home", platform="TV"), buy(2, 2, platform="FRIDGE"), view(3, 3, "/menu", platform="TV")]
    assert run(spark, rows) == {("Home > Purchase", True): 1}
    rows += [buy(4, 4, platform=None), view(5, 5, "/cart", platform="FRIDGE")]
    assert run(spark, rows) == {("Home > Purchase > Menu > Purchase", True): 1}


def test_cut_within_equal_times(spark):
    rows = [view(1, 5, "/home"), buy(2, 5, platform="IOS"), view(3, 5, "/menu"), view(4, 6, "/cart")]
    assert run(spark, rows) == {("Home > Purchase > Menu", True): 1}
    rows += [buy(5, 6, platform="TV"), view(6, 6, "/home"), view(7, 7, "/menu")]
    assert run(spark, rows) == {("Home > Purchase > Menu > Cart > Purchase > Home", True): 1}


def test_platform_may_be_missing(spark):
    rows = [view(1, 1, "/home", platform=None), buy(2, 2, platform=None), view(3, 3, "/menu", platform=None)]
    assert run(spark, rows) == {("Home > Purchase", True): 1}


def test_conversion_outside_the_streams_sets_no_cutoff_but_flags(spark):
    rows = [view(1, 1, "/home"), buy(2, 2, stream="s9"), view(3, 3, "/menu")]
    config = with_streams(BASE, ["s1"])
    assert run(spark, rows, config) == {("Home > Purchase > Menu", True): 1}


def test_longer_title_sets_the_cutoff_but_not_the_flag(spark):
    rows = [view(1, 1, "/home"), buy(2, 2, title="Order: Checkout Help"), view(3, 3, "/menu")]
    assert run(spark, rows) == {("Home > Purchase", False): 1}


def test_first_visits_do_not_exclude_a_session_unless_asked(spark):
    rows = [hit(1, 1, "a", "first_visit"), view(2, 2, "/home")]
    rows += [hit(3, 1, "b", "first_visit"), view(4, 2, "/home", user="b"), buy(5, 3, user="b")]
    rows += [view(6, 2, "/cart", user="c")]
    for scope in ("converters", "all", "none"):
        config = dataclasses.replace(BASE, first_visit_scope=scope)
        assert run(spark, rows, config) == {
            ("Home", False): 1, ("Home > Purchase", True): 1, ("Cart", False): 1
        }
    config = dataclasses.replace(BASE, first_visit_scope="exclude")
    assert run(spark, rows, config) == {("Cart", False): 1}


def test_cutoff_keeps_the_conversion_itself(spark):
    rows = [view(1, 9, "/home"), view(2, 10, "/menu"), buy(3, 10), view(4, 11, "/cart")]
    assert run(spark, rows) == {("Home > Menu > Purchase", True): 1}


def test_flag_of_a_dropped_repeat_is_lost(spark):
    rows = [view(1, 1, "/home"), buy(2, 2, title="Order: Other"), buy(3, 3)]
    assert run(spark, rows) == {("Home > Purchase", False): 1}


def test_ties_go_by_event_id(spark):
    rows = [view(2, 1, "/menu"), view(1, 1, "/home"), view(3, 1, "/cart")]
    assert run(spark, rows) == {("Home > Menu > Cart", False): 1}


def test_end_anchor_is_the_very_end(spark):
    rows = [view(1, 1, "/menu\n"), view(2, 2, "/home")]
    assert run(spark, rows) == {("Home", False): 1}


def test_repeated_parameter_gives_the_first_or_fails(spark):
    row = list(view(1, 1, "/home"))
    row[7] = row[7] + [("page_location", ("/menu", None))]
    assert run(spark, [tuple(row)]) == {("Home", False): 1}
    with pytest.raises(PySparkException, match="more than once"):
        run(spark, [tuple(row)], dataclasses.replace(BASE, strict_params=True))


def test_trailing_days(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-31')) event_date")
    kept = days.where(S.trailing_days(8, "2024-01-31")).agg(F.min("event_date"), F.max("event_date")).first()
    assert [str(d) for d in kept] == ["2024-01-23", "2024-01-30"]


CATEGORIES = [
    ("Starters", 3, "A", True),
    ("Salads", 3, "B", True),
    ("Trays", 3, "", True),
    ("2 for $25", 3, "Offers", True),
    ("Off", 3, "Off", False),
]


def app_run(spark, rows, config):
    categories = spark.createDataFrame(
        CATEGORIES, "item_category string, sessions bigint, content_group string, enabled boolean"
    )
    return counted(app_journeys(hits_table(spark, rows), categories, config))


def listed(i, ts, category, user="a"):
    return hit(i, ts, user, "view_item_list", item_category=category)


def test_app_labels(spark):
    rows = [
        listed(1, 1, "Starters"),
        listed(2, 2, "2 for $25"),
        listed(3, 3, "Off"),
        listed(4, 4, "Unknown"),
        hit(5, 5, "a", "add_to_cart", item_name="x"),
        hit(6, 6, "a", "add_to_cart"),
        hit(7, 7, "a", "view_favorite_store", firebase_screen_class="MyStoreTableViewController"),
        hit(8, 8, "a", "screen_view", firebase_screen_class="QuickReorderViewController"),
        hit(9, 9, "a", "begin_checkout"),
        hit(10, 10, "a", "ecommerce_purchase", firebase_screen_class="CheckoutActivity", other="ZCheckoutActivity"),
        listed(11, 11, "Salads"),
    ]
    journey = "A > Offers > added_item > viewed_favourite_store > Quick_Reorder > ZCheckoutActivity"
    assert app_run(spark, rows, dataclasses.replace(APP, days=None)) == {(journey, True): 1}


def test_empty_label_is_a_step_and_a_journey_of_it_alone_is_dropped(spark):
    rows = [listed(1, 1, "Starters"), listed(2, 2, "Trays"), listed(3, 3, "Salads"), listed(4, 1, "Trays", "b")]
    config = dataclasses.replace(APP, days=None, converted=None, drop_empty=False)
    assert app_run(spark, rows, config) == {("A >  > B", False): 1, ("", False): 1}
    assert app_run(spark, rows, dataclasses.replace(config, drop_empty=True)) == {("A >  > B", False): 1}


def random_rows(seed, sessions=60):
    rng = random.Random(seed)
    rows, event_id = [], 0
    for user in range(sessions):
        for _ in range(rng.randint(1, 25)):
            event_id += 1
            common = dict(
                user=f"u{user}",
                session=rng.choice([1, 1, 1, 2, None]),
                platform=rng.choice(["IOS", "ANDROID", "ANDROID", None, f"P{event_id % 5}"]),
                stream=rng.choice(["s1", "s2"]),
            )
            ts = rng.randint(0, 12) * 1_000_000
            kind = rng.random()
            if kind < 0.7:
                page = rng.choice(["/home", "/menu", "/cart", "/none"])
                rows.append(hit(event_id, ts, event="page_view", page_location=page, **common))
            elif kind < 0.8:
                title = rng.choice([BUY, "Order: Checkout Help", "Order: Other"])
                rows.append(hit(event_id, ts, event="purchase", page_title=title, **common))
            else:
                event = rng.choice(["first_visit", "user_engagement", "add_to_cart"])
                rows.append(hit(event_id, ts, event=event, **common))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("scope", ["converters", "all", "none", "exclude"])
@pytest.mark.parametrize(
    "spread",
    [
        dict(),
        dict(chunk_seconds=None),
        dict(chunk_seconds=1),
        dict(chunk_seconds=3, block_steps=1),
        dict(chunk_seconds=None, block_steps=2),
        dict(chunk_seconds=2, block_steps=1),
    ],
)
def test_random_hits_equal_the_model(spark, scope, spread):
    rows = random_rows(seed=len(scope) + len(str(spread)))
    for streams in (None, ["s1"]):
        config = dataclasses.replace(BASE, first_visit_scope=scope)
        if streams:
            config = with_streams(config, streams)
        spread_config = settings(config, **spread)
        expected = journeys(rows, config, label)
        assert run(spark, rows, spread_config) == expected
        if streams and len(spread) == 2:
            # The steps themselves, one by one, give the same.
            steps = steps_long(plans.session_steps(plans.web_hits(hits_table(spark, rows), RULES, config), spread_config))
            assert counted(count_journeys(journeys_from_steps(steps))) == expected


@pytest.mark.parametrize("events", [("page_view",), ("page_view", "user_engagement")])
def test_conversion_event_may_be_unlisted(spark, events):
    rows = random_rows(seed=5)
    config = dataclasses.replace(BASE, events=events)
    assert run(spark, rows, config) == journeys(rows, config, label)
    other = with_streams(config, ["s1"], ["s2"])
    assert run(spark, rows, other) == journeys(rows, other, label)


def test_hit_level_operators_equal_the_blocks(spark):
    rows = random_rows(seed=9)
    config = with_streams(BASE, ["s1"])
    hits = plans.web_hits(hits_table(spark, rows), RULES, config)
    cut = S.cut_at_conversion(S.with_cutoff(hits))
    by_hit = count_journeys(journeys_from_steps(S.drop_repeats(S.with_previous(cut, chunk_seconds=2))))
    assert counted(by_hit) == journeys(rows, config, label)
    steps = steps_long(plans.session_steps(hits, config))
    assert counted(count_journeys(journeys_from_steps(steps))) == journeys(rows, config, label)


def test_counts_add_up_and_no_step_repeats(spark):
    rows = random_rows(seed=11)
    found = run(spark, rows, dataclasses.replace(BASE, first_visit_scope="none"))
    keys = {(r[2], dict(r[7]).get("ga_session_id")) for r in rows}
    assert 0 < sum(found.values()) <= len(keys)
    for journey, _ in found:
        steps = journey.split(" > ")
        assert all(a != b for a, b in zip(steps, steps[1:]))


def test_one_giant_session(spark):
    """A session with nearly all hits: same result whatever the spread."""
    pages = ["/home", "/menu", "/cart"]
    rows = [view(i, i * 500_000, pages[i % 7 % 3], user="big") for i in range(3000)]
    rows += [view(5000 + i, i, "/home", user=f"u{i}") for i in range(20)]
    expected = journeys(rows, BASE, label)
    assert run(spark, rows, settings(chunk_seconds=60, block_steps=16)) == expected
    assert run(spark, rows, settings(chunk_seconds=None)) == expected


def test_settings_are_checked():
    with pytest.raises(ValueError):
        dataclasses.replace(BASE, first_visit_scope="some")
    with pytest.raises(ValueError):
        dataclasses.replace(BASE.conversion, flag_pattern="x")
    assert Sessions().chunk_seconds == 600
    assert Counter(APP.events)["view_item_list"] == 1
