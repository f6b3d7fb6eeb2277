"""The test tables as web and app hits: the same mapping for Spark and, as SQL text, for DuckDB.

Both are projections of the whole `events` table, row by row. `k` is the number in its `props`.
Session ids span one to five days by user, so that sessions differ in length and cross time chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.params import sql_text
from stepweave.schema import EVENT_PARAMS

AS_OF = "2024-01-31"
SITE = "https://shop.example.com"
HOME_URLS = (f"{SITE}/en", "https://stores.example.com/en-us/")
MORE_ENTREES = ("house-bowls",)
PAGES = (
    f"{SITE}/en",
    f"{SITE}/en/menu",
    f"{SITE}/en/menu/appetizers",
    f"{SITE}/en/menu/burgers",
    f"{SITE}/en/menu/pasta/creamy",
    f"{SITE}/en/menu/non-alcoholic-beverages",
    f"{SITE}/en/menu/dessert",
    f"{SITE}/en/menu/kids-menu",
    f"{SITE}/en/order/cart",
    f"{SITE}/en/accounts/cart-sign-in?returnUrl=/en/order/check-out",
    f"{SITE}/en/order/check-out?step=1",
    f"{SITE}/en/order/cross-sell-pre-checkout",
    f"{SITE}/en/menu/family-value-bundles",
    f"{SITE}/en/order/confirm-restaurant",
    f"{SITE}/en/menu/extras",
    f"{SITE}/en/accounts/sign-in",
    f"{SITE}/en/order/ordermethod",
    f"{SITE}/en/nutrition",
    f"{SITE}/en/accounts/my-account",
    f"{SITE}/en/gift-cards",
    f"{SITE}/en/sign-up",
    f"{SITE}/en/about",
    f"{SITE}/en/menu/2-for-30",
    f"{SITE}/en/menu/",
    "https://stores.example.com/en-us/",
    f"{SITE}/en/menu/house-bowls",
)
# name, sessions, content group
CATEGORIES = (
    ("Starters", 120, "Appetizers"),
    ("Noodles", 80, "Menu"),
    ("Burgers & More", 75, "Menu"),
    ("Green Salads", 60, "Menu"),
    ("2 for $25", 50, "Offers"),
    ("2 for $25 (Price may vary.)", 40, "Offers"),
    ("Specials (Mon-Fri)", 30, "Other"),
    ("House Bowls®", 25, "Menu"),
    ("House Bowls", 24, "Menu"),
    ("Party Trays", 20, ""),
    ("Kid's Plates", 15, "Kids Menu"),
    ("Cold Drinks", 12, "Drinks"),
    ("Sweets", 10, "Dessert"),
    ("Extras", 8, "Menu Extras"),
)
UNLISTED = ("Seasonal", "Packaging")
ITEM_CATEGORIES = tuple(name for name, _, _ in CATEGORIES) + UNLISTED


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    # Microseconds from the day and the time of day: no time zone, whole numbers only.
    micros = F.expr(
        "unix_date(cast(ts as date)) * 86400000000"
        " + cast(cast(ts - cast(cast(ts as date) as timestamp_ntz) as interval second) * 1000000 as bigint)"
    )
    session = F.expr("cast(case when k % 50 = 0 then null else day(ts) div (1 + user_id % 5) end as bigint)")
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .withColumn("k", k)
        .select(
            "event_id",
            micros.alias("event_timestamp"),
            F.col("ts").cast("date").alias("event_date"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_pseudo_id"),
            session.alias("session"),
            F.when(F.col("k") % 2 == 0, "IOS").otherwise("ANDROID").alias("platform"),
            F.when(F.col("user_id") % 4 == 0, "s2").otherwise("s1").alias("stream_id"),
            F.struct(
                F.when(F.col("user_id") % 3 == 0, "desktop").otherwise("mobile").alias("category")
            ).alias("device"),
            "event_type",
            "value",
            "k",
        )
    )


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.expr(f"array({', '.join(sql_text(v) for v in values)})"), index)


def _bag(texts: dict[str, Column]) -> Column:
    """The nested parameter array: the session id and the texts that are not NULL."""

    def entry(key: str, text: Column, number: Column) -> Column:
        value = F.struct(text.cast("string").alias("string_value"), number.cast("bigint").alias("int_value"))
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    none, empty = F.lit(None), F.array().cast(EVENT_PARAMS)
    present = [
        F.when(F.col("session").isNotNull(), F.array(entry("ga_session_id", none, F.col("session"))))
    ]
    present += [F.when(text.isNotNull(), F.array(entry(key, text, none))) for key, text in texts.items()]
    return F.concat(*[one.otherwise(empty) for one in present])


def _hits(events: DataFrame, event_name: Column, texts: dict[str, Column]) -> DataFrame:
    # The array goes through a generator of one row: to the optimizer it is then a column like one
    # from a file, and no filter repeats the work of building it.
    return events.withColumn("event_name", event_name).select(
        "event_id",
        "event_timestamp",
        "event_date",
        "user_pseudo_id",
        "event_name",
        "platform",
        "stream_id",
        "device",
        F.inline(F.array(F.struct(_bag(texts).alias("event_params")))),
    )


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k, value = F.col("event_type"), F.col("k"), F.col("value")
    name = (
        F.when(kind == "view", "page_view")
        .when((kind == "click") & (k % 2 == 0), "page_view")
        .when(kind == "click", "add_to_cart")
        .when(kind == "signup", "first_visit")
        .when(kind == "error", "user_engagement")
        .otherwise("purchase")
    )
    title = (
        F.when(kind != "purchase", "Shop")
        .when(value >= 50, "Order: Checkout")
        .when(value >= 25, "Order: Checkout Help")
        .otherwise("Order: Other")
    )
    texts = {
        "page_location": F.when(kind.isin("view", "click"), pick(PAGES, k % len(PAGES))),
        "page_title": title,
        "logged_in": F.when(kind == "error", F.when(k % 3 == 0, "Logged in").otherwise("Guest")),
    }
    return _hits(_events(spark, sf_dir), name, texts)


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    name = (
        F.when(kind == "view", "view_item_list")
        .when(kind == "click", "add_to_cart")
        .when(kind == "signup", "view_favorite_store")
        .when(kind == "error", "screen_view")
        .otherwise("ecommerce_purchase")
    )
    screen = (
        F.when(kind == "signup", F.when(k % 3 == 0, "StoreTableViewController").otherwise("MapActivity"))
        .when(kind == "error", F.when(k % 4 == 0, "QuickReorderViewController").otherwise("HomeActivity"))
        .when(
            kind == "purchase",
            F.when(k % 3 == 0, "CheckoutViewController")
            .when(k % 3 == 1, "CheckoutActivity")
            .otherwise("ReceiptActivity"),
        )
    )
    texts = {
        "item_category": F.when(kind == "view", pick(ITEM_CATEGORIES, k % len(ITEM_CATEGORIES))),
        "item_name": F.when((kind == "click") & (k % 2 == 0), F.concat(F.lit("Item "), k.cast("string"))),
        "firebase_screen_class": screen,
        "previous_class": F.when((kind == "purchase") & (k % 5 == 0), "OldCheckoutActivity"),
    }
    return _hits(_events(spark, sf_dir), name, texts)


def categories(spark: SparkSession) -> DataFrame:
    # An inline table: its size is known to the planner, like that of a file.
    rows = ", ".join(f"({sql_text(name)}, {sessions}L, {sql_text(group)}, true)" for name, sessions, group in CATEGORIES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(item_category, sessions, content_group, enabled)")
