"""Content groups: ordered rules, first match wins; and the category dimension."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.params import contains_pattern_sql, sql_text

MATCHES = ("regex", "equals", "any")


@dataclass(frozen=True)
class Rule:
    """A label for hits whose ``field`` matches ``pattern``, on one event or on any.

    ``match`` is ``regex`` (the text contains a match), ``equals``, or ``any`` (the event alone
    decides). Disabled rules are kept in the list and skipped.
    """

    label: str
    pattern: str | None = None
    match: str = "regex"
    event: str | None = None
    field: str = "page_location"
    enabled: bool = True

    def __post_init__(self):
        if self.match not in MATCHES:
            raise ValueError(f"match must be one of {MATCHES}: {self.match!r}")
        if (self.pattern is None) != (self.match == "any"):
            raise ValueError(f"a rule has a pattern unless it matches any: {self!r}")
        if self.match == "any" and self.event is None:
            raise ValueError(f"a rule needs a pattern or an event: {self!r}")

    def test(self) -> str:
        """The test on the text, as SQL; the event is tested apart."""
        if self.match == "equals":
            return f"`{self.field}` = {sql_text(self.pattern)}"
        if self.match == "regex":
            return contains_pattern_sql(self.field, self.pattern)
        return "TRUE"


def live_rules(rules: Iterable[Rule], enable: Sequence[str] = ()) -> list[Rule]:
    """The enabled rules, and the disabled ones whose label is listed, in order."""
    return [rule for rule in rules if rule.enabled or rule.label in enable]


def content_group(
    rules: Iterable[Rule], default: str | None = None, enable: Sequence[str] = ()
) -> Column:
    """The label of the first live rule that matches, else the default.

    Neighbouring rules of one event share its test: each such run is one ``CASE``, and the first run
    with a label wins. The order of the rules is kept. Besides saving tests this keeps the generated
    code of a long rule set small enough to be compiled to machine code. The expression is written as
    SQL text, which is one call to Spark instead of several per rule.
    """
    runs = []
    for event, run in groupby(live_rules(rules, enable), key=lambda rule: rule.event):
        whens = " ".join(f"WHEN {rule.test()} THEN {sql_text(rule.label)}" for rule in run)
        chain = f"CASE {whens} END"
        runs.append(chain if event is None else f"IF(event_name = {sql_text(event)}, {chain}, NULL)")
    runs.append("CAST(NULL AS STRING)" if default is None else sql_text(default))
    return F.expr(f"coalesce({', '.join(runs)})")


def with_label(hits: DataFrame, label: Column, name: str = "content_group") -> DataFrame:
    """Attach a label, computed once per hit.

    A filter on a plain computed column is moved below it and repeats its whole expression, for a rule
    set with every parameter lookup in it, at the scan. A filter does not pass a generator, so
    the label goes through one that yields a single row; it is part of the same generated code.
    """
    return with_columns_once(hits, **{name: label})


def with_label_by_dictionary(
    hits: DataFrame, label: Column, on: Sequence[str], name: str = "content_group"
) -> DataFrame:
    """Attach a label that depends on the columns ``on`` alone, computed once for each combination of their values.

    Worth its second scan where texts repeat: a long rule set then runs on the different texts only, and each hit costs
    one look-up. The join is plain and null-safe: Spark broadcasts a dictionary of checked size, and otherwise splits
    the hits of a frequent text.
    """
    renamed = {c: f"__on_{c}" for c in on}
    dictionary = with_label(hits.select(*on).distinct(), label, name).withColumnsRenamed(renamed)
    same = [F.col(c).eqNullSafe(F.col(other)) for c, other in renamed.items()]
    return hits.join(dictionary, same, "left").drop(*renamed.values())


def with_columns_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Attach columns behind a generator of one row, so that whatever uses them does not repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def events_of_rules(rules: Iterable[Rule], enable: Sequence[str] = ()) -> set[str] | None:
    """Events that a live rule can label; None if some rule labels any event."""
    events = {rule.event for rule in live_rules(rules, enable)}
    return None if None in events else events


def shadowed_rules(rules: Iterable[Rule]) -> list[tuple[Rule, Rule]]:
    """Pairs (rule, earlier rule) where the rule can never fire.

    Looks at plain texts only: each alternative of the rule holds an alternative of the earlier one.
    """

    def texts(rule: Rule) -> list[str]:
        return rule.pattern.split("|") if rule.match == "regex" else []

    found = []
    earlier: list[Rule] = []
    for rule in live_rules(rules):
        for before in earlier:
            same_hits = before.field == rule.field and before.event in (None, rule.event)
            if same_hits and texts(rule) and all(
                any(short in text for short in texts(before)) for text in texts(rule)
            ):
                found.append((rule, before))
                break
        earlier.append(rule)
    return found


def content_group_by_event(columns: Mapping[str, str]) -> Column:
    """The value of the column named for the hit's event; NULL for other events."""
    chain = F
    for event, column in columns.items():
        chain = chain.when(F.col("event_name") == event, F.col(column))
    return F.lit(None).cast("string") if chain is F else chain


def map_category(
    hits: DataFrame,
    categories: DataFrame,
    column: str = "item_category",
    output: str = "category_group",
    match: str = "equals",
    priority: Column | None = None,
) -> DataFrame:
    """Attach the content group of an item category.

    ``match="equals"``: the text is the category. The join carries no broadcast hint: Spark broadcasts the dimension
    after checking its size and falls back to a shuffle join, with skew handling, for one too large. A category
    listed twice keeps the label with the most sessions.

    ``match="contains"``: the category stands anywhere in the text, and of several the first rule wins: the
    least ``priority``, an expression over ``categories``; the most sessions, then the name, if not given. See ``find_categories``.
    """
    if match not in ("equals", "contains"):
        raise ValueError(f"match must be equals or contains: {match!r}")
    live = categories.where(F.col("enabled") & F.col("item_category").isNotNull())
    if match == "contains":
        texts = hits.select(F.col(column).alias("__category")).where("__category is not null").distinct()
        found = find_categories(texts, live, "__category", priority).withColumnRenamed("content_group", output)
        return hits.join(found, F.col(column) == F.col("__category"), "left").drop("__category")
    best = F.max(F.struct("sessions", "content_group"))
    unique = live.groupBy(F.col("item_category").alias("__category")).agg(best["content_group"].alias(output))
    return hits.join(unique, F.col(column) == F.col("__category"), "left").drop("__category")


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The different substrings of a size."""
    starts = F.sequence(F.lit(1), F.char_length(text) - (size - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.char_length(text) >= size, grams).otherwise(F.array().cast("array<string>"))


def find_categories(
    texts: DataFrame, categories: DataFrame, column: str, priority: Column | None = None
) -> DataFrame:
    """The texts that hold a category, with the content group of the first rule among those they hold.

    A text that holds a name holds each of its three-letter grams. Every name is filed under the one of them that the fewest
    names share (a shorter name under itself), so a text meets only the names filed under one of its own
    grams, and each is then looked for as a whole. No pair is formed without a shared gram.
    """
    if priority is None:
        priority = F.struct((-F.col("sessions")).alias("sessions"), F.col("item_category").alias("name"))
    rule = F.struct(priority.alias("priority"), "content_group")
    names = categories.groupBy(F.col("item_category").alias("name")).agg(F.min(rule).alias("rule"))
    name = F.col("name")
    grams = F.when(F.char_length(name) < GRAM, F.array(name)).otherwise(_grams(name, GRAM))
    filed = names.select("name", "rule", F.explode(grams).alias("gram"))
    shared = filed.groupBy("gram").agg(F.count("*").alias("n"))
    fewest = F.min_by("gram", F.struct("n", "gram"))
    index = filed.join(shared, "gram").groupBy("name").agg(F.first("rule").alias("rule"), fewest.alias("gram"))
    sizes = [F.array(F.lit("")), *[_grams(F.col(column), size) for size in range(1, GRAM + 1)]]
    met = texts.select(column, F.explode(F.concat(*sizes)).alias("gram")).join(index, "gram")
    held = met.where(F.col(column).contains(name))
    return held.groupBy(column).agg(F.min("rule")["content_group"].alias("content_group"))
