"""Session keys, hit filters, conversions and cutoffs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepweave.config import Conversion, JourneyConfig
from stepweave.functions.params import any_param_equals, contains_pattern, max_param_matching, param

TIME = "event_timestamp"


def session_key(
    separator: str = ".", session_param: str = "ga_session_id", *, strict: bool = False
) -> Column:
    """User and session id in one text; NULL when either is missing."""
    session = param(session_param, "int_value", strict=strict).cast("string")
    return F.concat(F.col("user_pseudo_id"), F.lit(separator), session)


def trailing_days(days: int, as_of: dt.date | str | None = None, column: str = "event_date") -> Column:
    """The whole days before ``as_of`` (today if not given): ``as_of`` - days ... ``as_of`` - 1."""
    end = F.current_date() if as_of is None else F.to_date(F.lit(str(as_of)))
    return F.col(column).between(F.date_sub(end, days), F.date_sub(end, 1))


def where_stream(streams: Sequence[str] | None) -> Column:
    return F.lit(True) if streams is None else F.col("stream_id").isin(*streams)


def where_device(category: str | None) -> Column:
    return F.lit(True) if category is None else F.col("device.category") == category


def where_events(names: Sequence[str], conversion: Conversion | None = None) -> Column:
    """Listed events, or any hit flagged as a conversion.

    When the conversion event is listed the second half adds nothing and is left out, so that the
    filter reaches the file scan.
    """
    listed = F.col("event_name").isin(*names)
    if conversion is None or conversion.event in names:
        return listed
    return listed | order_conversion(conversion).isNotNull()


def order_conversion(conversion: Conversion) -> Column:
    """The parameter value that flags the hit as a conversion, else NULL."""
    if conversion.flag_value is not None:
        return any_param_equals(conversion.event, conversion.flag_value)
    return max_param_matching(conversion.event, conversion.flag_pattern)


def conversion_flg(column: str = "order_conversion") -> Column:
    return F.col(column).isNotNull()


def conversion_ts(conversion: Conversion, *, strict: bool = False) -> Column:
    """Time of the hit if it sets a cutoff, else NULL."""
    text = param(conversion.param, strict=strict)
    sets_cutoff = (
        (F.col("event_name") == conversion.event)
        & where_stream(conversion.streams)
        & contains_pattern(text, conversion.cutoff_pattern)
    )
    return F.when(sets_cutoff, F.col(TIME))


def session_hits(
    events: DataFrame,
    config: JourneyConfig,
    columns: Mapping[str, Column],
    only_events: Sequence[str] | None = None,
) -> DataFrame:
    """Flat hits of one journey query, from one scan.

    Holds the hits of the query and the hits that only set a cutoff; the latter have
    ``is_hit`` false. The few parameters in use are taken out here, so the nested array goes no
    further. Hits without a key are dropped unless the settings keep them. ``only_events`` narrows
    the listed events where the caller needs no others.
    """
    conversion, sessions = config.conversion, config.sessions
    names = [name for name in config.events if only_events is None or name in only_events]
    listed = F.col("event_name").isin(*names)
    converts = F.col("event_name") == conversion.event
    on_hit_stream = where_stream(config.hit_streams)

    if config.days is not None:
        events = events.where(trailing_days(config.days, config.as_of))
    events = events.where(where_device(config.device))
    if config.hit_streams == conversion.streams:
        scanned = events.where(on_hit_stream & (listed | converts))
    elif config.hit_streams is None:
        scanned = events.where(listed | converts)
    else:
        scanned = events.where((on_hit_stream & listed) | converts)

    if conversion.event in names and config.hit_streams in (None, conversion.streams):
        is_hit = F.lit(True)
    else:
        is_hit = on_hit_stream & where_events(names, conversion)

    strict = config.strict_params
    cutoff_time = conversion_ts(conversion, strict=strict)
    key = session_key(sessions.separator, sessions.session_param, strict=strict)
    if sessions.keep_null_keys:
        # A NULL key never joins a cutoff.
        cutoff_time = F.when(key.isNotNull(), cutoff_time)
    else:
        # The parts rather than the key: cheaper, and the test on the user reaches the file scan.
        session = param(sessions.session_param, "int_value", strict=strict)
        scanned = scanned.where(F.col("user_pseudo_id").isNotNull() & session.isNotNull())
    return scanned.select(
        key.alias("key"),
        "platform",
        "event_name",
        TIME,
        *sessions.tie_break,
        order_conversion(conversion).alias("order_conversion"),
        cutoff_time.alias("conversion_ts"),
        is_hit.alias("is_hit"),
        *[column.alias(name) for name, column in columns.items()],
    )


def converters(hits: DataFrame) -> DataFrame:
    """Earliest conversion of each (key, platform) that has one."""
    return (
        hits.where(F.col("conversion_ts").isNotNull())
        .groupBy("key", "platform")
        .agg(F.min("conversion_ts").alias("conversion_time"))
    )


def cutoffs(converted: DataFrame) -> DataFrame:
    """Cutoff of each key: a hit counts while any platform's cutoff allows it, so the latest one."""
    return converted.groupBy("key").agg(F.max("conversion_time").alias("cutoff"))


def first_visit_lookup(hits: DataFrame, event: str = "first_visit") -> DataFrame:
    """Distinct (key, first-visit flag)."""
    flag = F.when(F.col("event_name") == event, 1).otherwise(0).alias("first_visit")
    return hits.select("key", flag).distinct()


def with_cutoff(hits: DataFrame, cutoff: DataFrame | None = None) -> DataFrame:
    """Attach the cutoff by key, from the hits themselves or from another table.

    The cutoff side is aggregated before it is shuffled; a giant key is on the other side, which
    Spark's skew join splits.
    """
    return hits.join(cutoffs(converters(hits)) if cutoff is None else cutoff, "key", "left")


def with_first_visit(hits: DataFrame, event: str = "first_visit") -> DataFrame:
    """Attach two flags of the key: has a first visit, has any other hit."""
    is_first = F.col("event_name") == event
    flags = (
        hits.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.bool_or(is_first).alias("has_first_visit"), F.bool_or(~is_first).alias("has_other_hit"))
    )
    return hits.join(flags, "key", "left")


def cut_at_conversion(hits: DataFrame) -> DataFrame:
    """Hits up to the cutoff, the conversion included; sessions without one whole."""
    return hits.where(F.col("cutoff").isNull() | (F.col("cutoff") >= F.col(TIME)))


def first_visit_condition(scope: str) -> Column:
    """Condition on hits that carry the cutoff and the first-visit flags.

    ``converters`` joins the test to the cutoff only, so sessions without a cutoff pass;
    ``exclude`` really drops sessions with a first visit.
    """
    if scope == "none":
        return F.lit(True)
    if scope == "all":
        return F.col("has_other_hit")
    if scope == "converters":
        return F.col("cutoff").isNull() | F.col("has_other_hit")
    if scope == "exclude":
        return F.col("has_first_visit").isNull() | ~F.col("has_first_visit")
    raise ValueError(f"unknown first-visit scope: {scope!r}")


def where_grouped(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("content_group").isNotNull())


def time_chunk(chunk_seconds: int | None) -> Column:
    """Number of the time chunk of a hit; one chunk for all time if not given. Hits without a time come first."""
    if chunk_seconds is None:
        return F.lit(0).cast("bigint")
    return F.expr(f"coalesce({TIME} div {int(chunk_seconds * 1_000_000)}, {-(2**63) + 1}L)")


def with_previous(
    hits: DataFrame, tie_break: Sequence[str] = ("event_id",), chunk_seconds: int | None = 600
) -> DataFrame:
    """Attach the content group of the previous grouped hit of the same key.

    The window runs inside time chunks of a key, so a giant key is spread over tasks. The last group
    of every chunk, one row per chunk, is carried to the first hit of the next.
    """
    hits = where_grouped(hits).withColumn("__chunk", time_chunk(chunk_seconds))
    chunk = ["key", "__chunk"]
    order = [TIME, *tie_break]
    inside = hits.withColumn(
        "__before", F.lag("content_group").over(W.partitionBy(*chunk).orderBy(*order))
    )
    carried = (
        hits.groupBy(*chunk)
        .agg(F.max_by("content_group", F.struct(*order)).alias("__last"))
        .select(
            F.col("key").alias("__key"),
            F.col("__chunk").alias("__in"),
            F.lag("__last").over(W.partitionBy("key").orderBy("__chunk")).alias("__carried"),
        )
    )
    same_chunk = F.col("key").eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__in"))
    return (
        inside.join(carried, same_chunk, "left")
        .withColumn("previous_group", F.coalesce("__before", "__carried"))
        .drop("__chunk", "__before", "__key", "__in", "__carried")
    )


def drop_repeats(hits: DataFrame) -> DataFrame:
    """Drop a hit whose content group equals the previous one."""
    previous = F.col("previous_group")
    return hits.where(previous.isNull() | (previous != F.col("content_group"))).drop("previous_group")
