"""Ordered work on sessions, skew-safe: from labelled hits to the steps, or the text, of each session.

A session is handled in two levels:

1. inside (key, time chunk): order the hits, drop repeats, and pack what is left into blocks of at
   most ``block_steps`` hits. One session holding a large share of all hits is spread over as
   many tasks as it has chunks.
2. per key, over summaries of what level 1 made: find the cutoff, cut what is behind it, and drop the first step of
   a chunk that repeats the last one of the chunk before.

Both are exact because cutting at a time keeps a prefix of the session, and dropping repeats looks
back only: the two commute, so the repeats can go before the cutoff is known.

The cutoff of a session is a time at which some hit of it converts. Level 1 therefore parts blocks at those times
(``segments``): whatever the cutoff turns out to be, a segment stays or goes as a whole, and only its text moves on to level 2.
Where the steps themselves are wanted (``session_blocks``, ``link_blocks``), summaries go to level 2 and back, and the
steps stay where they are. Conversions are kept by platform, whatever platforms there are: in one segment all have the
same time, so a summary holds a platform at most once.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepweave.config import JourneyConfig
from stepweave.functions.text import STEP_SEPARATOR
from stepweave.operators.rules import with_columns_once
from stepweave.operators.sessions import TIME, first_visit_condition, time_chunk


def effective_scope(config: JourneyConfig) -> str:
    """The first-visit scope, or ``none`` where it cannot change the result.

    For converters the conversion itself is a hit other than a first visit, so the test always
    passes when the conversion is among the hits.
    """
    conversion, streams = config.conversion, config.hit_streams
    if (
        config.first_visit_scope == "converters"
        and conversion.event in config.events
        and conversion.event != config.first_visit_event
        and (streams is None or set(conversion.streams or ()) <= set(streams) and conversion.streams)
    ):
        return "none"
    return config.first_visit_scope


def events_that_count(config: JourneyConfig, labelled: Collection[str] | None) -> list[str] | None:
    """Events that can bear on the journeys, given those that can get a label (None: any).

    Hits of other events leave at the scan: the test is on the event name alone and is pushed down.
    """
    scope = effective_scope(config)
    if labelled is None or scope in ("all", "converters"):
        return None
    also = [config.conversion.event]
    if scope == "exclude":
        also.append(config.first_visit_event)
    return [name for name in config.events if name in labelled or name in also]


def _ordered(hits: DataFrame, config: JourneyConfig) -> DataFrame:
    """Level 1 up to the packing: steps, and other hits that bear on the session, with their block.

    ``__since`` and ``__tied`` name the segment of a hit: the latest conversion before it in the chunk, and
    whether that was at the very time of the hit.
    """
    sessions = config.sessions
    wanted = [F.col("conversion_ts").isNotNull(), *_flags(config).values()]
    grouped = F.col("content_group").isNotNull()
    # Hits with no group that bear on nothing leave before the shuffle.
    hits = hits.where(reduce(lambda a, b: a | b, [grouped, *wanted]))
    if "chunk" not in hits.columns:  # hits stored by key and chunk hold it
        hits = hits.withColumn("chunk", time_chunk(sessions.chunk_seconds))
    ordered = W.partitionBy("key", "chunk").orderBy(TIME, *sessions.tie_break)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    previous = F.last("content_group", ignorenulls=True).over(before)
    is_step = grouped & (F.col("__previous").isNull() | (F.col("__previous") != F.col("content_group")))
    # All window columns in one select: one window operator over one sort.
    return (
        hits.select(
            "*",
            previous.alias("__previous"),
            F.row_number().over(ordered).alias("__n"),
            F.max("conversion_ts").over(before).alias("__since"),
        )
        .withColumn("__is_step", is_step)
        .where(reduce(lambda a, b: a | b, [F.col("__is_step"), *wanted]))
        .withColumn("block", F.expr(f"(__n - 1) div {int(sessions.block_steps)}"))
        .withColumn("__tied", F.col("__since") == F.col(TIME))
    )


def _flags(config: JourneyConfig) -> dict[str, Column]:
    """What the first-visit test needs to know of a session, by hit."""
    is_first = F.col("event_name") == config.first_visit_event
    scope = effective_scope(config)
    if scope == "exclude":
        return {"has_first_visit": F.col("is_hit") & is_first}
    return {} if scope == "none" else {"has_other_hit": F.col("is_hit") & ~is_first}


def _packed(kept: DataFrame, config: JourneyConfig, *by: str) -> DataFrame:
    """Steps in order, conversions by platform, and flags, of each group of hits."""
    sessions = config.sessions
    step = F.struct(TIME, *sessions.tie_break, "content_group", "conversion_flg")
    converts = F.struct("platform", F.col("conversion_ts").alias("at"))
    return kept.groupBy("key", "chunk", *by).agg(
        F.sort_array(F.collect_list(F.when(F.col("__is_step"), step))).alias("steps"),
        F.collect_set(F.when(F.col("conversion_ts").isNotNull(), converts)).alias("conversions"),
        F.min("__n").alias("__first"),
        *[F.bool_or(test).alias(name) for name, test in _flags(config).items()],
    )


def _latest_first(conversions: str) -> Column:
    """The latest of the platforms' first conversions, from an array ordered by platform and time."""
    here = F.col(conversions)
    firsts = F.filter(
        here, lambda c, i: (i == 0) | ~c["platform"].eqNullSafe(F.get(here, i - 1)["platform"])
    )
    return F.array_max(firsts["at"])


def _of_key(config: JourneyConfig) -> list[Column]:
    """Aggregates of a session over its summaries: conversions in order, and flags."""
    ordered = F.array_sort(F.flatten(F.collect_list(F.when(F.size("conversions") > 0, F.col("conversions")))))
    # Hits without a key are nobody's first visit: they never meet the lookup.
    flags = [F.when(F.col("key").isNotNull(), F.bool_or(name)).alias(name) for name in _flags(config)]
    return [ordered.alias("conversions"), *flags]


def segments(hits: DataFrame, config: JourneyConfig, separator: str = STEP_SEPARATOR) -> DataFrame:
    """Level 1 for journeys. ``hits`` are labelled: key, time, tie-break, content group, flag, conversion time.

    One row per part of a session that any cutoff keeps or drops whole: its place, the time of its first step, that step,
    the text of the others, the last step, and conversion flags of the first and of the others.
    """
    parts = _packed(_ordered(hits, config), config, "block", "__since", "__tied")
    groups, flagged, n = F.col("steps.content_group"), F.col("steps.conversion_flg"), F.size("steps")
    others = lambda column: F.slice(column, F.lit(2), F.greatest(n - 1, F.lit(0)))
    segment = F.struct(
        "chunk",
        F.col("__first").alias("n"),
        F.get(f"steps.{TIME}", F.lit(0)).alias("start"),
        F.get(groups, F.lit(0)).alias("first"),
        F.when(n > 1, F.array_join(others(groups), separator)).alias("rest"),
        F.get(groups, n - 1).alias("last"),
        F.get(flagged, F.lit(0)).alias("first_flag"),
        F.array_contains(others(flagged), True).alias("rest_flag"),
    )
    return parts.select("key", F.when(n > 0, segment).alias("segment"), "conversions", *_flags(config))


def journeys_of_segments(parts: DataFrame, config: JourneyConfig, separator: str = STEP_SEPARATOR) -> DataFrame:
    """Level 2 for journeys: key, journey, conversion_flg. A session collects texts, and no steps."""
    by_key = parts.groupBy("key").agg(
        F.array_sort(F.collect_list("segment")).alias("__segments"), *_of_key(config)
    )
    by_key = with_columns_once(by_key, cutoff=_latest_first("conversions"))
    scope = effective_scope(config)
    if scope != "none":
        by_key = by_key.where(first_visit_condition(scope))
    in_time = lambda s: F.col("cutoff").isNull() | (s["start"] <= F.col("cutoff"))
    by_key = with_columns_once(by_key, __kept=F.filter("__segments", in_time))

    def piece(s: Column, i: Column) -> Column:
        repeats = (i > 0) & (s["first"] == F.get("__kept", i - 1)["last"])
        whole = F.concat(s["first"], F.coalesce(F.concat(F.lit(separator), s["rest"]), F.lit("")))
        return F.struct(
            F.when(repeats, s["rest"]).otherwise(whole).alias("text"),
            (s["rest_flag"] | (~repeats & s["first_flag"])).alias("flag"),
        )

    pieces = with_columns_once(by_key.where(F.size("__kept") > 0), __pieces=F.transform("__kept", piece))
    return pieces.select(
        "key",
        F.array_join("__pieces.text", separator).alias("journey"),
        F.array_contains(F.col("__pieces.flag"), True).alias("conversion_flg"),
    )


def session_blocks(hits: DataFrame, config: JourneyConfig) -> DataFrame:
    """Level 1 for steps: the steps, conversions and flags of each block of a session."""
    return _packed(_ordered(hits, config), config, "block")


def link_blocks(blocks: DataFrame, config: JourneyConfig) -> DataFrame:
    """Level 2 for steps. Steps of each block after the cut and without repeats across chunks.

    Only a summary of each chunk is shuffled by key, one row of a fixed size, and returns with the last step before the
    chunk; the blocks stay partitioned by (key, chunk). Within a chunk no step repeats another.
    """
    flags = list(_flags(config))
    last = F.get(F.col("steps.content_group"), F.size("steps") - 1)
    with_steps = F.when(F.size("steps") > 0, F.col("block"))
    chunks = blocks.groupBy("key", "chunk").agg(
        F.max_by(last, with_steps).alias("__last"),
        F.min(with_steps).alias("__opens"),
        F.flatten(F.collect_list("conversions")).alias("conversions"),
        *[F.bool_or(name).alias(name) for name in flags],
    )
    summary = F.when(F.col("__opens").isNotNull(), F.struct("chunk", "__opens", "__last"))
    by_key = chunks.groupBy("key").agg(F.array_sort(F.collect_list(summary)).alias("__chunks"), *_of_key(config))
    by_key = with_columns_once(by_key, cutoff=_latest_first("conversions"))
    scope = effective_scope(config)
    if scope != "none":
        by_key = by_key.where(first_visit_condition(scope))

    def looks_back(c: Column, i: Column) -> Column:
        carried = F.when(i > 0, F.get("__chunks", i - 1)["__last"])
        return F.struct(c["chunk"].alias("chunk"), c["__opens"].alias("__opens"), carried.alias("__carried"))

    back = by_key.select("key", "cutoff", F.inline(F.transform("__chunks", looks_back)))
    linked = _join(blocks, back, config, "key", "chunk")

    def stays(step: Column, i: Column) -> Column:
        in_time = F.col("cutoff").isNull() | (step[TIME] <= F.col("cutoff"))
        repeats = (i == 0) & (F.col("block") == F.col("__opens")) & (step["content_group"] == F.col("__carried"))
        return in_time & ~F.coalesce(repeats, F.lit(False))

    # The other columns come along so that both uses of the blocks read one and the same shuffle of hits.
    others = {f"__{name}": F.col(name) for name in ("conversions", *flags)}
    kept = with_columns_once(linked, __steps=F.filter("steps", stays), **others)
    return kept.where(F.size("__steps") > 0).select("key", "chunk", "block", F.col("__steps").alias("steps"))


def _join(left: DataFrame, right: DataFrame, config: JourneyConfig, *by: str) -> DataFrame:
    """Inner join that keeps the partitioning of the left side; null keys meet only where they are kept."""
    if not config.sessions.keep_null_keys:
        return left.join(right, list(by))
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in by])
    return left.join(renamed, same).drop(*[f"__right_{c}" for c in by])


def steps_long(linked: DataFrame) -> DataFrame:
    """One row per step: key, time, tie-break, content group, flag."""
    return linked.select("key", F.inline("steps"))
