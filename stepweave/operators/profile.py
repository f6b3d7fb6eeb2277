"""Profile of a journey table: numbers, histograms, top rows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepweave.sources.tables import cut_lineage


DESCRIBED = (
    "column_name string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
)


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact interpolated quartiles, maximum; a row per column.

    The columns are read once, to a table of different values and how often each occurs, stored in the shared folder in
    ranges of even size. Sums over the ranges, four numbers each, tell which of them hold the quartiles, and only those are
    gone through in order. No task holds more than a range, however many different values there are. NULL does not count;
    NaN is above all numbers.
    """
    each = [F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    counted = df.select(F.inline(F.array(*each))).where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
    values = cut_lineage(counted.repartitionByRange("i", "v").withColumn("part", F.spark_partition_id()))
    sums = values.groupBy("i", "part").agg(
        F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    ranges = sums.orderBy("i", "part").collect()
    parts = [[r for r in ranges if r.i == i] for i in range(len(columns))]
    counts = [sum(r.n for r in own) for own in parts]
    means = [sum(r.s for r in own) / n if n else None for own, n in zip(parts, counts, strict=True)]
    gap = F.col("v") - F.get(F.array(*[F.lit(m).cast("double") for m in means]), F.col("i"))
    squares = dict(values.groupBy("i").agg(F.sum(gap * gap * F.col("n"))).collect())
    found = _values_at(values, parts, [_quartile_places(n) for n in counts])
    rows = []
    for i, (name, own, n) in enumerate(zip(columns, parts, counts, strict=True)):
        if n:
            std = (squares[i] / (n - 1)) ** 0.5 if n > 1 else None
            quartiles = [_between(found[i], k * (n - 1), 4) for k in (1, 2, 3)]
            rows.append((name, n, means[i], std, own[0].lo, *quartiles, own[-1].hi))
        else:
            rows.append((name, 0, *[None] * 7))
    return df.sparkSession.createDataFrame(rows, DESCRIBED)


def _quartile_places(n: int) -> list[int]:
    """Places, from 0, of the values that the quartiles of n values lie on or between."""
    return sorted({place for k in (1, 2, 3) if n for place in (k * (n - 1) // 4, -(-k * (n - 1) // 4))})


def _between(at: dict[int, float], numerator: int, denominator: int) -> float:
    place, rest = divmod(numerator, denominator)
    if not rest or at[place] == at[place + 1]:
        return at[place]
    return at[place] + (at[place + 1] - at[place]) * rest / denominator


def _values_at(values: DataFrame, parts: list[list], places: list[list[int]]) -> list[dict[int, float]]:
    """The values at places of the order of each column, read from the ranges that hold them."""
    tests, ranges = [], set()
    for own, wanted in zip(parts, places, strict=True):
        ends = list(accumulate(r.n for r in own))
        for place in wanted:
            held = own[bisect_right(ends, place)]
            inside = place - (ends[bisect_right(ends, place)] - held.n)
            ranges.add(f"(i = {held.i} AND part = {held.part})")
            tests.append((f"i = {held.i} AND part = {held.part} AND upto > {inside} AND upto - n <= {inside}", held.i, place))
    found: list[dict[int, float]] = [{} for _ in parts]
    if tests:
        upto = F.sum("n").over(W.partitionBy("i", "part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
        running = values.where(" OR ".join(sorted(ranges))).select("*", upto.alias("upto"))
        hits = F.expr(f"array({', '.join(f'IF({test}, {k}, NULL)' for k, (test, *_) in enumerate(tests))})")
        for v, k in running.select("v", F.explode(F.array_compact(hits)).alias("k")).collect():
            found[tests[k][1]][tests[k][2]] = v
    return found


def describe_joint(joint: DataFrame, columns: Sequence[str], weight: str = "n") -> DataFrame:
    """The same, lazily, from a table of combinations of values and the rows that have each.

    One task keeps the different values of a column, so this is for columns of few, as counts and lengths of journeys.
    """
    n = F.col(weight)
    mean = lambda c: F.sum(F.col(c) * n).cast("double") / F.sum(F.when(F.col(c).isNotNull(), n))
    # The means enter as a scalar subquery; deviations are taken from them.
    means = joint.agg(F.array(*[mean(c) for c in columns]).alias("m")).scalar()
    centred = joint.withColumn("__m", means)

    def described(i: int, c: str) -> Column:
        gap = F.col(c) - F.get("__m", F.lit(i))
        count = F.coalesce(F.sum(F.when(F.col(c).isNotNull(), n)), F.lit(0))
        return F.struct(
            F.lit(c).alias("column_name"),
            count.alias("count"),
            mean(c).alias("mean"),
            F.when(count > 1, F.sqrt(F.sum(gap * gap * n) / (count - 1))).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n).alias("q"),
            F.max(c).cast("double").alias("max"),
        ).alias(f"c{i}")

    wide = centred.agg(*[described(i, c) for i, c in enumerate(columns)])
    rows = wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))
    quartiles = [F.get("q", k).alias(f"q{25 * (k + 1)}") for k in range(3)]
    return rows.select("column_name", "count", "mean", "std", "min", *quartiles, "max")


def joint_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Different combinations of values, and the rows that have each."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def histogram(
    df: DataFrame, column: str, bins: int, more_than: int | None = None, weight: str | None = None
) -> DataFrame:
    """Equal-width bins of an integer column, empty ones included: bin (1 ...), lo, hi, n.

    The last bin holds its upper end. When all values are equal the range is widened by half a
    unit on either side. ``more_than`` keeps larger values only; with ``weight`` a row stands for so many.
    """
    rows = F.lit(1) if weight is None else F.col(weight)
    values = df.select(F.col(column).cast("bigint").alias("x"), rows.alias("w")).where(F.col("x").isNotNull())
    if more_than is not None:
        values = values.where(F.col("x") > more_than)
    ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where(F.col("lo").isNotNull())
    # The two ends enter as a scalar subquery: one row, no join.
    with_ends = values.select("x", "w", ends.select(F.struct("lo", "hi")).scalar().alias("e"))
    below = F.coalesce(F.expr(f"(x - e.lo) * {bins} div nullif(e.hi - e.lo, 0)"), F.lit(bins // 2))
    counts = with_ends.groupBy(F.least(below + 1, F.lit(bins)).cast("int").alias("bin")).agg(
        F.sum("w").alias("n")
    )
    span = F.col("hi") - F.col("lo")
    lo = F.when(span == 0, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    width = F.when(span == 0, F.lit(1.0)).otherwise(span.cast("double")) / bins
    frame = ends.select(
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), lo.alias("lo"), width.alias("width")
    )
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("lo"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def shape(df: DataFrame, weight: str | None = None, n_columns: int | None = None) -> DataFrame:
    """Numbers of rows and columns; with ``weight`` a row stands for so many."""
    rows = F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    columns = len(df.columns) if n_columns is None else n_columns
    return df.agg(rows.alias("n_rows")).withColumn("n_columns", F.lit(columns).cast("bigint"))


def _by_count(count_col: str, journey_col: str) -> list[Column]:
    return [F.desc(count_col), F.asc(journey_col)]


def top_journeys(
    df: DataFrame, k: int, count_col: str = "counts", journey_col: str = "journey"
) -> DataFrame:
    """The k most frequent journeys; ties by journey."""
    return df.orderBy(*_by_count(count_col, journey_col)).limit(k)


def nth_journey(
    df: DataFrame, position: int, count_col: str = "counts", journey_col: str = "journey"
) -> DataFrame:
    """The journey at a 0-based position of the same order."""
    return df.orderBy(*_by_count(count_col, journey_col)).offset(position).limit(1)


def preview(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First n rows of an order, so that the same rows show every time."""
    return df.orderBy(*order).limit(n)
