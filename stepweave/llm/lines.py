"""Removal of lines that many sites share.

Every line is known by a hash. Lines that two sites share at all are found with a minimum and a maximum. Their spread is
estimated with a HyperLogLog sketch of the sites per line, which Spark builds in each task and merges in the
aggregation, so a line that stands everywhere costs a sketch and not a set. Where the estimate is too near the
threshold to tell, the sites are counted exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.shared import stored


@dataclass(frozen=True)
class Spread:
    """Lines of at least ``sites`` sites go. ``log_size`` is the sketch's; estimates within ``deviations`` standard
    errors, and at least one, of the threshold are counted exactly."""

    sites: int = 10
    log_size: int = 12
    deviations: float = 6.0

    @property
    def margin(self) -> float:
        return max(1.0, self.deviations * 1.04 / math.sqrt(2**self.log_size) * self.sites)


KEY = ["h1", "h2"]
AROUND = " \t\r"  # not part of a line that is compared


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def widespread(lines: DataFrame, config: Spread) -> DataFrame:
    """Hashes of the lines (h1, h2, site) that stand on enough sites. Null sites don't count."""
    shared = lines.groupBy(*KEY).agg(F.min("site").alias("x"), F.max("site").alias("y")).where("x <> y" if config.sites > 1 else "x is not null")
    shared = stored(shared.select(*KEY), "shared")
    seen = stored(lines.join(shared, KEY).select(*KEY, "site"), "seen")
    spread = seen.groupBy(*KEY).agg(F.hll_sketch_agg("site", F.lit(config.log_size)).alias("sketch"))
    spread = stored(spread.select(*KEY, F.hll_sketch_estimate("sketch").alias("estimate")), "spread")
    sure = spread.where(F.col("estimate") > config.sites + config.margin).select(*KEY)
    near = spread.where(F.abs(F.col("estimate") - config.sites) <= config.margin).select(*KEY)
    exact = seen.join(near, KEY).where("site is not null").distinct().groupBy(*KEY).count()
    return sure.union(exact.where(F.col("count") >= config.sites).select(*KEY))


def remove_lines(
    docs: DataFrame,
    config: Spread = Spread(),
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """One row per document: id, n_lines, n_removed, text without the lines that enough sites share.

    Lines end with a newline and are compared without spaces, tabs and carriage returns around them; lines of nothing else
    are never removed. Null texts stay null and have no lines; an empty text has one. Rows of a null
    id count for the spread but are kept whole. An id stands for one text; repeated rows give a row each. Other columns are
    ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(site_col).cast("string").alias("site")
    )
    line = F.trim("line", F.lit(AROUND))
    lines = rows.select("id", "site", F.posexplode(_lines(F.col("text"))).alias("at", "line")).where(line != "")
    # Two hashes of 64 bits: one would meet another by chance among many billions of lines.
    lines = lines.select("id", "site", "at", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))
    lines = stored(lines, "lines")
    gone = stored(widespread(lines, config), "widespread")
    removed = lines.where("id is not null").join(gone, KEY).groupBy("id").agg(F.collect_set("at").alias("removed"))
    all_lines = _lines(F.col("text"))
    none = F.array().cast("array<int>")
    out = rows.join(removed, "id", "left").withColumn("removed", F.coalesce("removed", none))
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "removed")
    # The lines are split once; the expression is only reached for documents that lose some.
    text = F.when(
        F.size("removed") > 0,
        F.array_join(F.transform(kept, lambda p: F.get(F.col("all_lines"), p)), "\n"),
    ).otherwise(F.col("text"))
    out = out.withColumn("all_lines", all_lines)
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("all_lines")).alias("n_lines"),
        F.size("removed").alias("n_removed"),
        text.alias("text"),
    )
