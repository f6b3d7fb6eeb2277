"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes.

The tree has levels domain, language and source. A token budget is divided from the root down: the
children of a node share its budget in proportion to their weights, none gets more than its subtree
can give, and what one cannot use goes to its siblings first. Only what a whole subtree cannot use is
left to its parent's siblings. Leaves give ``epochs`` times their tokens at most.

Each leaf is read in epochs. An epoch orders the leaf by a hash of seed, epoch and document. Full epochs
take every document; the last one takes the longest prefix that fits. The prefix is found with sums
over ranges of the hash, so no task ever orders a whole leaf, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepweave.llm.shared import stored

LEVELS = ("domain", "lang", "source")
DIGITS = 3  # hash digits of a range: 4096 ranges a level


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by level and name (1 for others), budget in percent of all tokens."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    percent: int = 100
    epochs: int = 2
    seed: str = "0"


def words(text: Column) -> Column:
    """Words between ASCII white space; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(config: Mix, level: str) -> Column:
    known = config.weights.get(level, {})
    if any(w < 0 for w in known.values()):
        raise ValueError("weights must not be negative")
    out = F.lit(1)
    for name, weight in known.items():
        out = F.when(F.col(level) == F.lit(name), F.lit(weight)).otherwise(out)
    return out.cast("decimal(12,0)")


def _divide(children: DataFrame, parents: Sequence[str], level: str, config: Mix) -> DataFrame:
    """Divide ``budget`` of each parent over its children up to ``capacity``: adds ``share``.

    In the order of capacity per weight, a child is filled if the rest, divided by the weights still to come,
    reaches its capacity; the others share what is left in proportion, rounded down.
    """
    amount = lambda c: F.col(c).cast("decimal(20,0)")
    rows = children.withColumn("w", _weight(config, level))
    ratio = F.when(F.col("w") == 0, F.lit(float("inf"))).otherwise(F.col("capacity").cast("double") / F.col("w").cast("double"))
    rows = rows.withColumn("ratio", ratio)
    order = W.partitionBy(*parents).orderBy("ratio", level)
    ahead, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("filled", F.coalesce(F.sum("capacity").over(ahead), F.lit(0)))
    rows = rows.withColumn("to_come", F.sum("w").over(rest).cast("decimal(12,0)"))
    full = (F.col("w") > 0) & (amount("capacity") * F.col("to_come") <= (amount("budget") - amount("filled")).cast("decimal(20,0)") * F.col("w"))
    rows = rows.withColumn("full", full)
    group = W.partitionBy(*parents)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0))
    open_w = F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(group), F.lit(0)).cast("decimal(12,0)")
    rows = rows.withColumn("left_over", (F.col("budget") - taken).cast("decimal(20,0)")).withColumn("open_w", open_w)
    part = F.expr("case when w = 0 or open_w = 0 then 0 else (left_over * w) div open_w end")
    share = F.when(F.col("full"), F.col("capacity")).otherwise(F.least(part, F.col("capacity")))
    return rows.withColumn("share", share.cast("long")).drop(
        "w", "ratio", "filled", "to_come", "full", "left_over", "open_w"
    )


def budgets(leaves: DataFrame, config: Mix) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``budget``. The tree has as many rows as leaves, not documents."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * config.epochs)
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {int(config.percent)} div 100").alias("budget"))
    above: DataFrame = total
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        nodes = leaves.groupBy(*parents, level).agg(F.sum("capacity").alias("capacity"))
        if parents:
            nodes = nodes.join(above, parents)
        else:  # one row: a scalar beside every domain
            nodes = nodes.withColumn("budget", F.lit(total.head()["budget"]))
        above = _divide(nodes, parents, level, config).select(*parents, level, F.col("share").alias("budget"))
    return above


def mix(
    docs: DataFrame,
    config: Mix,
    domain: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """One row per document and epoch that it is taken in: id, domain, lang, source, epoch, n_tokens.

    Null domains, languages and sources are nodes named by an empty text. Tokens are words; null and empty
    texts have none and are taken where they fall within the prefix. Rows of a repeated id stand
    next to each other, ordered by text; rows equal in both are interchangeable, each counts. A row of
    a null id stands where its text's digest puts it. An empty table gives no rows. Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        words(text).alias("n_tokens"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"),
    )
    rows = stored(rows, "sized")
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = budgets(leaves, config).join(leaves, list(LEVELS))
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    plan = plan.withColumn("full_epochs", full.cast("int"))
    plan = stored(plan.withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens")), "plan")
    placed = rows.join(plan.select(*LEVELS, "full_epochs", "rest"), list(LEVELS))
    out = ["id", *LEVELS, "epoch", "n_tokens"]
    whole = placed.where("full_epochs > 0").withColumn("epoch", F.explode(F.expr("sequence(0, full_epochs - 1)")))
    part = placed.where(F.col("full_epochs") < config.epochs).withColumn("epoch", F.col("full_epochs"))
    named = F.coalesce(F.col("id").cast("string"), F.col("digest"))  # rows without an id spread by their text
    name = F.concat_ws(":", F.lit(config.seed), F.col("epoch").cast("string"), named)
    part = part.withColumn("order", F.md5(name.cast("binary"))).withColumn("before", F.lit(0).cast("long"))
    taken, edge = [whole.select(*out)], part
    for level in range(2):
        edge = edge.withColumn("range", F.substring("order", 1 + level * DIGITS, DIGITS))
        inside, edge = _split(edge)
        taken.append(inside.select(*out))
    last = W.partitionBy(*LEVELS).orderBy("order", "digest").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("n_tokens").over(last))
    taken.append(edge.where("upto <= rest").select(*out))
    result = taken[0]
    for more in taken[1:]:
        result = result.union(more)
    return result.withColumnRenamed("id", id_col)


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of hash ranges that fit as a whole, and those of the range in which a leaf's budget ends."""
    sums = rows.groupBy(*LEVELS, "range").agg(
        F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("before")
    )
    upto = W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, 0)  # 4096 rows at most
    sums = sums.withColumn("upto", F.col("before") + F.sum("size").over(upto))
    sums = sums.select(*LEVELS, "range", F.col("upto") - F.col("size"), "upto", "rest").toDF(
        *LEVELS, "range", "ahead", "upto", "limit"
    )
    sums = stored(sums.where("ahead <= limit"), "ranges")
    joined = rows.drop("before").join(sums, [*LEVELS, "range"])
    inside = joined.where("upto <= limit")
    edge = joined.where("upto > limit").withColumn("before", F.col("ahead"))
    return inside, edge.drop("range", "ahead", "upto", "limit")
