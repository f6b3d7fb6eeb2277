"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct n-word shingles. Every hash function gives two signature values,
its minimum and its maximum over the set, each of which two documents share with a probability equal
to their Jaccard similarity. Values are banded; documents with a band in common are candidates, and a
candidate pair is a link only if the full sets say so.

No bucket is ever expanded into all its pairs, however many copies meet in it:

1. Documents with equal sets form a class, stood for by its smallest id.
2. In each bucket all members are compared with one leader, in a few rounds with other leaders.
   What is linked so far is contracted to components after every round.
3. What still meets in a bucket without being of one component is put into blocks of bounded size, and the
   full sets of every two blocks are compared as a product of matrices, within a task that returns
   only links that join components. No candidate is left out and none becomes a row.

Only components are returned, so pairs inside one component need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm import text as tx
from stepweave.llm.components import components
from stepweave.llm.shared import stored, tidy


@dataclass(frozen=True)
class MinMax:
    """``hashes`` functions give 2 * hashes values, in bands of ``rows``.

    At a similarity of 0.8 a pair shares one of the 24 bands of 4 with probability 1 - 3e-6.
    """

    words: int = 5
    percent: int = 80
    hashes: int = 48
    rows: int = 4
    leader_rounds: int = 2
    block: int = 512
    block_shingles: int = 200_000


SIGNED = "id long, n_shingles long, set_a long, set_b long, bands array<long>"


def near_duplicates(
    docs: DataFrame, config: MinMax = MinMax(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents with ``100 * intersection >= percent * union`` are linked; ``component_id`` is the
    smallest id reachable and ``kept`` marks the document of that id. Null and empty texts and texts
    without a word have the empty set and link with nothing. Fewer than n words are one shingle.
    Repeated rows of an id give a row each; an id should have one text, else one of them stands for it.
    A row whose id is null links with nothing, has no component and is kept. Other columns are
    ignored. Shingles are compared by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(rows.mapInArrow(lambda batches: _sign(batches, config), SIGNED), "signed")
    full = signed.where("id is not null and n_shingles > 0")
    key = ["set_a", "set_b", "n_shingles"]
    classes = stored(full.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    linked = _links(rows, full.join(classes, key).where("id = rep").dropDuplicates(["rep"]), config)
    component = classes.join(components(linked), F.col("rep") == F.col("node"), "left")
    component = component.select(*key, F.coalesce("component", "rep").alias("component_id"), "n")
    moved = stored(component.join(classes.select(*key, "rep"), key).where("n > 1 or component_id <> rep"), "moved")
    found = signed.drop("bands").join(moved.select(*key, "component_id"), key, "left")
    of = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(
        F.col("id").alias(id_col),
        "n_shingles",
        of.alias("component_id"),
        F.coalesce(of == F.col("id"), F.lit(True)).alias("kept"),
    )


def _links(rows: DataFrame, reps: DataFrame, config: MinMax) -> DataFrame:
    """Links between class representatives that join all documents of a component: a, b."""
    buckets = reps.select("rep", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    busy = stored(buckets.groupBy("bucket").count().where("count > 1").select("bucket"), "busy")
    members = stored(buckets.join(busy, "bucket").withColumn("at", F.col("rep")), "members")
    texts = rows.join(members.select(F.col("rep").alias("id")).distinct(), "id").dropDuplicates(["id"])
    texts = stored(texts, "texts")
    links = stored(members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0), "links")
    checked = links

    def compare(pairs: DataFrame) -> None:
        """Verify new candidate pairs, contract what is linked, keep buckets of several components."""
        nonlocal members, links, checked
        small, large = F.least("size", "other_size"), F.greatest("size", "other_size")
        pairs = pairs.where(100 * small >= config.percent * large)
        pairs = pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
        pairs = stored(pairs.distinct().join(checked, ["a", "b"], "left_anti"), "pairs")
        checked = checked.union(pairs)
        new = stored(_confirm(pairs, texts, config), "links")
        links = links.union(new)
        if new.isEmpty():
            return
        at = components(links).select(F.col("node").alias("rep"), "component")
        moved = members.join(at, "rep", "left").withColumn("at", F.coalesce("component", "rep"))
        moved = stored(moved.select("bucket", "rep", "size", "at"), "members")
        mixed = moved.groupBy("bucket").agg(F.min("at").alias("x"), F.max("at").alias("y")).where("x <> y")
        members = stored(moved.join(stored(mixed.select("bucket"), "mixed"), "bucket"), "members")

    for k in range(config.leader_rounds):
        order = F.struct(F.xxhash64("rep", F.lit(k)) if k else F.lit(0), "rep", "size", "at")
        leader = members.groupBy("bucket").agg(F.min(order).alias("l"))
        leader = leader.select(
            "bucket",
            F.col("l.rep").alias("other"),
            F.col("l.size").alias("other_size"),
            F.col("l.at").alias("other_at"),
        )
        compare(members.join(stored(leader, "leaders"), "bucket").where("at <> other_at"))
        if members.isEmpty():
            return links
    return links.union(_rest(members, texts, config))


def _rest(members: DataFrame, texts: DataFrame, config: MinMax) -> DataFrame:
    """Links between different components of members that meet in a bucket, compared block by block.

    A group is what hangs together by buckets. Its members are dealt to blocks by hash; those of a component
    that fills blocks of its own stand apart, so that they need not meet each other.
    """
    first = stored(members.groupBy("bucket").agg(F.min("rep").alias("first")), "first")
    group = components(members.join(first, "bucket").select("rep", "first"), "rep", "first")
    rest = members.select("rep", "size", "at").distinct().join(group.withColumnRenamed("node", "rep"), "rep")
    rest = stored(rest.withColumnRenamed("component", "s"), "rest")

    def blocks_of(n: str, size: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / config.block), F.ceil(F.col(size) / config.block_shingles))

    by_at = rest.groupBy("s", "at").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    by_at = by_at.withColumn("k", blocks_of("n", "m")).withColumn("solo", F.when(F.col("k") > 1, F.col("at")))
    small = by_at.where("solo is null").groupBy("s").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    small = small.select("s", blocks_of("n", "m").alias("k_small"))
    k = F.when(F.col("k") > 1, F.col("k")).otherwise(F.col("k_small"))
    plan = stored(by_at.join(small, "s", "left").select("s", "at", "solo", k.alias("k")), "plan")
    chunk = F.concat_ws(":", F.coalesce("solo", F.lit(-1)), F.pmod(F.xxhash64("rep"), F.col("k")))
    placed = rest.join(plan, ["s", "at"]).select("rep", "s", "at", "solo", chunk.alias("chunk"))
    sets = texts.join(placed, F.col("id") == F.col("rep")).select("rep", "s", "at", "solo", "chunk", "text")
    sets = sets.mapInArrow(
        lambda batches: _packed(batches, config), "rep long, s long, at long, solo long, chunk string, shingles binary"
    )
    blocks = sets.groupBy("s", "chunk", "solo").agg(F.collect_list(F.struct("rep", "at", "shingles")).alias("rows"))
    blocks = stored(blocks, "blocks")
    heads = blocks.select("s", F.col("chunk").alias("chunk_a"), F.col("solo").alias("solo_a"))
    other = blocks.select("s", F.col("chunk").alias("chunk_b"), F.col("solo").alias("solo_b"))
    pairs = heads.join(other, "s").where("chunk_a <= chunk_b and coalesce(solo_a <> solo_b, true)")
    pairs = stored(pairs.select("s", "chunk_a", "chunk_b"), "block-pairs")
    a = blocks.select("s", F.col("chunk").alias("chunk_a"), F.col("rows").alias("rows_a"))
    b = blocks.select("s", F.col("chunk").alias("chunk_b"), F.col("rows").alias("rows_b"))
    laid = pairs.join(a, ["s", "chunk_a"]).join(b, ["s", "chunk_b"]).select("rows_a", "rows_b")
    return stored(laid.mapInArrow(lambda batches: _joining(batches, config), "a long, b long"), "links")


@tidy
def _packed(batches: Iterator[pa.RecordBatch], config: MinMax) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = pa.array([x.tobytes() for x in _sets(batch.column("text"), config)], pa.binary())
        kept = batch.select([c for c in batch.schema.names if c != "text"])
        yield kept.append_column("shingles", packed)


COLUMNS = 16_384  # shingles of a matrix product


@tidy
def _joining(batches: Iterator[pa.RecordBatch], config: MinMax) -> Iterator[pa.RecordBatch]:
    """Of two blocks, links that join different components, as few as it takes."""
    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in range(batch.num_rows):
            sides = []
            for name in ("rows_a", "rows_b"):
                rows = batch.column(name)[row].values
                packed = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("shingles")]
                sides.append((rows.field("rep").to_numpy(), rows.field("at").to_numpy(), packed))
            found += _join_blocks(*sides, config)
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _join_blocks(left: tuple, right: tuple, config: MinMax) -> list[tuple[int, int]]:
    (rep_a, at_a, sets_a), (rep_b, at_b, sets_b) = left, right
    both = _intersections(sets_a, sets_b)
    sizes_a, sizes_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    close = 100 * both >= config.percent * (sizes_a[:, None] + sizes_b - both)
    close &= at_a[:, None] != at_b
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in np.argwhere(close).tolist():
        x, y = find(int(at_a[i])), find(int(at_b[j]))
        if x != y:
            root[x] = y
            out.append((int(rep_a[i]), int(rep_b[j])))
    return out


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: membership matrices over the common shingles, a range of columns at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    places = []
    for flat, sets in ((flat_a, a), (flat_b, b)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, flat)
        at[at == len(common)] = 0
        known = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[known], kind="stable")
        places.append((row[known][order], at[known][order]))
    for start in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - start)
        matrices = []
        for (row, at), n in zip(places, (len(a), len(b)), strict=True):
            low, high = np.searchsorted(at, (start, start + width))
            dense = np.zeros((n, width), np.float32)
            dense[row[low:high], at[low:high] - start] = 1
            matrices.append(dense)
        out += matrices[0] @ matrices[1].T
    return out.astype(np.int64)


def _confirm(pairs: DataFrame, texts: DataFrame, config: MinMax) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda batches: _similar(batches, config), "a long, b long")


def _sets(column: pa.Array, config: MinMax) -> list[np.ndarray]:
    out = []
    for texts in tx.slices(column):
        values, bounds = tx.shingles(tx.words(texts), config.words)
        out += [values[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


@tidy
def _similar(batches: Iterator[pa.RecordBatch], config: MinMax) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        pairs = zip(_sets(batch.column("text_a"), config), _sets(batch.column("text_b"), config), strict=True)
        for k, (x, y) in enumerate(pairs):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[k] = 100 * both >= config.percent * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


@tidy
def _sign(batches: Iterator[pa.RecordBatch], config: MinMax) -> Iterator[pa.RecordBatch]:
    random = np.random.Generator(np.random.PCG64(7))
    factors = random.integers(1, 2**63, config.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n_bands = 2 * config.hashes // config.rows
    weights = tx.mix(np.arange(1, config.rows + 1, dtype=np.uint64))
    for batch in batches:
        sizes, sets, bands = [], [], []
        for texts in tx.slices(batch.column("text")):
            values, bounds = tx.shingles(tx.words(texts), config.words)
            size = np.diff(bounds)
            filled = size > 0
            at = bounds[:-1][filled]
            summed = np.zeros((len(texts), 2), np.uint64)
            band = np.zeros((len(texts), n_bands), np.uint64)
            if len(at):
                for c in range(2):
                    summed[filled, c] = np.add.reduceat(tx.mix(values + np.uint64(c + 1)), at)
                signature = np.empty((len(at), 2 * config.hashes), np.uint64)
                for k, factor in enumerate(factors):
                    value = values * factor
                    value ^= value >> np.uint64(32)
                    np.minimum.reduceat(value, at, out=signature[:, 2 * k])
                    np.maximum.reduceat(value, at, out=signature[:, 2 * k + 1])
                parts = tx.mix(signature[:, : n_bands * config.rows]).reshape(len(at), n_bands, config.rows)
                numbers = tx.mix(np.arange(n_bands, dtype=np.uint64) + np.uint64(99))
                band[filled] = tx.mix((parts * weights).sum(axis=2, dtype=np.uint64) + numbers)
            sizes.append(size)
            sets.append(summed)
            bands.append(band)
        if not sizes:
            continue
        summed, band = np.concatenate(sets).view(np.int64), np.concatenate(bands).view(np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, band.size + 1, n_bands, dtype=np.int32)), pa.array(band.reshape(-1))
        )
        columns = [batch.column("id"), pa.array(np.concatenate(sizes).astype(np.int64))]
        columns += [pa.array(summed[:, 0].copy()), pa.array(summed[:, 1].copy()), lists]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_a", "set_b", "bands"])
