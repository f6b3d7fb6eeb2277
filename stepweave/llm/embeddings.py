"""Near-duplicate embeddings by products of int8 tiles with exact error bounds.

Every vector is scaled to length one and quantised to int8 with a scale of its own; the length of what
quantisation lost bounds how far any product with it can be off. Blocks of vectors meet each other once, and within a
task their int8 tiles are multiplied. Only pairs whose product plus bound reaches the threshold are recomputed in
double precision from the full vectors, so no link is lost and none is wrong.

Equal vectors are one vector with a number of copies. Tasks return counts of links per vector and the few links that join
components, never the pairs, so a group of thousands of near copies is no more rows than it has members.

The work is quadratic in the number of different vectors, as the comparison of all with all is; memory is not:
a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.components import components
from stepweave.llm.shared import stored


@dataclass(frozen=True)
class Tiles:
    threshold: float = 0.95
    block: int = 8192
    tile: int = 1024


EXACT_DIMENSIONS = 1024  # sums of so many int8 products are exact in 32-bit floats
ROUNDING = 1e-9  # more than double arithmetic can be off


def link_embeddings(
    vectors: DataFrame, config: Tiles = Tiles(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Two vectors of equally many components are linked if their cosine is at least ``threshold``, which must be above 0. Null and empty vectors,
    zero vectors, and vectors with null or non-finite components link with nothing. Every other row counts as a vector, also
    rows that repeat an id. A row of a null id takes no part: no links, no component, kept. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # A square that overflows or vanishes is left to the task, which scales before it squares.
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    usable = F.col("id").isNotNull() & (F.size("v") > 0) & ~bad & some
    hashed = rows.select(
        "id",
        F.coalesce(usable, F.lit(False)).alias("usable"),
        "v",
        F.xxhash64("v").alias("h1"),
        F.xxhash64(F.lit(1), "v").alias("h2"),
    )
    hashed = stored(hashed, "vectors")
    classes = hashed.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    found = _compare(hashed, classes, config)
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null"))
    own = classes.join(links, F.col("rep") == F.col("a"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    own = own.select(
        "h1",
        "h2",
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    # Vectors that are alone need no row here.
    own = stored(own.where("n_links > 0"), "linked").withColumn("usable", F.lit(True))
    out = hashed.drop("v").join(own, ["h1", "h2", "usable"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _compare(hashed: DataFrame, classes: DataFrame, config: Tiles) -> DataFrame:
    """Links between different vectors, of every two blocks: rows (a, null, number of vectors linked to a) and
    links that join components (a, b, null)."""
    n = classes.count()
    blocks = max(1, -(-n // config.block))
    different = hashed.join(classes, ["h1", "h2"]).where("usable and id = rep").dropDuplicates(["h1", "h2"])
    different = different.select(
        "id", "v", "copies", F.size("v").alias("size"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    )
    packed = different.groupBy("size", "block").applyInArrow(
        _pack, "size int, block long, ids binary, copies binary, codes binary, scales binary, bounds binary, units binary"
    )
    packed = stored(packed, "blocks")
    heads = packed.select("size", F.col("block").alias("x"))
    others = packed.select("size", F.col("block").alias("y"))
    ahead = F.pmod(F.col("y") - F.col("x"), F.lit(blocks))
    # Each pair of blocks once, and as many for one block as for another.
    once = (2 * ahead < blocks) | ((2 * ahead == blocks) & (F.col("x") < F.col("y")))
    pairs = stored(heads.join(others, "size").where(once), "block-pairs")
    left = packed.select("size", F.col("block").alias("x"), *[F.col(c).alias(f"x_{c}") for c in PARTS])
    right = packed.select("size", F.col("block").alias("y"), *[F.col(c).alias(f"y_{c}") for c in PARTS])
    both = pairs.join(right, ["size", "y"]).join(left, ["size", "x"])
    return stored(both.mapInArrow(lambda batches: _tiles(batches, config), "a long, b long, n long"), "links")


PARTS = ("ids", "copies", "codes", "scales", "bounds", "units")


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and bounds on the length of what each vector lost."""
    scales = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scales[:, None]).clip(-127, 127).astype(np.int8)
    lost = units - codes * scales[:, None]
    return codes, scales, np.sqrt((lost * lost).sum(axis=1)) + ROUNDING


def unit_vectors(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    size, block = (k.as_py() for k in key)
    table = table.sort_by("id").combine_chunks()
    flat = table.column("v").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    units = unit_vectors(flat.to_numpy(zero_copy_only=False).reshape(-1, size))
    codes, scales, bounds = quantise(units)
    ids, copies = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "copies"))
    parts = (ids, copies, codes, scales, bounds, units)
    return pa.table(
        {"size": pa.array([size], pa.int32()), "block": pa.array([block], pa.int64())}
        | {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in zip(PARTS, parts, strict=True)}
    )


@dataclass(frozen=True)
class Block:
    ids: np.ndarray
    copies: np.ndarray
    codes: np.ndarray  # int8 values as 32-bit floats
    scales: np.ndarray
    bounds: np.ndarray
    units: np.ndarray


def _block(batch: pa.RecordBatch, side: str, row: int, size: int) -> Block:
    kinds = (np.int64, np.int64, np.int8, np.float64, np.float64, np.float64)
    ids, copies, codes, scales, bounds, units = (
        np.frombuffer(batch.column(f"{side}_{c}")[row].as_buffer(), kind) for c, kind in zip(PARTS, kinds, strict=True)
    )
    return Block(ids, copies, codes.reshape(-1, size).astype(np.float32), scales, bounds, units.reshape(-1, size))


def _tiles(batches: Iterator[pa.RecordBatch], config: Tiles) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            size = batch.column("size")[row].as_py()
            same = batch.column("x")[row].as_py() == batch.column("y")[row].as_py()
            left = _block(batch, "x", row, size)
            right = left if same else _block(batch, "y", row, size)
            a, b = close_pairs(left, right, same, config)
            n = np.zeros(len(left.ids) + (0 if same else len(right.ids)), np.int64)
            shift = 0 if same else len(left.ids)
            np.add.at(n, a, right.copies[b])
            np.add.at(n, b + shift, left.copies[a])
            ids = left.ids if same else np.concatenate((left.ids, right.ids))
            some = np.flatnonzero(n)
            joins = _forest(left.ids[a], right.ids[b])
            none = [None] * len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((ids[some], joins[:, 0]))),
                    pa.array(none + joins[:, 1].tolist(), pa.int64()),
                    pa.array(n[some].tolist() + [None] * len(joins), pa.int64()),
                ],
                ["a", "b", "n"],
            )


def close_pairs(left: Block, right: Block, same: bool, config: Tiles) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose cosine, in double precision, reaches the threshold; each pair once."""
    found_a, found_b = [], []
    step = config.tile
    for i in range(0, len(left.ids), step):
        for j in range(i if same else 0, len(right.ids), step):
            rows, cols = slice(i, i + step), slice(j, j + step)
            product = _product(left.codes[rows], right.codes[cols])
            # First with the largest scale and bound of the tile, then with those of the pair.
            loss = left.bounds[rows] + (1 + left.bounds[rows]) * right.bounds[cols].max()
            least = (config.threshold - loss) / (left.scales[rows] * right.scales[cols].max())
            a, b = np.nonzero(product >= np.minimum(least, 0.999999 * least).astype(np.float32)[:, None])
            if i == j and same:
                a, b = a[a < b], b[a < b]
            a, b, exact = a + i, b + j, product[a, b].astype(np.float64)
            reach = exact * left.scales[a] * right.scales[b] + left.bounds[a] + (1 + left.bounds[a]) * right.bounds[b]
            near = reach + ROUNDING >= config.threshold
            found_a.append(a[near])
            found_b.append(b[near])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 100_000):
        part = slice(at, at + 100_000)
        keep[part] = np.einsum("ij,ij->i", left.units[a[part]], right.units[b[part]]) >= config.threshold
    return a[keep], b[keep]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] <= EXACT_DIMENSIONS:
        return a @ b.T
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMENSIONS):
        out += a[:, at : at + EXACT_DIMENSIONS] @ b[:, at : at + EXACT_DIMENSIONS].T
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As few of the links as join the same components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[x] = y
            out.append((i, j))
    return np.array(out, np.int64).reshape(-1, 2)
