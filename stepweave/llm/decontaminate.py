"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the words under its ones are hashed, those under its
zeros are ignored, so a substituted word does not hide a copy. Hashes of the benchmark and of the
documents are joined, and around every hit the two texts are laid over each other, word by word on the
diagonal of the hit, to see how much of them is the same.

The masks are chosen so that no overlap of the rule is missed. A span of 26 words or more of which 80
percent agree falls into two of 13 or more, and one of these agrees as much; so every overlap holds one of
13 to 25 words, and however few words differ in that, one of the masks passes them over (``missed`` counts
the ways in which none does; for rules other than the default, look there before trusting the masks).

Few of the documents' seeds are ever shuffled: a Bloom filter of the benchmark's seeds, whose size is
a parameter and does not follow the data, goes to every task; only what passes is joined. It saves work and
decides nothing. A document with hits takes the words around them along, so its text is read once. The
join tells which stretch meets which item; each two are brought together once, and all diagonals on which
they share a seed are looked at there.

Items of fewer words than an overlap needs count as a whole: all their words are laid over as many of the
document. They have masks of their own, as long as the item: it is cut into a few blocks more than words
may differ, and each mask leaves out as many blocks, so whatever words differ, one mask passes them over
and nothing is missed. Only lengths that the benchmark holds are searched for.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm import text as tx
from stepweave.llm.shared import stored, tidy


@dataclass(frozen=True)
class Seeds:
    """``masks`` of the seeds; an overlap has ``min_words`` words (all, of a shorter item) of which ``percent`` agree."""

    masks: tuple[str, ...] = (
        "11011111",
        "11010100111",
        "1110010010011",
        "11100011011",
        "111010010101",
        "10001110111",
    )
    min_words: int = 13
    percent: int = 80
    filter_bits: int = 25

    @property
    def span(self) -> int:
        return max(map(len, self.masks))

    @property
    def whole(self) -> int:
        """Items of fewer words are compared as a whole."""
        return max(self.min_words, self.span)


BITMAP_BITS = 32_768  # of one bitmap of Spark's bitmap functions


def missed(config: Seeds, n_words: int) -> int:
    """Ways to place as many different words as the rule allows in ``n_words`` so that every mask meets one.

    Overlaps of the rule are all found if this is 0 from ``min_words`` to twice as many less one: longer ones
    hold one of those. Ways with fewer different words are found where these are."""
    differ = n_words * (100 - config.percent) // 100
    places = np.array(list(itertools.combinations(range(n_words), differ)), np.int64)
    ways = (np.int64(1) << places).sum(axis=1, dtype=np.int64)
    for mask in config.masks:
        for shift in range(n_words - len(mask) + 1):
            ways = ways[(ways & (int(mask[::-1], 2) << shift)) != 0]
    return len(ways)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    config: Seeds = Seeds(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that overlap: their best overlap.

    id, item, n_words (of the longest span that meets the rule; its ends may differ), n_equal (words that agree), item_words, start_word and
    start_byte, end_byte in the document. Words are runs of letters and digits, without case. Null or empty
    texts on either side overlap with nothing. Rows of a null id take no part. Repeated rows give one result; of equal overlaps the first place counts. Other
    columns are ignored. Texts are searched whole.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where("item is not null and text is not null")
    seeds = items.mapInArrow(
        lambda batches: _item_seeds(batches, config),
        "item long, item_words array<long>, item_seeds array<long>, item_places array<int>",
    )
    # Rows of one id may hold several texts.
    seeds = stored(seeds.withColumn("item_body", F.xxhash64("item_words")), "seeds")
    short = items.mapInArrow(
        lambda batches: _short_items(batches, config), "item long, seed long, item_words array<long>"
    )
    short = stored(short, "short")
    lengths = sorted(r[0] for r in short.select(F.size("item_words")).distinct().collect())  # fewer than config.whole
    size = 1 << config.filter_bits
    every = seeds.select(F.explode("item_seeds").alias("seed")).union(short.select("seed"))
    bits = every.select(F.explode(F.array(*[F.pmod(F.shiftrightunsigned("seed", k), F.lit(size)) for k in (0, 32)])).alias("bit"))
    # At most size / 32768 rows of 4 KB.
    maps = bits.groupBy(F.floor(F.col("bit") / BITMAP_BITS).alias("k")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("bit"), F.lit(BITMAP_BITS))).alias("map")
    )
    bloom = np.zeros(size // 8, np.uint8)
    for row in maps.toLocalIterator():
        part = np.frombuffer(row["map"], np.uint8)
        bloom[row["k"] * (BITMAP_BITS // 8) :][: len(part)] = part
    longest = seeds.agg(F.max(F.size("item_words"))).head()[0] or 0
    shared = spark.sparkContext.broadcast((bloom, longest))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    segments = rows.where("id is not null and text is not null").mapInArrow(
        lambda batches: _segments(batches, config, *shared.value),
        "id long, at int, words array<long>, starts array<int>, ends array<int>, seeds array<long>, places array<int>",
    )
    segments = stored(segments.withColumn("body", F.xxhash64("words", "starts")), "segments")
    hits = segments.select("id", "at", "body", F.explode(F.array_distinct("seeds")).alias("seed"))
    heads = seeds.select("item", "item_body", F.explode(F.array_distinct("item_seeds")).alias("seed"))
    pairs = hits.join(heads, "seed").select("id", "at", "body", "item", "item_body").distinct()
    pairs = stored(pairs, "pairs")
    laid = pairs.join(segments.dropDuplicates(["id", "at", "body"]), ["id", "at", "body"])
    laid = laid.join(seeds.dropDuplicates(["item", "item_body"]), ["item", "item_body"])
    laid = laid.select(
        "id", "item", "at", "words", "starts", "ends", "seeds", "places", "item_words", "item_seeds", "item_places"
    )
    found = laid.mapInArrow(
        lambda batches: _overlaps(batches, config),
        "id long, item long, n_words int, n_equal int, item_words int, start_word int, start_byte int, end_byte int",
    )
    if lengths:
        places = rows.where("id is not null and text is not null").mapInArrow(
            lambda batches: _short_places(batches, config, lengths, shared.value[0]),
            "id long, seed long, start_word int, start_byte int, end_byte int, words array<long>",
        )
        places = places.join(short, "seed").where("size(words) = size(item_words)")
        same = F.size(F.filter(F.zip_with("words", "item_words", lambda a, b: a == b), lambda x: x)).alias("n_equal")
        n = F.size("item_words")
        places = places.select("id", "item", n.alias("n_words"), same, n.alias("item_words"), "start_word", "start_byte", "end_byte")
        found = found.union(places.where(F.col("n_equal") * 100 >= F.col("n_words") * config.percent))
    order = F.struct("n_equal", (-F.col("start_word")).alias("back"), "n_words", "item_words", "start_byte", "end_byte")
    best = found.groupBy("id", "item").agg(F.max(order).alias("b"))
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        "b.n_words",
        "b.n_equal",
        "b.item_words",
        (-F.col("b.back")).alias("start_word"),
        "b.start_byte",
        "b.end_byte",
    )


def _seed_hashes(found: tx.Words, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash at each word where the mask fits into the document, and those words' indices."""
    n = len(found.hash) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = tx.mix(np.arange(1, len(mask) + 1, dtype=np.uint64) + np.uint64(1000 * (number + 1))) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for k, one in enumerate(mask):
        if one == "1":
            total += found.hash[k : k + n] * factors[k]
    fits = np.flatnonzero(found.doc[:n] == found.doc[len(mask) - 1 :])
    return tx.mix(total[fits]), fits


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def _all_seeds(found: tx.Words, config: Seeds, bloom: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all masks, or of these what passes the filter, in order of their words, and those words' indices."""
    parts = []
    for k, mask in enumerate(config.masks):
        seed, place = _seed_hashes(found, mask, k)
        if bloom is not None:
            ok = _passes(seed, bloom, config)
            seed, place = seed[ok], place[ok]
        parts.append((seed, place))
    seed, place = (np.concatenate([p[side] for p in parts]) for side in (0, 1))
    order = np.argsort(place, kind="stable")
    return seed[order], place[order]


def _item_seeds(batches: Iterator[pa.RecordBatch], config: Seeds) -> Iterator[pa.RecordBatch]:
    """A row per item that is not compared as a whole: its words, its seeds and where they begin."""
    for batch in batches:
        for texts in tx.slices(batch.column("text")):
            found = tx.words(texts, tx.ALNUM)
            seed, place = _all_seeds(found, config)
            doc = found.doc[place]
            long = np.flatnonzero(np.diff(found.bounds) >= config.whole)
            spans = list(zip(np.searchsorted(doc, long), np.searchsorted(doc, long, "right"), strict=True))
            bounds = list(zip(found.bounds[long], found.bounds[long + 1], strict=True))
            hashes = found.hash.view(np.int64)
            ids = batch.column("item").slice(texts.first, len(texts)).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[long]),
                    _lists([hashes[a:b] for a, b in bounds], pa.int64()),
                    _lists([seed[i:j].view(np.int64) for i, j in spans], pa.int64()),
                    _lists([place[i:j] - a for (i, j), (a, _) in zip(spans, bounds, strict=True)], pa.int32()),
                ],
                ["item", "item_words", "item_seeds", "item_places"],
            )


def _whole_seeds(found: tx.Words, n: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask of items of n words: hash at each word where n words fit, and those words' indices."""
    fits = np.flatnonzero(found.doc[: max(len(found.doc) - n + 1, 0)] == found.doc[n - 1 :])
    differ = n * (100 - percent) // 100
    cuts = np.linspace(0, n, min(n, differ + 4) + 1).astype(int)
    factors = tx.mix(np.arange(n, dtype=np.uint64) + np.uint64(1_000_000 * n)) | np.uint64(1)
    blocks = [sum((found.hash[fits + k] * factors[k] for k in range(a, b)), np.zeros(len(fits), np.uint64)) for a, b in itertools.pairwise(cuts)]
    for number, kept in enumerate(itertools.combinations(range(len(blocks)), len(blocks) - differ)):
        total = sum((blocks[k] for k in kept), np.full(len(fits), number + 1, np.uint64))
        yield tx.mix(total), fits


def _short_items(batches: Iterator[pa.RecordBatch], config: Seeds) -> Iterator[pa.RecordBatch]:
    """Seeds of the items that are compared as a whole, with all their words."""
    for batch in batches:
        for texts in tx.slices(batch.column("text")):
            found = tx.words(texts, tx.ALNUM)
            sizes = np.diff(found.bounds)
            ids = batch.column("item").slice(texts.first, len(texts)).to_numpy()
            hashes = found.hash.view(np.int64)
            for n in range(1, config.whole):
                if not (sizes == n).any():
                    continue
                for seed, place in _whole_seeds(found, n, config.percent):
                    own = sizes[found.doc[place]] == n
                    seed, place = seed[own], place[own]
                    words = _lists([hashes[p : p + n] for p in place], pa.int64())
                    columns = [pa.array(ids[found.doc[place]]), pa.array(seed.view(np.int64)), words]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "seed", "item_words"])


def _short_places(
    batches: Iterator[pa.RecordBatch], config: Seeds, lengths: list[int], bloom: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Where a short item may stand; of the same words in a document the first place."""
    names = ["id", "seed", "start_word", "start_byte", "end_byte", "words"]
    for batch in batches:
        for texts in tx.slices(batch.column("text")):
            found = tx.words(texts, tx.ALNUM)
            ids = batch.column("id").slice(texts.first, len(texts)).to_numpy()
            hashes = found.hash.view(np.int64)
            for n in lengths:
                for seed, place in _whole_seeds(found, n, config.percent):
                    ok = _passes(seed, bloom, config)
                    seed, place = seed[ok], place[ok]
                    if not len(seed):
                        continue
                    doc = found.doc[place]
                    windows = np.column_stack([doc, *(hashes[place + k] for k in range(n))])
                    first = np.unique(windows, axis=0, return_index=True)[1]
                    seed, place, doc = seed[first], place[first], doc[first]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[doc]),
                            pa.array(seed.view(np.int64)),
                            pa.array((place - found.bounds[doc]).astype(np.int32)),
                            pa.array((found.start[place] - texts.offsets[doc]).astype(np.int32)),
                            pa.array((found.end[place + n - 1] - texts.offsets[doc]).astype(np.int32)),
                            _lists([hashes[p : p + n] for p in place], pa.int64()),
                        ],
                        names,
                    )


def _passes(seed: np.ndarray, bloom: np.ndarray, config: Seeds) -> np.ndarray:
    bits = np.uint64((1 << config.filter_bits) - 1)
    out = np.ones(len(seed), bool)
    for shift in (0, 32):
        bit = ((seed >> np.uint64(shift)) & bits).astype(np.int64)
        out &= (bloom[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
    return out


@tidy
def _segments(batches: Iterator[pa.RecordBatch], config: Seeds, bloom: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """Runs of words around seeds that pass the filter, as far as an item can reach from there."""
    names = ["id", "at", "words", "starts", "ends", "seeds", "places"]
    for batch in batches:
        for texts in tx.slices(batch.column("text")):
            found = tx.words(texts, tx.ALNUM)
            seed, place = _all_seeds(found, config, bloom)
            if not len(seed):
                continue
            doc = found.doc[place]
            low = np.maximum(place - longest, found.bounds[doc])
            high = np.minimum(place + config.span + longest, found.bounds[doc + 1])
            cut = np.ones(len(place), bool)
            cut[1:] = (doc[1:] != doc[:-1]) | (low[1:] > high[:-1])
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(place)) - 1
            base = texts.offsets[doc[first]]
            bounds = found.bounds[doc[first]]
            ids = batch.column("id").slice(texts.first, len(texts)).to_numpy()
            spans = list(zip(low[first], high[last], base, bounds, first, last + 1, strict=True))
            hashes = found.hash.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[doc[first]]),
                    pa.array((low[first] - bounds).astype(np.int32)),
                    _lists([hashes[a:b] for a, b, *_ in spans], pa.int64()),
                    _lists([found.start[a:b] - o for a, b, o, *_ in spans], pa.int32()),
                    _lists([found.end[a:b] - o for a, b, o, *_ in spans], pa.int32()),
                    _lists([seed[i:j].view(np.int64) for *_, i, j in spans], pa.int64()),
                    _lists([place[i:j] - w for _, _, _, w, i, j in spans], pa.int32()),
                ],
                names,
            )


def best_overlap(equal: np.ndarray, percent: int, min_words: int = 1) -> tuple[int, int]:
    """Of aligned words, the longest span of at least ``min_words`` of which ``percent`` agree, (0, 0) if none does.

    Of equally long ones the one with most equal words, then the first. It is the longest interval whose
    score is not negative, where a different word costs what makes ``percent`` break even."""
    if not len(equal):
        return 0, 0
    score = np.concatenate(([0], np.where(equal, 100 - percent, -percent).cumsum()))
    lowest = np.minimum.accumulate(score)
    # For each end, the first start whose score is not higher: the lows fall, and it is where they get there.
    start = np.searchsorted(-lowest, -score, "left")
    length = np.arange(len(score)) - start
    if length.max() < max(min_words, 1):
        return 0, 0
    ends = np.flatnonzero(length == length.max())
    end = int(ends[(score[ends] - score[start[ends]]).argmax()])
    return int(start[end]), end


def _diagonals(seeds: np.ndarray, places: np.ndarray, item_seeds: np.ndarray, item_places: np.ndarray) -> np.ndarray:
    """Different distances of a seed's place from its place in the item, over all shared seeds, ascending."""
    order = np.argsort(seeds, kind="stable")
    seeds, places = seeds[order], places[order]
    low, high = np.searchsorted(seeds, item_seeds), np.searchsorted(seeds, item_seeds, "right")
    shared = np.flatnonzero(low < high)
    if not len(shared):
        return np.zeros(0, np.int64)
    shift = int(item_places.max()) - int(places.min())
    # A flag per distance: repeated words share seeds in far more ways than there are distances.
    flags = np.zeros(int(places.max()) + shift + 1, bool)
    for k in shared:
        flags[places[low[k] : high[k]] - item_places[k] + shift] = True
    return np.flatnonzero(flags) - shift


def _best(words: np.ndarray, at: int, item: np.ndarray, diagonals: np.ndarray, config: Seeds) -> tuple[int, ...] | None:
    """Over all diagonals the overlap with most equal words, then the first: n_equal, -first, n_words."""
    least = min(config.min_words, len(item))
    best: tuple[int, ...] | None = None
    for diagonal in diagonals:
        shift = int(diagonal) - at
        low, high = max(0, -shift), min(len(item), len(words) - shift)
        equal = words[low + shift : high + shift] == item[low:high]
        total = int(np.count_nonzero(equal))
        if total * 100 < least * config.percent or best and total < best[0]:
            continue
        a, b = best_overlap(equal, config.percent, least)
        if b > a:
            one = (int(np.count_nonzero(equal[a:b])), -(low + shift + a), b - a)
            best = max(best or one, one)
    return best


@tidy
def _overlaps(batches: Iterator[pa.RecordBatch], config: Seeds) -> Iterator[pa.RecordBatch]:
    """Of each stretch and item brought together, their best overlap."""
    names = ["id", "item", "n_words", "n_equal", "item_words", "start_word", "start_byte", "end_byte"]
    kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 6
    lists = ("words", "starts", "ends", "item_words", "seeds", "places", "item_seeds", "item_places")
    for batch in batches:
        out = []
        cols = [batch.column(c) for c in ("id", "item", "at")]
        values = [batch.column(c) for c in lists]
        for row in range(batch.num_rows):
            doc, item, at = (c[row].as_py() for c in cols)
            words, starts, ends, own, *seeds = (c[row].values.to_numpy(zero_copy_only=False) for c in values)
            best = _best(words, at, own, _diagonals(*seeds), config)
            if best:
                equal, first, n = best[0], -best[1], best[2]
                out.append((doc, item, n, equal, len(own), at + first, int(starts[first]), int(ends[first + n - 1])))
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
