"""Repeated passages by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A window is any string of ``length`` bytes. It is a repeat if it also starts in a document of a smaller
id. Windows are dealt out so that equal ones meet: the smallest hash of a window's k-grams is its anchor, and
neighbouring windows of one anchor form a run whose bytes, its context, travel together.

1. A window reaches ``(length - gram) / 2`` bytes beyond its anchor to the left or to the right. So for each run
   the anchor so extended to both sides is counted by a short hash, which tells what a single document holds. A
   filter of fixed size of the others goes to every task; it saves work and decides nothing.
2. Contexts of runs that pass are shuffled by anchor: those of a slice and bucket compressed together, equal ones
   once, with the places (ids and bytes) that have them.
3. Equal windows have one anchor, so a context that is the only one of its anchor is left as it is. Each task joins
   the others to one text and builds its Burrows-Wheeler transform. Starting with the intervals of single bytes, all intervals are extended backward by one byte, breadth first, level by level. A boundary that
   appears at level l is a common prefix of l - 1 bytes, so common prefixes come out by increasing value; an interval
   of one suffix is dropped, and the expansion stops at ``length``: what is left are the sets of equal windows.
4. The smallest id of each set goes to the places that have the context, and each document unites its repeats.

A passage that very many documents share is one context for every 4 MB of text in step 3. Its places, some five
bytes each, stay compressed; those of one part after the other become spans. Contexts are told apart by 96 bits of
hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm import text as tx

BITMAP_BITS = 32_768
SPAN_BITS = 16
SEPARATOR = 255  # a byte that UTF-8 never has


@dataclass(frozen=True)
class Repeats:
    """Windows of ``length`` bytes, anchors of ``gram``; runs are cut at ``run`` windows.

    ``bucket_bytes`` of documents make one bucket of contexts, a small part of which is left after step 1; contexts
    of ``sorted_bytes``, or of one anchor, are sorted at a time.
    """

    length: int = 50
    gram: int = 16
    run: int = 128
    bucket_bytes: int = 6_000_000
    sorted_bytes: int = 3_000_000
    filter_bits: int = 27


@dataclass
class Runs:
    doc: np.ndarray  # document within the slice
    start: np.ndarray  # byte within the slice
    size: np.ndarray  # windows
    anchor: np.ndarray
    context: np.ndarray
    left: np.ndarray  # hashes of the extended anchors; 0 where the run has no such window
    right: np.ndarray
    free: np.ndarray  # runs that hold their anchor more than once are not filtered
    more: tuple[np.ndarray, np.ndarray]  # documents and hashes of the extended anchors of those


def runs(texts: tx.Texts, config: Repeats) -> Runs:
    """The runs of a slice: every window of every document is in exactly one."""
    n, length, gram = len(texts.data), config.length, config.gram
    none = np.zeros(0, np.int64)
    if n < length:
        return Runs(none, none, none, *[none.view(np.uint64)] * 4, none > 0, (none, none.view(np.uint64)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tx._BYTE_VALUES[texts.data] * tx._power_table(tx._BASE, n), out=sums[1:])
    inverse = tx._power_table(tx._BASE_INVERSE, n + 1)
    grams = sums[gram:] - sums[:-gram]
    grams *= inverse[: n - gram + 1]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    width, least, reach = length - gram + 1, grams, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: n - length + 1], least[width - reach :][: n - length + 1])
    sizes = np.diff(texts.offsets)
    valid = np.zeros(n - length + 1, bool)
    fits = np.flatnonzero(sizes >= length)
    edge = np.zeros(n - length + 2, np.int64)
    np.add.at(edge, texts.offsets[fits], 1)
    np.add.at(edge, texts.offsets[fits + 1] - length + 1, -1)
    np.greater(edge.cumsum()[:-1], 0, out=valid)
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first[texts.offsets[fits]] = True
    start = np.flatnonzero(first)
    if not len(start):
        return Runs(none, none, none, *[none.view(np.uint64)] * 4, none > 0, (none, none.view(np.uint64)))
    doc = np.searchsorted(texts.offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], n), texts.offsets[doc + 1] - length + 1)
    parts = -(-(end - start) // config.run)
    if parts.max() > 1:
        offset = tx.within(parts) * config.run
        last = np.repeat(end, parts)
        start, doc = np.repeat(start, parts) + offset, np.repeat(doc, parts)
        end = np.minimum(start + config.run, last)
    stop = end + length - 1
    context = tx.mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    anchor = least[start]
    first = _place(grams, anchor, start, 1, width)
    free = first != _place(grams, anchor, end + width - 2, -1, width)
    reach = -(-(length - gram) // 2)

    def side(at: np.ndarray, run: np.ndarray, right: bool) -> np.ndarray:
        has = (stop[run] - at >= gram + reach) if right else (at - start[run] >= reach)
        a, b = (at[has], at[has] + gram + reach) if right else (at[has] - reach, at[has] + gram)
        out = np.zeros(len(at), np.uint64)
        out[has] = tx.mix((sums[b] - sums[a]) * inverse[a] + np.uint64(1 + right)) | np.uint64(1)
        return out

    every = np.arange(len(start))
    left, right = (np.where(free, np.uint64(0), side(first, every, x)) for x in (False, True))
    several, found = np.flatnonzero(free), [(none, none)]
    for step in range(int((end - start)[several].max(initial=0)) + width - 1):
        several = several[start[several] + step <= end[several] + width - 2]
        here = several[grams[start[several] + step] == anchor[several]]
        found.append((here, start[here] + step))
    run, at = (np.concatenate(x) for x in zip(*found, strict=True))
    more = np.tile(doc[run], 2), np.concatenate([side(at, run, x) for x in (False, True)])
    return Runs(doc, start, end - start, anchor, context, left, right, free, more)


def _place(grams: np.ndarray, anchor: np.ndarray, at: np.ndarray, step: int, width: int) -> np.ndarray:
    """The first place of each run's anchor from its first window on, or from its last one back."""
    place, left = at.copy(), np.arange(len(at))
    for _ in range(width):
        left = left[grams[place[left]] != anchor[left]]
        if not len(left):
            break
        place[left] += step
    return place


def _short(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(32)).astype("<u4")


def _bits(values: np.ndarray, bucket: np.ndarray, config: Repeats) -> np.ndarray:
    mixed = tx.mix(values.astype(np.uint64) + (bucket.astype(np.uint64) << np.uint64(32)))
    return (mixed & np.uint64((1 << config.filter_bits) - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], buckets: int, config: Repeats) -> Iterator[pa.RecordBatch]:
    """Short hashes of extended anchors by bucket, each at most twice a slice: once for each document."""
    for batch in batches:
        for texts in tx.slices(batch.column("text"), 2 * tx.SLICE_BYTES):
            runs_found = list(_in_parts(texts, config))
            doc = np.concatenate([x for r in runs_found for x in (r.doc, r.doc, r.more[0])])
            anchor = np.concatenate([x for r in runs_found for x in (r.left, r.right, r.more[1])])
            doc, anchor = doc[anchor > 0], anchor[anchor > 0]
            order = np.lexsort((doc, anchor))
            doc, anchor = doc[order], anchor[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            anchor = anchor[fresh]
            keep = np.ones(len(anchor), bool)
            keep[2:] = anchor[2:] != anchor[:-2]
            anchor = anchor[keep]
            bucket = (anchor % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, short = bucket[order], _short(anchor[order])
            at = np.flatnonzero(np.concatenate((bucket[:1] >= 0, bucket[1:] != bucket[:-1])))
            ends = np.append(at[1:], len(bucket))
            packed = [_pack(np.diff(short[a:b], prepend=short.dtype.type(0))) for a, b in zip(at, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(packed, pa.binary())], ["bucket", "packed"])


def _in_parts(texts: tx.Texts, config: Repeats) -> Iterator[Runs]:
    """The runs of a large slice, found in pieces that suit the processor's cache."""
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(texts.offsets, texts.offsets[at] + 1_000_000, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        own = texts.offsets[at : end + 1]
        piece = runs(tx.Texts(0, texts.data[own[0] : own[-1]], own - own[0]), config)
        piece.doc, piece.start, piece.more = piece.doc + at, piece.start + own[0], (piece.more[0] + at, piece.more[1])
        yield piece
        at = end


def _passes(value: np.ndarray, buckets: int, bloom: np.ndarray, config: Repeats) -> np.ndarray:
    bit = _bits(_short(value), (value % np.uint64(buckets)).astype(np.int64), config)
    return ((bloom[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0) & (value > 0)


def _repeated(key: tuple, table: pa.Table, config: Repeats) -> pa.Table:
    """Filter bits of the short hashes that a bucket holds twice."""
    packed = [np.cumsum(_unpack(x.as_buffer(), "<u4")[0], dtype=np.uint32) for x in table.column("packed")]
    short = np.sort(np.concatenate(packed))
    twice = np.unique(short[1:][short[1:] == short[:-1]])
    bucket = np.full(len(twice), key[0].as_py(), np.int64)
    return pa.table({"bit": np.unique(_bits(twice, bucket, config))})


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as compressed planes of their first bytes, second bytes and so on, after their sizes."""
    planes = [x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in columns]
    sizes = np.array([sum(map(len, planes)), *map(len, columns)], "<i8")
    return sizes.tobytes() + pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpack(raw: pa.Buffer, *kinds: str) -> list[np.ndarray]:
    head = 8 * (len(kinds) + 1)
    total, *sizes = np.frombuffer(raw[:head], "<i8").tolist()
    planes, at, columns = np.frombuffer(pa.decompress(raw[head:], total, "zstd"), np.uint8), 0, []
    for kind, n in zip(map(np.dtype, kinds), sizes, strict=True):
        end = at + n * kind.itemsize
        columns.append(np.ascontiguousarray(planes[at:end].reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at = end
    return columns


#: Of each context: short hash, hash, windows, places; of each place: id and byte; then the bytes of the contexts.
PARTS = ("<u4", "<u8", "<u2", "<u4", "<i8", "<i4", "u1")


def _contexts(
    batches: Iterator[pa.RecordBatch], buckets: int, bloom: np.ndarray, config: Repeats
) -> Iterator[pa.RecordBatch]:
    """What passes the filter, of a slice and bucket: each context once, and its places in the order of ids."""
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for texts in tx.slices(batch.column("text"), 2 * tx.SLICE_BYTES):
            found = []
            for r in _in_parts(texts, config):
                bucket = (r.anchor % np.uint64(buckets)).astype(np.int64)
                sides = [_passes(x, buckets, bloom, config) for x in (r.left, r.right)]
                ok = np.flatnonzero(sides[0] | sides[1] | r.free)
                found.append((bucket[ok], _short(r.anchor[ok]), r.context[ok], r.doc[ok], r.start[ok], r.size[ok]))
            bucket, short, context, doc, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(bucket):
                continue
            own, at = ids[texts.first + doc], (start - texts.offsets[doc]).astype("<i4")
            order = np.lexsort((own, context, (bucket.astype(np.uint64) << np.uint64(32)) | short))
            bucket, short, context, own, at = (x[order] for x in (bucket, short, context, own, at))
            opens = np.ones(len(order), bool)
            opens[1:] = (context[1:] != context[:-1]) | (short[1:] != short[:-1]) | (bucket[1:] != bucket[:-1])
            first = np.flatnonzero(opens)
            begin, size = start[order[first]], size[order[first]]
            length = size + config.length - 1
            raw = texts.data[np.repeat(begin, length) + tx.within(length)]
            ends = np.concatenate(([0], np.cumsum(length)))
            bucket, short, context, places = bucket[first], short[first], context[first], np.diff(first, append=len(order))
            first = np.append(first, len(order))
            heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            packed = [
                _pack(
                    *(short[a:b], context[a:b], size[a:b].astype("<u2"), places[a:b].astype("<u4")),
                    *(own[first[a] : first[b]], at[first[a] : first[b]], raw[ends[a] : ends[b]]),
                )
                for a, b in zip(heads, np.append(heads[1:], len(bucket)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), pa.array(packed, pa.binary())], ["bucket", "packed"])


def sorted_suffixes(data: np.ndarray, length: int) -> np.ndarray:
    """Cyclic suffixes in the order of their first ``length`` bytes, by ranks of prefixes: as many as 64 bits hold make a
    longer one. Suffixes that no longer share their prefix are not sorted again."""
    letters = np.bincount(data, minlength=256) > 0
    rank = (np.cumsum(letters) - 1).astype(np.uint64)[data]
    order, rest, known = np.arange(len(data)), np.arange(len(data)), 1
    while True:
        bits = max(1, int(rank.max()).bit_length())
        key, reach = rank, 0
        for _ in range(64 // bits - 1):
            reach = min(reach + known, length - known)
            key = (key << np.uint64(bits)) | np.roll(rank, -reach)
            if known + reach == length:
                break
        known += reach
        some = order[rest]
        order[rest] = some[np.argsort(key[some])]
        if known == length:
            return order
        ranked = key[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))
        rank = np.empty(len(data), np.uint64)
        rank[order] = (np.cumsum(new[:-1]) - 1).astype(np.uint64)
        rest = np.flatnonzero(~(new[:-1] & new[1:]))


def equal_windows(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows that occur more than once, and the number of the set of equal ones of each.

    Separators are part of no window. Places come ordered by set. Suffixes are only sorted as far as
    windows reach, so the transform may lead to another suffix than its own, but only to one
    of the same window.
    """
    suffixes = sorted_suffixes(data, length)
    transform = data[suffixes - 1]
    # Where the suffix one byte shorter stands: the stable order of the transform's bytes.
    shorter = np.argsort(transform, kind="stable").astype(np.int32)
    first = data[suffixes]
    interval = np.full(len(data), -1, np.int32)
    active = np.flatnonzero(first != SEPARATOR)
    interval[active] = 0
    for level in range(length):
        to = interval[shorter[active]] if level else np.zeros(len(active), np.int32)
        ok = to >= 0
        live, to = active[ok], to[ok]
        interval[active] = -1
        byte = first[live]
        opens = np.ones(len(live) + 1, bool)
        np.not_equal(to[1:], to[:-1], out=opens[1:-1])
        opens[1:-1] |= byte[1:] != byte[:-1]
        several = ~(opens[:-1] & opens[1:])  # intervals of one suffix are dropped
        number = np.cumsum(opens[:-1], dtype=np.int32)
        active = live[several]
        if not len(active):
            break
        interval[active] = number[several]
    return suffixes[active], interval[active]


@dataclass
class Classes:
    """For different contexts: the smallest id of each of their windows, as spans of equal ids, by context."""

    owner: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    least: np.ndarray


def _classes(least: np.ndarray, top: np.ndarray, size: np.ndarray, raw: np.ndarray, config: Repeats) -> Classes:
    """Of different contexts, with their smallest and largest ids and their bytes."""
    start = np.cumsum(size + 1) - size - 1  # a separator after each
    data = np.full(int(size.sum()) + len(size), SEPARATOR, np.uint8)
    inside = np.ones(len(data), bool)
    inside[start + size] = False
    data[inside] = raw
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    lowest = least[owner]
    place, number = equal_windows(data, config.length)
    if len(place):
        at = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        smallest = np.minimum.reduceat(lowest[place], at)
        lowest[place] = np.repeat(smallest, np.diff(np.append(at, len(place))))
    # Windows in order of place; a span ends where the id or the context changes.
    window = np.ones(len(data), bool)
    tail = np.repeat(start + size + 1, config.length) - np.tile(np.arange(config.length), len(size)) - 1
    window[tail] = False
    at = np.flatnonzero(window)
    low, own = lowest[at], owner[at]
    opens = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (low[1:] != low[:-1]))))
    end = np.append(opens[1:], len(at)) - 1
    own, low = own[opens], low[opens]
    useful = low < top[own]
    own, low = own[useful], low[useful]
    begin = at[opens[useful]] - start[own]
    stop = at[end[useful]] - start[own] + config.length
    return Classes(own, begin, stop, low)


def _spans(batches: Iterator[pa.RecordBatch], config: Repeats) -> Iterator[pa.RecordBatch]:
    """The intervals of a bucket's places. Contexts come several times, once for each slice that has them."""
    packed = [x.as_buffer() for batch in batches for x in batch.column("packed")]
    found = []
    for x in packed:
        short, context, size, places, own, _, raw = _unpack(x, *PARTS)
        first = np.cumsum(places, dtype=np.int64) - places
        found.append((short, context, size.astype(np.int64), own[first], own[first + places - 1], raw))
    bounds = np.cumsum([0, *(len(x[0]) for x in found)])
    short, context, size, least, most, raw = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    order = np.lexsort((least, context, short))
    s, c = short[order], context[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
    head = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    length = size + config.length - 1
    begin = (np.cumsum(length) - length)[order[head]]
    length, short, least, top = length[order[head]], s[head], least[order[head]], np.maximum.reduceat(most[order], head)
    # An anchor that only one document holds has no repeats. Of one with a single context, each window has that one's ids.
    group = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
    contexts = np.diff(np.append(group, len(head)))
    shared = np.minimum.reduceat(least, group) < np.maximum.reduceat(top, group)
    alone = group[shared & (contexts == 1)]
    rows = np.flatnonzero(np.repeat(shared & (contexts > 1), contexts))
    # Contexts of whole anchors, up to ``sorted_bytes``, are sorted at a time.
    ends = np.append(np.flatnonzero(short[rows[1:]] != short[rows[:-1]]) + 1, len(rows))
    reach = np.append(0, np.cumsum(length[rows]))[ends]
    parts, at, done = [Classes(alone, np.zeros(len(alone), np.int64), length[alone], least[alone])], 0, 0
    while at < len(rows):
        end = int(ends[max(np.searchsorted(reach, done + config.sorted_bytes, "right") - 1, np.searchsorted(ends, at, "right"))])
        own = rows[at:end]
        some = raw[np.repeat(begin[own], length[own]) + tx.within(length[own])]
        part = _classes(least[own], top[own], length[own], some, config)
        part.owner = own[part.owner]
        parts.append(part)
        at, done = end, int(length[own].sum()) + done
    found = [np.concatenate([getattr(p, f) for p in parts]) for f in ("owner", "begin", "stop", "least")]
    order = np.argsort(found[0], kind="stable")
    classes = Classes(*(x[order] for x in found))
    del raw
    n_spans = np.bincount(classes.owner, minlength=len(head))
    first_span = np.cumsum(n_spans) - n_spans
    for a, b, x in zip(bounds[:-1], bounds[1:], packed, strict=True):
        places, own, at = _unpack(x, *PARTS)[3:6]
        each = np.repeat(number[a:b], places)
        n = n_spans[each]
        span = np.repeat(first_span[each], n) + tx.within(n)
        own, at = np.repeat(own, n), np.repeat(at.astype(np.int64), n)
        ok = classes.least[span] < own
        own, at, span = own[ok], at[ok], span[ok]
        # A span is never longer than a run and a window.
        interval = ((at + classes.begin[span]) << SPAN_BITS) + classes.stop[span] - classes.begin[span]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(interval)], ["doc", "interval"])


def repeats(docs: DataFrame, config: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Intervals to remove from each document that has any: id, intervals. They are unordered, may overlap, and hold
    the first byte and, in the last 16 bits, the length.

    Rows of a null id take no part. An id stands for one text; repeated rows of it don't make it a repeat.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(8, -(-total // config.bucket_bytes))

    counted = rows.mapInArrow(lambda batches: _count(batches, buckets, config), "bucket long, packed binary")
    bits = counted.groupBy("bucket").applyInArrow(lambda k, t: _repeated(k, t, config), "bit long")
    maps = bits.groupBy(F.floor(F.col("bit") / BITMAP_BITS).alias("k")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("bit"), F.lit(BITMAP_BITS))).alias("map")
    )
    bloom = np.zeros((1 << config.filter_bits) // 8, np.uint8)  # of fixed size, 16 MB
    for row in maps.toLocalIterator():
        part = np.frombuffer(row["map"], np.uint8)
        bloom[row["k"] * (BITMAP_BITS // 8) :][: len(part)] = part
    shared = spark.sparkContext.broadcast(bloom)

    contexts = rows.mapInArrow(
        lambda batches: _contexts(batches, buckets, shared.value, config), "bucket long, packed binary"
    )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _spans(batches, config)

    found = contexts.groupBy("bucket").applyInArrow(spans, "doc long, interval long")
    return found.groupBy("doc").agg(F.collect_set("interval").alias("intervals")).withColumnRenamed("doc", "id")


def remove_repeats(
    docs: DataFrame,
    config: Repeats = Repeats(),
    id_col: str = "doc_id",
    text_col: str = "text",
    with_bytes: bool = False,
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans; with ``with_bytes`` also ``kept``.

    Every byte covered by a window that also starts in a document of a smaller id is removed. Null texts are empty; shorter
    texts than a window are kept, as are rows of a null id. Repeated rows give a row each. Texts are
    worked on whole, matches never cross documents, and ``kept`` is binary, as a cut may split a
    character. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    joined = rows.join(repeats(docs, config, id_col, text_col), "id", "left")
    kept = ", kept binary" if with_bytes else ""
    out = joined.mapInArrow(
        lambda batches: _removed(batches, with_bytes),
        "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        f"spans array<struct<a:bigint,b:bigint>>{kept}",
    )
    return out.withColumnRenamed("id", id_col)


def _removed(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        column = batch.column("intervals")
        for i, text in enumerate(batch.column("text")):
            raw = text.as_buffer().to_pybytes()
            merged: list[list[int]] = []
            if column[i].is_valid:
                packed = np.sort(column[i].values.to_numpy())
                a = packed >> SPAN_BITS
                reach = np.maximum.accumulate(a + (packed & ((1 << SPAN_BITS) - 1)))
                opens = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
                ends = np.append(opens[1:], len(a)) - 1
                merged = np.stack([a[opens], reach[ends]], axis=1).tolist()
            edges = [0, *[x for m in merged for x in m], len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append([{"a": x, "b": y} for x, y in merged])
            if with_bytes:
                out["kept"].append(kept)
        columns = [batch.column("id"), *[pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")]]
        columns += [pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], pa.list_(span))]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        if with_bytes:
            columns.append(pa.array(out["kept"], pa.binary()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(columns, names)
