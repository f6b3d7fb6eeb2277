"""Byte-level BPE over overlapping chunks of text, and back to bytes.

A text is cut into chunks that reach some way into the next. Every chunk is pre-tokenised by itself, in any
task, beginning wherever it happens to begin. A pre-token depends only on what stands after its start, so as soon as
two neighbours share a boundary they agree from there on: the first boundary that both have in their overlap is where
they are stitched. Chunk k therefore agrees with the pre-tokens of the whole text from the greatest of the first k
stitches on. It is encoded from there to the next such place; a chunk that begins inside one long
pre-token may be left with nothing. Neighbours without a common boundary become one chunk and are tried again, so any
pre-token stays whole however long it is.

Texts of one chunk are encoded where they are read. Longer ones are stored once per different text and spread by
chunk. Decoding looks up the bytes of ids and joins them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepweave.llm.shared import stored


@dataclass(frozen=True)
class Bpe:
    """``path``: lines of base64 token and rank. ``pattern``: pre-tokens; it must match every character, look at
    nothing before a match, and at no more than ``REACH`` bytes after one."""

    path: str
    pattern: str
    chunk: int = 1 << 16
    overlap: int = 1 << 10


REACH = 16
PIECES_KEPT = 1 << 17  # remembered pre-tokens per worker, some 25 MB; twice as many save a seventh of the time
LONGEST_KEPT = 64
OUT_BYTES = 1 << 23


def encode(docs: DataFrame, config: Bpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens long, ids binary (little-endian unsigned 32-bit integers).

    A null text is an empty one and has no ids. Bytes that are not UTF-8 are read as U+FFFD. Repeated rows and rows of
    a null id are rows like any other; other columns are ignored.
    """
    text = F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("data"))
    is_long = F.octet_length("data") > config.chunk
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.where(~is_long).mapInArrow(
        lambda batches: _encode(batches, config, ["id"]), f"id {kind}, n_tokens long, ids binary"
    )
    whole = rows.where(is_long).withColumn("digest", F.sha2("data", 256))
    done = _encode_long(whole, config)
    again = whole.select("id", "digest").join(done, "digest").select("id", "n_tokens", "ids")
    return short.union(again).select(F.col("id").alias(id_col), "n_tokens", "ids")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The table with column ``out_col`` binary: the bytes of the ids one after another.

    Null ids give null; an id that the rank file lacks is an error. ``out_col`` replaces a column of that name."""
    kept = encoded.drop(out_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(lambda batches: _decode(batches, path, ids_col, out_col), f"{fields}, `{out_col}` binary")


def _encode_long(whole: DataFrame, config: Bpe) -> DataFrame:
    """digest, n_tokens, ids of every different text."""
    texts = stored(whole.groupBy("digest").agg(F.first("data").alias("data")), "long-texts")
    size = F.octet_length("data").cast("long")
    step = F.lit(config.chunk).cast("long")
    spans = texts.select("digest", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), size - 1, step)).alias("lo"))
    spans = spans.select("digest", "lo", F.least(F.col("lo") + step, "size").alias("hi"), "size")
    marks = stored(_marks(spans, texts, config), "marks")
    by_text = W.partitionBy("digest").orderBy("lo")
    while True:
        # Where chunks agree first; nothing for the first chunk of a text, which is right from its start.
        common = F.array_min(F.array_intersect("head", F.lag("tail").over(by_text)))
        at = F.when(F.col("lo") == 0, F.lit(0).cast("long")).otherwise(common)
        stitched = marks.withColumn("at", at)
        apart = F.col("at").isNull()
        groups = stitched.withColumn("g", F.sum(F.when(apart, 0).otherwise(1)).over(by_text))
        joined = groups.groupBy("digest", "g").agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.max("size").alias("size"),
            F.count("*").alias("n"),
            F.first("head").alias("head"),
            F.first("tail").alias("tail"),
        )
        if stitched.where(apart).isEmpty():
            break
        joined = stored(joined, "joined")
        kept = joined.where("n = 1").select("digest", "lo", "hi", "size", "head", "tail")
        wider = _marks(joined.where("n > 1").select("digest", "lo", "hi", "size"), texts, config)
        marks = stored(kept.union(wider), "marks")
    start = F.max("at").over(by_text.rowsBetween(W.unboundedPreceding, 0))
    ends = stitched.withColumn("lo", start).withColumn(
        "hi", F.coalesce(F.lead("lo").over(W.partitionBy("digest").orderBy("lo", "hi")), "size")
    )
    pieces = _cut(ends.where("lo < hi").select("digest", "lo", "hi", "size"), texts, REACH)
    ids = pieces.mapInArrow(
        lambda batches: _encode(batches, config, ["digest", "lo"]), "digest string, lo long, n_tokens long, ids binary"
    )
    # Ids of one text are one value; nothing else of the text is in its group.
    return stored(
        ids.groupBy("digest").agg(
            F.sum("n_tokens").alias("n_tokens"), F.expr("listagg(ids, X'') within group (order by lo)").alias("ids")
        ),
        "long-ids",
    )


def _cut(spans: DataFrame, texts: DataFrame, beyond: int) -> DataFrame:
    """Spans with their bytes and some beyond, spread over tasks by span and not by text."""
    data = F.substring(F.col("data"), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + beyond).cast("int"))
    cut = spans.join(texts, "digest").select("digest", "lo", "hi", "size", data.alias("data"))
    return cut.repartition(F.col("digest"), F.col("lo"))


def _marks(spans: DataFrame, texts: DataFrame, config: Bpe) -> DataFrame:
    return _cut(spans, texts, config.overlap).mapInArrow(
        lambda batches: _boundaries(batches, config),
        "digest string, lo long, hi long, size long, head array<long>, tail array<long>",
    )


# In tasks


def _whole_characters(data: bytes) -> tuple[int, str]:
    """The text without cut characters at its ends, and how many bytes were left out before it."""
    skip = 0
    while skip < min(3, len(data)) and data[skip] & 0xC0 == 0x80:
        skip += 1
    end = len(data)
    for back in range(1, min(4, end - skip) + 1):
        lead = data[end - back]
        if lead & 0xC0 != 0x80:
            if back < (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                end -= back
            break
    return skip, data[skip:end].decode()


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    """Function text -> pre-tokens, as the library that owns the rank files would cut them.

    The two expression engines know different Unicode versions. Texts with a character on which they disagree go by
    the other engine's classes, written out."""
    import regex
    import tiktoken

    plain = regex.compile(pattern)
    classes = sorted(set(regex.findall(r"\\p\{\w+\}", pattern)))
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    exact, odd = pattern, set()
    for name in classes:
        engine = tiktoken.Encoding(
            "class", pat_str=f"{name}+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}
        )
        theirs = set(bytes(engine.encode_ordinary(every)).decode())
        odd |= theirs ^ set(regex.findall(name, every))
        exact = exact.replace(name, f"[{_ranges(theirs)}]")
    if not odd:
        return plain.findall
    strange, careful = regex.compile(f"[{_ranges(odd)}]"), regex.compile(exact, regex.V1)
    return lambda text: (plain if text.isascii() or not strange.search(text) else careful).findall(text)


def _ranges(characters: set[str]) -> str:
    codes = np.array(sorted(map(ord, characters)))
    breaks = np.flatnonzero(np.diff(codes) > 1)
    firsts, lasts = codes[np.append(0, breaks + 1)], codes[np.append(breaks, len(codes) - 1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


def _boundaries(batches: Iterator[pa.RecordBatch], config: Bpe) -> Iterator[pa.RecordBatch]:
    split = _splitter(config.pattern)
    for batch in batches:
        heads, tails = [], []
        for lo, hi, size, data in zip(*(batch[c].to_pylist() for c in ("lo", "hi", "size", "data")), strict=True):
            skip, text = _whole_characters(data)
            cuts = np.cumsum([lo + skip, *[len(p.encode()) for p in split(text)]])
            # Near the end of what was read a pre-token may look different from what it is.
            cuts = cuts if lo + len(data) >= size else cuts[cuts <= lo + len(data) - REACH]
            heads.append(cuts[cuts < lo + config.overlap])
            tails.append(cuts[cuts >= hi])
        yield pa.RecordBatch.from_arrays(
            [*[batch[c] for c in ("digest", "lo", "hi", "size")], _lists(heads), _lists(tails)],
            ["digest", "lo", "hi", "size", "head", "tail"],
        )


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *[len(p) for p in parts]])
    flat = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


class _Ids(dict):
    """Pre-token -> its ids as bytes. Short ones are remembered, up to a number."""

    def __init__(self, path: str):
        import tiktoken

        self.engine = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.engine.encode_ordinary(piece), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = ids
        return ids


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def _encode(batches: Iterator[pa.RecordBatch], config: Bpe, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Ids of whole texts, or of spans that begin at a boundary and end at one."""
    split, ids = _splitter(config.pattern), _ids(config.path)
    for batch in batches:
        spans = "hi" in batch.schema.names
        at, held, out = 0, 0, []
        for i in range(batch.num_rows):
            data = batch["data"][i].as_py()
            _, text = _whole_characters(data)
            pieces = split(text)
            if spans:
                ends = np.cumsum([len(p.encode()) for p in pieces])
                pieces = pieces[: int(np.searchsorted(ends, batch["hi"][i].as_py() - batch["lo"][i].as_py())) + 1]
            out.append(b"".join(map(ids.__getitem__, pieces)))
            held += len(out[-1])
            if held >= OUT_BYTES or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch[c].slice(at, len(out)) for c in keep],
                        pa.array([len(x) // 4 for x in out], pa.int64()),
                        pa.array(out, pa.binary()),
                    ],
                    [*keep, "n_tokens", "ids"],
                )
                at, held, out = i + 1, 0, []


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}


def _decode(batches: Iterator[pa.RecordBatch], path: str, ids_col: str, out_col: str) -> Iterator[pa.RecordBatch]:
    token = _tokens(path).__getitem__
    for batch in batches:
        at, held, out = 0, 0, []
        for i, ids in enumerate(batch[ids_col]):
            ids = ids.as_py()
            out.append(None if ids is None else b"".join(map(token, np.frombuffer(ids, "<u4").tolist())))
            held += len(out[-1] or b"")
            if held >= OUT_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(at, len(out))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, out_col])
                at, held, out = i + 1, 0, []
