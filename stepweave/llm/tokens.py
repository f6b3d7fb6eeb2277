"""Token-ID output: tokenized documents as compressed, checksummed blocks, and their reader.

Documents are put in order of their ids by a range shuffle. Each task encodes its range, cuts the stream
of ids into blocks of a fixed number of ids and writes one row per block: a header in columns, the
coded ids, a crc32 of header and coded ids, and one of the ids. A block begins with empty statistics and holds the list of its documents, so any
block can be read alone; a long document spans blocks. The rows stand in Parquet files, so that any store
that Spark writes to will do.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepweave.llm import coder
from stepweave.llm import text as tx
from stepweave.llm.shared import folder, give_back, stored, tidy

FORMAT = "ids-cm-3"
BLOCK = (
    "format string, part int, block int, first long, n_ids int, docs array<long>, lengths array<int>, "
    "continues boolean, crc long, data binary, head_crc long"
)
WORDS_KEPT = 300_000  # words, and their ids, that a Python worker remembers from task to task; beyond, those of the last slice
SLICE_BYTES = 16_000_000  # of texts encoded at a time: the more, the fewer words come again after they were forgotten
PART_BYTES = 30_000_000  # of texts in a part, about: their ids fill the coder's lanes once, whose steps cost the same for fewer
_models: dict[str, list] = {}


@dataclass(frozen=True)
class Output:
    """``block`` ids a block, 4,096 at most; ``end_id`` follows each document; ids are below 65536."""

    tokenizer: str
    end_id: int = 2
    block: int = 4096


def _tokenizer(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encodes texts: all their ids, and where those of each text end. White space always parts words of these
    tokenizers' patterns, so each different word of the texts is encoded once; only ASCII white space is used to part
    them here. Where the tokenizer's own rules are those of ``_Plain``, words are parted further and their cases joined."""
    if path not in _models:
        # A task has one core, and other tasks have the others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        nothing = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))
        model = Tokenizer.from_file(path)
        _models[path] = [model, _Plain.of(path, model), nothing]
    held = _models[path]

    def coded(words: pa.Array) -> pa.ListArray:
        """The ids of words never seen before."""
        model, plain, _ = held
        simple = plain.holds(words) if plain else pa.array(np.zeros(len(words), bool))
        some, others = words.filter(simple), words.filter(pc.invert(simple))
        first = plain.encode(some) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if first is None:
            first = _together(_encoded(model, some.to_pylist()))
        found = [first]
        for at in range(0, len(others), 10_000):
            found.append(_together(_encoded(model, others.slice(at, 10_000).to_pylist())))
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
        simple = simple.to_numpy(zero_copy_only=False)
        return lists.take(pa.array(np.where(simple, np.cumsum(simple), len(some) + np.cumsum(~simple)) - 1))

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, plain, (words, ids) = held
        if plain:
            pieces, bounds = plain.pieces(texts)
            pieces = pieces.dictionary_encode()
            kinds = pc.ascii_trim_whitespace(pieces.dictionary)
            kinds = pc.if_else(plain.holds(kinds), pc.utf8_lower(kinds), kinds).dictionary_encode()
            which, kinds = kinds.indices.take(pieces.indices), kinds.dictionary
        else:
            split = pc.ascii_split_whitespace(texts)
            pieces, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy()
            which, kinds = pieces.indices, pieces.dictionary
        place = pc.fill_null(pc.index_in(kinds, value_set=words), -1).to_numpy().copy()
        new = place < 0
        if new.any():
            place[new] = len(words) + np.arange(new.sum())
            fresh = kinds.filter(pa.array(new))
            words, ids = pa.concat_arrays([words, fresh]), pa.concat_arrays([ids, coded(fresh)])
        place = pa.array(place)
        held[2] = (words, ids) if len(words) <= WORDS_KEPT else (kinds, ids.take(place))
        found = ids.take(place.take(which))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[bounds[1:] - bounds[0]].astype(np.int64)

    return encode


def _together(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint32), np.fromiter(map(len, words), np.int64, len(words)) >> 2


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer | None]:
    """Where texts begin and end in their bytes, those bytes, and the buffer that holds them."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return ends, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), data


class _Plain:
    """Words of letters, or of ASCII marks, under rules that part words where letters meet marks and join their cases.

    The library gets them without the steps that don't change them: each is one word of its merges. Letters are those of
    ASCII and U+00C0 to U+00FF, which have one byte pair each, stay as they are when composed and have one lower case.
    Words (between white space) with any other character, an apostrophe, a digit or the first character of an added token
    are not parted.
    """

    SPACE, LETTER, MARK, OTHER = range(4)
    RULES = {
        "normalizer": {
            "type": "Sequence",
            "normalizers": [
                {"type": "NFC"},
                {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
                {"type": "Lowercase"},
            ],
        },
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {
                    "type": "Split",
                    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                    "behavior": "Removed",
                    "invert": True,
                },
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }

    def __init__(self, model: Tokenizer, added: list[str], suffix: str) -> None:  # noqa: F821
        from tokenizers import Tokenizer, pre_tokenizers

        self.table = np.full(256, self.OTHER, np.uint8)
        self.table[33:127] = self.MARK
        for c in range(128):
            if chr(c).isalnum():
                self.table[c] = self.LETTER if chr(c).isalpha() else self.OTHER
        # U+00C0 to U+00FF are 0xC3 and a byte from 0x80 to 0xBF, of which two are no letters. Other characters beyond
        # ASCII have another first byte.
        self.table[[0xC3, *range(0x80, 0xC0)]] = self.LETTER
        self.table[["×".encode()[1], "÷".encode()[1]]] = self.OTHER
        self.table[[9, 10, 11, 12, 13, 32]] = self.SPACE
        self.table[ord("'")] = self.OTHER
        for token in added:
            self.table[token.encode()[0]] = self.OTHER
        self.model = Tokenizer(model.model)  # the same merges, not held twice
        parts = pre_tokenizers.CharDelimiterSplit(" ")
        steps = [parts, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.model.pre_tokenizer = pre_tokenizers.Sequence(steps)
        self.ascii = Tokenizer(model.model)  # whose bytes stand for themselves
        self.ascii.pre_tokenizer = parts
        vocabulary = model.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values()), bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str, model: Tokenizer) -> _Plain | None:  # noqa: F821
        """None where the rules are not known to be these."""
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        bpe = rules["model"]
        same = all(rules.get(k) == rule for k, rule in cls.RULES.items()) and not rules.get("post_processor")
        same = same and bpe.get("type") == "BPE" and bool(bpe.get("end_of_word_suffix")) and not bpe.get("dropout")
        return cls(model, [t["content"] for t in rules["added_tokens"]], bpe["end_of_word_suffix"]) if same else None

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of words with the white space before them, and where those of each text begin and end."""
        offsets, data, buffer = _raw(texts.cast(pa.string()))
        base = offsets[0] if len(offsets) else 0
        ends = offsets - base
        kind = self.table[data[base : offsets[-1]]]
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != self.SPACE)
        new[ends[ends < len(kind)]] = True
        at = np.flatnonzero(new)
        other = kind[np.append(at[1:], len(kind))[: len(at)] - 1] == self.OTHER
        if other.any():
            opens = kind[at] == self.SPACE
            opens[np.searchsorted(at, ends[ends < len(kind)])] = True
            word = np.cumsum(opens) - 1
            whole = np.zeros(len(at), bool)
            whole[word[other]] = True
            at = at[opens | ~whole[word]]
        found = np.append(at, len(kind)).astype(np.int32) + np.int32(base)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(found), buffer]), np.searchsorted(at, ends)

    def holds(self, words: pa.Array) -> pa.Array:
        """Which words have letters or marks only."""
        offsets, data, _ = _raw(words)
        others = np.append(0, np.cumsum(self.table[data[: offsets[-1]]] == self.OTHER, dtype=np.int32))
        return pa.array(others[offsets[1:]] == others[offsets[:-1]])

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Their ids, and how many each has; a word's last id stands for an end of a word. None if that doesn't come out."""
        filled = pc.binary_length(words).to_numpy() > 0
        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        ids, sizes = np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        which = np.flatnonzero(~filled)
        for model, own in ((self.ascii, filled & plain), (self.model, filled & ~plain)):
            some = words.filter(pa.array(own))
            groups = np.append(np.arange(0, len(some), 250), len(some)).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups), some), " ")
            found = [np.zeros(0, np.uint32)]
            for at in range(0, len(texts), 40):
                batch = model.encode_batch_fast(texts.slice(at, 40).to_pylist(), add_special_tokens=False)
                found += [np.array(e.ids, np.uint32) for e in batch]
            found = np.concatenate(found)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(some) or len(found) != (ends[-1] if len(ends) else 0):
                return None
            sizes[own] = np.diff(ends, prepend=0)
            which, ids = np.append(which, np.flatnonzero(own)), np.append(ids, found)
        return ids[np.argsort(np.repeat(which, sizes[which]), kind="stable")], sizes


def _encoded(model: "Tokenizer", words: list[str]) -> list[bytes]:  # noqa: F821
    """The ids of each word. Many words are one text, parted by a digit: that is a token by itself in these patterns, and
    what has it inside, or gives another number of parts, is encoded alone."""
    mark = model.encode("0", add_special_tokens=False).ids
    out: list[bytes | None] = [None] * len(words)
    if len(mark) == 1:
        plain = [k for k, w in enumerate(words) if "0" not in w]
        groups = [plain[a : a + 200] for a in range(0, len(plain), 200)]
        texts = [" 0 ".join([words[k] for k in g]) for g in groups]
        for group, e in zip(groups, model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == mark[0])
            if len(cuts) == len(group) - 1:
                raw = ids.tobytes()
                starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
                for k, a, b in zip(group, starts, ends, strict=True):
                    out[k] = raw[a:b]
    alone = [k for k, x in enumerate(out) if x is None]
    for k, e in zip(alone, model.encode_batch_fast([words[k] for k in alone], add_special_tokens=False), strict=True):
        out[k] = np.array(e.ids, np.uint32).tobytes()
    return out


def write(docs: DataFrame, path: str, config: Output, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents in ascending order of id, then of text.

    Null and empty texts are an end id alone. Repeated rows are written each. Null ids come first. Other columns are
    ignored. An empty table gives a folder without blocks.
    """
    if not 0 < config.block <= coder.LONGEST:
        raise ValueError(f"a block holds 1 to {coder.LONGEST} ids")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    rows = rows.repartitionByRange(max(1, -(-total // PART_BYTES)), "id", "tie").sortWithinPartitions("id", "tie", "text")
    blocks = rows.select("id", "text").mapInArrow(lambda batches: _blocks(batches, config), BLOCK)
    blocks.write.parquet(path)


def _head_crc(part: int, block: int, first: int, n_ids: int, docs: list, lengths: list, continues: bool, crc: int, data: bytes) -> int:
    """Of all that a block holds, so that an altered id or length of a document is noticed as well."""
    head = struct.pack("<iiqi?q", part, block, first, n_ids, continues, crc)
    known = np.array([0 if d is None else d for d in docs], "<i8").tobytes() + bytes(d is None for d in docs)
    return zlib.crc32(data, zlib.crc32(head + known + np.array(lengths, "<i4").tobytes()))


@tidy
def _blocks(batches: Iterator[pa.RecordBatch], config: Output) -> Iterator[pa.RecordBatch]:
    encode = _tokenizer(config.tokenizer)
    part, block, first = TaskContext.get().partitionId(), 0, 0
    waiting: list[tuple[int | None, np.ndarray, bool]] = []  # id, ids, whether it began in an earlier block
    held = 0
    enough = coder.LANES * 5 // 4 * config.block  # as many as are coded in step

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, held, block, first
        stream = np.concatenate([w[1] for w in waiting]) if waiting else np.zeros(0, np.uint16)
        whole = len(stream) if last else len(stream) // config.block * config.block
        bounds = np.concatenate(([0], np.cumsum([len(w[1]) for w in waiting]))).astype(np.int64)
        at = int(np.searchsorted(bounds, whole, "right")) - 1
        rest = waiting[at:]
        if rest and bounds[at] < whole:
            rest = [(rest[0][0], rest[0][1][whole - bounds[at] :].copy(), True), *rest[1:]]
        waiting = [(one, None, late) for one, _, late in waiting]  # the stream has their ids
        starts = np.arange(0, whole, config.block)
        pieces = [stream[a : min(a + config.block, whole)] for a in starts]
        give_back()  # what encoding left, before the coder needs as much
        rows = []
        for a, ids, data in zip(starts, pieces, coder.encode(pieces), strict=True):
            b = a + len(ids)
            low, high = int(np.searchsorted(bounds, a, "right")) - 1, int(np.searchsorted(bounds, b, "left"))
            lengths = np.minimum(bounds[low + 1 : high + 1], b) - np.maximum(bounds[low:high], a)
            continues = bool(bounds[low] < a or waiting[low][2])
            head = (part, block, first, len(ids), [w[0] for w in waiting[low:high]], lengths.tolist(), continues)
            body = (zlib.crc32(ids.astype("<u4").tobytes()), data)
            rows.append((FORMAT, *head, *body, _head_crc(*head, *body)))
            block += 1
            first += len(ids)
        if rows:
            names = [f.split()[0] for f in BLOCK.split(", ")]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            kinds += [pa.list_(pa.int32()), pa.bool_(), pa.int64(), pa.binary(), pa.int64()]
            for at in range(0, len(rows), 1000):
                columns = zip(*rows[at : at + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
        waiting, held = rest, len(stream) - whole

    for batch in batches:
        for doc, texts in _slices(batch.column("id"), batch.column("text")):
            ids, ends = encode(texts)
            if int(ids.max(initial=config.end_id)) >= coder.LARGEST:
                raise ValueError("an id does not fit into 16 bits")
            ids = np.insert(ids.astype(np.uint16), ends, config.end_id)
            starts = np.append(0, ends + np.arange(1, len(ends) + 1)).tolist()
            waiting += [(one, ids[a:b], False) for one, a, b in zip(doc.to_pylist(), starts[:-1], starts[1:], strict=True)]
            held += len(ids)
            if held >= enough:
                yield from cut(last=False)
    yield from cut(last=True)


def _slices(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows of up to ``SLICE_BYTES`` of texts, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")) - at)
        yield ids.slice(at, n), texts.slice(at, n)
        at += n


PIECE = "part int, block int, place int, id long, at long, n_ids long, crc long, partial boolean, ids binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode all blocks: a row per document and block, ``ids`` as little-endian unsigned 32-bit integers.

    ``at`` is the position of its first id among those of the part, ``partial`` whether the document has
    ids in other blocks too, or may have. A block whose checksum does not hold ends the read with an error.
    """
    return spark.read.schema(BLOCK).parquet(path).mapInArrow(lambda batches: _pieces(batches, True), PIECE)


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], all_ids: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PIECE.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
    for batch in batches:
        for span in coder.groups(range(batch.num_rows)):
            some = batch.slice(span.start, len(span)).to_pydict()
            if any(f != FORMAT for f in some["format"]):
                raise ValueError("not a block of this format")
            fields = ("part", "block", "first", "n_ids", "docs", "lengths", "continues", "crc", "data")
            for *block, head_crc in zip(*(some[f] for f in fields), some["head_crc"], strict=True):
                if _head_crc(*block) != head_crc:
                    raise ValueError(f"block {block[1]} of part {block[0]} is damaged")
            rows = []
            for k, ids in enumerate(coder.decode(some["data"], some["n_ids"])):
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != some["crc"][k]:
                    raise ValueError(f"block {some['block'][k]} of part {some['part'][k]} is damaged")
                docs, lengths = some["docs"][k], some["lengths"][k]
                offset = 0
                for place, (doc, n) in enumerate(zip(docs, lengths, strict=True)):
                    own = raw[4 * offset : 4 * (offset + n)]
                    # The last document of a full block may go on in the next one.
                    partial = place == len(docs) - 1 or place == 0 and some["continues"][k]
                    first = some["first"][k] + offset
                    kept = own if all_ids else None
                    rows.append((some["part"][k], some["block"][k], place, doc, first, n, zlib.crc32(own), partial, kept))
                    offset += n
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _zero_ids() -> list[np.ndarray]:
    """What 1, 2, 4 and so on ids of zero, appended, make of each of a crc32's bits."""
    one = np.array([0xEDB88320, *(1 << k for k in range(31))], np.uint32)  # a bit of zero
    found = []
    for k in range(5 + 40):
        if k >= 5:  # an id has 2 ** 5 bits
            found.append(one)
        one = _times(one, one)
    return found


def _times(bits: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for k in range(32):
        out ^= ((crc >> np.uint32(k)) & np.uint32(1)) * bits[k]
    return out


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What checksums give to one of n more ids; the checksum of a whole is the exclusive or of those of its pieces."""
    for k, bits in enumerate(_zero_ids()[: int(n.max(initial=0)).bit_length()]):
        crc = np.where((n >> k) & 1 > 0, _times(bits, crc), crc)
    return crc


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from the lengths and checksums of their pieces, in order; every document has one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("pieces")
        pieces = lists.flatten()
        at, n, crc = (pieces.field(k).to_numpy() for k in ("at", "n_ids", "crc"))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        begin, last, sizes = bounds[:-1], bounds[1:] - 1, np.diff(bounds)
        after = np.repeat((at + n)[last], sizes) - (at + n)
        whole = np.bitwise_xor.reduceat(_moved(crc.astype(np.uint32), after), begin).astype(np.int64)
        columns = [*(batch.column(k) for k in ("part", "id", "at")), pa.array(np.add.reduceat(n, begin)), pa.array(whole)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "id", "at", "n_ids", "crc"])


def digest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids before it), n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("size"))  # a row per file part
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    # Stored, since both branches below read it: blocks are decoded once.
    pieces = stored(blocks.mapInArrow(lambda batches: _pieces(batches, False), PIECE).drop("ids"), "pieces")
    # A document is named by the place of its first id; pieces that continue one are given that place. Their
    # checksums are joined, not their ids.
    whole = pieces.where("not partial").select("part", "id", "at", "n_ids", "crc")
    heads = blocks.select("part", "block", "first", "n_ids", "docs", "lengths", "continues")
    cut = pieces.where("partial").join(_beginnings(heads), ["part", "block", "place"])
    joined = cut.groupBy("part", "begins").agg(
        F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("at", "n_ids", "crc"))).alias("pieces")
    )
    joined = joined.select("part", "id", F.col("begins").alias("at"), "pieces")
    cut = joined.mapInArrow(_joined, "part int, id long, at long, n_ids long, crc long")
    return whole.union(cut).join(parts, "part").select(
        F.col("id").alias(id_col),
        (F.col("offset") + F.col("at")).alias("start"),
        F.col("n_ids").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )


def _beginnings(heads: DataFrame) -> DataFrame:
    """For the first and last document of each block, the place where it begins: part, block, place, begins.

    Only headers are read. Within a part, the last beginning so far is carried along the blocks.
    """
    n = F.size("docs")
    last = F.col("first") + F.col("n_ids") - F.element_at("lengths", -1)
    opened = F.when((n > 1) | ~F.col("continues"), last)  # where the block's last document begins, if in it
    earlier = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    rows = heads.select(
        "part",
        "block",
        n.alias("n"),
        "continues",
        "first",
        F.last(opened, ignorenulls=True).over(earlier).alias("carried"),
        F.last(opened, ignorenulls=True).over(upto).alias("opened"),
    )
    front = F.struct(F.lit(0).alias("place"), F.when(F.col("continues"), F.col("carried")).otherwise(F.col("first")).alias("begins"))
    back = F.struct((F.col("n") - 1).alias("place"), F.col("opened").alias("begins"))
    both = F.when(F.col("n") > 1, F.array(front, back)).otherwise(F.array(back))
    return rows.select("part", "block", F.inline(both))


def encode_documents(docs: DataFrame, config: Output) -> DataFrame:
    """Write the documents to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = folder(spark, "ids")
    write(docs, path, config)
    return digest(spark, path)


