"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled texts tells, from any place of a
text, how long the longest match with that sample is. Parsing a text greedily into such matches gives
a number of phrases; ``phrases * log2(sample length)`` is the cross-parsing (Ziv-Merhav) estimate of
the bits that the text needs given that language. The language that needs fewest wins.

The automata are small tables that every task gets. A text is cut into windows of equal length and
all windows of a batch step through an automaton together, one symbol at a time, so the cost of a
symbol is one table look-up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm import text as tx
from stepweave.llm.shared import tidy

UND = "und"


@dataclass(frozen=True)
class LanguageSample:
    """Bounds of what is learned from: only these rows and symbols reach the driver.

    ``symbols`` per language, from at most ``rows`` texts of it, ``row_chars`` characters of each.
    Every language is learned.
    """

    symbols: int = 40_000
    rows: int = 400
    row_chars: int = 2_000


WINDOW = 512
TOGETHER = 50  # languages whose rows are on the driver at a time
TABLE_BYTES = 256 << 20  # of the automata's tables that a task holds at a time, or one table
CELLS = 4_000_000  # rows times languages worked on at a time


@dataclass(frozen=True)
class Automaton:
    """Suffix automaton of one language's sample: edges of states, and its length."""

    lang: str
    length: int
    states: int
    source: np.ndarray
    symbol: np.ndarray
    target: np.ndarray


@dataclass(frozen=True)
class LanguageModel:
    #: Byte -> symbol; 0 is everything between words, ``unknown`` a byte no sample holds.
    symbols: np.ndarray
    n_symbols: int
    automata: tuple[Automaton, ...]


def fit(
    labelled: DataFrame,
    config: LanguageSample = LanguageSample(),
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
) -> LanguageModel:
    """Learn from rows with text and language; all others are left out.

    The sample of a language is its rows with the smallest hashes of id and text. It is found with
    counts per language, a threshold on the hash and a last cut on the driver, so no language is
    ordered in one task.
    """
    rows = labelled.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40)).alias("h"),
    ).where(F.col("lang").isNotNull() & _has_letter(F.col("text")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return LanguageModel(np.zeros(256, np.uint8), 2, ())
    # Twice the rows wanted, so that hardly ever fewer are found; small languages are taken whole.
    share = {r["lang"]: min(1.0, 2 * config.rows / r["count"]) for r in counts}
    used = np.zeros(256, bool)
    streams: dict[str, np.ndarray] = {}
    langs = list(share)
    for at in range(0, len(langs), TOGETHER):
        below = F.lit(False)
        for lang in langs[at : at + TOGETHER]:
            below = below | ((F.col("lang") == F.lit(lang)) & (F.col("h") < F.lit(int(share[lang] * (1 << 40)))))
        few = rows.where(below).select("lang", "h", F.substring("text", 1, config.row_chars).alias("text"))
        texts: dict[str, list[str]] = {}
        for row in sorted(few.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
            texts.setdefault(row["lang"], []).append(row["text"])
        for lang, own in texts.items():
            data = _lower(" ".join(own[: config.rows]))
            used |= np.bincount(data, minlength=256) > 0
            streams[lang] = data[_kept(tx.LETTERS[data])][: config.symbols].copy()
    letters = used & (tx.LETTERS > 0)
    symbols = np.zeros(256, np.uint8)
    symbols[letters] = np.arange(1, letters.sum() + 1)
    unknown = int(letters.sum()) + 1
    symbols[(tx.LETTERS > 0) & ~letters] = unknown
    upper = np.arange(65, 91)
    symbols[upper] = symbols[upper + 32]
    built = tuple(_automaton(k, symbols[v]) for k, v in sorted(streams.items()))
    return LanguageModel(symbols, unknown + 1, built)


def _has_letter(text: Column) -> Column:
    """Whether there is a letter; hardly any text is made a string of the JVM's beyond its first characters."""
    return F.substring(text, 1, 64).rlike(r"\p{L}") | text.rlike(r"\p{L}")


def _lower(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode(), np.uint8)


def _kept(symbols: np.ndarray) -> np.ndarray:
    """One separator of each run of them, and all else."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return keep


def _squeeze(symbols: np.ndarray) -> np.ndarray:
    return symbols[_kept(symbols)]


def _automaton(lang: str, stream: np.ndarray) -> Automaton:
    nexts: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in stream.tolist():
        current = len(nexts)
        nexts.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in nexts[at]:
            nexts[at][c] = current
            at = link[at]
        if at >= 0:
            q = nexts[at][c]
            if longest[q] == longest[at] + 1:
                link[current] = q
            else:
                split = len(nexts)
                nexts.append(dict(nexts[q]))
                longest.append(longest[at] + 1)
                link.append(link[q])
                link[q] = link[current] = split
                while at >= 0 and nexts[at].get(c) == q:
                    nexts[at][c] = split
                    at = link[at]
        last = current
    sizes = [len(x) for x in nexts]
    return Automaton(
        lang,
        len(stream),
        len(nexts),
        np.repeat(np.arange(len(nexts), dtype=np.int32), sizes),
        np.fromiter((c for x in nexts for c in x), np.uint8, sum(sizes)),
        np.fromiter((t for x in nexts for t in x.values()), np.int32, sum(sizes)),
    )


def _table(automaton: Automaton, n_symbols: int) -> np.ndarray:
    """Next state for (state, symbol); ~state where the symbol begins a phrase.

    So it does at the start, and where no match goes on. A symbol that the sample lacks is a phrase of its own.
    """
    moves = np.full((automaton.states, n_symbols), -1, np.int32)
    moves[automaton.source, automaton.symbol] = automaton.target
    root = np.where(moves[0] >= 0, moves[0], 0)
    moves[0] = -1
    return np.where(moves >= 0, moves, ~root[None, :]).astype(np.int32).reshape(-1)


def predict(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """A row per row of ``docs``: id, the columns of ``keep``, lang_pred, score, phrases (by language).

    ``prefix`` goes before the last three names, so that they don't clash with what is kept. ``und`` with score 0 where the text is null or has no letter, or where no language was learned.
    Ties go to the language first in alphabetical order. The score, 0 to 1, is the winner's share of
    the odds that the estimated bits give to all languages, at one tenth of a bit a bit. Windows of 512
    symbols are parsed on their own; every language pays the same for that. Repeated rows
    and null ids give a row each; long texts are parsed whole.
    """
    text = F.col(text_col).cast("string")
    others = [c for c in keep if c != text_col]
    rows = docs.select(
        F.col(id_col).alias("id"),
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(others)],
        text.alias("text"),
        F.coalesce(_has_letter(text), F.lit(False)).alias("has_letter"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n in rows.columns[:-1] if n != "text" or text_col in keep]
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    found = rows.mapInArrow(
        lambda batches: _predict(batches, shared.value, names),
        f"{fields}, lang_pred string, score double, phrases array<int>",
    )
    kept = ["text" if c == text_col else f"keep_{others.index(c)}" for c in keep]
    return found.select(
        F.col("id").alias(id_col),
        *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)],
        *[F.col(c).alias(f"{prefix}{c}") for c in ("lang_pred", "score", "phrases")],
    )


LOWERED_ROWS = 500  # whose lower-case texts are held at a time


def _groups(model: LanguageModel) -> list[tuple[Automaton, ...]]:
    """Automata in order, as many together as have tables of ``TABLE_BYTES``."""
    groups, held = [], TABLE_BYTES
    for one in model.automata:
        need = 4 * one.states * model.n_symbols
        if held + need > TABLE_BYTES:
            groups.append(())
            held = 0
        groups[-1] += (one,)
        held += need
    return groups


@tidy
def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel, kept: list[str]) -> Iterator[pa.RecordBatch]:
    groups = _groups(model)
    n_langs = len(model.automata)
    tables = [_table(a, model.n_symbols) for a in groups[0]] if len(groups) == 1 else []
    bits = np.array([np.log2(max(a.length, 2)) for a in model.automata])
    names = np.array([a.lang for a in model.automata] + [UND], object)
    rows = max(1, CELLS // max(n_langs, 1))
    for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
        text = batch.column("text")
        phrases = np.zeros((batch.num_rows, n_langs), np.int64)
        done = 0
        for group in groups:
            if len(groups) > 1:
                tables = []  # the last group's go first
                tables = [_table(a, model.n_symbols) for a in group]
            for at in range(0, batch.num_rows, LOWERED_ROWS):
                for texts in tx.slices(pc.utf8_lower(text.slice(at, LOWERED_ROWS))):
                    first = at + texts.first
                    phrases[first : first + len(texts), done : done + len(group)] = _phrases(texts, tables, model)
            done += len(group)
        none = ~batch.column("has_letter").to_numpy(zero_copy_only=False) | (n_langs == 0)
        cost = phrases * bits
        if n_langs:
            best = np.where(none, n_langs, cost.argmin(axis=1))
            odds = np.exp2(-0.1 * (cost - cost.min(axis=1, keepdims=True)))
            score = np.where(none, 0.0, 1 / odds.sum(axis=1))
        else:
            best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
        columns = [batch.column(c) for c in kept]
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_langs),
            pa.array(phrases.astype(np.int32).reshape(-1)),
        )
        columns += [pa.array(names[best].tolist(), pa.string()), pa.array(score), lists]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", "phrases"])


def _phrases(texts: tx.Texts, tables: list[np.ndarray], model: LanguageModel) -> np.ndarray:
    """Phrases of each document in each language."""
    n = len(texts)
    symbols = model.symbols[texts.data]
    fresh = np.ones(len(symbols), bool)
    fresh[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    fresh[texts.offsets[:-1][texts.offsets[:-1] < len(symbols)]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))[texts.offsets]
    symbols = symbols[fresh]
    sizes = np.diff(kept)
    counts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(n), counts)
    start = np.repeat(kept[:-1], counts) + tx.within(counts) * WINDOW
    length = np.minimum(np.repeat(kept[1:], counts) - start, WINDOW)
    order = np.argsort(-length, kind="stable")
    doc, start, length = doc[order], start[order], length[order]
    # Windows still running at each step: a prefix, as they are ordered by length.
    running = np.searchsorted(-length, -np.arange(WINDOW), "left")
    out = np.zeros((n, len(tables)), np.int64)
    for k, table in enumerate(tables):
        state = np.zeros(len(start), np.int32)
        count = np.zeros(len(start), np.int64)
        for step in range(WINDOW):
            m = running[step]
            if m == 0:
                break
            at = table[state[:m] * model.n_symbols + symbols[start[:m] + step]]
            begins = at < 0
            count[:m] += begins
            state[:m] = np.where(begins, ~at, at)
        out[:, k] = np.bincount(doc, count, n)
    return out


def split_part(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold of a row."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def identify(docs: DataFrame, fold: int = 2, parts: int = 4, config: LanguageSample = LanguageSample()) -> DataFrame:
    """Learn from the labelled documents outside a fold; predict all: doc_id, held_out, lang_pred, score."""
    held = split_part("doc_id", parts) == fold
    model = fit(docs.where(~held), config)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
