"""Toxic spans and document scores with a linear-chain conditional random field.

Only documents are labelled. Tokens get labels from that: a word (or a word's beginning) that many toxic documents
and hardly any others hold marks its tokens in toxic documents; all other tokens are clean. A
linear-chain CRF with two states is trained on a bounded sample of documents so labelled. Its features
are the word and its beginnings of three to six bytes, for the token and its two neighbours, so that
unseen words with a known stem are found too, and transitions carry a span over the words within it.

Scoring runs forward-backward over whole documents, many documents in step. The marginal of a token is its
probability of being toxic; ``1 - product(1 - marginal)`` is the probability that a document has any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm import text as tx
from stepweave.llm.langid import split_part
from stepweave.llm.shared import stored

PREFIXES = (3, 4, 5, 6)
KINDS = len(PREFIXES) + 1  # the word itself, then its beginnings


@dataclass(frozen=True)
class Training:
    """At most ``sample`` documents of each label, those with the smallest hashes, are learned from: Spark counts their
    terms, and the first ``documents`` of each reach the driver to fit weights.

    A term marks tokens if its documents are toxic ``ratio`` times as often as clean, after smoothing, and if
    chance would have given so many toxic ones with a probability below exp(-``evidence``). At most ``terms``
    such terms become features, those of most toxic documents. ``bias`` is the log-odds a token starts from: low
    enough that the many clean tokens of a very long document don't add up.
    """

    sample: int = 3000
    documents: int = 600
    ratio: float = 10.0
    evidence: float = 20.0
    bias: float = -14.0
    terms: int = 20_000
    rounds: int = 40
    penalty: float = 0.05
    threshold: float = 0.5


@dataclass(frozen=True)
class Crf:
    """Log-linear weights of the toxic state; ``terms`` are sorted hashes of words and beginnings."""

    terms: np.ndarray
    weights: np.ndarray  # (term, place): the token itself, the one before, the one after
    bias: float
    moves: np.ndarray  # (from, to)


def _terms(found: tx.Words) -> np.ndarray:
    """(kind, token) hashes of each token's word and beginnings; a beginning as long as its word counts too."""
    return np.stack([found.hash, *[found.prefix_hash(n) for n in PREFIXES]])


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each label hold a term, for one batch."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for texts in tx.slices(batch.column("text")):
            found = tx.words(texts, tx.LETTERS)
            hashes = _terms(found).reshape(-1)
            doc = np.tile(found.doc, KINDS)
            order = np.lexsort((doc, hashes))
            hashes, doc = hashes[order], doc[order]
            if not len(hashes):
                continue
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            hashes, label = hashes[fresh], toxic[texts.first + doc[fresh]]
            at = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[at].view(np.int64)),
                    pa.array(np.add.reduceat((label == 1).astype(np.int64), at)),
                    pa.array(np.add.reduceat((label == 0).astype(np.int64), at)),
                ],
                ["term", "toxic", "clean"],
            )


def fit(labelled: DataFrame, config: Training = Training()) -> Crf:
    """Learn from rows (id, text, toxic); rows without text or label are left out.

    A label's sample is found with its count, a threshold on a hash, and a limit on what is below, so no table is put in order.
    """
    rows = labelled.select("id", "text", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("text is not null and toxic in (0, 1)")
    h = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    few = [
        # Twice the rows wanted, so that hardly ever fewer are found; a small label is taken whole.
        rows.where((F.col("toxic") == label) & (h < int(min(1.0, 2 * config.sample / max(sizes.get(label, 0), 1)) * (1 << 40))))
        .select(h.alias("h"), "text", "toxic")
        .orderBy("h", "text")
        .limit(config.sample)
        for label in (0, 1)
    ]
    rows = stored(few[0].union(few[1]), "sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.select("text", "toxic").mapInArrow(_document_terms, "term long, toxic long, clean long")
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = F.col("toxic") / max(n_toxic, 1) / ((F.col("clean") + 0.5) / max(n_clean, 1))
    share = n_toxic / max(n_toxic + n_clean, 1)
    marking = counted.where((F.col("toxic") > 0) & (rate >= config.ratio))
    marking = marking.where(_surprise(F.col("toxic"), F.col("clean"), share) >= config.evidence)
    terms = marking.orderBy(F.desc("toxic"), "term").limit(config.terms).select("term").collect()
    marks = np.sort(np.array([r["term"] for r in terms], np.int64).view(np.uint64))
    first = [rows.where(F.col("toxic") == label).orderBy("h", "text").limit(config.documents) for label in (0, 1)]
    sample = sorted(first[0].union(first[1]).collect(), key=lambda r: (r["h"], r["text"]))
    texts = pa.array([r["text"] for r in sample], pa.string())
    toxic = np.array([r["toxic"] for r in sample], np.int64)
    return _train(texts, toxic, marks, config)


def _surprise(toxic: Column, clean: Column, share: float) -> Column:
    """Chernoff bound on the chance of so many toxic documents: minus its logarithm."""
    n = toxic + clean
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * max(q, 1e-9)))).otherwise(0.0)
    return part(toxic, share) + part(clean, 1 - share)


def _features(found: tx.Words, terms: np.ndarray) -> np.ndarray:
    """(kind, token) index into the terms; len(terms) for none."""
    hashes = _terms(found)
    at = np.searchsorted(terms, hashes.reshape(-1)).reshape(hashes.shape)
    known = np.concatenate((terms, np.zeros(1, np.uint64)))[at] == hashes
    return np.where(known & (at < len(terms)), at, len(terms))


def _train(texts: pa.Array, toxic: np.ndarray, marks: np.ndarray, config: Training) -> Crf:
    """Gradient ascent on the penalised conditional likelihood of the token labels, in steps of adaptive size."""
    slices = [(s, tx.words(s, tx.LETTERS)) for s in tx.slices(texts)]
    data = []
    for s, found in slices:
        features = _features(found, marks)
        marked = (features < len(marks)).any(axis=0) & (toxic[s.first + found.doc] == 1)
        data.append((found, features, marked.astype(np.float64)))
    n_marked = sum(float(y.sum()) for *_, y in data)
    n_weights = 3 * (len(marks) + 1)
    # Weights, bias and transitions in one vector.
    theta = np.zeros(n_weights + 5)
    theta[n_weights] = config.bias
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    rate = np.full(len(theta), 0.4)
    rate[n_weights:] = 0.02
    for step in range(config.rounds if n_marked else 0):
        weights = theta[:n_weights].reshape(-1, 3)
        slope = np.zeros_like(theta)
        slope_w = slope[:n_weights].reshape(-1, 3)
        for found, features, y in data:
            potential = _potential(found, features, weights, theta[n_weights])
            p, pairs = _marginals(found, potential, theta[n_weights + 1 :].reshape(2, 2), pairs=True)
            error = y - p
            some = np.flatnonzero((features < len(marks)).any(axis=0))
            for place in range(3):
                moved = _shifted_error(found, error, place)[some]
                for kind in features[:, some]:
                    slope_w[:, place] += np.bincount(kind, moved, len(marks) + 1)
            inner = np.flatnonzero(found.doc[1:] == found.doc[:-1])
            both = 2 * y[inner].astype(np.int64) + y[inner + 1].astype(np.int64)
            slope[n_weights] += error.sum()
            slope[n_weights + 1 :] += np.bincount(both, minlength=4) - pairs.reshape(-1)
        slope[:n_weights] -= config.penalty * theta[:n_weights]
        slope_w[-1] = 0
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        unbiased = mean / (1 - 0.9 ** (step + 1)), square / (1 - 0.99 ** (step + 1))
        theta = theta + rate * unbiased[0] / (np.sqrt(unbiased[1]) + 1e-6)
    weights = theta[:n_weights].reshape(-1, 3).copy()
    weights[-1] = 0
    return Crf(marks, weights, float(theta[n_weights]), theta[n_weights + 1 :].reshape(2, 2))


def _shifted_error(found: tx.Words, error: np.ndarray, place: int) -> np.ndarray:
    """Error of the token whose neighbour (or self) a token is."""
    out = error.copy() if place == 0 else np.zeros_like(error)
    same = found.doc[1:] == found.doc[:-1]
    if place == 1:  # a token stands before the one that errs
        out[:-1][same] = error[1:][same]
    elif place == 2:
        out[1:][same] = error[:-1][same]
    return out


def _potential(found: tx.Words, features: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Log-potential of the toxic state of each token; that of the clean state is 0."""
    out = np.full(len(found.hash), bias)
    some = np.flatnonzero((features < len(weights) - 1).any(axis=0))
    if not len(some):
        return out
    for place, off in ((0, 0), (1, 1), (2, -1)):
        gain = weights[features[:, some], place].sum(axis=0)
        to = some + off
        ok = (to >= 0) & (to < len(out))
        ok[ok] = found.doc[to[ok]] == found.doc[some[ok]]
        np.add.at(out, to[ok], gain[ok])
    return out


def _marginals(
    found: tx.Words, potential: np.ndarray, moves: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over every document, all documents in step: P(toxic) of each token.

    Messages are odds of the toxic against the clean state, so one number a token is enough and nothing
    underflows. ``pairs`` adds the expected counts of transitions.
    """
    sizes = np.diff(found.bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = found.bounds[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(steps), "left")
    local = np.exp(np.clip(potential, -60, 60))
    e = np.exp(moves)
    forward, backward = np.empty_like(local), np.ones_like(local)
    ratio = np.zeros(0)
    for t in range(steps):
        at = begin[: running[t]] + t
        if t == 0:
            ratio = local[at]
        else:
            r = ratio[: running[t]]
            ratio = (e[0, 1] + r * e[1, 1]) / (e[0, 0] + r * e[1, 0]) * local[at]
        forward[at] = ratio = np.clip(ratio, 1e-30, 1e30)
    # From the end: documents still running are a prefix that grows.
    ratio = np.ones(len(sizes))
    for t in range(steps - 2, -1, -1):
        m = running[t + 1]
        at = begin[:m] + t
        r = ratio[:m] * local[at + 1]
        ratio[:m] = np.clip((e[1, 0] + r * e[1, 1]) / (e[0, 0] + r * e[0, 1]), 1e-30, 1e30)
        backward[at] = ratio[:m]
    odds = forward * backward
    marginal = odds / (1 + odds)
    if not pairs:
        return marginal, None
    inner = np.flatnonzero(found.doc[1:] == found.doc[:-1])
    f, b = forward[inner], backward[inner + 1] * local[inner + 1]
    joint = np.stack([e[0, 0] + 0 * f, e[0, 1] * b, f * e[1, 0], f * e[1, 1] * b])
    joint /= joint.sum(axis=0)
    return marginal, joint.sum(axis=1).reshape(2, 2)


SPAN = "array<struct<start:int,end:int,p:double>>"


def tag(
    docs: DataFrame, model: Crf, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, score, predicted, spans (byte offsets and the largest marginal within).

    The score is the probability that any token is toxic, 0 to 1; null and empty texts and texts without
    a letter score 0. A span is a maximal run of tokens whose marginal is at least ``threshold``. Repeated rows
    and null ids give a row each; long texts are tagged whole; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(
        lambda batches: _tag(batches, shared.value, threshold), f"id {kind}, score double, spans {SPAN}"
    )
    return found.select(
        F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans"
    )


def _tag(batches: Iterator[pa.RecordBatch], model: Crf, threshold: float) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
    for batch in batches:
        score = np.zeros(batch.num_rows)
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for texts in tx.slices(batch.column("text")):
            found = tx.words(texts, tx.LETTERS)
            potential = _potential(found, _features(found, model.terms), model.weights, model.bias)
            p, _ = _marginals(found, potential, model.moves)
            clean = np.bincount(found.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts))
            score[texts.first : texts.first + len(texts)] = 1 - np.exp(clean)
            hot = np.flatnonzero(p >= threshold)
            if len(hot):
                fresh = np.ones(len(hot), bool)
                fresh[1:] = (hot[1:] != hot[:-1] + 1) | (found.doc[hot[1:]] != found.doc[hot[:-1]])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(hot)) - 1
                top = np.maximum.reduceat(p[hot], first)
                for a, b, q in zip(hot[first], hot[last], top, strict=True):
                    d = found.doc[a]
                    o = texts.offsets[d]
                    one = {"start": int(found.start[a] - o), "end": int(found.end[b] - o), "p": float(q)}
                    spans[texts.first + d].append(one)
        columns = [batch.column("id"), pa.array(score), pa.array(spans, pa.list_(span))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "score", "spans"])


def score_documents(
    docs: DataFrame, labels: DataFrame, fold: int = 0, parts: int = 5, config: Training = Training()
) -> DataFrame:
    """Learn from labelled documents outside a fold and score all: doc_id, held_out, score, predicted, spans."""
    held = split_part("doc_id", parts) == fold
    known = labels.where(~held & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    few = [known.where(F.col("toxic") == label).orderBy(*order).limit(config.sample) for label in (0, 1)]
    # Twice ``sample`` ids at most, so the texts of the others need not move.
    learned = docs.where(~held).select("doc_id", "text").join(F.broadcast(few[0].union(few[1])), "doc_id")
    model = fit(learned.select(F.col("doc_id").alias("id"), "text", "toxic"), config)
    return tag(docs, model, config.threshold).select(
        "doc_id", held.alias("held_out"), "score", "predicted", "spans"
    )
