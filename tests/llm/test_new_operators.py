"""Byte-level BPE, whitening and periodic runs against plain Python."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
from stepweave.llm import bpe, periods, whitening
from stepweave.llm.registered import byte_bpe, with_repeats
from tests.llm import tables as t

SF_DIR = "/root/testdata/sf0.001"


def library():
    import tiktoken

    config = byte_bpe()
    return tiktoken.Encoding(
        "own", pat_str=config.pattern, mergeable_ranks=bpe._ranks(config.path), special_tokens={}
    )


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("chunk, overlap", [(64, 24), (700, 100)])
def test_chunks_are_encoded_like_whole_texts(spark, chunk, overlap):
    rng = random.Random(3)
    marks = ["a", "b", " ", "  ", "'s", "'re", "'", "é", "字", "😀", "\n", "\n\n", "1", "²", "!!", "\x1c", "\x00"]
    marks += ["՘", "\U000323b1"]  # letters in one Unicode version, and not in another
    rows = [(i, "".join(rng.choices(marks, k=rng.randint(0, 300)))) for i in range(60)]
    # Long pre-tokens, over many chunks, and places where a chunk begins inside one.
    long = ["a" * 2000, " " * 300 + "x", "ab " * 40 + "a" * 200 + " b" * 40, "\n" * 900 + "x", "字" * 400]
    rows += [(200 + i, text) for i, text in enumerate([*long, "''" * 500 + "start " * 20, None, "", "é"])]
    rows += [(None, "abc " * 300), (None, None), rows[3], rows[3], rows[60], rows[60]]
    df = t.frame(spark, rows, "doc_id long, text string").withColumnRenamed("part", "ids")
    config = bpe.Bpe(byte_bpe().path, byte_bpe().pattern, chunk, overlap)
    found = bpe.decode(bpe.encode(df, config), config.path).collect()
    engine = library()
    wanted = Counter((i, packed(engine.encode_ordinary(x or "")), (x or "").encode()) for i, x in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found) == wanted
    assert all(4 * r.n_tokens == len(r.ids) for r in found)


def test_bpe_of_empty_tables_and_bad_bytes(spark):
    config = byte_bpe()
    df = t.frame(spark, [(1, "x")], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df.limit(0), config), config.path).collect() == []
    (row,) = bpe.decode(bpe.encode(df.selectExpr("doc_id", "cast(x'61ff62' as string) as text"), config), config.path).collect()
    assert bytes(row.decoded).decode() == "a�b"
    (none,) = bpe.decode(df.selectExpr("doc_id", "cast(null as binary) as ids"), config.path).collect()
    assert none.decoded is None


def test_op11_equals_the_library(spark):
    engine = library()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in contract.queries()["op11_byte_bpe"](spark, SF_DIR).collect()}
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = engine.encode_ordinary(text or "")
        assert found[doc_id][1:] == (
            len(ids),
            hashlib.sha256(packed(ids)).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )


def whitened_by_hand(rows):
    """Per id: deviation, and unsigned whitened values; shares; over rows of (id, vector)."""
    whole = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in whole}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in whole:
        gap = [n * int(a) - int(s) for a, s in zip(x, sums, strict=True)]
        out.append((i, sum(g * g for g in gap), np.abs(np.array(gap, float) / n @ vectors / np.sqrt(np.abs(values)))))
    return n, out, values / np.trace(cov)


def equal_whitening(found, rows, k):
    n, wanted, shares = whitened_by_hand(rows)
    assert len(found) == k * len(rows)
    got = Counter((r.vec_id, r.component, int(r.deviation), round(abs(r.whitened), 7) + 0.0) for r in found)
    assert got == Counter((i, c + 1, dev, round(w[c], 7) + 0.0) for i, dev, w in wanted for c in range(k))
    for r in found:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6)) * [9, 5, 3, 2, 1, 0.5]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(90, rows[3][1]), rows[4], rows[4], (None, rows[5][1]), (91, [-0.0, 0.0, 0.0, 0.0, 0.0, -0.0])]
    odd = [(92, None), (93, []), (94, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (95, [float("nan")] * 6), (96, [float("-inf")] * 6), (97, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>"
    df = t.frame(spark, rows + odd, schema).selectExpr("*", "1 as n", "2 as component", "3 as x", "4 as v")
    equal_whitening(whitening.whiten(df).collect(), rows, 6)
    assert whitening.whiten(df, whitening.Whitening(components=2)).count() == 2 * len(rows)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id = 4")).collect() == []  # one vector varies in nothing


def test_whitening_without_full_rank_and_with_huge_entries(spark):
    rng = np.random.default_rng(5)
    flat = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 5))
    flat = np.round(flat * 64) / 64
    rows = [(i, [*v.tolist(), 7.0]) for i, v in enumerate(flat)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(df).collect()} <= set(range(1, 6))
    huge = [(i, [1e300 * (i % 2), float(i), 3e11 * i]) for i in range(6)]
    found = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    x = [[whitening.LARGEST if v >= 2**44 else math.floor(64 * v) + 1_000_000 for v in row] for _, row in huge]
    sums = [sum(column) for column in zip(*x, strict=True)]
    for r in found:
        assert int(r.deviation) == sum((6 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))


def test_op12_equals_plain_algebra(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    equal_whitening(contract.queries()["op12_whitening"](spark, SF_DIR).collect(), rows, 16)


def test_factors_of_a_matrix():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(9, 5)) * [1e3, 10, 1, 0.1, 0.05]
    matrix = a @ a.T
    factor = whitening.pivoted_cholesky(matrix)
    assert factor.shape == (9, 5)
    assert np.abs(factor @ factor.T - matrix).max() < 1e-9
    # Row by row in the order of the pivots it is triangular, and no diagonal entry is below a later one.
    pivots = [int(np.flatnonzero((factor[:, k] != 0) & (factor[:, k + 1 :] == 0).all(axis=1))[0]) for k in range(5)]
    square = factor[pivots]
    assert (square == np.tril(square)).all() and (np.diff(np.diagonal(square)) <= 0).all()
    rotated = whitening.jacobi(factor)
    norms = np.linalg.norm(rotated, axis=0)
    gram = (rotated / norms).T @ (rotated / norms)
    assert np.abs(gram - np.eye(len(gram))).max() < 1e-12
    assert np.allclose(np.sort(norms)[::-1][:5], np.linalg.svd(a)[1], rtol=1e-6)
    assert whitening.components_of(np.zeros((3, 3)))[0].size == 0


def all_runs(words, times=4, least=6):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i : i + length]
            if length >= max(least, times * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("times, least", [(4, 6), (2, 2), (3, 7)])
def test_runs_equal_all_periods(times, least, monkeypatch):
    monkeypatch.setattr(periods, "TREE_WORDS", 50)
    rng = random.Random(5)
    texts = []
    for _ in range(700):
        some = "abcde"[: rng.choice([1, 2, 2, 3, 5])]
        words = rng.choices(some, k=rng.randint(0, 40))
        if rng.random() < 0.6:
            words += rng.choices(some, k=rng.randint(1, 6)) * rng.randint(2, 7) + rng.choices(some, k=rng.randint(0, 5))
        texts.append(rng.choice([" ", "\t\n "]).join(words))
    for part in periods.tx.slices(pa.array(texts)):
        found = np.stack(periods.runs_of(part, periods.Runs(times, least)))
        for d in range(len(part)):
            own = [tuple(x) for x in found[1:, found[0] == d].T.tolist()]
            assert own == all_runs(texts[part.first + d].split(), times, least)


def test_extensions_equal_comparison():
    rng = np.random.default_rng(7)
    line = rng.integers(0, 2, 300)
    tree = periods.SuffixTree(line)
    a, b = rng.integers(0, 300, (2, 4000))
    a, b = a[a != b], b[a != b]
    text = line.tolist()
    for x, y, k in zip(a, b, tree.extension(a, b), strict=True):
        longest = 300 - max(x, y)
        assert text[x : x + k] == text[y : y + k] and (k == longest or text[x + k] != text[y + k])
    suffixes = sorted(range(300), key=lambda i: text[i:])
    assert np.argsort(tree.ranks()).tolist() == suffixes
    suffixes = sorted(range(300), key=lambda i: [-c for c in text[i:]])
    assert np.argsort(tree.ranks(opposite=True)).tolist() == suffixes


def expected_runs(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    found = all_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * top[1] // top[2] if found else None
    return found, (*top, milli), kept.decode()


def test_runs_of_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, f"{text} " + "u v w " * (i % 7) + "end") for i, text, *_ in t.documents(n=30)[:30]]
    rows += [(50, None), (51, ""), (52, " \n"), (53, "a" * 300), (54, "A a " * 9), (55, "x\0 " * 8 + "x y")]
    rows += [(56, "é " * 3000), (57, " ".join(rng.choices("ab", k=900))), (None, "q " * 8), (None, None), rows[5], rows[5]]
    df = t.frame(spark, rows, "doc_id long, text string").selectExpr("*", "1 as n_runs", "2 as runs", "3 as length")
    found = Counter(
        (r.doc_id, r.n_runs, tuple(map(tuple, r.runs)), r.start, r.length, r.period, r.exponent_milli, r.collapsed)
        for r in periods.periodic_runs(df).collect()
    )
    wanted = Counter()
    for doc_id, text in rows:
        runs, top, kept = expected_runs(text)
        wanted[(doc_id, len(runs), tuple(runs), *top, kept)] += 1
    assert found == wanted
    assert periods.periodic_runs(df.limit(0)).collect() == []


def test_op13_equals_all_periods(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in contract.queries()["op13_periodic_runs"](spark, SF_DIR).collect()}
    assert len(found) == len(docs)
    repeated = 0
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, top, kept = expected_runs(" ".join(words))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        repeated += bool(runs)
        assert found[doc_id][1:] == (
            len(runs),
            *top,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(kept.encode()).hexdigest(),
        )
    assert repeated > 5


def test_repeats_need_words_and_an_id(spark):
    rows = [(None, "a b c"), (31, None), (31, ""), (31, " \n"), (31, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, with_repeats(df).collect())) == Counter(rows)
