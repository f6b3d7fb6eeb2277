"""MinHash, embeddings, suffixes and components against plain Python."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa

from stepweave.llm import embeddings, lines, minhash, suffix
from stepweave.llm import text as tx
from stepweave.llm.components import components
from tests.llm import tables as t


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(200, 230)]
    other = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    links = chain + star + other
    df = spark.createDataFrame([*links, (5, 5), (None, 3), (7, None), links[0]], "a long, b long")
    found = {r.node: r.component for r in components(df).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert found == t.smallest_reachable(sorted({x for pair in links for x in pair}), links)


def _minhash_expected(rows, n):
    sets = {i: t.shingle_set(text, n) for i, text, *_ in rows if i is not None}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    at = t.smallest_reachable(ids, links)
    return sorted(
        (
            (i, len(t.shingle_set(text, n)), None if i is None else at[i], i is None or at[i] == i)
            for i, text, *_ in rows
        ),
        key=str,
    )


def test_minhash_equals_all_pairs(spark):
    rows = t.documents()
    found = minhash.near_duplicates(t.frame(spark, rows), minhash.MinMax(words=2))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == _minhash_expected(rows, 2)


def test_minhash_in_small_blocks(spark):
    """A group of near copies of all degrees, most of which no leader links."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(60), rng.randint(0, 9)):
            words[k] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    config = minhash.MinMax(words=2, leader_rounds=1, block=8)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), config)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _minhash_expected(rows, 2)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], t.DOCS)
    assert minhash.near_duplicates(docs).collect() == []
    assert suffix.remove_repeats(docs).collect() == []
    assert lines.remove_lines(docs).collect() == []
    assert embeddings.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def _vectors():
    rng = np.random.default_rng(4)
    rows = [[float(x) for x in rng.normal(size=8)] for _ in range(70)]
    for k in range(0, 40, 2):
        near = np.array(rows[k]) + rng.normal(size=8) * rng.choice([0.01, 0.2, 0.3])
        rows.append([float(x) * 5 for x in near])
    rows += [rows[3], rows[3], rows[5], [1.0, 2.0], [1.0, 2.1], [1e-200] * 8, [1e200] * 8]
    bad = [None, [], [0.0] * 8, [1.0, None] + [1.0] * 6, [math.nan] + [1.0] * 7, [math.inf] * 8]
    return [*enumerate(rows), *enumerate(bad, 500), (None, rows[3])]


def test_embeddings_equal_all_pairs(spark):
    rows = _vectors()
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and i < 500]
    unit = {i: (v / abs(v).max()) / np.linalg.norm(v / abs(v).max()) for i, v in good}
    links = [
        (a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    ]
    n = {i: sum(i in pair for pair in links) for i, _ in rows}
    ids = [i for i, _ in rows if i is not None]
    at = t.smallest_reachable(ids, links)
    expected = [(i, n[i] if i is not None else 0, at.get(i), i is None or at[i] == i) for i, _ in rows]
    df = t.frame(spark, rows, "vec_id long, embedding array<double>")
    found = embeddings.link_embeddings(df, embeddings.Tiles(block=16, tile=8))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(2)
    units = embeddings.unit_vectors(rng.normal(size=(300, 24)) ** 3)
    codes, scales, bounds = embeddings.quantise(units)
    exact = units @ units.T
    rough = (codes.astype(float) @ codes.astype(float).T) * scales[:, None] * scales
    assert (abs(exact - rough) <= bounds[:, None] + (1 + bounds[:, None]) * bounds).all()


def _suffix_expected(rows, length=50):
    seen: dict[bytes, int] = {}
    texts = {}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        texts.setdefault((i, text), raw)
        if i is not None:
            for p in range(len(raw) - length + 1):
                w = raw[p : p + length]
                seen[w] = min(seen.get(w, i), i)
    out = []
    for i, text, *_ in rows:
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if i is not None and seen[raw[p : p + length]] < i:
                cover[p : p + length] = b"\1" * length
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffixes_equal_all_windows(spark):
    rows = t.documents(seed=8, n=40)
    config = suffix.Repeats(bucket_bytes=20_000)
    found = suffix.remove_repeats(t.frame(spark, rows), config, with_bytes=True)
    rows_found = found.collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_found]
    assert sorted(got, key=str) == _suffix_expected(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows_found)
    assert all(r.n_removed == sum(b - a for a, b in r.spans) for r in rows_found)


def test_suffixes_of_a_hot_anchor(spark):
    """One passage in very many differing contexts, sorted in small parts."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(k, "".join(rng.choice("abcd") for _ in range(k % 60)) + passage[k % 9 :] + str(k) * 9) for k in range(300)]
    rows += [(500, rows[7][1]), (400, rows[7][1]), (None, passage), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix.remove_repeats(docs, suffix.Repeats(bucket_bytes=8_000, sorted_bytes=500)).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]
    assert sorted(got, key=str) == _suffix_expected(rows)


def test_suffix_contexts_are_shuffled_small():
    """Of texts that repeat throughout, what is shuffled takes less than half of what all contexts have."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(400)), "text": texts + texts})
    config = suffix.Repeats()
    bloom = np.full((1 << config.filter_bits) // 8, 255, np.uint8)
    rows = pa.Table.from_batches(suffix._contexts(iter([batch]), 8, bloom, config))
    shuffled = rows.get_total_buffer_size()
    runs = suffix.runs(next(tx.slices(batch.column("text").slice(0, 200))), config)
    assert 2 * shuffled < (runs.size + config.length - 1 + 28).sum()
    parts = [suffix._unpack(x.as_buffer(), *suffix.PARTS) for x in rows.column("packed")]
    assert sum(int(p[3].sum()) for p in parts) == 2 * len(runs.doc)


def test_suffix_contexts_alone_of_their_anchor_are_not_sorted(monkeypatch):
    """Copies have equal contexts, which are one; only those around a change share their anchor with others."""
    rng = random.Random(12)
    copies = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(4)]
    rows = list(enumerate([*copies, *copies, copies[0][:1000] + "x" + copies[0][1000:], copies[1][:90] * 3]))
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [text for _, text in rows]})
    config = suffix.Repeats()
    bloom = np.full((1 << config.filter_bits) // 8, 255, np.uint8)
    packed = list(suffix._contexts(iter([batch]), 1, bloom, config))
    seen, sort = [], suffix.sorted_suffixes
    monkeypatch.setattr(suffix, "sorted_suffixes", lambda data, length: seen.append(len(data)) or sort(data, length))
    covers = {i: bytearray(len(text)) for i, text in rows}
    for found in suffix._spans(iter(packed), config):
        for i, interval in zip(found.column("doc").to_pylist(), found.column("interval").to_pylist(), strict=True):
            a, n = interval >> suffix.SPAN_BITS, interval & ((1 << suffix.SPAN_BITS) - 1)
            covers[i][a : a + n] = b"\1" * n
    assert [(i, sum(c)) for i, c in covers.items()] == [(r[0], r[2]) for r in sorted(_suffix_expected(rows))]
    assert 0 < sum(seen) < 3000


def test_sorted_suffixes_are_in_order():
    rng = np.random.default_rng(5)
    for n, letters, length in ((1, 1, 50), (40, 1, 7), (700, 2, 1), (3000, 3, 9), (3000, 30, 50), (2000, 255, 50)):
        data = rng.integers(0, letters, n).astype(np.uint8)
        data[n // 2 : n // 2 + n // 3] = data[: n // 3]
        wound = np.resize(data, n + length).tobytes()
        order = suffix.sorted_suffixes(data, length).tolist()
        assert sorted(order) == list(range(n))
        prefixes = [wound[k : k + length] for k in order]
        assert prefixes == sorted(prefixes)


def test_equal_windows_equal_a_dictionary():
    rng = np.random.default_rng(1)
    for n, letters, length in ((200, 2, 5), (500, 3, 8), (60, 1, 50), (300, 2, 50)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        data[n // 2 : n // 2 + n // 4] = data[: n // 4]
        data[n // 5 : n // 5 + 3] = 0
        data[[n // 3, n - 1]] = suffix.SEPARATOR
        place, number = suffix.equal_windows(data, length)
        sets: dict[int, set] = {}
        for p, k in zip(place.tolist(), number.tolist(), strict=True):
            sets.setdefault(k, set()).add(p)
        by_text: dict[bytes, set] = {}
        for p in range(n - length + 1):
            if not (data[p : p + length] == suffix.SEPARATOR).any():
                by_text.setdefault(data[p : p + length].tobytes(), set()).add(p)
        assert sorted(map(sorted, sets.values())) == sorted(sorted(s) for s in by_text.values() if len(s) > 1)


def test_lines_equal_counts_of_sites(spark):
    rows = t.documents()
    ends = ("\r\n", "\n", " \t\r\n")
    rows += [(200 + i, f"windows and others{ends[i]}text {i}", "en", f"src{i}", 1) for i in range(3)]
    sites: dict[str, set] = {}
    for _, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            if source is not None:
                sites.setdefault(line.strip(" \t\r"), set()).add(source)
    expected = []
    for i, text, *_ in rows:
        all_lines = [] if text is None else text.split("\n")
        gone = [bool(x.strip(" \t\r")) and i is not None and len(sites.get(x.strip(" \t\r"), ())) >= 3 for x in all_lines]
        kept = None if text is None else "\n".join(x for x, g in zip(all_lines, gone, strict=True) if not g)
        expected.append((i, len(all_lines), sum(gone), kept))
    found = lines.remove_lines(t.frame(spark, rows), lines.Spread(sites=3))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(expected, key=str)
    assert any(r[2] for r in expected)
    assert all(r[2] == 1 for r in expected if r[0] is not None and 200 <= r[0] < 203)
