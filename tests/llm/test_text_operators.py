"""Language, toxicity, benchmark leaks, token files, mixing and chats."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from stepweave.llm import chat, coder, decontaminate, langid, minhash, mixing, shared, sql, tokens, toxicity
from stepweave.llm.registered import tokenizer_path
from stepweave.llm.shared import folder
from tests.llm import tables as t
from workload.compare import difference, duckdb_tables

SF_DIR = "/root/testdata/sf0.001"


def test_languages_are_found_and_odd_texts_are_und(spark):
    rows = t.documents(n=95)
    docs = t.frame(spark, rows)
    model = langid.fit(docs.where("doc_id < 70"))
    found = langid.predict(docs, model, keep=["lang", "score"], prefix="_").collect()
    assert len(found) == len(rows)
    lang = {}
    for r in found:
        lang.setdefault(r.doc_id, set()).add(r._lang_pred)
        assert 0 <= r._score <= 1 and r.score == "x"
    assert lang[100] == lang[101] == lang[103] == lang[104] == {"und"}
    held = [r for r in found if r.doc_id is not None and 70 <= r.doc_id < 95]
    assert np.mean([r._lang_pred == r.lang for r in held]) >= 0.9


def test_no_language_is_learned_from_nothing(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert [r.lang_pred for r in langid.predict(docs, model).collect()] == ["und"]
    assert langid.predict(docs.limit(0), model).collect() == []


def test_letters_are_found_anywhere(spark):
    """The test for letters looks at the first characters, and at all others only where those hold none."""
    rows = [(k, text, "en") for k, text in enumerate(["7 " * 40 + "word", "\U0001d7d8" * 70 + "\u00e9", "7 " * 90, "", None, "a"])]
    docs = t.frame(spark, rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert found == {0: "en", 1: "en", 2: "und", 3: "und", 4: "und", 5: "en"}
    # Texts are searched as a whole only where their beginning holds no letter.
    plan = docs.select(langid._has_letter(docs.text))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("substring(text") < plan.rfind("text")


def test_every_label_is_learned_and_groups_of_automata_decide_alike(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(230):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)]
        texts = [" ".join(rng.choices(own, k=12)) for _ in range(1 if i == 229 else 2)]
        rows += [(len(rows) + k, text, f"l{i:03}") for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert [a.lang for a in model.automata] == [f"l{i:03}" for i in range(230)]
    found = sorted(langid.predict(docs, model).collect())
    assert [r.lang_pred for r in found] == [lang for *_, lang in rows]
    batch = langid.pa.RecordBatch.from_pydict({"text": [r[1] for r in rows], "has_letter": [True] * len(rows)})
    monkeypatch.setattr(langid, "TABLE_BYTES", 1 << 19)
    monkeypatch.setattr(langid, "CELLS", 230 * 100)
    assert 1 < len(langid._groups(model)) < 230
    parts = list(langid._predict(iter([batch]), model, ["text"]))
    assert len(parts) > 1
    again = [x for p in parts for x in zip(p["lang_pred"].to_pylist(), p["phrases"].to_pylist(), strict=True)]
    assert again == [(r.lang_pred, r.phrases) for r in found]


def test_phrases_equal_longest_matches():
    import pyarrow as pa

    rng = random.Random(1)
    sample = "".join(rng.choice("ab ") for _ in range(60))
    table = np.zeros(256, np.uint8)
    table[[97, 98]] = [1, 2]
    table[99] = 3  # in no sample
    stream = langid._squeeze(table[np.frombuffer(sample.encode(), np.uint8)])
    model = langid.LanguageModel(table, 4, (langid._automaton("x", stream),))
    known = bytes(stream)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (0, 1, 5, 200, 700)]
    for one in langid.tx.slices(pa.array(texts)):
        found = langid._phrases(one, [langid._table(a, 4) for a in model.automata], model)[:, 0]
    for text, n in zip(texts, found, strict=True):
        symbols = bytes(langid._squeeze(table[np.frombuffer(text.encode(), np.uint8)]))
        count = 0
        for at in range(0, len(symbols), langid.WINDOW):
            rest = symbols[at : at + langid.WINDOW]
            while rest:
                k = max((k for k in range(1, len(rest) + 1) if rest[:k] in known), default=1)
                count, rest = count + 1, rest[k:]
        assert n == count


def test_toxic_documents_are_found(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(800):
        words = t.sentence(rng, "en", 40).split(" ")
        if i % 8 == 0:
            words[rng.randrange(40)] = rng.choice(["idiot", "moron", "zork" + rng.choice("abcdefgh") * 3])
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0)))
    odd = [(900, None), (901, ""), (902, "12 34"), (None, "idiot"), (903, "IDIOT, you"), docs[8], docs[8]]
    df = t.frame(spark, docs + odd, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (8, None), (8, 1), (None, 1), (7777, 0)], "doc_id long, toxic int")
    found = toxicity.score_documents(df, known).collect()
    assert len(found) == len(docs) + len(odd)
    by_id = {r.doc_id: r for r in found}
    held = [by_id[i] for i, _ in docs if by_id[i].held_out]
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in held]) > 0.95
    assert all(by_id[i].score == 0 and by_id[i].spans == [] for i in (900, 901, 902))
    assert by_id[903].predicted == 1 and by_id[903].spans[0][:2] == (0, 5) and by_id[None].predicted == 1


def test_toxicity_of_empty_tables_and_without_labels(spark):
    docs = t.frame(spark, t.documents(n=12))
    known = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs.limit(0), known).collect() == []
    for none in (known.limit(0), known.selectExpr("doc_id", "cast(null as int) as toxic")):
        found = toxicity.score_documents(docs, none).collect()
        assert len(found) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_marginals_equal_sums_over_all_sequences():
    import itertools

    import pyarrow as pa

    (one,) = toxicity.tx.slices(pa.array(["a b c d", "", "e"]))
    found = toxicity.tx.words(one, toxicity.tx.LETTERS)
    rng = np.random.default_rng(1)
    potential, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    p, pairs = toxicity._marginals(found, potential, moves, pairs=True)
    total, each, both = 0.0, np.zeros(4), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=4):
        w = np.exp(sum(potential[k] * y[k] for k in range(4)) + sum(moves[y[k], y[k + 1]] for k in range(3)))
        total, each = total + w, each + w * np.array(y)
        for k in range(3):
            both[y[k], y[k + 1]] += w
    assert np.allclose(p[:4], each / total) and np.isclose(p[4], 1 / (1 + np.exp(-potential[4])))
    assert np.allclose(pairs, both / total)


def test_leaks_are_found_with_substitutions(spark):
    rng = random.Random(6)
    items = [(i, t.sentence(rng, "en", 25) + f" item{i} " + t.sentence(rng, "en", 15)) for i in range(6)]
    items += [(90, None), (91, ""), (92, "too short"), (None, items[0][1]), items[2]]
    docs, expected = [], set()
    for i in range(30):
        words = t.sentence(rng, "en", 80).split(" ")
        if i % 3 == 0:
            passage = items[i % 6][1].split(" ")
            if i % 2:
                for k in range(4, len(passage), 7):
                    passage[k] = "else"
            words[20:20] = passage
            expected.add((i, i % 6))
        elif i % 3 == 1:  # as many equal words, but never in a row
            words[20:20] = [w for a in items[i % 6][1].split(" ") for w in (a, "x", "y")]
        docs.append((i, " ".join(words).upper()))
    docs += [(200, None), (201, ""), (None, items[1][1]), docs[3], (202, items[5][1])]
    expected.add((202, 5))
    df, bench = t.frame(spark, docs, "doc_id long, text string"), t.frame(spark, items, "item_id long, text string")
    found = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
    texts = dict(docs)
    for r in found:
        own = texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()
        assert len(re.findall(r"\w+", own)) == r.n_words and 100 * r.n_equal >= 80 * r.n_words
    assert decontaminate.contaminated(df.limit(0), bench).collect() == []
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == []


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_best_overlap_equals_a_loop_over_all_spans(percent):
    rng = np.random.default_rng(percent)
    rows = [rng.random(n) < p for n in (0, 1, 5, 13, 14, 40) for p in (0.0, 0.3, 0.7, 0.85, 1.0) for _ in range(12)]
    for equal in rows:
        for least in (1, 13):
            spans = [(a, b) for a in range(len(equal)) for b in range(a + least, len(equal) + 1)]
            good = [(a, b) for a, b in spans if 100 * equal[a:b].sum() >= percent * (b - a)]
            best = max(good, key=lambda s: (s[1] - s[0], equal[s[0] : s[1]].sum(), -s[0]), default=(0, 0))
            assert decontaminate.best_overlap(equal, percent, least) == best


def test_an_equal_word_far_away_hides_no_overlap(spark):
    item = [f"w{i}" for i in range(40)]
    words = item[:17] + [f"x{i}" for i in range(23)]
    words[12], words[30] = "else", item[30]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    (found,) = decontaminate.contaminated(df, bench).collect()
    # 16 equal words and the first ones of what follows, as far as 80 percent agree
    assert (found.start_word, found.n_words, found.n_equal) == (0, 20, 16)


def test_masks_miss_no_overlap_of_the_rule():
    config = decontaminate.Seeds()
    assert config.whole == config.min_words == 13
    assert [decontaminate.missed(config, n) for n in range(13, 26)] == [0] * 13
    assert decontaminate.missed(decontaminate.Seeds(masks=("1101011011", "1110010111", "1011101101")), 15) == 61


def _overlap_by_force(words, item):
    """Longest span that meets the rule on each diagonal; of these the one with most equal words, then the first."""
    best = None
    for diagonal in range(-len(item) + 1, len(words)):
        low, high = max(0, -diagonal), min(len(item), len(words) - diagonal)
        equal = [words[k + diagonal] == item[k] for k in range(low, high)]
        upto = np.concatenate(([0], np.cumsum(equal, dtype=int)))
        spans = [(a, b) for a in range(len(equal)) for b in range(a + 13, len(equal) + 1)]
        good = [(b - a, int(upto[b] - upto[a]), -a) for a, b in spans if 100 * (upto[b] - upto[a]) >= 80 * (b - a)]
        if good:
            n, same, back = max(good)
            best = max(best or (0,), (same, -(diagonal + low - back), n))
    return best


def test_long_items_equal_all_spans_of_all_diagonals(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(13, 45))]) for i in range(12)]
    items.append((12, ["same"] * 30))
    docs = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        if i % 8:
            item = items[i % len(items)][1]
            n = rng.randint(13, min(25, len(item)))
            start = rng.randint(0, len(item) - n)
            passage = list(item[start : start + n])
            for k in rng.sample(range(n), min(n, n // 5 + (i % 3 == 0))):  # as many as the rule allows, or one more
                passage[k] = f"x{k}"
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, words))
    docs.append((7, list(items[3][1])))  # another text of the same id
    docs.append((300, ["same"] * 700))
    items.append((2, list(items[5][1])))  # another text of the same item
    expected = {}
    for i, words in docs:
        for j, item in items:
            best = _overlap_by_force(words, item) if i != 300 or j == 12 else None
            if best:
                one = (*best, len(item))
                expected[i, j] = max(expected.get((i, j), one), one)
    assert len(expected) > 80
    df = t.frame(spark, [(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = t.frame(spark, [(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontaminate.contaminated(df, bench).collect()
    assert len(found) == len(expected)
    assert {(r.doc_id, r.item_id): (r.n_equal, -r.start_word, r.n_words, r.item_words) for r in found} == expected


def test_a_document_of_one_word_takes_one_row_per_item(spark):
    df = spark.createDataFrame([(1, "so " * 16_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "so " * 60), (6, "so " * 59 + "what")], "item_id long, text string")
    found = {r.item_id: (r.start_word, r.n_words, r.n_equal) for r in decontaminate.contaminated(df, bench).collect()}
    assert found == {5: (0, 60, 60), 6: (0, 60, 59)}


def test_short_items_are_found_wherever_they_differ(spark):
    rng = random.Random(8)
    items, docs, expected = [], [], set()
    for n in range(1, 13):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for copy in range(8):
            differ = min(copy % 4, n)
            at = rng.sample(range(n), differ) if copy < 4 else [0, n - 1, 1][:differ]
            own = [f"x{k}" if k in at else w for k, w in enumerate(words)]
            docs.append((len(docs), " ".join(["before", *own, "after"] if copy % 2 else own)))
            equal = sum(a == b for a, b in zip(own, words, strict=True))
            if 100 * equal >= 80 * n:
                expected.add((docs[-1][0], n, n, equal, copy % 2))
    docs += [(500, "i3w0 i3w1"), (501, "i5w0 i5w1 i5w2 i5w3 x " * 2 + items[4][1]), (None, items[3][1]), docs[0]]
    expected.add((501, 5, 5, 5, 10))
    items += [(40, None), (41, ""), (42, "- -"), items[2]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(df, bench).collect()
    assert len(found) == len(expected)
    assert {(r.doc_id, r.item_id, r.n_words, r.n_equal, r.start_word) for r in found} == expected
    texts = dict(docs)
    assert all(len(texts[r.doc_id][r.start_byte : r.end_byte].split(" ")) == r.n_words == r.item_words for r in found)


@pytest.mark.parametrize("lanes", [3, 1024])
def test_coder_gives_back_what_it_got(monkeypatch, lanes):
    monkeypatch.setattr(coder, "LANES", lanes)
    rng = np.random.default_rng(3)
    blocks = [rng.zipf(1.3, n).clip(0, 65_535).astype(np.uint32) for n in (0, 1, 2, 300, 299)]
    blocks += [np.full(400, 65_535, np.uint32), rng.integers(0, 65_536, 200).astype(np.uint32)]
    blocks += [np.tile(rng.integers(0, 50_000, 20), 30).astype(np.uint32)]
    data = coder.encode(blocks)
    for a, b in zip(blocks, coder.decode(data, [len(x) for x in blocks]), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    assert len(data[-1]) < 200  # ids that come again are predicted


def _token_rows(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    out, start = [], 0
    for i, text, *_ in order:
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_token_files_hold_every_document(spark, block):
    rows = [r for r in t.documents(n=25) if r[0] is not None] + [(-5, "It's an odd\x1c text é", "en", "s", 1)]
    config = tokens.Output(tokenizer_path(), block=block)
    path = folder(spark, "ids")
    tokens.write(t.frame(spark, rows), path, config)
    found = tokens.digest(spark, path)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(_token_rows(rows))
    pieces = tokens.read(spark, path).orderBy("part", "at").collect()
    assert all(zlib.crc32(p.ids) == p.crc for p in pieces)
    assert sum(len(p.ids) for p in pieces) == 4 * sum(r[2] for r in _token_rows(rows))


def test_each_word_is_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    texts = ["one 0 two\t10,0 three's 00", "", "  two\n one\x0b\x0cthree's caf\u00e9 e\u0301 0", "\u0301 \u03a3 A\u03a3", "one", "\u2003\x1c"]
    texts += [" ".join(f"{w}{k}" for k in range(450)) for w in ("a", "b", "a")]
    given = []
    encoded = tokens._encoded
    monkeypatch.setattr(tokens, "_encoded", lambda m, words: given.extend(words) or encoded(m, words))
    monkeypatch.setattr(tokens, "_models", {})
    encode = tokens._tokenizer(tokenizer_path())
    for _ in range(2):
        ids, ends = encode(pa.array(texts))
        found = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert found == [model.encode(x, add_special_tokens=False).ids for x in texts]
        assert len([w for w in given if w]) == len({w for w in given if w}) > 900


ATOMS = ["a", "B", "the", "Don", "'", "'s", "'T", "ll", "1", "23", "\u00bd", "\u00e9", "\u00c9", "\u00df", "\u00d7", "\u00f7", "\u00ff"]
ATOMS += ["J\u030c", "T\u0308", "\u030c", "o\u0308", "\u03a3", "\u0130", "\u4e2d", "\u00a0", "\u0085", "\x1c", "\x00", "\x7f", " ", "  "]
ATOMS += ["\n", "\t", "\r\n", "\x0b", ".", ",", "!?", "...", "-", "_", "(", "<", "<|", "<|endoftext|>", "|>", "</w>", "\u0120", '"']


def test_plain_words_are_parted_as_the_library_parts_them(monkeypatch):
    """Letters and marks apart, cases joined: what needs all steps of the tokenizer is seldom."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    given = []
    encoded = tokens._encoded
    monkeypatch.setattr(tokens, "_encoded", lambda m, words: given.extend(words) or encoded(m, words))
    monkeypatch.setattr(tokens, "_models", {})
    encode = tokens._tokenizer(tokenizer_path())
    ids, ends = encode(pa.array(["left out", "\u00dcber (Stra\u00dfe), UND... Stra\u00dfe-und \u00fcBER", "don't", None, "und"]).slice(1).fill_null(""))
    assert given == ["don't"]
    assert ids.tolist() == model.encode("\u00fcber ( stra\u00dfe ), und ... stra\u00dfe - und \u00fcber don't und", add_special_tokens=False).ids
    rng = np.random.default_rng(4)
    for n in range(60):
        texts = ["".join(rng.choice(ATOMS, rng.choice([0, 1, 3, 10, 60]))) for _ in range(40)]
        ids, ends = encode(pa.array(texts))
        found = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert found == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_words_come_once_in_many_megabytes(monkeypatch):
    """Of words beyond those kept, none is given to the library again within 16 MB of texts; ASCII takes fewer steps."""
    words = [[c + a + b for a in "abcdefghijklmnopqrstuvw" for b in "aeiou\u00e9"] for c in "xyz"]
    texts = [" ".join(some * 8_000) for some in (words[0], words[1], words[0], words[2])]
    given, encode = [], tokens._Plain.encode
    monkeypatch.setattr(tokens._Plain, "encode", lambda self, some: given.extend(some.to_pylist()) or encode(self, some))
    monkeypatch.setattr(tokens, "WORDS_KEPT", 3)
    monkeypatch.setattr(tokens, "_models", {})
    coded = tokens._tokenizer(tokenizer_path())
    sizes = []
    for _, some in tokens._slices(pa.array(range(4)), pa.array(texts)):
        ids, ends = coded(some)
        sizes += np.diff(ends, prepend=0).tolist()
    given = [w for w in given if w]
    assert len(given) == len(set(given)) == 3 * len(words[0])
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    assert sizes == [8_000 * len(model.encode(" ".join(words[k]), add_special_tokens=False).ids) for k in (0, 1, 0, 2)]


def test_a_part_is_coded_in_one_round(monkeypatch):
    """A part of some blocks beyond ``LANES`` is one group; a few that stay behind would take all steps again."""

    class Task:
        get = classmethod(lambda cls: cls())

        def partitionId(self):
            return 0

    monkeypatch.setattr(tokens, "TaskContext", Task)
    monkeypatch.setattr(coder, "LANES", 8)
    coded, lanes = coder._encode, []
    monkeypatch.setattr(coder, "_encode", lambda blocks: lanes.append(len(blocks)) or coded(blocks))
    monkeypatch.setattr(tokens, "SLICE_BYTES", 1)
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": ["a b c d e f g h i j k l m n o"] * 9})
    found = pa.Table.from_batches(tokens._blocks(iter([batch]), tokens.Output(tokenizer_path(), block=16)))
    assert found.column("docs").to_pylist() == [[k] for k in range(9)]
    assert lanes == [9]


def test_other_rules_get_whole_words(monkeypatch, tmp_path):
    """Words are parted only under the rules known to allow it."""
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"] = {"type": "NFC"}
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    monkeypatch.setattr(tokens, "WORDS_KEPT", 3)
    texts = ["One two, THREE one", "", "Three two, One!"]
    for _ in range(2):
        ids, ends = tokens._tokenizer(str(path))(pa.array(texts))
        found = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert found == [Tokenizer.from_file(str(path)).encode(x, add_special_tokens=False).ids for x in texts]


def test_few_blocks_do_not_stay_behind(monkeypatch):
    """Some blocks beyond a group take no second round of as many steps, and groups are of one size."""
    monkeypatch.setattr(coder, "LANES", 100)
    assert [len(g) for n in (0, 1, 125, 126, 260) for g in coder.groups(range(n))] == [1, 125, 63, 63, 87, 87, 86]


def test_workers_give_memory_back(monkeypatch):
    """Workers outlive their tasks: what they free must not stay with them."""
    done = []
    monkeypatch.setattr(shared, "give_back", lambda: done.append(True))
    found = shared.tidy(lambda n, by=1: iter(range(0, n, by)))(5, by=2)
    assert next(found) == 0 and not done
    assert list(found) == [2, 4] and done == [True]
    work = [tokens._blocks, tokens._pieces, langid._predict, decontaminate._segments, decontaminate._overlaps]
    work += [minhash._sign, minhash._packed, minhash._joining, minhash._similar]
    assert all(f.__wrapped__.__name__ == f.__name__ for f in work)
    monkeypatch.undo()
    shared.give_back()


def test_checksums_of_pieces_are_joined(spark):
    """No ids are sent: those of a document that spans blocks give its checksum by theirs."""
    rng = np.random.default_rng(8)
    rows, whole = [], []
    for doc in range(30):
        parts = [rng.integers(0, 65_536, n).astype("<u4") for n in rng.integers(1, 5000, rng.integers(1, 7))]
        at = np.cumsum([17, *map(len, parts)])
        pieces = [{"at": int(a), "n_ids": len(p), "crc": zlib.crc32(p)} for a, p in zip(at, parts)]
        rows.append({"part": 0, "id": doc, "at": 17, "pieces": pieces})
        whole.append((doc, int(at[-1]) - 17, zlib.crc32(np.concatenate(parts))))
    kind = pa.list_(pa.struct([("at", pa.int64()), ("n_ids", pa.int64()), ("crc", pa.int64())]))
    schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("at", pa.int64()), ("pieces", kind)])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    found = pa.Table.from_batches(tokens._joined(iter([batch.slice(0, 11), batch.slice(11), batch.slice(0, 0)])))
    assert [(r["id"], r["n_ids"], r["crc"]) for r in found.to_pylist()] == whole
    path = folder(spark, "ids")
    tokens.write(t.frame(spark, t.documents(n=9)), path, tokens.Output(tokenizer_path(), block=7))
    plan = tokens.digest(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "binary" not in plan and "listagg" not in plan


def test_null_ids_come_first_and_empty_tables_pass(spark):
    rows = [(3, "c"), (None, "a"), (1, "b")]
    config = tokens.Output(tokenizer_path())
    found = tokens.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), config)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(_token_rows(rows), key=str)
    assert tokens.encode_documents(spark.createDataFrame([], t.DOCS), config).collect() == []


def test_coder_settles_carries_and_odd_blocks():
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, k + 1, 4 * k).astype(np.uint32) for k in range(1, 120)]
    blocks += [rng.integers(0, 65_536, 4096).astype(np.uint32), np.zeros(4096, np.uint32), np.arange(4096, dtype=np.uint32)]
    blocks += [np.tile(rng.permutation(65_536)[:1500], 3)[:4096].astype(np.uint32)]
    data = coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, coder.decode(data, [len(x) for x in blocks]), strict=True))
    assert len(data[-3]) < 100 and len(data[-4]) < 2.05 * 4096  # little for what is sure, little more than 16 bits for noise
    with pytest.raises(ValueError, match="at most"):
        coder.encode([np.zeros(4097, np.uint32)])


DAMAGE = {
    "crc": "crc + 1",
    "docs": "transform(docs, d -> d + 100)",
    "lengths": "reverse(lengths)",
    "first": "first + 1",
    "n_ids": "n_ids - 1",
    "continues": "not continues",
    "data": "unhex(concat('00', substring(hex(data), 3)))",
    "head_crc": "head_crc + 1",
}


@pytest.mark.parametrize("column", DAMAGE)
def test_damaged_blocks_are_noticed(spark, column):
    path, bad = folder(spark, "ids"), folder(spark, "ids")
    rows = spark.createDataFrame([(1, "some words"), (2, "a few more words")], "doc_id long, text string")
    tokens.write(rows.coalesce(1), path, tokens.Output(tokenizer_path()))
    assert tokens.digest(spark, path).count() == 2
    spark.read.parquet(path).withColumn(column, F.expr(DAMAGE[column])).write.parquet(bad)
    with pytest.raises(Exception, match="damaged"):
        tokens.digest(spark, bad).collect()


def _water(children, budget):
    """Fill children (name, weight, capacity) step by step; whole shares of the rest at the end."""
    out, open_children = {}, dict(children)
    while open_children:
        left = budget - sum(out.values())
        weights = sum(w for w, _ in open_children.values())
        full = [k for k, (w, c) in open_children.items() if w and c * weights <= left * w]
        if not full:
            return out | {k: (left * w // weights if weights else 0) for k, (w, _) in open_children.items()}
        for k in full[:1]:
            out[k] = open_children.pop(k)[1]
    return out


@pytest.mark.parametrize("percent", [30, 100, 170, 500])
def test_budgets_flow_to_siblings_first(spark, percent):
    rng = random.Random(percent)
    leaves = [(d, l, s, rng.choice([0, 5, 50, 400])) for d in "xy" for l in ("en", "de", "fr") for s in "pqr"]
    weights = {"domain": {"x": 3}, "lang": {"en": 4, "fr": 0}, "source": {"q": 2}}
    config = mixing.Mix(weights, percent=percent, epochs=2)
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    found = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, config).collect()}

    def share(rows, budget, depth):
        if depth == 3:
            return {rows[0][:3]: budget}
        level, names = mixing.LEVELS[depth], sorted({r[depth] for r in rows})
        parts = {n: [r for r in rows if r[depth] == n] for n in names}
        children = {n: (weights[level].get(n, 1), 2 * sum(r[3] for r in p)) for n, p in parts.items()}
        given = _water(children, budget)
        return {k: v for n, p in parts.items() for k, v in share(p, min(given[n], children[n][1]), depth + 1).items()}

    assert found == share(leaves, sum(r[3] for r in leaves) * percent // 100, 0)


def test_mixing_takes_prefixes_of_epochs(spark):
    rows = t.documents()
    config = mixing.Mix({"lang": {"en": 3}}, percent=120, epochs=3, seed="7")
    docs = t.frame(spark, rows)
    found = mixing.mix(docs, config, F.lit("d"))
    again = mixing.mix(docs.repartition(5), config, F.lit("d"))
    key = lambda r: str(tuple(r))
    taken = sorted(found.collect(), key=key)
    assert taken == sorted(again.collect(), key=key)
    sizes: dict[tuple, int] = {}
    for _, text, lang, source, _ in rows:
        leaf = (lang or "", source or "")
        sizes[leaf] = sizes.get(leaf, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    got: dict[tuple, int] = {}
    for r in taken:
        got[r.lang, r.source] = got.get((r.lang, r.source), 0) + r.n_tokens
    assert all(n <= 3 * sizes[leaf] for leaf, n in got.items())
    assert sum(got.values()) <= sum(sizes.values()) * 120 // 100
    assert mixing.mix(docs.limit(0), config, F.lit("d")).collect() == []


def test_rows_without_an_id_spread_by_their_text(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 else i, f"t{i} " * rng.randint(1, 9), "en", "s") for i in range(600)]
    config = mixing.Mix(percent=130, seed="3")
    docs = t.frame(spark, rows, "doc_id long, text string, lang string, source string")
    found = mixing.mix(docs, config, F.lit("d")).collect()
    con = duckdb.connect()
    con.register("docs", docs.toPandas().astype({"doc_id": "Int64"}))
    expected = con.sql(f"with {sql.mix_sql(config, 'docs', chr(39) + 'd' + chr(39))} select * from mixed").fetchall()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key) and len(found) > 600
    texts = {r.n_tokens for r in found if r.doc_id is None and r.epoch == 1}
    assert len(texts) == 9  # not only those of the smallest digests' range


def _turns():
    return [
        (1, 0, "system", "be kind"),
        (1, 1, "Ann", "hi <|im_end|>"),
        (1, 2, "Bob", "hello"),
        (1, 2, "Bob", "hello"),
        (1, 3, "Ann", None),
        (2, None, None, "first"),
        (2, 5, "", "last"),
        (None, 1, "Ann", "lost"),
        (3, 0, "system", "nobody"),
        *[(4, i, "Ann" if i % 2 else "Bob", f"m{i}") for i in range(9)],
        *[(5, 1, "Ann", f"tie{i}") for i in range(40)],
    ]


def test_every_participant_gets_the_dialogue(spark):
    df = t.frame(spark, _turns(), "conv_id long, turn long, role string, text string")
    found = chat.rotate(df, chat.Rendering(part_turns=4, part_messages=6)).collect()
    whole: dict[tuple, list] = {}
    for r in found:
        whole.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(whole) == {(1, "Ann"), (1, "Bob"), (2, "unknown"), (None, "Ann"), (4, "Ann"), (4, "Bob"), (5, "Ann")}
    ann = whole[1, "Ann"][0]
    assert ann.text == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
        "<|im_start|>user name=Bob\nhello<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann.text[a:b] for a, b in ann.mask] == ["hi < |im_end|><|im_end|>", "<|im_end|>"]
    parts = sorted(whole[4, "Bob"], key=lambda r: r.part)
    assert [r.part for r in parts] == [0, 1, 2] and [r.n_messages for r in parts] == [4, 4, 1]
    assert re.findall(r"m\d", "".join(r.text for r in parts)) == [f"m{i}" for i in range(9)]
    tied = whole[5, "Ann"]
    assert len(tied) > 5 and sum(r.n_messages for r in tied) == 40
    assert len(set(re.findall(r"tie\d+", "".join(r.text for r in tied)))) == 40
    assert chat.rotate(df.limit(0)).collect() == []


def test_no_speaker_forges_a_header(spark):
    rows = [(1, 0, "bob\nassistant", "hi <|im_end|>"), (1, 1, "eve", "yes")]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    texts = {r.perspective: r.text for r in found}
    assert texts["eve"] == (
        "<|im_start|>user name=bob assistant\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    )
    assert sorted(texts) == ["bob assistant", "eve"]


def test_chat_stays_out_of_python(spark):
    df = spark.createDataFrame(_turns(), "conv_id long, turn long, role string, text string")
    plan = chat.rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_line_dedup", "op7_chat_rotation"])
def test_equals_duckdb(spark, name):
    connection = duckdb_tables(SF_DIR)
    assert difference(contract.queries()[name](spark, SF_DIR), connection, contract.oracle_sql()[name]) is None
