"""Small tables with everything that may stand in a row, and plain-Python versions of the operators."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named as the operators name their own.
EXTRA = ("id", "component_id", "kept", "score", "lang_pred", "rep", "at", "n_tokens", "epoch", "spans", "site", "part")

SYLLABLES = {
    "en": "the and ing tion er re on at en ha st ou",
    "de": "der und ung sch ein ver keit lich ge zu ö ä",
    "fr": "le et tion eau oi aux ent pa é è ç que",
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose in three languages with exact and near copies, shared lines, odd texts and rows that repeat."""
    rng = random.Random(seed)
    line = sentence(rng, "en", 12)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = "\n".join(sentence(rng, lang, rng.randint(3, 30)) for _ in range(rng.randint(1, 5)))
        if rows and i % 5 == 0:
            _, text, lang, *_ = rng.choice(rows)
        elif rows and i % 5 == 1:
            _, text, lang, *_ = rng.choice(rows)
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 7 == 2:
            text += "\n" + line
        rows.append((i, text, lang, f"src{i % 6}", len(text)))
    odd = [
        (100, None, "en", "src1", None),
        (101, "", None, None, 0),
        (102, "word", "en", "src2", 4),
        (103, " \t\n\n ", "en", "src3", 5),
        (104, "123 456 !!", "en", "src3", 10),
        (105, sentence(rng, "en", 8000), "en", "src0", 1),
        (106, "a" * 500, "en", "src0", 500),
        (107, "A" * 500, "fr", "src1", 500),
        (None, rows[3][1], "en", "src1", 3),
        (None, None, None, None, None),
    ]
    return rows + odd + [rows[4], rows[4], odd[2]]


def frame(spark, rows: list[tuple], schema: str = DOCS):
    """With extra columns whose names clash with those of the operators."""
    df = spark.createDataFrame(rows, schema).repartition(3)
    for name in EXTRA:
        if name not in df.columns:
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def lowered_words(text: str | None) -> list[bytes]:
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(table))


def shingle_set(text: str | None, n: int) -> frozenset:
    words = lowered_words(text)
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def smallest_reachable(nodes: list, links: list[tuple]) -> dict:
    at = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at
