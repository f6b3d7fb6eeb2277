"""Column expressions over the nested key/value parameter array of a hit.

A parameter is looked up by position in the parallel key and value arrays. That needs no lambda, so
it stays inside whole-stage code generation, and the scan reads only the typed slots in use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAMS = "event_params"


def _keys(params: str) -> Column:
    return F.col(f"{params}.key")


def _values(slot: str, params: str) -> Column:
    return F.col(f"{params}.value.{slot}")


def param(key: str, slot: str = "string_value", *, strict: bool = False, params: str = PARAMS) -> Column:
    """First parameter with this key, or NULL. ``strict`` fails on a key that occurs twice."""
    position = F.array_position(_keys(params), key)
    value = F.get(_values(slot, params), position - 1)
    if not strict:
        return value
    repeats = F.size(F.filter(_keys(params), lambda k: k == F.lit(key)))
    return F.when(
        repeats > 1,
        F.raise_error(F.concat(F.lit(f"parameter {key!r} occurs more than once: "), repeats.cast("string"))),
    ).otherwise(value)


def param_on(
    event: str, key: str, slot: str = "string_value", *, strict: bool = False, params: str = PARAMS
) -> Column:
    """The parameter, on hits of one event only."""
    return F.when(F.col("event_name") == event, param(key, slot, strict=strict, params=params))


def any_param_equals(event: str, value: str, *, params: str = PARAMS) -> Column:
    """``value`` if the event carries it under any key, else NULL."""
    found = F.array_contains(_values("string_value", params), value)
    return F.when((F.col("event_name") == event) & found, F.lit(value))


#: A code point that is no character; parts the values of a hit while they are one text.
NO_CHARACTER = "\uffff"


def max_param_matching(event: str, pattern: str, *, params: str = PARAMS) -> Column:
    """Largest parameter value of the event, under any key, that contains the pattern.

    For an alternation of plain texts the values are searched as one text, which needs no lambda and so
    stays inside the scan's generated code; only hits of the event are searched.
    """
    values, texts = _values("string_value", params), plain_texts(pattern)
    if texts is None:
        matching = F.filter(values, lambda v: contains_pattern(v, pattern))
    else:
        whole = f"[^{NO_CHARACTER}]*(?:{'|'.join(texts)})[^{NO_CHARACTER}]*"
        matching = F.regexp_extract_all(F.array_join(values, NO_CHARACTER), F.lit(whole), F.lit(0))
    return F.when(F.col("event_name") == event, F.array_max(matching))


def label_if(condition: Column, label: str) -> Column:
    """A constant label where the condition holds, else NULL."""
    return F.when(condition, F.lit(label))


_SPECIAL = set("\\^$.|?*+()[]{}")


def plain_texts(pattern: str) -> list[str] | None:
    """The alternatives of a pattern of plain texts, else None."""
    parts = pattern.split("|")
    return parts if all(part and not _SPECIAL & set(part) for part in parts) else None


def at_very_end(pattern: str) -> str:
    """Every ``$`` anchor as the very end of the text: in Java it also matches before a last newline.

    A dollar that is escaped, or stands in brackets or between \\Q and \\E, is a character.
    """
    out: list[str] = []
    at, depth, quoted = 0, 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if quoted:
            quoted = two != "\\E"
            step = pattern[at] if quoted else two
        elif pattern[at] == "\\":
            quoted = two == "\\Q"
            step = two
        else:
            step = pattern[at]
            depth = max(0, depth + (step == "[") - (step == "]"))
        out.append("\\z" if step == "$" and not depth and not quoted else step)
        at += len(step)
    return "".join(out)


def contains_pattern(value: Column, pattern: str) -> Column:
    """True where the text contains a match of the regular expression.

    An alternation of plain texts becomes substring tests, which are several times faster than a
    regular expression and mean the same.
    """
    texts = plain_texts(pattern)
    if texts is None:
        return value.rlike(at_very_end(pattern))
    return reduce(lambda test, text: test | value.contains(text), texts[1:], value.contains(texts[0]))


def sql_text(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_pattern_sql(column: str, pattern: str) -> str:
    """The same test on a column, as SQL text."""
    texts = plain_texts(pattern)
    if texts is None:
        return f"`{column}` RLIKE {sql_text(at_very_end(pattern))}"
    return " OR ".join(f"contains(`{column}`, {sql_text(text)})" for text in texts)
