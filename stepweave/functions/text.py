"""Column expressions over journey text and colours."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave.functions.params import sql_text

STEP_SEPARATOR = " > "
END_STEP = "Journey End"

# The node palette, in order; node i takes colour i modulo the size.
PALETTE = tuple(
    """
    #8E8C99 #35297F #2D1BB5 #80447B #F40EA4 #8EE7FF #FFB1FF #197EB2 #F861C3 #6F1C67
    #8E8C99 #35297F #2D1BB5 #B61CA7 #F40EA4
    #35297F #2D1BB5 #80447B #F40EA4 #8EE7FF #FFB1FF #197EB2 #F861C3 #6F1C67
    #8E8C99 #35297F #2D1BB5 #B61CA7 #F40EA4
    #35297F #2D1BB5 #80447B #F40EA4 #8EE7FF #FFB1FF #197EB2 #F861C3 #6F1C67
    #8E8C99 #35297F #2D1BB5 #B61CA7 #F40EA4
    #35297F #2D1BB5 #80447B #F40EA4 #8EE7FF #FFB1FF #197EB2 #F861C3 #6F1C67
    #8E8C99 #35297F #2D1BB5 #B61CA7 #F40EA4
    """.split()
)


def _quoted(separator: str) -> str:
    return f"\\Q{separator}\\E"


def split_steps(journey: Column, separator: str = STEP_SEPARATOR, max_steps: int | None = None) -> Column:
    """Journey text to its steps; beyond ``max_steps`` they are cut without a sign.

    A missing journey is an empty one, which has one step without a name. CSV files don't tell the two apart.
    """
    journey = F.coalesce(journey, F.lit(""))
    if max_steps is None:
        return F.split(journey, _quoted(separator))
    if max_steps < 1:
        raise ValueError(f"max_steps must be at least 1: {max_steps}")
    return F.slice(F.split(journey, _quoted(separator), max_steps + 1), 1, max_steps)


def journey_length(journey: Column, separator: str = STEP_SEPARATOR) -> Column:
    """Number of steps; the empty text has one."""
    return F.size(split_steps(journey, separator))


def with_end_step(
    journey: Column, conversion_label: str = "Conversion", separator: str = STEP_SEPARATOR
) -> Column:
    """Append the end step unless the text, less white space at its end, ends with the label."""
    journey = F.coalesce(journey, F.lit(""))
    converted = F.endswith(F.regexp_replace(journey, r"\s+\z", ""), F.lit(conversion_label))
    return F.when(converted, journey).otherwise(F.concat(journey, F.lit(separator + END_STEP)))


def hex_to_rgba(color: Column, opacity: float) -> Column:
    """``#8E8C99`` to ``rgba(142, 140, 153, 0.9)``."""
    digits = F.ltrim(color, F.lit("#"))
    channels = [F.conv(F.substring(digits, start, 2), 16, 10) for start in (1, 3, 5)]
    parts = [F.lit("rgba(")]
    for channel in channels:
        parts += [channel, F.lit(", ")]
    return F.concat(*parts, F.lit(f"{opacity})"))


def palette_color(index: Column, palette: tuple[str, ...] = PALETTE) -> Column:
    """Hex colour of a node index; the palette repeats when there are more nodes than colours."""
    colors = F.expr(f"array({', '.join(sql_text(c) for c in palette)})")
    return F.get(colors, (index % len(palette)).cast("int"))


def check_date(text: str) -> str:
    """Return the text if it is written ``YYYY-MM-DD``, else raise ``ValueError``."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"dates are written YYYY-MM-DD: {text!r}")
    return text
