"""Column-level building blocks."""

from stepweave.functions.params import (
    any_param_equals,
    contains_pattern,
    label_if,
    max_param_matching,
    param,
    param_on,
)
from stepweave.functions.text import (
    PALETTE,
    check_date,
    hex_to_rgba,
    journey_length,
    palette_color,
    split_steps,
    with_end_step,
)

__all__ = [
    "PALETTE",
    "any_param_equals",
    "check_date",
    "contains_pattern",
    "hex_to_rgba",
    "journey_length",
    "label_if",
    "max_param_matching",
    "palette_color",
    "param",
    "param_on",
    "split_steps",
    "with_end_step",
]
