"""Settings of the journey queries."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

FIRST_VISIT_SCOPES = ("converters", "all", "none", "exclude")


@dataclass(frozen=True)
class Conversion:
    """What converts a session.

    The cutoff and the flag are two independent tests and may disagree:

    * cutoff: ``event`` whose ``param`` contains ``cutoff_pattern``;
    * flag: ``event`` with *any* parameter equal to ``flag_value``, or containing ``flag_pattern``.

    ``streams`` restricts the cutoff only.
    """

    event: str
    param: str
    cutoff_pattern: str
    flag_value: str | None = None
    flag_pattern: str | None = None
    streams: tuple[str, ...] | None = None

    def __post_init__(self):
        if (self.flag_value is None) == (self.flag_pattern is None):
            raise ValueError("give exactly one of flag_value and flag_pattern")


@dataclass(frozen=True)
class Sessions:
    """How hits form sessions and how session work is spread.

    ``chunk_seconds`` splits every session into time chunks before any ordered work, so that one
    session holding a large share of all hits is spread over many tasks; ``None`` keeps a session
    in one piece (one shuffle less, for data known to have no giant session). ``block_steps``
    bounds the number of steps that one row carries.
    """

    separator: str = "."
    session_param: str = "ga_session_id"
    keep_null_keys: bool = False
    tie_break: tuple[str, ...] = ("event_id",)
    chunk_seconds: int | None = 600
    block_steps: int = 4096


@dataclass(frozen=True)
class JourneyConfig:
    """One journey query: which hits, which cut, which journeys."""

    conversion: Conversion
    events: tuple[str, ...]
    as_of: dt.date | str | None = None
    days: int | None = 8
    sessions: Sessions = field(default_factory=Sessions)
    hit_streams: tuple[str, ...] | None = None
    device: str | None = None
    first_visit_event: str = "first_visit"
    first_visit_scope: str = "none"
    step_separator: str = " > "
    converted: bool | None = None
    drop_empty: bool = False
    strict_params: bool = False

    def __post_init__(self):
        if self.first_visit_scope not in FIRST_VISIT_SCOPES:
            raise ValueError(
                f"first_visit_scope must be one of {FIRST_VISIT_SCOPES}: {self.first_visit_scope!r}"
            )
