"""Query parameters: closed sets, validation and clamps."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

# Zone levels, finest first, and the column that holds each one in the input files.
LEVEL_SOURCE = {
    "taz": "TAZ_1270",
    "g250": "TAZ_250",
    "g33": "TAZ_33",
    "g15": "TAZ_15",
    "city": "CITY",
}
LEVELS = tuple(LEVEL_SOURCE)
BASE_LEVEL = "taz"
GROUP_LEVELS = LEVELS[1:]

# The column with the display name of each level in the base zone table.
LEVEL_LABEL = {"taz": "zone_name", "g250": "name_250", "g33": "name_33", "g15": "name_15", "city": "city"}

# Day types and the hour range of a day.
DAYS = ("weekday", "friday", "saturday")
HOURS = range(24)

# Result cap, default thresholds and the range of top-N.
FLOW_CAP = 5000
API_MIN_TRIPS = 1.0
UI_MIN_TRIPS = 100.0
BREAKDOWN_MIN_TRIPS = 1.0
TOP_N_DEFAULT, TOP_N_MIN, TOP_N_MAX = 10, 3, 20

_LEVEL_BY_NAME = {**{name: name for name in LEVELS}, **{source: name for name, source in LEVEL_SOURCE.items()}}


def resolve_level(name: str) -> str:
    """Canonical level name; the column names of the input files are accepted too."""
    try:
        return _LEVEL_BY_NAME[name]
    except KeyError:
        raise ValueError(f"invalid level {name!r}; valid: {list(_LEVEL_BY_NAME)}") from None


def parse_ids(text: str | None) -> tuple[str, ...]:
    """Split a comma-separated id list, dropping blanks. Ids that hold a comma need a Python list instead."""
    return tuple(part.strip() for part in (text or "").split(",") if part.strip())


def clamp_hours(hour_min: int, hour_max: int) -> tuple[int, int]:
    """Keep both bounds in 0..24 and the lower one from passing the upper one."""
    upper = min(max(int(hour_max), 0), 24)
    return min(max(int(hour_min), 0), 23, upper), upper


def clamp_min_trips(value: float) -> float:
    return max(0.0, float(value))


def clamp_top_n(value: object) -> int:
    """Top-N in 3..20, read from the leading whole number; text without one counts as 3."""
    leading = re.match(r"\s*[+-]?\d+", str(value))
    return max(TOP_N_MIN, min(TOP_N_MAX, int(leading.group()))) if leading else TOP_N_MIN


def _ids(values: Iterable[str] | str | None) -> tuple[str, ...]:
    if values is None or isinstance(values, str):
        return parse_ids(values)
    return tuple(str(value) for value in values)


@dataclass(frozen=True)
class FlowQuery:
    """Arguments of one roll-up.

    `hour_min` is inclusive and `hour_max` exclusive. No `day` (None or "") sums all day types. `min_trips` applies to
    the summed flow. Id lists hold ids of the rolled-up level; an empty list is no predicate. `cap=None` returns all flows.
    """

    level: str | None = None
    origin_level: str | None = None
    dest_level: str | None = None
    day: str | None = None
    hour_min: int = 0
    hour_max: int = 24
    min_trips: float = API_MIN_TRIPS
    origin_ids: Sequence[str] | str | None = field(default=())
    dest_ids: Sequence[str] | str | None = field(default=())
    exclude_origin_ids: Sequence[str] | str | None = field(default=())
    exclude_dest_ids: Sequence[str] | str | None = field(default=())
    include_self_loops: bool = False
    cap: int | None = None

    def __post_init__(self) -> None:
        origin, dest = self.origin_level or self.level, self.dest_level or self.level
        if not origin or not dest:
            raise ValueError("give 'level', or both 'origin_level' and 'dest_level'")
        if self.day and self.day not in DAYS:
            raise ValueError(f"invalid day {self.day!r}; valid: {list(DAYS)}")
        if self.cap is not None and self.cap < 1:
            raise ValueError("cap must be positive, or None for all flows")
        fixed = {
            "origin_level": resolve_level(origin),
            "dest_level": resolve_level(dest),
            "day": self.day or None,
            "hour_min": int(self.hour_min),
            "hour_max": int(self.hour_max),
            "min_trips": float(self.min_trips),
        }
        for name in ("origin_ids", "dest_ids", "exclude_origin_ids", "exclude_dest_ids"):
            fixed[name] = _ids(getattr(self, name))
        for name, value in fixed.items():
            object.__setattr__(self, name, value)

    @property
    def same_level(self) -> bool:
        return self.origin_level == self.dest_level

    @property
    def cells_per_pair(self) -> int:
        """How many (day, hour) cells of one zone pair can pass the filters."""
        hours = len([h for h in HOURS if self.hour_min <= h < self.hour_max])
        return hours * (1 if self.day else len(DAYS))
