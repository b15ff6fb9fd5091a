"""Composite queries: the flow set of a zone selection under one of four modes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zoneflow.functions.scale import top_per_group
from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.operators.rollup import all_flows, flow_order
from zoneflow.params import API_MIN_TRIPS, FlowQuery, resolve_level

# Names of modes, roles and directions.
SINGLE, INTERNAL, EXTERNAL, COMBINED = 1, 2, 3, 4
ROLES = ("origin", "destination")
DIRECTIONS = ("outgoing", "incoming", "both")


@dataclass(frozen=True)
class Selection:
    """A zone selection and the question asked about it.

    Modes: 1 flows of the selected zones, 2 flows inside the selection, 3 flows between the selection and the rest,
    4 both of these. Mode 1 and role "destination" roll the other side up to `counterpart_level`; modes 2 to 4 use
    `map_level` on both sides, so the levels must be equal, and need at least two zones.
    """

    ids: Sequence[str]
    map_level: str
    counterpart_level: str | None = None
    mode: int = SINGLE
    role: str = "origin"
    direction: str = "both"
    day: str | None = "weekday"
    hour_min: int = 0
    hour_max: int = 24
    min_trips: float = API_MIN_TRIPS
    include_self_loops: bool = False
    cap: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "ids", tuple(dict.fromkeys(str(i) for i in self.ids)))
        object.__setattr__(self, "map_level", resolve_level(self.map_level))
        object.__setattr__(self, "counterpart_level", resolve_level(self.counterpart_level or self.map_level))
        if self.mode not in (SINGLE, INTERNAL, EXTERNAL, COMBINED):
            raise ValueError(f"invalid mode {self.mode!r}")
        if self.role not in ROLES or self.direction not in DIRECTIONS:
            raise ValueError(f"invalid role {self.role!r} or direction {self.direction!r}")
        if self.mode != SINGLE and self.role == "origin" and self.ids:
            if len(self.ids) < 2:
                raise ValueError(f"mode {self.mode} needs at least two zones")
            if self.map_level != self.counterpart_level:
                raise ValueError(f"mode {self.mode} needs the same level on both sides")

    @property
    def wants_outgoing(self) -> bool:
        return self.direction in ("outgoing", "both")

    @property
    def wants_incoming(self) -> bool:
        return self.direction in ("incoming", "both")

    def query(self, origin_level: str, dest_level: str, **ids: Sequence[str]) -> FlowQuery:
        return FlowQuery(
            origin_level=origin_level, dest_level=dest_level, day=self.day, hour_min=self.hour_min,
            hour_max=self.hour_max, min_trips=self.min_trips, include_self_loops=self.include_self_loops, cap=self.cap,
            **ids,
        )


def flow_set(od: DataFrame, zones: ZoneModel, selection: Selection, with_flag: bool = False) -> DataFrame:
    """Flows `tag, origin_id, dest_id, trips` of a selection: all of them, or the `cap` largest of each tag if a cap is given.

    With `with_flag` each row also tells whether its tag was cut (`truncated`). An empty selection has no flows. In mode
    1 with both directions and self-loops kept, a self-loop is an outgoing and an incoming flow.
    """
    tagged = _tagged(od, zones, selection)
    if selection.cap is None:
        return tagged.withColumn("truncated", F.lit(False)) if with_flag else tagged
    probe = top_per_group(tagged, ["tag"], flow_order(), selection.cap + 1)
    if with_flag:
        probe = probe.withColumn("truncated", F.max("rnk").over(Window.partitionBy("tag")) > selection.cap)
    return probe.where(F.col("rnk") <= selection.cap).drop("rnk")


def is_truncated(flagged: DataFrame) -> DataFrame:
    """One row: was any part of the flow set cut? Takes the result of `flow_set(..., with_flag=True)`."""
    return flagged.agg(F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))


def _tagged(od: DataFrame, zones: ZoneModel, s: Selection) -> DataFrame:
    near, far, ids = s.map_level, s.counterpart_level, list(s.ids)

    def tagged(tag: str, query: FlowQuery) -> DataFrame:
        return all_flows(od, zones, query).select(F.lit(tag).alias("tag"), "origin_id", "dest_id", "trips")

    if not ids:
        return tagged("internal", s.query(near, near)).where(F.lit(False))
    if s.role == "destination":
        return tagged("incoming", s.query(far, near, dest_ids=ids))
    if s.mode == SINGLE:  # levels may differ and a self-loop has both tags; each id-filtered lookup drops most trips early
        parts = {
            "outgoing": s.query(near, far, origin_ids=ids) if s.wants_outgoing else None,
            "incoming": s.query(far, near, dest_ids=ids) if s.wants_incoming else None,
        }
        return reduce(DataFrame.unionByName, [tagged(tag, query) for tag, query in parts.items() if query])

    parts = {
        "internal": s.query(near, near, origin_ids=ids, dest_ids=ids),
        "outgoing": s.query(near, near, origin_ids=ids, exclude_dest_ids=ids),
        "incoming": s.query(near, near, dest_ids=ids, exclude_origin_ids=ids),
    }
    if s.mode == INTERNAL:
        wanted = ["internal"]
    elif s.mode == EXTERNAL:
        wanted = ["outgoing"] * s.wants_outgoing + ["incoming"] * s.wants_incoming
    else:
        wanted = list(parts)
    if len(wanted) == 1:
        return reduce(DataFrame.unionByName, [tagged(tag, parts[tag]) for tag in wanted])

    # The parts are disjoint sets of (origin, destination) pairs, so one scan and one roll-up answers them all.
    starts, ends = F.col("origin_id").isin(ids), F.col("dest_id").isin(ids)
    flows = all_flows(od, zones, s.query(near, near), pair_predicate=starts | ends if "internal" in wanted else starts != ends)
    tag = F.when(starts & ends, "internal").when(starts, "outgoing").otherwise("incoming")
    return flows.select(tag.alias("tag"), "origin_id", "dest_id", "trips")

