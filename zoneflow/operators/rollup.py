"""The central query: trips between zone groups of any two levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zoneflow.functions.skipping import MOST_IDS, within
from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.params import BASE_LEVEL, FlowQuery

# Cells per pair from which summing a pair first is worth a shuffle of its own (only where zones are not broadcast).
_PRE_AGGREGATE_CELLS = 8


def flow_order() -> list[Column]:
    """Largest flows first; ids break ties so that a capped result is always the same."""
    return [F.desc("trips"), F.asc("origin_id"), F.asc("dest_id")]


def filter_od(od: DataFrame, query: FlowQuery) -> DataFrame:
    """Day and half-open hour range. A stored table prunes its day partitions and parquet row groups by them."""
    od = od.where((F.col("hour") >= query.hour_min) & (F.col("hour") < query.hour_max))
    return od.where(F.col("day") == query.day) if query.day else od


@dataclass(frozen=True)
class _Side:
    """One end of the trips: the zone column, the group that replaces it, and the ids asked for or left out."""

    zones: ZoneModel
    zone: str
    group: str
    level: str
    only: Sequence[str] = ()
    without: Sequence[str] = ()
    source: str = BASE_LEVEL

    @cached_property
    def lookup(self) -> DataFrame:
        lookup = self.zones.lookup(self.level, "base_id", self.group, self.source)
        if self.only:
            lookup = lookup.where(F.col(self.group).isin(list(self.only)))
        return lookup.where(~F.col(self.group).isin(list(self.without))) if self.without else lookup

    @cached_property
    def small(self) -> bool:
        return self.zones.fits_lookup(self.lookup) if self.only else self.zones.fits

    def skipping(self, trips: DataFrame) -> DataFrame:
        """Trips without most of those that the ids asked for leave out: their zones, if they are few, reach the scan as ranges.

        The join with the lookup decides; the ranges only let the scan skip files, row groups and pages.
        """
        if not self.only:
            return trips
        zones = [row["base_id"] for row in self.lookup.select("base_id").limit(MOST_IDS + 1).collect()]
        return trips.where(within(F.col(self.zone), zones)) if 0 < len(zones) <= MOST_IDS else trips

    def replace(self, trips: DataFrame) -> DataFrame:
        return self.zones.to_groups(trips, self.zone, self.lookup, self.small)


def all_flows(
    od: DataFrame, zones: ZoneModel, query: FlowQuery, pair_predicate: Column | None = None,
    pre_aggregate: bool | None = None, sources: tuple[str, str] = (BASE_LEVEL, BASE_LEVEL),
) -> DataFrame:
    """Every flow `origin_id, dest_id, trips` of the query, without cap.

    Facts whose zone is unknown drop out. With broadcast lookups this is one scan, one partial and one final
    aggregation. A lookup that is too large is joined by shuffle; trips are then summed again as soon as a key is replaced
    by its group, so what moves shrinks step by step and a hot zone is combined before it moves. `pre_aggregate` forces the
    summation per zone pair before the first join on or off. `sources` are the levels of the ids in `od`, if it holds sums of groups.
    """
    trips = filter_od(od, query).select("from_zone", "to_zone", "trips")
    first = _Side(zones, "from_zone", "origin_id", query.origin_level, query.origin_ids, query.exclude_origin_ids, sources[0])
    second = _Side(zones, "to_zone", "dest_id", query.dest_level, query.dest_ids, query.exclude_dest_ids, sources[1])
    if second.only and not first.only:
        first, second = second, first  # the side with an id list first: its lookup drops most trips

    trips = second.skipping(first.skipping(trips))
    if pre_aggregate is None:
        pre_aggregate = not first.small and query.cells_per_pair >= _PRE_AGGREGATE_CELLS
    if pre_aggregate:
        trips = sum_trips(trips, "from_zone", "to_zone")
    half = first.replace(trips)
    if not second.small and first.level != BASE_LEVEL:
        half = sum_trips(half, first.group, second.zone)
    pairs = second.replace(half)

    if query.same_level and not query.include_self_loops:
        pairs = pairs.where("origin_id <> dest_id")
    if pair_predicate is not None:
        pairs = pairs.where(pair_predicate)
    flows = sum_trips(pairs, "origin_id", "dest_id").where(F.col("trips") >= query.min_trips)
    return flows if query.same_level or query.include_self_loops else drop_internal(flows, zones, query)


def drop_internal(flows: DataFrame, zones: ZoneModel, query: FlowQuery) -> DataFrame:
    """Drop whole flows between groups of two levels that share a base zone."""
    internal = zones.internal_pairs(query.origin_level, query.dest_level).toDF("origin_id", "dest_id")
    return flows.join(zones.hint(internal), ["origin_id", "dest_id"], "left_anti")


def flow_rollup(od: DataFrame, zones: ZoneModel, query: FlowQuery) -> DataFrame:
    """The `query.cap` largest flows (all of them if the cap is None)."""
    flows = all_flows(od, zones, query)
    return flows if query.cap is None else flows.orderBy(*flow_order()).limit(query.cap)


def ranked_flows(od: DataFrame, zones: ZoneModel, query: FlowQuery) -> DataFrame:
    """Capped flows with their rank and whether the cap cut anything off."""
    if query.cap is None:
        raise ValueError("ranked flows need a cap")
    probe = all_flows(od, zones, query).orderBy(*flow_order()).limit(query.cap + 1)
    rank = F.row_number().over(Window.orderBy(*flow_order())).cast("bigint")
    return (
        probe.withColumn("rnk", rank)
        .withColumn("truncated", F.max("rnk").over(Window.partitionBy()) > query.cap)
        .where(F.col("rnk") <= query.cap)
    )


def is_truncated(od: DataFrame, zones: ZoneModel, query: FlowQuery) -> DataFrame:
    """One row: does the query have more flows than its cap?"""
    if query.cap is None:
        raise ValueError("only a capped query can be truncated")
    probe = all_flows(od, zones, query).limit(query.cap + 1)
    return probe.agg((F.count("*") > query.cap).alias("truncated"))


def grouped_trips(od: DataFrame, zones: ZoneModel, levels: tuple[str, str], sources: tuple[str, str]) -> DataFrame:
    """Trips summed per day type, hour and pair of groups: `from_zone, to_zone, day, hour, trips` with the groups as ids."""
    origin = _Side(zones, "from_zone", "origin_id", levels[0], source=sources[0])
    dest = _Side(zones, "to_zone", "dest_id", levels[1], source=sources[1])
    trips = dest.replace(origin.replace(od.select("from_zone", "to_zone", "day", "hour", "trips")))
    named = trips.withColumnsRenamed({"origin_id": "from_zone", "dest_id": "to_zone"})
    return sum_trips(named, "from_zone", "to_zone", "day", "hour")


def sum_trips(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("trips").alias("trips"))
