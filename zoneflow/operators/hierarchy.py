"""Zone hierarchy: lookups from base zones to groups, internal pairs, labels and points of a level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneflow.functions.ids import group_key
from zoneflow.functions.scale import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast
from zoneflow.operators.dissolve import zone_table
from zoneflow.params import BASE_LEVEL, LEVEL_LABEL, LEVELS, resolve_level


@dataclass(frozen=True)
class ZoneModel:
    """The base zone table (one row per zone, unique `taz`) and how it may be joined.

    A table derived here joins two levels at most, so it has at most twice the rows of the base table. One check against half of the
    bounds decides for all of them: within they are broadcast, beyond they are joined by shuffle. `tables` holds stored group tables
    (`group_id, label, centroid_lat, centroid_lon`) of any levels; labels and points of other levels are derived.
    """

    base: DataFrame
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    broadcast_rows: int = BROADCAST_ROWS
    broadcast_bytes: int = BROADCAST_BYTES

    @cached_property
    def fits(self) -> bool:
        texts = [*LEVELS, *(c for c in LEVEL_LABEL.values() if c not in LEVELS)]
        return fits_broadcast(self.base.select(*texts), self.broadcast_rows // 2, self.broadcast_bytes // 2)

    def hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.fits else df

    def lookup(self, level: str, base_name: str = "base_id", group_name: str = "group_id", source: str = BASE_LEVEL) -> DataFrame:
        """Base zone to group at `level`; the identity at the base level. Zones without a parent map to 'None'.

        From groups of another `source` level, each must lie in one group of `level`."""
        column = F.col(resolve_level(level))
        if source == BASE_LEVEL:
            return self.base.select(F.col(BASE_LEVEL).alias(base_name), group_key(column).alias(group_name))
        return self.base.select(group_key(F.col(source)).alias(base_name), group_key(column).alias(group_name)).distinct()

    def fits_lookup(self, lookup: DataFrame) -> bool:
        """Whether a part of a lookup, say the zones of some groups, may be broadcast even if the whole may not."""
        return self.fits or fits_broadcast(lookup, self.broadcast_rows, self.broadcast_bytes)

    def to_groups(self, facts: DataFrame, zone: str, lookup: DataFrame, small: bool) -> DataFrame:
        """Replace the zone column of a fact table by the group of a lookup (`base_id` and a group column).

        Facts of unknown zones drop out. A `small` lookup is broadcast and probed by a 64-bit hash of the id, which Spark keeps in its
        long-key hash table; on large facts that halves the time of text keys. Ids are still compared in full, in a form the
        optimizer does not turn back into a text key: each starts with the other.
        """
        if not small:
            return facts.join(lookup.withColumnRenamed("base_id", zone), zone).drop(zone)
        mine, known = F.col(zone), F.col("base_id")
        same = (F.xxhash64(mine) == F.xxhash64(known)) & F.startswith(mine, known) & F.startswith(known, mine)
        return facts.join(F.broadcast(lookup), same).drop(zone, "base_id")

    def lookups(self) -> DataFrame:
        """All levels at once, long: `base_id, level, group_id`."""
        keys = self.base.select(F.col(BASE_LEVEL).alias("base_id"), *[group_key(F.col(c)).alias(c) for c in LEVELS])
        return keys.unpivot("base_id", list(LEVELS), "level", "group_id")

    def internal_pairs(self, origin_level: str, dest_level: str) -> DataFrame:
        """Group pairs that share a base zone. Such a pair is internal as a whole, also for levels that do not nest."""
        origin, dest = resolve_level(origin_level), resolve_level(dest_level)
        return self.base.select(
            group_key(F.col(origin)).alias("orig_gid"), group_key(F.col(dest)).alias("dest_gid")
        ).distinct()

    def labels(self, levels: Sequence[str]) -> DataFrame:
        """`level, id, label` of the given levels; label may be null. Zones without a parent have no group row."""
        return reduce(DataFrame.unionByName, [self._labels(level) for level in _distinct(levels)])

    def _labels(self, level: str) -> DataFrame:
        if level in self.tables:
            return self.tables[level].select(F.lit(level).alias("level"), F.col("group_id").alias("id"), "label")
        rows = self.base.select(
            F.lit(level).alias("level"), F.col(level).alias("id"), F.col(LEVEL_LABEL[level]).alias("label")
        )
        if level == BASE_LEVEL:
            return rows
        return rows.where("id IS NOT NULL").groupBy("level", "id").agg(F.min("label").alias("label"))

    def points(self, levels: Sequence[str]) -> DataFrame:
        """`level, id, label, centroid_lon, centroid_lat` of the given levels."""
        return reduce(DataFrame.unionByName, [self._points(level) for level in _distinct(levels)])

    def _points(self, level: str) -> DataFrame:
        if level in self.tables:
            rows = self.tables[level].withColumnRenamed("group_id", "id")
        else:
            rows = zone_table(self.base, level)
        return rows.select(F.lit(level).alias("level"), "id", "label", "centroid_lon", "centroid_lat")


def _distinct(levels: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(resolve_level(level) for level in levels))
