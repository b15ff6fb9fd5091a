"""Stored sums of trips between groups, and the smallest of them that answers a question.

Sums per day type, hour and pair of groups add up to those of any coarser pair of levels, as long as every group of the stored level lies
in one group of the level asked for. Which levels do is read from the zones, not assumed. Each table is built from the smallest one
that covers it already, so the trips are read once for the finest tables only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.functions.ids import group_key
from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.operators.rollup import all_flows, flow_order, grouped_trips
from zoneflow.params import BASE_LEVEL, LEVELS, FlowQuery, resolve_level

Pair = tuple[str, str]
SUMS_SCHEMA = "from_zone string, to_zone string, trips double, day string, hour int"
MANIFEST_SCHEMA = "origin string, dest string, rows bigint"


def refinements(zones: ZoneModel) -> set[Pair]:
    """Pairs (fine, coarse) of levels such that every group of the fine one lies in one group of the coarse one."""
    keys = zones.base.select(*[group_key(F.col(level)).alias(level) for level in LEVELS])
    found = set()
    for fine in LEVELS:
        spread = keys.groupBy(fine).agg(*[(F.min(c) == F.max(c)).alias(f"in_{c}") for c in LEVELS])
        row = spread.agg(*[F.coalesce(F.every(f"in_{c}"), F.lit(True)).alias(c) for c in LEVELS]).first()
        found |= {(fine, coarse) for coarse in LEVELS if row[coarse]}
    return found


@dataclass(frozen=True)
class PartialSums:
    """Tables of sums below a folder: the rows of each pair of levels, and which levels refine which."""

    folder: str
    rows: dict[Pair, int]
    refines: set[Pair]

    def path(self, pair: Pair) -> str:
        return f"{self.folder}/sums/{pair[0]}-{pair[1]}"

    def read(self, spark: SparkSession, pair: Pair) -> DataFrame:
        return spark.read.schema(SUMS_SCHEMA).parquet(self.path(pair))

    def covering(self, origin: str, dest: str) -> Pair | None:
        """The smallest stored pair whose sums add up to those of the levels asked for."""
        fits = [p for p in self.rows if (p[0], origin) in self.refines and (p[1], dest) in self.refines]
        return min(fits, key=lambda p: (self.rows[p], p), default=None)


def write_sums(od: DataFrame, zones: ZoneModel, folder: str, pairs: Iterable[Pair]) -> PartialSums:
    """Stores the sums of the given pairs of levels, fine ones first, and how many rows each has."""
    spark, refines = od.sparkSession, refinements(zones)
    wanted = {(resolve_level(a), resolve_level(b)) for a, b in pairs}
    finer = lambda pair: (-sum((pair[i], level) in refines for i in (0, 1) for level in LEVELS), pair)
    sums = PartialSums(folder, {}, refines)
    for pair in sorted(wanted, key=finer):
        source = sums.covering(*pair)
        table = od if source is None else sums.read(spark, source)
        grouped = grouped_trips(table, zones, pair, source or (BASE_LEVEL, BASE_LEVEL))
        grouped.repartition("day", "hour").write.mode("overwrite").partitionBy("day", "hour").parquet(sums.path(pair))
        sums.rows[pair] = sums.read(spark, pair).count()
    manifest = [(*pair, n) for pair, n in sums.rows.items()]
    spark.createDataFrame(manifest, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/sums/manifest")
    return sums


def read_sums(spark: SparkSession, zones: ZoneModel, folder: str) -> PartialSums:
    """The stored sums of a folder, for the zones they were made from."""
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/sums/manifest").collect()
    return PartialSums(folder, {(r.origin, r.dest): r["rows"] for r in rows}, refinements(zones))


def flows_from_sums(od: DataFrame, zones: ZoneModel, sums: PartialSums, query: FlowQuery) -> DataFrame:
    """The flows of `flow_rollup`, from the smallest stored sums that cover the question, or from the trips if none does."""
    source = sums.covering(query.origin_level, query.dest_level)
    if source is None:
        flows = all_flows(od, zones, query)
    else:
        flows = all_flows(sums.read(od.sparkSession, source), zones, query, sources=source)
    return flows if query.cap is None else flows.orderBy(*flow_order()).limit(query.cap)
