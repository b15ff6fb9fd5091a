"""Breakdown of a flow set into shares: per zone with top-N and "others", per flow type, per tab."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zoneflow import texts
from zoneflow.functions.flows import internal_kind, round_half_up
from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.params import TOP_N_DEFAULT, clamp_top_n, resolve_level

# The tabs of a breakdown. Each zone tab sums one tag of the flow set by one endpoint.
OVERVIEW = "overview"
ZONE_TABS = {
    "outgoing": ("outgoing", "dest_id"),
    "incoming": ("incoming", "origin_id"),
    "internal_origins": ("internal", "origin_id"),
    "internal_dests": ("internal", "dest_id"),
    "origin": ("internal", "origin_id"),
    "dest": ("internal", "dest_id"),
}

# Slices of the overview, in their order.
_OVERVIEW_LABELS = {
    "outgoing": texts.TAG_LABELS["outgoing"],
    "incoming": texts.TAG_LABELS["incoming"],
    "inter_selected": texts.INTER_SELECTED,
    "intra_zone": texts.INTRA_ZONE,
    "internal": texts.TAG_LABELS["internal"],
}

OTHERS = "others"
_PARTS = 64  # salted parts of a tab
LABEL_MIN_SHARE = 0.05  # fixed value: smaller slices carry no label


def tabs_of(mode: int, role: str = "origin", direction: str = "both") -> list[str]:
    """Tabs a breakdown shows. Where there is a single view this is its default tab."""
    if mode == 4:
        return [OVERVIEW, "outgoing", "incoming", "internal_origins", "internal_dests"]
    if mode == 2:
        return ["origin", "dest"]
    if role == "destination" or direction == "incoming":
        return ["incoming"]
    return ["outgoing", "incoming"] if direction == "both" else ["outgoing"]


def trips_by(flows: DataFrame, endpoint: str) -> DataFrame:
    """Trips of a flow set per origin or per destination: `id, trips`."""
    if endpoint not in ("origin_id", "dest_id"):
        raise ValueError(f"invalid endpoint {endpoint!r}")
    return flows.groupBy(F.col(endpoint).alias("id")).agg(F.sum("trips").alias("trips"))


def overview(flows: DataFrame, include_self_loops: bool) -> DataFrame:
    """Trips per flow type: `id, label, trips, ord`. With self-loops, internal flows split by whether they leave their zone."""
    summed = flows.groupBy(_flow_type(include_self_loops).alias("id")).agg(F.sum("trips").alias("trips")).where("trips > 0")
    return summed.select("id", _overview_label(F.col("id")).alias("label"), "trips", _overview_position(F.col("id")).alias("ord"))


def _flow_type(include_self_loops: bool) -> Column:
    internal = internal_kind("inter_selected", "intra_zone") if include_self_loops else F.lit("internal")
    return F.when(F.col("tag") == "internal", internal).otherwise(F.col("tag"))


def _overview_label(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for item in _OVERVIEW_LABELS.items() for x in item])[kind]


def _overview_position(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _OVERVIEW_LABELS)), kind).cast("int")


def slices(
    flows: DataFrame, zones: ZoneModel, tabs: Sequence[str], include_self_loops: bool,
    map_level: str, counterpart_level: str | None = None, role: str = "origin", top_n: int = TOP_N_DEFAULT,
) -> DataFrame:
    """Slices of the given tabs: `tab, id, label, trips, n_zones, ord`.

    A zone tab holds its top-N zones, ranked by trips with ties by id, and folds the rest into one row with the id
    'others' that counts its zones; there is none when nothing is left. The overview holds every flow type.

    All tabs come from one pass over the flows. Trips are summed per zone first. Zones are then ranked in salted parts of
    a tab; the best N of each part stay candidates and the others are summed at once, so what meets in the final ranking
    of a tab is bounded, whatever the number of zones.
    """
    top_n, near = clamp_top_n(top_n), resolve_level(map_level)
    far = resolve_level(counterpart_level or near)
    entries = [
        F.when(F.col("tag") == tag, F.struct(F.lit(tab).alias("tab"), F.col(endpoint).alias("id")))
        for tab, (tag, endpoint) in ZONE_TABS.items() if tab in tabs
    ]
    if OVERVIEW in tabs:
        entries.append(F.struct(F.lit(OVERVIEW).alias("tab"), _flow_type(include_self_loops).alias("id")))
    exploded = flows.select("trips", F.inline(F.array_compact(F.array(*entries))))
    totals = exploded.groupBy("tab", "id").agg(F.sum("trips").alias("trips")).where("tab <> 'overview' OR trips > 0")

    is_overview, best = F.col("tab") == OVERVIEW, [F.desc("trips"), F.asc("id")]
    part = Window.partitionBy("tab", "salt").orderBy(*best)
    salted = totals.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_PARTS))).withColumn("r", F.row_number().over(part))
    kept = F.when(is_overview | (F.col("r") <= top_n), F.col("id"))
    parts = salted.groupBy("tab", "salt", kept.alias("id")).agg(F.sum("trips").alias("trips"), F.count("*").alias("n_zones"))

    rank = F.row_number().over(Window.partitionBy("tab").orderBy(F.col("id").isNull(), *best))
    ranked = parts.withColumn("rank", F.when(F.col("id").isNotNull(), rank))
    place = F.when(is_overview, _overview_position(F.col("id"))).when(F.col("rank") <= top_n, F.col("rank"))
    placed = ranked.withColumn("place", place)
    folded = placed.groupBy(
        "tab", F.coalesce("place", F.lit(top_n + 1)).alias("ord"), F.when(F.col("place").isNotNull(), F.col("id")).alias("zone")
    ).agg(F.sum("trips").alias("trips"), F.sum("n_zones").alias("n_zones"))

    # Origins are named at the counterpart level, destinations too unless the selection is the destination.
    by_origin = F.col("tab").isin([tab for tab, (_, endpoint) in ZONE_TABS.items() if endpoint == "origin_id"])
    level = F.when(by_origin, far).when(~is_overview, far if role == "origin" else near)
    names = zones.labels([far, near]).withColumnRenamed("id", "zone")
    labelled = folded.withColumn("level", level).join(zones.hint(names), ["level", "zone"], "left")
    others = F.col("zone").isNull()
    label = F.when(others, F.format_string(texts.OTHERS_LABEL, F.col("n_zones"))).when(
        is_overview, _overview_label(F.col("zone"))
    ).otherwise(F.coalesce("label", "zone"))
    return labelled.select(
        "tab", F.when(others, OTHERS).otherwise(F.col("zone")).alias("id"), label.alias("label"), "trips", "n_zones", "ord"
    )


def percent(trips: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(trips / total * 100, 1)).otherwise(0.0)


def shares(df: DataFrame) -> DataFrame:
    """Add `pct`, the share of each slice in its tab, to one decimal. Takes slices, at most N + 1 rows per tab."""
    total = F.sum("trips").over(Window.partitionBy("tab"))
    return df.withColumn("pct", percent(F.col("trips"), total))


def angles(df: DataFrame) -> DataFrame:
    """Add start, sweep and middle angle in degrees of each slice in its order, and whether it is labelled. Takes slices."""
    tab = Window.partitionBy("tab")
    before = tab.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("trips") / F.sum("trips").over(tab)
    start = F.coalesce(F.sum("trips").over(before), F.lit(0.0)) / F.sum("trips").over(tab) * 360
    return df.withColumns({"start_deg": start, "sweep_deg": share * 360, "show_label": share >= LABEL_MIN_SHARE}).withColumn(
        "mid_deg", F.col("start_deg") + F.col("sweep_deg") / 2
    )


def export_table(df: DataFrame) -> DataFrame:
    """Breakdown export: `tab, ord, id, label, trips, pct` with rounded trips and a total row per non-empty tab.

    Takes slices; as a tab has few of them, its rows and their total are put together in one group.
    """
    shown_id = F.when(F.col("id") == OTHERS, texts.OTHERS_ID).otherwise(F.col("id"))
    row = F.struct(
        F.col("ord").cast("bigint").alias("ord"), shown_id.alias("id"), "label",
        round_half_up(F.col("trips")).alias("trips"), "pct",
    )
    grouped = shares(df).select("tab", row.alias("row")).groupBy("tab").agg(
        F.collect_list("row").alias("rows"), F.sum("row.trips").alias("total"), F.max("row.ord").alias("last")
    )
    total = F.struct(
        (F.col("last") + 1).alias("ord"), F.lit("").alias("id"), F.lit(texts.TOTAL).alias("label"),
        F.col("total").alias("trips"), F.lit(100.0).alias("pct"),
    )
    return grouped.select("tab", F.inline(F.concat("rows", F.array(total))))


def flow_totals(flows: DataFrame) -> DataFrame:
    """One row: number of flows over all tags, rounded trips, smallest and largest flow."""
    return flows.agg(
        F.count("*").alias("n_flows"), F.coalesce(round_half_up(F.sum("trips")), F.lit(0)).alias("total_trips"),
        F.min("trips").alias("min_trips"), F.max("trips").alias("max_trips"),
    )
