"""Result tables meant for files: labelled flows, filter summary, bounded name lists, zone search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneflow import texts
from zoneflow.functions.flows import day_label, hour_label, internal_kind, round_half_up, time_label
from zoneflow.functions.scale import top_per_group
from zoneflow.operators.flowmap import label_flows
from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.params import LEVEL_SOURCE, UI_MIN_TRIPS
from zoneflow.plans.modes import Selection

NAME_LIST_CHARS = 120  # fixed value: length budget of a name list
SEARCH_MIN_CHARS, SEARCH_RESULTS = 2, 8  # fixed values of the zone search

_TAG_POSITION = {"outgoing": 1, "incoming": 2, "internal": 3}


def flow_table(flows: DataFrame, zones: ZoneModel, selection: Selection) -> DataFrame:
    """`origin_id, origin_name, dest_id, dest_name, trips, type` with rounded trips."""
    kind = F.when(F.col("tag") == "outgoing", texts.TAG_LABELS["outgoing"]).when(
        F.col("tag") == "incoming", texts.TAG_LABELS["incoming"]
    ).otherwise(internal_kind(texts.INTER_SELECTED, texts.INTRA_ZONE))
    labelled = label_flows(flows, zones, selection.map_level, selection.counterpart_level)
    return labelled.select(
        "origin_id", F.col("origin_label").alias("origin_name"), "dest_id", F.col("dest_label").alias("dest_name"),
        round_half_up(F.col("trips")).alias("trips"), kind.alias("type"), "tag",
    )


def sorted_flow_table(table: DataFrame) -> DataFrame:
    """Export order: by rounded trips, then outgoing, incoming, internal, then ids."""
    return table.orderBy(F.desc("trips"), tag_position(), "origin_id", "dest_id")


def tag_position() -> Column:
    return F.create_map(*[F.lit(x) for item in _TAG_POSITION.items() for x in item])[F.col("tag")]


def export_name(selection: Selection) -> str:
    level = LEVEL_SOURCE[selection.map_level]
    return f"od_flows_{level}_{selection.day or 'all'}_{selection.hour_min}-{selection.hour_max}"


def filter_line(selection: Selection) -> Column:
    """Day and time of the filters in one line."""
    span = time_label(F.lit(selection.hour_min), F.lit(selection.hour_max))
    return F.concat(day_text(selection), F.lit(" · "), span)


def day_text(selection: Selection) -> Column:
    return day_label(F.lit(selection.day)) if selection.day else F.lit(texts.ALL_DAYS)


def legend_line(selection: Selection) -> str:
    """Short filter text: day, hours, and the threshold where it is not the usual one."""
    parts = [selection.day, f"h{selection.hour_min}–h{selection.hour_max} (excl.)"]
    if selection.min_trips != UI_MIN_TRIPS:
        parts.append(f"min {number_text(selection.min_trips)} trips")
    return " · ".join(part for part in parts if part)


def number_text(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def summary_table(flagged: DataFrame, zones: ZoneModel, selection: Selection) -> DataFrame:
    """Key/value rows `ord, key, value` that describe an exported flow set.

    Takes the result of `flow_set(..., with_flag=True)`. The total sums rounded flows. The warning row is there only if
    the set was cut. Selected zones follow in selection order, the first one with the key.
    """
    facts = flagged.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(round_half_up(F.col("trips"))), F.lit(0)).alias("total"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("cut"),
    )
    text = [
        (texts.KEY_DAY, day_text(selection)),
        (texts.KEY_HOURS, F.lit(hour_label(selection.hour_min, selection.hour_max))),
        (texts.KEY_MIN_TRIPS, F.lit(number_text(selection.min_trips))),
        (texts.KEY_SELF_LOOPS, F.lit(texts.YES if selection.include_self_loops else texts.NO)),
        (texts.KEY_LEVEL, F.lit(LEVEL_SOURCE[selection.map_level])),
        (texts.KEY_FLOWS, F.col("n").cast("string")),
        (texts.KEY_TRIPS, F.col("total").cast("string")),
        (texts.KEY_WARNING, F.when(F.col("cut"), texts.truncated_warning(selection.cap or 0))),
    ]
    rows = [
        F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(key).alias("key"), value.alias("value"))
        for i, (key, value) in enumerate(text, 1)
    ]
    head = facts.select(F.inline(F.array(*rows))).where(F.col("value").isNotNull() | (F.col("key") != texts.KEY_WARNING))
    if not selection.ids:
        return head

    ids = list(selection.ids)
    known = zones.labels([selection.map_level]).where(F.col("id").isin(ids)).agg(
        F.map_from_entries(F.collect_list(F.struct("id", F.coalesce("label", "id")))).alias("names")
    )  # one entry per selected zone
    names = known.select(F.posexplode(F.array(*[F.coalesce(F.col("names")[i], F.lit(i)) for i in ids])).alias("at", "value"))
    chosen = names.select(
        (F.col("at") + len(text) + 1).cast("bigint").alias("ord"),
        F.when(F.col("at") == 0, texts.KEY_ZONES).otherwise("").alias("key"), "value",
    )
    return head.unionByName(chosen)


def name_lists(names: DataFrame, max_chars: int = NAME_LIST_CHARS) -> DataFrame:
    """Names of each group joined by ", " within a length budget: `group_id, names`.

    Takes `group_id, ord, name`, with `ord` unique in a group. A list that fits is given whole. Otherwise names are taken
    in order while they fit together with the text that counts the remaining ones; the first that does not fit ends the
    list. As every name but the first takes two characters or more, a budget bounds how many can be shown: only that
    many names of a group are ever brought together, and the rest is just counted.
    """
    most = max_chars // 2 + 2
    counts = names.groupBy("group_id").agg(F.count("*").alias("n"))
    head = top_per_group(names.select("group_id", "ord", "name"), ["group_id"], [F.asc("ord")], most)
    lists = head.groupBy("group_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rnk", "name"))), lambda item: item["name"]
    ).alias("shown"))
    joined = lists.join(counts, "group_id")
    return joined.select("group_id", bounded_list(F.col("shown"), F.col("n"), max_chars).alias("names"))


def bounded_list(shown: Column, n: Column, max_chars: int) -> Column:
    """The text of one list: `shown` holds its first names, `n` counts all of them."""
    def text(k: Column) -> Column:
        left = n - k
        names = F.concat_ws(", ", F.slice(shown, F.lit(1), k))
        more = F.format_string(texts.MORE_ZONES, left)
        return F.when(left == 0, names).when(k == 0, more).otherwise(F.concat(names, F.lit(", "), more))

    lengths = F.transform(F.sequence(F.lit(1), F.size(shown)), lambda k: F.length(text(k)))
    first_miss = F.array_position(F.transform(lengths, lambda size: size > max_chars), True)
    taken = F.when(first_miss > 0, first_miss.cast("int") - 1).otherwise(F.size(shown))
    whole = F.concat_ws(", ", shown)
    fits = (F.size(shown) == n) & (F.length(whole) <= max_chars)
    return F.when(fits, whole).otherwise(text(taken))


def selected_zone_list(zones: ZoneModel, level: str, ids: Sequence[str], max_chars: int = NAME_LIST_CHARS) -> DataFrame:
    """One row `names`: the labels of the selected zones, in selection order, within the length budget."""
    known = zones.labels([level]).where(F.col("id").isin(list(ids)) & F.col("label").isNotNull()).agg(
        F.map_from_entries(F.collect_list(F.struct("id", "label"))).alias("names")
    )  # one entry per selected zone
    labels = F.array(*[F.coalesce(F.col("names")[i], F.lit(i)) for i in ids])
    return known.select(bounded_list(labels, F.lit(len(ids)), max_chars).alias("names"))


def search_zones(zones: ZoneModel, level: str, text: str, selected: Sequence[str] = ()) -> DataFrame:
    """First zones, in id order, whose label or id contains the text whatever its case: `id, label`.

    Zones already selected are left out, as is every zone for a text of fewer than two characters.
    """
    rows = zones.labels([level]).select("id", "label")
    if len(text) < SEARCH_MIN_CHARS:
        return rows.where(F.lit(False))
    wanted = F.lower(F.lit(text))
    hit = F.coalesce(F.contains(F.lower("label"), wanted), F.lit(False)) | F.contains(F.lower("id"), wanted)
    if selected:
        hit = hit & ~F.col("id").isin(list(selected))
    return rows.where(hit).orderBy("id").limit(SEARCH_RESULTS)
