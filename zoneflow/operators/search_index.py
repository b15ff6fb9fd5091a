"""Text search over zones by posting lists of letter pairs and triples.

A zone stands in the posting list of every pair and triple of letters of its lower-case label and id. A text is looked up by its triples (its
pair, if it has two letters): only these lists are read, zones found in all of them are verified, so the answer is that of a scan. Postings are sorted by
their letters, and letters reach the scan as ranges, so files, row groups and pages of other letters are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.operators.export import SEARCH_MIN_CHARS, SEARCH_RESULTS
from zoneflow.operators.hierarchy import ZoneModel
from zoneflow.params import LEVELS

POSTINGS_SCHEMA = "gram string, id string, label string, level string"
SIZES = (2, 3)


def grams(text: Column, size: int) -> Column:
    """Distinct runs of `size` letters of a lower-case text; null and shorter texts have none."""
    last = F.length(text) - size + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_distinct(F.transform(places, lambda at: F.substring(text, at, F.lit(size))))


def postings(zones: ZoneModel, levels: Sequence[str] = LEVELS) -> DataFrame:
    """`gram, id, label, level`, a row per zone or group and run of letters in its label or id."""
    rows = zones.labels(levels).select("level", "id", "label")
    texts = [F.lower(F.coalesce(name, F.lit(""))) for name in ("label", "id")]
    every = F.array_union(F.array_union(grams(texts[0], 2), grams(texts[0], 3)), F.array_union(grams(texts[1], 2), grams(texts[1], 3)))
    return rows.select(F.explode(every).alias("gram"), "id", "label", "level")


def write_index(zones: ZoneModel, folder: str, levels: Sequence[str] = LEVELS) -> str:
    """Stores the postings, a folder per level, sorted by their letters over all files; a list of any length spreads over several."""
    path = f"{folder}/zone_search"
    keys = ["level", "gram", "id"]
    ordered = postings(zones, levels).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").partitionBy("level").parquet(path)
    return path


def search_index(spark: SparkSession, folder: str, level: str, text: str, selected: Sequence[str] = ()) -> DataFrame:
    """What `search_zones` finds, from the postings of the text's letters alone."""
    stored = spark.read.schema(POSTINGS_SCHEMA).parquet(f"{folder}/zone_search").where(F.col("level") == level)
    if len(text) < SEARCH_MIN_CHARS:
        return stored.select("id", "label").where(F.lit(False))
    wanted = text.lower()
    size = min(SIZES[-1], len(wanted))
    asked = sorted({wanted[i : i + size] for i in range(len(wanted) - size + 1)})
    met = stored.where(F.col("gram").isin(asked))
    if selected:
        met = met.where(~F.col("id").isin(list(selected)))
    # label and id may hold some of the letters each; only where one of them holds all in order does it count
    found = met.groupBy("id", "label").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
    hit = F.coalesce(F.contains(F.lower("label"), F.lit(wanted)), F.lit(False)) | F.contains(F.lower("id"), F.lit(wanted))
    return found.where(hit).select("id", "label").orderBy("id").limit(SEARCH_RESULTS)
