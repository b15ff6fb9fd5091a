"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A document of source s is wanted `rate(s)` times on average: the target weight of s times all characters, over the characters
of s. Its number of copies is the quantile of the Poisson distribution of that mean at a position hashed from seed, id and
text. The copies of all sources are then dealt by a hash over the whole corpus.

Results: a null source is a source of its own; a null or empty text counts as one character more than it has, as does any
other, so that no source is without size; a null id hashes as an empty one. Rows equal in id and text get the same number of
copies. An empty table gives an empty table. Columns named like the added ones (`copy`, `shuffle_key`) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneflow.llm import common

#: Numbers in all quantile tables together up to which they are sent to every executor.
BROADCAST_NUMBERS = 1_000_000
#: Sampling temperature: the target weight of a source is its share of the corpus to this power.
POWER = 0.5
SEED = 5
KEY = "mix_source"


def position(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def source_rates(docs: DataFrame, power: float = POWER) -> DataFrame:
    """Target repetition rate of each source, the corpus keeping its size."""
    sizes = docs.groupBy(F.col("source").alias(KEY)).agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)) + 1).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    weights = sizes.join(F.broadcast(total)).withColumn("weight", F.pow(F.col("size") / F.col("total"), F.lit(power)))
    norm = weights.agg(F.sum("weight").alias("norm"))
    return weights.join(F.broadcast(norm)).select(KEY, (F.col("weight") / F.col("norm") * F.col("total") / F.col("size")).alias("rate"))


def quantile_tables(rates: DataFrame) -> DataFrame:
    """The Poisson distribution function of each rate as a sorted array: as far as it differs from 1."""
    reach = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30)
    by_source = Window.partitionBy(KEY).orderBy("k")
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(by_source)
    mass = F.exp(F.col("k") * F.log("rate") - F.col("rate") - log_factorial)
    terms = rates.select(KEY, "rate", F.explode(F.sequence(F.lit(0), reach.cast("int"))).alias("k")).withColumn("mass", mass)
    return terms.withColumn("below", F.sum("mass").over(by_source)).groupBy(KEY).agg(F.array_sort(F.collect_list("below")).alias("mix_below"))


def replicate(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """Copies of each document, without order."""
    docs = docs.drop("copy", "shuffle_key", "mix_below")
    tables = common.checkpointed(tables)
    if (tables.agg(F.sum(F.size("mix_below"))).first()[0] or 0) <= BROADCAST_NUMBERS:
        tables = F.broadcast(tables)
    known = docs.join(tables, docs["source"].eqNullSafe(tables[KEY]), "left").drop(KEY)
    at = position(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    copies = F.size(F.filter("mix_below", lambda below: below <= F.col("mix_at")))
    counted = known.withColumn("mix_at", at).withColumn("mix_n", copies).where("mix_n > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1))).drop("mix_below", "mix_at", "mix_n")


def mix(docs: DataFrame, power: float = POWER) -> DataFrame:
    """Replicated documents, dealt over all partitions by a hash, shuffle_key, and in its order within each."""
    copies = replicate(docs, quantile_tables(source_rates(docs, power)))
    key = F.md5(F.concat_ws(":", F.lit(SEED + 1), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy"))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0) + 1) AS size FROM documents GROUP BY source),
weights AS (SELECT source, size, sum(size) OVER () AS total, pow(size / sum(size) OVER (), {POWER}) AS weight FROM sizes),
rates AS (SELECT source, weight / sum(weight) OVER () * total / size AS rate FROM weights),
terms AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS mass
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates)
),
below AS (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
placed AS (
  SELECT *, CAST('0x' || substr(md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))), 1, 13) AS BIGINT)
    / 4503599627370496.0 AS mix_at
  FROM documents
)
SELECT p.doc_id, p.text, p.lang, p.source, p.n_chars, CAST(b.k AS INTEGER) AS copy,
  md5(concat('{SEED + 1}:', coalesce(CAST(p.doc_id AS VARCHAR), ''), ':', b.k)) AS shuffle_key
FROM placed p JOIN below b ON p.source IS NOT DISTINCT FROM b.source AND b.below <= p.mix_at
"""
