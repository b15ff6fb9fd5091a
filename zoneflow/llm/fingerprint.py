"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

The sketch of a text holds the SKETCH smallest 64-bit hashes of its shingles of five words; a text of fewer words is one
shingle. Two sketches merge into that of the texts together, and tell resemblance, containment and the number of distinct
shingles.

Results: null counts as an empty text; texts without words have an empty sketch, resemble another such text fully (1) and any
other not at all (0). Repeated rows keep their own results; of rows that share an id, the next document is that of the next larger
id, and within an id the rows follow in a hash order of their texts. A null id comes first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneflow.llm import common

SKETCH = 128
SHINGLE = 5


def with_sketch(df: DataFrame, text: str, name: str, k: int = SKETCH, shingle: int = SHINGLE) -> DataFrame:
    """Adds the sorted array of the k smallest shingle hashes of a text column."""
    hashes, words = f"{name}_words", F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    n = F.size(hashes)
    longer = F.transform(
        F.sequence(F.lit(1), F.greatest(n - (shingle - 1), F.lit(1))),
        lambda i: F.xxhash64(*[F.try_element_at(hashes, i + j) for j in range(shingle)]),
    )
    every = F.when(n > 0, longer).otherwise(F.array().cast("array<bigint>"))
    with_words = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    return with_words.withColumn(name, F.slice(F.sort_array(F.array_distinct(every)), 1, k)).drop(hashes)


def merged(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, keys: list[str], sketch: str, k: int = SKETCH) -> DataFrame:
    """Sketch of all rows of each key, merged hash by hash, so that no group is gathered in one place."""
    hashes = df.select(*keys, F.explode(sketch).alias("hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
    return hashes.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Share of the smallest hashes of both texts together that both have: exact for fewer than k shingles."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    spread = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(spread, F.lit(2.0**-64)))


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of the shingles of a that b has too."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(shared / distinct_shingles(a, k), F.lit(1.0)))


def as_text(sketch: Column) -> Column:
    return F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def next_rows(rows: DataFrame, order: list[str], key: str) -> DataFrame:
    """Adds next_key, the key of the following row; the last row is followed by the first.

    Rows are range-partitioned; only the first row of each partition is looked at beyond it, as many rows as partitions."""
    parts = common.checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    firsts = parts.groupBy("part").agg(F.min(F.struct(*[F.struct(F.col(o).isNotNull(), F.col(o)) for o in order], F.col(key).alias("first_key"))).alias("f"))
    ahead = firsts.select("part", F.col("f.first_key").alias("own"), F.lead("f.first_key").over(Window.orderBy("part")).alias("ahead"), F.first("f.first_key").over(Window.orderBy("part")).alias("very_first"))
    after = ahead.select("part", F.coalesce("ahead", "very_first").alias("after"))
    return parts.withColumn("within", F.lead(key).over(inside)).join(F.broadcast(after), "part").withColumn("next_key", F.coalesce("within", "after")).drop("part", "within", "after")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    Texts are dealt by row once; what a document takes from the next one is sent to it as a head and a sketch."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", F.sha2("text", 256)))
    # rows equal in id and text are one link of the chain
    links = rows.groupBy("key", F.col("doc_id").alias("id")).agg(F.first(F.char_length("text")).alias("n"))
    chain = next_rows(links, ["id", "key"], "key")
    before = chain.select(F.col("next_key").alias("key"), F.col("key").alias("before"), F.floor(F.col("n") / 2).cast("int").alias("wanted"))
    dealt = rows.repartition("key")
    following = dealt.join(before, "key")
    following = with_sketch(following.withColumn("head", F.left("text", F.col("wanted"))), "text", "next_sketch")
    # the id goes along so that both uses of the dealt texts ask for the same columns and share one exchange
    heads = following.groupBy(F.col("before").alias("key")).agg(F.first(F.struct("doc_id", "head", "next_sketch")).alias("f")).select("key", "f.head", "f.next_sketch")
    n = F.char_length("text")
    both = with_sketch(dealt.join(heads, "key").withColumn("n_chars", n.cast("bigint")), "text", "sketch")
    edited = both.withColumn("edited", F.concat(F.left("text", n - F.floor(n / 2).cast("int")), F.col("head")))
    return with_sketch(edited, "edited", "edited_sketch")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint_pairs(common.table(spark, sf_dir, "documents"))
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(other).alias("edited_fingerprint"),
        resemblance(own, other).alias("near_edited"), resemblance(own, following).alias("near_next"),
        distinct_shingles(own).alias("n_distinct"), containment(own, other).alias("kept_share"),
    )
