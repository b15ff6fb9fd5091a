"""Importance resampling of documents towards the distribution of a target table.

The features of a text (runs of words) fall into a fixed number of buckets. The log ratio of the smoothed shares that a bucket has
in the target and in the documents is its gain, kept in an array that every task looks up; a document's weight is its mean gain.
Weights plus Gumbel noise that depends on the id alone are the scores, so that taking the highest of them draws without replacement.

The cutoff is found exactly by the weighted median of medians: every partition reports the median and the number of its remaining
keys, the median of the medians, weighted by those numbers, is the pivot, and at least a quarter of all remaining keys fall away
with each of its sides. One job a round counts both sides and finds the next medians of both. Winners are sorted by ranges.

Results: a null or wordless text has no features and weight 0, and is never drawn unless the least number of words is 0. A null id
draws as an empty id and comes after all others of its score. Rows that share an id are rows of their own; what ties in score and
id is ranked in the order of the table. Repeated target rows count as often as they stand there. Empty tables give empty results;
without a target every gain follows the documents alone. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import common, terms

#: Buckets of the features, longest run of words that is one, seed of the noise, least words of a document to draw, percent drawn.
BUCKETS, RUN, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Words whose bucket a task remembers.
REMEMBERED = 200_000
#: A null id as a key: after all others.
LAST = (1 << 63) - 1


class Buckets(dict):
    """Bucket of each feature, computed when first asked for."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found

    def of(self, words: list[bytes], run: int) -> np.ndarray:
        """Buckets of all runs of 1 to `run` words, repeats included."""
        found = [self[w] for w in words]
        for n in range(2, run + 1):
            found += [self[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
        return np.array(found, np.int64)


def bucket_counts(table: DataFrame, buckets: int, run: int) -> np.ndarray:
    """Features of all texts in each bucket; what travels is one number a bucket and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in common.blocks(batches, "text"):
            for text in batch["text"].cast(pa.binary()).to_pylist():
                total += np.bincount(known.of(terms.words(text), run), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in table.select("text").mapInArrow(scan, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    size, s, t = len(docs), int(docs.sum()), int(target.sum())
    ratio = [float((b + 1) * (s + size)) / float((a + 1) * (t + size)) for a, b in zip(docs.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(shared.value))
        for batch in common.blocks(batches, "text"):
            found = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                words = terms.words(text)
                at = known.of(words, run)
                found[:, i] = len(words), len(at), shared.value[at].sum() // max(1, len(at))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, found)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int) -> Column:
    """Thousandths of Gumbel noise, drawn by the id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000) * F.log(-F.log((draw + F.lit(0.5)) / F.lit(4294967296.0))))


def middle(keys: np.ndarray) -> list[int]:
    """The lower median of key columns; zeros if there are none."""
    n = keys.shape[1]
    return keys[:, np.lexsort(keys[::-1])[(n - 1) // 2]].tolist() if n else [0, 0, 0]


SIDES = [f"{side}_{name}" for side in ("before", "after") for name in ("n", "score", "id", "place")]


def halves(keys: DataFrame, pivot: tuple | None, low: tuple | None, high: tuple | None) -> list:
    """Per partition the number and the median of the keys between low and high that come before the pivot, and of those after it."""
    if low:
        keys = keys.where(F.col("score") <= -low[0])
    if high:
        keys = keys.where(F.col("score") >= -high[0])

    def before(found: np.ndarray, key: tuple) -> np.ndarray:
        a, b, c = found
        return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c < key[2]))))

    def same(found: np.ndarray, key: tuple) -> np.ndarray:
        return (found == np.array(key)[:, None]).all(axis=0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([-b["score"].to_numpy(), b["doc_id"].fill_null(LAST).to_numpy(), b["place"].to_numpy()]) for b in batches]
        found = np.concatenate([np.zeros((3, 0), np.int64), *parts], axis=1)
        if low:
            found = found[:, ~before(found, low) & ~same(found, low)]
        if high:
            found = found[:, before(found, high)]
        first = before(found, pivot) if pivot else np.ones(found.shape[1], bool)
        rest = ~first & ~same(found, pivot) if pivot else ~first
        row = [x for side in (first, rest) for x in (int(side.sum()), *middle(found[:, side]))]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], SIDES)

    return keys.select("score", "doc_id", "place").mapInArrow(count, ", ".join(f"{name} bigint" for name in SIDES)).collect()


def side(rows: list, name: str) -> list[tuple[int, tuple]]:
    """Number and median of each partition that has keys left on that side."""
    found = [(r[f"{name}_n"], (r[f"{name}_score"], r[f"{name}_id"], r[f"{name}_place"])) for r in rows]
    return [f for f in found if f[0]]


def weighted_middle(medians: list[tuple[int, tuple]]) -> tuple:
    """The least median up to which half of all keys are in partitions of smaller or equal medians."""
    half, seen = sum(n for n, _ in medians) / 2, 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys left")


def cutoff(keys: DataFrame, medians: list[tuple[int, tuple]], k: int) -> tuple:
    """The k-th key (from 1) in the order of falling score, rising id and place."""
    low = high = None
    while True:
        pivot = weighted_middle(medians)
        rows = halves(keys, pivot, low, high)
        first, rest = side(rows, "before"), side(rows, "after")
        n = sum(m[0] for m in first)
        if k == n + 1:
            return pivot
        if k <= n:
            high, medians = pivot, first
        else:
            low, medians, k = pivot, rest, k - n - 1


def ranked(winners: DataFrame) -> DataFrame:
    """Adds the rank from 1 by ranges of keys, each sorted by itself, plus the number of rows in the ranges before."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    placed = winners.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("position", F.monotonically_increasing_id())
    placed = common.stored(placed.withColumn("part", F.shiftright("position", 33)), "winners")
    before, rows = 0, []
    for row in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        rows.append((row.part, before))
        before += row.n
    starts = placed.sparkSession.createDataFrame(rows, "part bigint, before bigint")
    index = F.col("position").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + index + 1)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rows not drawn have no rank."""
    gain = gains(bucket_counts(docs, buckets, run), bucket_counts(target, buckets, run))
    scored = weighed(docs, gain, run).withColumn("score", F.col("weight") + noise(seed)).withColumn("place", F.monotonically_increasing_id())
    keys = common.stored(scored.sortWithinPartitions(F.desc("score")), "resampling")
    drawable = keys.where(F.col("n_words") >= least_words)
    medians = side(halves(drawable, None, None, None), "before")
    k = percent * sum(n for n, _ in medians) // 100
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return keys.withColumn("rank", F.lit(None).cast("bigint")).select(*columns)
    score, ident, place = cutoff(drawable, medians, k)
    own = F.coalesce("doc_id", F.lit(LAST))
    won = (F.col("score") > -score) | ((F.col("score") == -score) & ((own < ident) | ((own == ident) & (F.col("place") <= place))))
    won = won & (F.col("n_words") >= least_words)
    lost = keys.where(~won).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked(keys.where(won)).select(*columns).union(lost.select(*columns))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
doc_words AS (SELECT doc_id, unnest(ws) AS w FROM docs),
item_words AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM doc_words UNION SELECT w FROM item_words)),
bucketed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) % {BUCKETS} AS b
  FROM hexed, steps
),
s AS (SELECT b, count(*) AS n FROM doc_words JOIN bucketed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM item_words JOIN bucketed USING (w) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM doc_words) + {BUCKETS}) AS DOUBLE)
    / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM item_words) + {BUCKETS}) AS DOUBLE))) AS g
  FROM (SELECT DISTINCT b FROM bucketed) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
),
weights AS (SELECT doc_id, floor(sum(g) / count(*)) AS weight FROM doc_words JOIN bucketed USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (doc_id)
),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
