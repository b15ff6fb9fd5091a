"""Ranked lexical search with buckets of similar vector length.

A document is the vector of its term impacts over the terms of the queries, a query the vector of its term weights; a score is their
inner product. Document vectors are ordered by length (Euclidean norm) and dealt into buckets. The bucket of the longest vectors is
searched first; the scores it ends with are thresholds for all others. Of a block of vectors in the order of their length, queries
whose own length times the longest vector's stays below their threshold are pruned (Cauchy-Schwarz). For those left the heaviest
coordinates of the query are multiplied out and the rest is bounded by the lengths that remain; only pairs whose bound reaches
the threshold are scored, in whole numbers. A task keeps the best rows of each query and raises its thresholds as it goes on.

Queries come in blocks of at most QUERY_TERMS terms, so that a task's terms, thresholds and vectors have a bounded size; every block
is searched against all documents.

Results: a null or wordless text matches nothing, and an item without terms, or whose terms no document holds, has no rows. Rows of
`items` that share an id (a null id, too) are one query of all their terms. Document rows that share an id are rows of their own; a
null document id comes after all others of its score. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneflow.llm import common, terms

#: Rows a query returns; terms of a block of queries, a single longer query being a block of its own; documents of a bucket.
TOP, QUERY_TERMS, BUCKET_ROWS = 50, 1 << 16, 8192
#: Share (percent) of a document's length in its impacts, impact of a term in whole numbers, saturation in thousandths.
LENGTH_SHARE, UNIT, SATURATION = 50, 1_000_000_000, 20
#: Coordinates multiplied out before a pair is scored; cells of a block of vectors and of pairs in a worker.
FOCUS, CELLS = 8, 1 << 22
#: Bounds are computed in floating point and widened by this share.
SLACK = 1 + 1e-9
LAST = (1 << 63) - 1


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "text"):
            found = [sorted(set(terms.words(t))) for t in batch["text"].cast(pa.binary()).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(row)), pa.array([t for f in found for t in f], pa.binary())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(scan, f"item_id {kind}, term binary").distinct()


def query_blocks(asked: DataFrame) -> list[Column]:
    """Conditions on item_id that split the queries into blocks of at most QUERY_TERMS terms."""
    blocks, size = [], 0
    for row in asked.groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("item_id")).collect():
        if not blocks or size + row.n > QUERY_TERMS:
            blocks.append([])
            size = 0
        blocks[-1].append(row.item_id)
        size += row.n
    conditions = []
    for ids in blocks:
        known = [i for i in ids if i is not None]
        inside = F.col("item_id").between(known[0], known[-1]) if known else F.lit(False)
        conditions.append(inside | F.col("item_id").isNull() if len(known) < len(ids) else inside)
    return conditions


class Queries:
    """Queries of a block: `names` by number; `term` and `start` hold the term numbers of each query one after the other."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r.item_id is not None, r.item_id, r.term))
        self.names = list(dict.fromkeys(r.item_id for r in rows))
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary = {t: i for i, t in enumerate(dict.fromkeys(bytes(r.term) for r in rows))}
        self.term = np.array([self.vocabulary[bytes(r.term)] for r in rows], np.int64)
        self.start = np.searchsorted([number[r.item_id] for r in rows], np.arange(len(self.names) + 1))

    def weigh(self, weight: np.ndarray) -> None:
        """Takes the weights of all terms; finds the lengths of the queries and their heaviest coordinates."""
        self.weight = weight
        n = len(self.names)
        own = np.repeat(np.arange(n), np.diff(self.start))
        w = weight[self.term]
        self.focus, self.focus_weight = np.full((n, FOCUS), len(weight)), np.zeros((n, FOCUS), np.int64)
        order = np.lexsort((-w, own))
        rank = np.arange(len(order)) - self.start[own[order]]
        chosen = rank < FOCUS
        self.focus[own[order][chosen], rank[chosen]] = self.term[order][chosen]
        self.focus_weight[own[order][chosen], rank[chosen]] = w[order][chosen]
        whole = np.bincount(own, w.astype(float) ** 2, n)
        self.length = np.sqrt(whole)
        self.rest_length = np.sqrt(np.maximum(0, whole - (self.focus_weight.astype(float) ** 2).sum(axis=1)))

    def scores(self, block: np.ndarray, doc: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a vector of the block and a query."""
        found = np.zeros(len(doc), np.int64)
        size = self.start[query + 1] - self.start[query]
        cuts = np.searchsorted(np.cumsum(size), np.arange(CELLS, int(size.sum()), CELLS)) + 1
        for at in np.split(np.arange(len(doc)), np.unique(cuts)):
            if len(at):
                n = size[at]
                first = np.cumsum(n) - n
                term = self.term[np.repeat(self.start[query[at]] - first, n) + np.arange(first[-1] + n[-1])]
                found[at] = np.add.reduceat(block[np.repeat(doc[at], n), term] * self.weight[term], first)
        return found


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms, numbers of its known terms and how often each occurs, of every document with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in common.blocks(batches, "text"):
            size, at, often = np.zeros(batch.num_rows, np.int64), [], []
            for i, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
                words = terms.words(text)
                size[i] = len(words)
                own = np.unique(np.array([known[w] for w in words if w in known], np.int32), return_counts=True)
                at.append(own[0])
                often.append(own[1])
            ends = pa.array(np.cumsum([0, *(len(a) for a in at)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((at, np.int32), (often, np.int64))]
            rows = pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size), *lists], ["doc_id", "n", "terms", "often"])
            yield rows.filter(pa.array(size > 0))

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n bigint, terms array<int>, often array<bigint>")


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the offsets between its rows."""
    lists = batch[name]
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def impacts(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, squared length, term numbers and impacts of every vector."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            often, ends = flat(batch, "often")
            slow = SATURATION * (100 - LENGTH_SHARE + (LENGTH_SHARE * batch["n"].to_numpy() * n_docs) // n_terms)
            found = (UNIT * often) // (1000 * often + np.repeat(slow, np.diff(ends)))
            square = common.per_row(found**2, ends)
            at = flat(batch, "terms")[0]
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (at, found)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(square), *lists], ["doc_id", "square", "terms", "impacts"])

    known = rows.where(F.size("terms") > 0)
    return known.mapInArrow(scan, "doc_id bigint, square bigint, terms array<int>, impacts array<int>")


class Best:
    """The best rows of each query so far, and the score that a row needs."""

    def __init__(self, need: np.ndarray, top: int):
        self.need, self.top = np.maximum(need, 1), top
        self.rows = np.zeros((3, 0), np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([query, score, doc])], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        rank = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        last = rank == self.top - 1
        self.need[rows[0, last]] = np.maximum(self.need[rows[0, last]], rows[1, last])
        self.rows = rows[:, rank < self.top]


def searched(buckets: DataFrame, queries: Queries, need: np.ndarray, top: int) -> DataFrame:
    """Best rows (query, score, doc_id) of each task; what can no longer be among the best `top` is left out."""
    shared = buckets.sparkSession.sparkContext.broadcast((vars(queries), need))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, needed = shared.value
        q, best = common.restored(Queries, fields), Best(needed.copy(), top)
        width = len(q.weight) + 1  # one more for coordinates that a query does not have
        for batch in batches:
            ids = batch["doc_id"].fill_null(LAST).to_numpy()
            squares = batch["square"].to_numpy().astype(float)
            at, ends = flat(batch, "terms")
            impact = flat(batch, "impacts")[0]
            rows = max(1, CELLS // max(width, len(q.names)))
            for a in range(0, batch.num_rows, rows):
                b = min(a + rows, batch.num_rows)
                asked = np.flatnonzero(q.length * math.sqrt(squares[a:b].max()) * SLACK >= best.need)  # Cauchy-Schwarz
                if not len(asked):
                    continue
                block = np.zeros((b - a, width), np.int64)
                part = slice(ends[a], ends[b])
                block[np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), at[part]] = impact[part]
                known, left = np.zeros((b - a, len(asked))), np.repeat(squares[a:b, None], len(asked), axis=1)
                for f in range(FOCUS):
                    values = block[:, q.focus[asked, f]].astype(float)
                    known += values * q.focus_weight[asked, f]
                    left -= values**2
                bound = known + q.rest_length[asked] * np.sqrt(np.maximum(left, 0))
                doc, column = np.nonzero(bound * SLACK >= best.need[asked])
                query = asked[column]
                score = q.scores(block, doc, query)
                good = score >= best.need[query]
                best.add(query[good], score[good], ids[a:b][doc[good]])
        query, score, doc = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score), pa.array(doc, mask=doc == LAST)], ["query", "score", "doc_id"])

    return buckets.select("doc_id", "square", "terms", "impacts").mapInArrow(scan, "query bigint, score bigint, doc_id bigint")


def by_length(found: DataFrame, rows: int) -> DataFrame:
    """The vectors, longest first, in buckets of some thousand; equal lengths may part, so no length makes a bucket too large."""
    order = [F.desc("square"), F.asc("doc_id")]
    placed = found.repartitionByRange(max(1, -(-rows // BUCKET_ROWS)), *order).sortWithinPartitions(*order)
    return common.stored(placed.withColumn("bucket", F.shiftright(F.monotonically_increasing_id(), 33)), "lengths")


def search_block(docs: DataFrame, queries: Queries, top: int) -> DataFrame | None:
    """query, score and doc_id, among them the best `top` rows of every query of a block; None if there are none."""
    rows = common.stored(vectors(docs, queries.vocabulary), "vectors")
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.count_if(F.size("terms") > 0).alias("known")).first()
    if not total.known:
        return None
    holders = np.zeros(len(queries.vocabulary), np.int64)
    for row in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # one row a term of the block
        holders[row.t] = row.n
    queries.weigh(np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * n + 1))) for n in holders.tolist()], np.int64))
    buckets = by_length(impacts(rows, total.docs, total.terms), total.known)
    none = np.zeros(len(queries.names), np.int64)
    first = common.stored(searched(buckets.where("bucket = 0"), queries, none, top), "longest")
    need = none.copy()
    for row in best(first, top).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).collect():  # one row a query
        need[row["query"]] = row.score if row.n == top else 0
    return first.union(searched(buckets.where("bucket > 0"), queries, need, top))


def best(rows: DataFrame, top: int) -> DataFrame:
    """Adds the rank of each query's best `top` rows."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the best `top` documents of every item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    asked = common.stored(item_terms(items), "queries")
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for inside in query_blocks(asked):
        queries = Queries(asked.where(inside).collect())
        rows = search_block(docs, queries, top)
        if rows is not None:
            names = spark.createDataFrame(list(enumerate(queries.names)), f"query bigint, item_id {kind}")
            result = result.union(best(rows, top).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return result


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_LOWER = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH tf AS (SELECT doc_id, {_LOWER} AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS t FROM documents) GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, {_LOWER} AS term FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
weighed AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN df USING (term), total),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * (({UNIT} * tf) // (1000 * tf + {SATURATION} * (100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // terms)))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id
),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
