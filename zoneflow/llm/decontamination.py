"""Benchmark decontamination by winnowing.

Of every SPAN - GRAM + 1 consecutive hashes of GRAM words the smallest are kept, so any SPAN words that a document shares with a
benchmark item hold a fingerprint that both kept. Fingerprints are joined, and each hit is extended word by word to both sides;
SPAN equal words or more are contamination. Items of fewer words are one fingerprint each, looked up at every document word.

Results: a null or wordless text has no words and no hits; items without words are never found. Rows that share an id keep their
own results. Repeated items count once; a null item id is found but not counted or listed. Empty tables give no hits. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import common

SPAN, GRAM = 10, 4
SIDE = SPAN - GRAM
WIDTH = SPAN + SIDE
FOUND = "start int, words int, key bigint, around binary"


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts: runs of digits, a-z and what is not ASCII, after A-Z were lower-cased."""
    data, offsets = common.utf8(texts)
    low = common.folded(data)
    return common.words(low, (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)), offsets)


def slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over `width` neighbouring values, from each on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = pick(values[: len(values) - step], values[step:]), have + step
    return values


def winnowed(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which kept fingerprints begin, and the fingerprints."""
    keys, window = common.grams(hashes, GRAM), SIDE + 1
    if len(keys) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = slid(keys, window, np.minimum)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least[text[: len(least)] != text[SPAN - 1 :][: len(least)]] = 0
    none = np.zeros(window - 1, np.uint64)
    most = slid(np.concatenate([none, least, none]), window, np.maximum)
    at = np.flatnonzero(most == keys)
    return at, keys[at]


def surroundings(hashes: np.ndarray, offsets: np.ndarray, text: np.ndarray, at: np.ndarray, missing: int) -> list[bytes]:
    """The words from SIDE before to SIDE after each fingerprint; `missing` stands where the text has none."""
    place = at[:, None] + np.arange(-SIDE, GRAM + SIDE)
    inside = (place >= offsets[text][:, None]) & (place < offsets[text + 1][:, None])
    found = np.where(inside, hashes[place.clip(0, max(0, len(hashes) - 1))], np.uint64(missing))
    return [row.tobytes() for row in found]


def fingerprints(table: DataFrame, ident: str, short: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """Per row: its id, n_words, and the fingerprints that the bitmap lets pass.

    short: word counts of short items to look up at every word; None for the items themselves, of which short ones are one fingerprint."""
    shared = table.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in common.blocks(batches, "text"):
            hashes, offsets = text_words(batch["text"])
            sizes = np.diff(offsets)
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            at, keys = winnowed(hashes, offsets)
            parts = [(at, np.full(len(at), GRAM + 2 * SIDE), keys)]
            for n in short if short is not None else range(1, SPAN):
                keys = common.grams(hashes, n)
                at = np.arange(len(keys))
                fits = text_of[at] == text_of[at + n - 1] if short is not None else (sizes[text_of[at]] == n) & (at == offsets[text_of[at]])
                parts.append((at[fits], np.full(int(fits.sum()), n), keys[fits]))
            at, n, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            if bits is not None:
                passed = common.in_filter(bits, keys)
                at, n, keys = at[passed], n[passed], keys[passed]
            order = np.argsort(text_of[at], kind="stable")
            at, n, keys = at[order], n[order], keys[order]
            text = text_of[at]
            around = surroundings(hashes, offsets, text, at, 0 if short is not None else 1)
            structs = pa.StructArray.from_arrays(
                [pa.array((at - offsets[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(around, pa.binary())],
                ["start", "words", "key", "around"],
            )
            ends = np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), structs)
            yield pa.RecordBatch.from_arrays([batch[ident], pa.array(sizes.astype(np.int64)), lists], [ident, "n_words", "found"])

    kind = table.schema[ident].dataType.simpleString()
    return table.select(ident, "text").mapInArrow(scan, f"`{ident}` {kind}, n_words bigint, found array<struct<{FOUND}>>")


def extended(pairs: DataFrame) -> DataFrame:
    """Document words that stand in a whole window of an item, from joined fingerprints."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item = (np.frombuffer(b"".join(batch[name].to_pylist()), np.uint64).reshape(-1, WIDTH) for name in ("around", "item_around"))
            start, n = batch["start"].to_numpy(), batch["words"].to_numpy()
            same = doc == item
            left = np.cumprod(same[:, :SIDE][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, SIDE + GRAM :], axis=1).sum(axis=1)
            whole = n < SPAN
            middle = same[:, SIDE : SIDE + GRAM].all(axis=1)
            short = whole & (same | (np.arange(WIDTH) < SIDE) | (np.arange(WIDTH) >= SIDE + n[:, None])).all(axis=1)
            hit = np.where(whole, short, middle & (left + GRAM + right >= SPAN))
            begin = np.where(whole, start, start - left)
            end = np.where(whole, start + n, start + GRAM + right)
            rows = pa.RecordBatch.from_arrays(
                [batch["row"], batch["item_id"], pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["row", "item_id", "begin", "end"]
            )
            yield rows.filter(pa.array(hit))

    return pairs.mapInArrow(compare, f"row bigint, item_id {pairs.schema['item_id'].dataType.simpleString()}, begin int, end int")


def covered(spans) -> F.Column:
    """Number of places that sorted spans cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda done, s: F.struct((done["n"] + F.greatest(s["end"] - F.greatest(s["begin"], done["end"]), F.lit(0))).alias("n"), F.greatest(done["end"], s["end"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda done: done["n"].cast("bigint"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every document row."""
    items = common.checkpointed(fingerprints(benchmark, "item_id", None, None).select("item_id", F.explode("found").alias("f")).select("item_id", "f.*"))
    short = [r.words for r in items.select("words").where(F.col("words") < SPAN).distinct().collect()]
    scanned = fingerprints(docs, "doc_id", short, common.key_filter(items, "key")).withColumn("row", F.monotonically_increasing_id())
    scanned = common.checkpointed(scanned)
    hits = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    named = items.select("item_id", "words", "key", F.col("around").alias("item_around"))
    spans = extended(hits.join(named, ["key", "words"]))
    merged = spans.groupBy("row", "begin", "end").agg(F.collect_set("item_id").alias("items"))
    per_row = merged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    listed = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string")))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("bigint"))
    return scanned.select("row", "doc_id", "n_words").join(per_row, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose id no contaminated text has."""
    found = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(common.small(found), F.col("doc_id").eqNullSafe(F.col("found_id")), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
item_windows AS (
  SELECT item_id, least(len(ws), {SPAN}) AS m, array_to_string(ws[i : i + least(len(ws), {SPAN}) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {SPAN} + 1, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
),
doc_windows AS (
  SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM item_windows))
),
hits AS (SELECT DISTINCT doc_id, item_id, i, m FROM doc_windows JOIN item_windows USING (m, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(listed, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""
