"""Removal of repeated byte strings with sparse suffix arrays.

Every SPAN-byte window has an anchor, the place of the smallest hash of GRAM bytes inside it, so equal windows have equal anchors.
The windows of one anchor form a stretch of text. Stretches are compared over the whole corpus by anchor and content: one that an
earlier document holds in full is removed. Where stretches share an anchor but differ, as at the ends of a repeat, their
bytes are gathered in shards by anchor; each shard is sorted by Larsson-Sadakane refinement, common prefixes follow by Kasai's
rule, and groups of equal windows show the earliest document of each. An anchor with more stretches than a shard takes is dealt
over several, whose groups are merged by their windows' contents.

Results: null counts as an empty text; shorter texts than SPAN bytes lose nothing. A null id precedes all others. Rows that share
an id never remove each other's bytes, and share what is removed against earlier ids. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneflow.llm import common

SPAN, GRAM = 50, 16
REACH = SPAN - GRAM
#: Stretches of one anchor that go to one shard, and bytes that a shard sorts at once.
SHARD_ROWS = 20_000
SHARD_BYTES = 8 << 20
#: Text bytes whose stretches are found at once; numbers of so many places stay in the caches of a core.
SCAN_BYTES = 256 << 10
CLOSE = 32
PLACE_BITS = np.uint64(28)
LOW48 = np.uint64((1 << 48) - 1)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,))


class Stretches:
    """Anchors of a block of texts: the text, the anchor's place, its first and last window, its hash and that of the stretch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data) - SPAN + 1
        if n <= 0:
            self.text = self.anchor = self.first = self.last = np.zeros(0, np.int64)
            self.key = self.content = np.zeros(0, np.int64)
            return
        word = eights(data)
        gram = common.mixed(word[:-8] * common.BASE + common.mixed(word[8:]))
        place = np.arange(len(gram), dtype=np.uint64) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))
        least = (gram >> PLACE_BITS) << PLACE_BITS | (((np.uint64(1) << PLACE_BITS) - np.uint64(1)) - place)
        have = 1
        while have < REACH + 1:
            step = min(have, REACH + 1 - have)
            least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
        owner = (((np.uint64(1) << PLACE_BITS) - np.uint64(1)) - (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1)))).astype(np.int64)
        if len(data) >> int(PLACE_BITS):
            start = np.arange(n)
            owner = start + ((owner - start) & ((1 << int(PLACE_BITS)) - 1))
        sizes = np.diff(offsets)
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        whole = text[:n] == text[SPAN - 1 :]
        begins = np.flatnonzero(whole & np.concatenate([[True], (owner[1:] != owner[:-1]) | ~whole[:-1] | (text[1:n] != text[: n - 1])]))
        ends = np.flatnonzero(whole & np.concatenate([(owner[1:] != owner[:-1]) | ~whole[1:] | (text[1:n] != text[: n - 1]), [True]]))
        self.text, self.anchor, self.first, self.last = text[begins], owner[begins], begins, ends
        self.key = (gram[self.anchor] & LOW48).astype(np.int64)
        powers = np.cumprod(np.full(len(data), common.BASE, np.uint64))
        inverse = pow(int(common.BASE), -1, 1 << 64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
        back = np.cumprod(np.full(len(data), np.uint64(inverse), np.uint64))
        total = (sums[ends + SPAN] - sums[begins]) * back[begins]
        shape = ((self.anchor - begins) << 8 | (ends - begins)).astype(np.uint64)
        self.content = (common.mixed(common.mixed(total) + shape) & LOW48).astype(np.int64)

    def named(self) -> np.ndarray:
        """One number for text, anchor and content."""
        return pairs_named(self.text.astype(np.uint64), self.key, self.content)


def pairs_named(text: np.ndarray, key: np.ndarray, content: np.ndarray) -> np.ndarray:
    return common.mixed(common.mixed(key.astype(np.uint64) * common.BASE + text) + content.astype(np.uint64) * common.BASE)


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each suffix whether it shares CLOSE bytes with the one before it.

    Larsson and Sadakane: the rank of a suffix is that of the first of its group of equal beginnings, eight bytes at first. Only groups
    that are not yet single are sorted again, by the ranks as many bytes further on as are sorted."""
    n = len(data)
    word = np.ndarray((n,), ">u8", data.tobytes() + bytes(8), 0, (1,)).astype(np.uint64)
    order = np.argsort(word, kind="stable")
    word = word[order]
    heads = np.concatenate([[True], word[1:] != word[:-1]]) if n else np.zeros(0, bool)
    rank = np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    width, slots = 8, np.arange(n)
    close = np.zeros(n, bool)
    while len(slots):
        if width == CLOSE:
            close = np.concatenate([[False], rank[order[1:]] == rank[order[:-1]]])
        alone = heads & np.append(heads[1:], True)
        slots, heads = slots[~alone], heads[~alone]
        if not len(slots):
            break
        at = order[slots]
        # of suffixes that end within the sorted bytes the shorter comes first
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + width + 1, n - at)
        pair = rank[at] << 32 | after
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        heads = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[at] = slots[np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))]
        width *= 2
    found = np.zeros(n, bool)
    found[order] = close
    return order, found


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Bytes, up to `limit`, that each suffix shares with the one before it in order. Kasai's rule, all pieces of the text side by side."""
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    found, length = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    for step in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > step)
        at = starts[live] + step
        here = place[at]
        live, at, here = live[here > 0], at[here > 0], here[here > 0]
        other, h = order[here - 1], np.maximum(length[live] - 1, 0)
        going = np.arange(len(at))
        while len(going):
            going = going[(h[going] < limit) & (at[going] + h[going] < n) & (other[going] + h[going] < n)]
            going = going[data[at[going] + h[going]] == data[other[going] + h[going]]]
            h[going] += 1
        length[live], found[here] = h, h
    return found


def repeated_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rank_of: np.ndarray) -> np.ndarray:
    """For each byte of pieces: whether the SPAN bytes from it on stand in a piece with a smaller rank_of."""
    order, close = suffix_array(data)
    # windows are longer than CLOSE, so only runs of such places need exact prefixes
    edges = np.flatnonzero(np.diff(np.concatenate([[0], close.view(np.int8), [0]])))
    shared = common_prefixes(data, order, edges[::2], edges[1::2] - edges[::2], SPAN)
    piece = np.repeat(np.arange(len(starts)), sizes)
    whole = (np.arange(len(data)) - starts[piece] <= sizes[piece] - SPAN)[order]
    group = np.cumsum(shared < SPAN)
    value = rank_of[piece[order]]
    least = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group[whole], value[whole])
    found = np.zeros(len(data), bool)
    found[order] = whole & (value > least[group])
    return found


def anchors(docs: DataFrame) -> DataFrame:
    """Distinct key and content of the stretches of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "text", SCAN_BYTES):
            s = Stretches(*common.utf8(batch["text"]))
            _, at = np.unique(s.named(), return_index=True)
            doc = batch["doc"].to_numpy()[s.text[at]]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s.key[at]), pa.array(s.content[at])], ["doc", "key", "content"])

    return docs.select("doc", "text").mapInArrow(scan, "doc bigint, key bigint, content bigint")


def judged(stretches: DataFrame) -> DataFrame:
    """Stretches that an earlier document holds (`held`), and the first ones of each content of an anchor that several contents share,
    with the number of those."""
    of_key, of_content = Window.partitionBy("key"), Window.partitionBy("key", "content")
    rows = stretches.repartition("key").withColumn("first", F.min("doc").over(of_content))
    rows = rows.withColumn("low", F.min("first").over(of_key)).withColumn("high", F.max("first").over(of_key))
    rows = rows.withColumn("n", F.sum((F.col("doc") == F.col("first")).cast("bigint")).over(of_key))
    held = F.col("doc") > F.col("first")
    return rows.where(held | (F.col("low") < F.col("high"))).select("doc", "key", "content", held.alias("held"), "n")


def matched(batch: pa.RecordBatch, column: str) -> tuple[Stretches, np.ndarray, np.ndarray, pa.Array]:
    """Stretches of a batch that its lists name: which ones, the list entry of each, and the entries."""
    s = Stretches(*common.utf8(batch["text"]))
    lists = batch[column]
    text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()) if not lists.null_count else [len(x) if x is not None else 0 for x in lists.to_pylist()])
    entries = lists.flatten()
    names = pairs_named(text.astype(np.uint64), entries.field("key").to_numpy(), entries.field("content").to_numpy())
    order = np.argsort(names)
    own = s.named()
    at = np.searchsorted(names[order], own).clip(0, max(0, len(names) - 1))
    hit = np.flatnonzero(names[order][at] == own) if len(names) else np.zeros(0, np.int64)
    return s, hit, order[at[hit]] if len(names) else hit, entries


def contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted stretches: doc, key, content, windows before the anchor, bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "text", SCAN_BYTES):
            s, hit, entry, entries = matched(batch, "wanted")
            _, once = np.unique(entry, return_index=True)
            hit, entry = hit[once], entry[once]
            data, _ = common.utf8(batch["text"])
            raw = data.tobytes()
            parts = [raw[a : b + SPAN] for a, b in zip(s.first[hit].tolist(), s.last[hit].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch["doc"].to_numpy()[s.text[hit]]), pa.array(s.key[hit]), pa.array(s.content[hit]), entries.field("n").take(pa.array(entry)),
                    pa.array(parts, pa.binary()),
                ],
                ["doc", "key", "content", "n", "bytes"],
            )

    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "content", "n")).alias("wanted"))
    return docs.join(lists, "doc").select("doc", "text", "wanted").mapInArrow(cut, "doc bigint, key bigint, content bigint, n bigint, bytes binary")


MASK = "doc bigint, key bigint, content bigint, mask bigint"


def masks(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first 64 flags of each piece as bits."""
    place = starts[:, None] + np.arange(REACH + 1)
    return (found[np.minimum(place, len(found) - 1)] << np.arange(REACH + 1)).sum(axis=1) if len(starts) else np.zeros(0, np.int64)


def sharded(stretches: DataFrame) -> DataFrame:
    """Flags of the windows of stretches whose anchors fit into one shard."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8)
            sizes = np.array([len(x) for x in rows["bytes"].to_pylist()], np.int64)
            starts = np.cumsum(sizes) - sizes
            found = repeated_windows(data, starts, sizes, rows["doc"].to_numpy())
            inside = np.arange(REACH + 1) <= (sizes - SPAN)[:, None]
            flags = masks(found, starts) & (inside << np.arange(REACH + 1)).sum(axis=1)
            columns = [rows[c].combine_chunks() for c in ("doc", "key", "content")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(flags)], ["doc", "key", "content", "mask"])

        size = 0
        for batch in batches:
            keys = batch["key"].to_numpy()
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at))
                size += held[-1]["bytes"].nbytes
                at = batch.num_rows
                if size >= SHARD_BYTES:
                    # rows come sorted by anchor: all but the last anchor are complete
                    table = pa.Table.from_batches(held)
                    cut = int(np.searchsorted(table["key"].to_numpy(), keys[-1]))
                    if cut:
                        yield flush(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(b["bytes"].nbytes for b in held)
        if held:
            yield flush(pa.Table.from_batches(held))

    return stretches.select("doc", "key", "content", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(sort, MASK)


def merged(stretches: DataFrame) -> DataFrame:
    """The same for anchors of many stretches: shards hand on their windows, whose earliest document is found by content."""
    count = F.length("bytes") - (SPAN - 1)
    windows = stretches.select("doc", "key", "content", F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("at"), F.substring(F.col("bytes"), i + 1, F.lit(SPAN)).alias("window")))).alias("w")).select("doc", "key", "content", "w.*")
    least = windows.groupBy("window").agg(F.min("doc").alias("least"))
    flagged = windows.join(least, "window").where("doc > least")
    return flagged.groupBy("doc", "key", "content").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at"))).alias("mask"))


def removed(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """What is left of each text: columns of the query."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "text", SCAN_BYTES):
            data, offsets = common.utf8(batch["text"])
            s, hit, entry, entries = matched(batch, "flags")
            mask = entries.field("mask").to_numpy()[entry] if len(entry) else np.zeros(0, np.int64)
            edges = np.zeros(len(data) + 1, np.int32)
            windows = s.last[hit] - s.first[hit] + 1
            whole = mask < 0
            np.add.at(edges, s.first[hit][whole], 1)
            np.add.at(edges, s.last[hit][whole] + SPAN, -1)
            for i in range(int(windows[~whole].max(initial=0))):
                one = hit[~whole][((mask[~whole] >> i) & 1 > 0) & (windows[~whole] > i)]
                np.add.at(edges, s.first[one] + i, 1)
                np.add.at(edges, s.first[one] + i + SPAN, -1)
            gone = np.cumsum(edges[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            firsts = offsets[:-1][np.diff(offsets) > 0]
            begins[firsts] = gone[firsts]
            raw, kept = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[offsets]
            digest = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
            left = [raw[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(offsets)), pa.array(common.per_row(gone, offsets)), pa.array(common.per_row(begins, offsets)), pa.array(digest), pa.array(left, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    lists = flags.groupBy("doc").agg(F.collect_list(F.struct("key", "content", "mask")).alias("flags"))
    empty = F.expr("cast(array() as array<struct<key:bigint,content:bigint,mask:bigint>>)")
    rows = docs.join(lists, "doc", "left").select("doc_id", "text", F.coalesce("flags", empty).alias("flags"))
    return rows.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "text")
    found = common.stored(judged(anchors(keyed)), "stretches")
    dealt = keyed.repartition("doc")
    flags = found.where("held").select("doc", "key", "content", F.lit(-1).cast("bigint").alias("mask"))
    # bytes of every stretch are cut once: those of large anchors apart, if there are any
    wanted = found.where("not held").select("doc", "key", "content", "n")
    large = wanted.where(F.col("n") > SHARD_ROWS)
    flags = flags.union(sharded(contents(dealt, wanted.where(F.col("n") <= SHARD_ROWS))).where("mask <> 0"))
    if not large.isEmpty():
        flags = flags.union(merged(contents(dealt, large)))
    return removed(dealt, flags)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents")).drop("kept")
