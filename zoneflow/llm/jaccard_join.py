"""Exact join of documents at a Jaccard similarity of their word shingles, as a join in a metric space, and its components.

1 - similarity is a metric, and documents without a common shingle lie at distance 1 from each other. So documents meet only where
they can be near: all shingles have one order, rare ones first, and of a set at least one of its first shingles stands among the
first ones of every set that it links with. The first few (`index`) suffice for the smaller set of a pair. The documents of a first
shingle and a size window are a region, and regions are joined recursively:

 1. Some documents of a region are its pivots. The distance of every document of the region to them is computed on full sets;
    distances up to EPS are links, and links form components.
 2. Documents go to the Voronoi region of their nearest pivot. By the triangle inequality a document can link with one of another
    region only if its distance to that region's pivot is at most the region's radius + EPS, and at most the distance to its own
    pivot + 2 EPS; the region gets a copy of such boundary documents.
 3. Pivots are done. In the component of the pivot, documents that lie deeper than EPS below the nearest document of another
    component are done, too. Regions of one component, or without an index document, are done.

Where the regions would not get smaller, the region stays whole. After ROUNDS rounds regions that share documents are put together where
that is less work, and joined in blocks by parity sketches: the bits in which two of them differ are at most the shingles in
which the sets differ, so most pairs of different components fall away by a bound that never errs. Of what remains first the nearest pair
of each two components is confirmed on full sets, twice, then every pair of components that are still apart. No link between components
is lost. The order of shingles comes from counts over all documents, kept as one number for each
of a fixed number of slots; any order gives the same result, a good one gives small regions.

Results: null and wordless texts have no shingles and stand alone. A text of fewer words than a shingle is one shingle. Equal sets
are one class and compared once. Rows that share an id are compared as rows of their own; a null id is smaller than no other and
gets the smallest other id of its component. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneflow.llm import common
from zoneflow.llm.components import connected_components
from zoneflow.llm.near_duplicates import SCAN_BYTES, may_link, set_names, set_rows, shingle_sets

#: Links have PERCENT of their union in common, or more; words of a shingle.
PERCENT, SHINGLE = 80, 5
#: Slots of the table of shingle counts, bits of the bitmap of shared shingles; shingles or pairs that a task holds before it sums them up.
SLOT_BITS, SHARED_BITS, COUNTED = 23, 26, 1 << 20
#: Rounds of pivots; pivots of a region after the first round, which has one.
ROUNDS, PIVOTS = 2, 4
#: Documents of a block of the last step, and of a part of a pivot's documents; bits of a parity sketch.
BLOCK, PART, SKETCH = 2048, 512, 2048
#: Distances are compared with this slack.
SLACK = 1e-9


def planes(values: np.ndarray) -> bytes:
    """Bytes of 32-bit values, first all lowest ones, then the next: of small values most planes are zero and compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def shingle_levels(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """For each slot of shingle hashes the largest number of documents that hold one of its shingles, as the number's bits; and
    a bitmap in which the bit of every shingle that more than one document holds is set.

    Tasks send sorted 32-bit heads of their shingles with counts, cut into chunks by their first bits. Both tables have a fixed size; as
    the corpus grows, more slots are shared, which makes the order less telling and lets more shingles pass, but changes no result."""
    bits = min(16, max(6, (4 * docs.rdd.getNumPartitions() - 1).bit_length()))
    low = 32 - bits

    def packed(heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(heads, return_counts=True)
        values = values.astype(np.int64)
        ends = np.searchsorted(values, np.arange(0, (1 << 32) + 1, 1 << low))
        full = np.flatnonzero(np.diff(ends))
        steps = np.diff(values, prepend=0)
        steps[ends[full]] = values[ends[full]] - (full << low)  # from the start of the chunk
        columns = [[planes(x[ends[c] : ends[c + 1]]) for c in full] for x in (steps, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(c, pa.binary()) for c in columns)], ["chunk", "heads", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in common.blocks(batches, "text", SCAN_BYTES):
            heads = (shingle_sets(batch["text"], shingle)[0] >> np.uint64(32)).astype(np.uint32)
            held.append(heads)
            n += len(heads)
            if n >= COUNTED:
                yield from packed(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from packed(np.concatenate(held))

    def most(group: pa.Table) -> pa.Table:
        heads = np.concatenate([np.cumsum(from_planes(h), dtype=np.uint32) for h in group["heads"].to_pylist()])
        counts = np.concatenate([from_planes(c) for c in group["counts"].to_pylist()])
        order = np.argsort(heads, kind="stable")
        heads, counts = heads[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        total = np.add.reduceat(counts.astype(np.int64), first)
        slots = np.zeros(1 << (SLOT_BITS - bits), np.uint8)
        level = np.frexp(total.astype(float))[1] - 1
        np.maximum.at(slots, heads[first] >> np.uint32(32 - SLOT_BITS), level.astype(np.uint8))
        shared = np.zeros(1 << (SHARED_BITS - bits), bool)
        shared[heads[first][total > 1] >> np.uint32(32 - SHARED_BITS)] = True
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (slots, np.packbits(shared))]
        return pa.table([group["chunk"].slice(0, 1).combine_chunks(), *columns], ["chunk", "levels", "shared"])

    rows = docs.select("text").mapInArrow(scan, "chunk bigint, heads binary, counts binary")
    found = rows.groupBy("chunk").applyInArrow(most, "chunk bigint, levels binary, shared binary")
    levels, shared = np.zeros((1 << bits, 1 << (SLOT_BITS - bits)), np.uint8), np.zeros((1 << bits, 1 << (SHARED_BITS - bits - 3)), np.uint8)
    for row in found.toLocalIterator():
        levels[row.chunk], shared[row.chunk] = np.frombuffer(row.levels, np.uint8), np.frombuffer(row.shared, np.uint8)
    return levels.ravel(), shared.ravel()


def prefixes(docs: DataFrame, tables: tuple[np.ndarray, np.ndarray], shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, name of the set, those of its first shingles in the common order that others may hold, and how many of
    these are index."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, shared = sent.value
        for batch in common.blocks(batches, "text", SCAN_BYTES):
            keys, offsets = shingle_sets(batch["text"], shingle)
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(size)), size)
            sorted_keys = keys[np.lexsort((keys, levels[keys >> np.uint64(64 - SLOT_BITS)], owner))]
            probe = np.where(size > 0, size + percent * size // -100 + 1, 0)
            index = np.where(size > 0, size + 2 * percent * size // -(100 + percent) + 1, 0)
            rank, bit = np.arange(len(keys)) - offsets[owner], sorted_keys >> np.uint64(64 - SHARED_BITS)
            kept = (rank < probe[owner]) & (shared[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(size)))]).astype(np.int32)
            n_index = np.bincount(owner[kept & (rank < index[owner])], minlength=len(size))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sorted_keys[kept].view(np.int64)))
            columns = [batch["doc_id"], pa.array(size), pa.array(set_names(keys, offsets), pa.binary()), lists, pa.array(n_index)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "name", "keys", "n_index"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n_shingles bigint, name binary, keys array<bigint>, n_index bigint")


def first_regions(classes: DataFrame, percent: int) -> DataFrame:
    """region, node, n and index of the classes that share a first shingle within a size window. Near copies share many; what the
    same classes share is one region, named by them. If two such names were equal, their regions would be joined as one."""
    entries = classes.select("node", F.col("n_shingles").alias("n"), "n_index", F.posexplode("keys").alias("pos", "key"))
    entries = entries.select("node", "n", "key", (F.col("pos") < F.col("n_index")).alias("index")).repartition("key")
    met = entries.groupBy("key").agg(F.count("*").alias("rows"), F.max("index").alias("any")).where("rows > 1 and any")
    # sizes of a link differ by one size class at most; the base is widened against rounding
    size = F.floor(F.log("n") / F.log(F.lit(1.0001 * 100 / percent)))
    kept = entries.join(met.select("key"), "key").withColumn("own", size)
    dealt = kept.withColumn("window", F.explode(F.array("own", F.col("own") + 1))).withColumn("region", F.xxhash64("key", "window"))
    path = common.shared_path(classes.sparkSession, "windows")
    dealt.drop("key").write.parquet(path)
    common.release(classes.sparkSession)
    dealt = classes.sparkSession.read.parquet(path)
    full, members = F.max(F.col("own") == F.col("window")).alias("full"), F.bit_xor(F.xxhash64("node")).alias("members")
    wide = dealt.groupBy("region").agg(F.count("*").alias("rows"), full, F.max("index").alias("any"), members)
    wide = wide.where("rows > 1 and full and any").select("region", F.xxhash64("rows", "members").alias("members"))
    regions = dealt.join(wide, "region").groupBy(F.col("members").alias("region"), "node", "n").agg(F.max("index").alias("index"))
    regions = common.stored(regions, "regions")
    common.drop_path(classes.sparkSession, path)
    return regions


def rooted(rows: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """Adds the component of a column of nodes."""
    named = roots.select(F.col("node").alias(node), F.col("root").alias("known"))
    return rows.join(named, node, "left").withColumn(root, F.coalesce("known", node)).drop("known")


def alive(regions: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of regions that hold several components and an index document, with the size of the region."""
    placed = common.stored(rooted(regions, roots), "placed")
    spread = placed.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("index").alias("any"), F.count("*").alias("size"))
    return placed.join(spread.where("low < high and any").select("region", "size"), "region")


def pivots(live: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """region and pivot: index documents of most regions, from different components."""
    known = live.where("index").join(weights, "node")
    best = known.groupBy("region", "root").agg(F.max(F.struct("weight", "node")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("best")))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("region", F.col("best.node").alias("pivot"))


def class_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The sets of the `wanted` classes (node, doc_id, name). A name stands for one class, so sets are dealt out by it and only once."""
    named = set_rows(docs, wanted, shingle).groupBy("name").agg(F.first("items").alias("items"))
    return named.join(wanted.select("node", "name"), "name").select("node", "items")


def asked_sets(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the documents of the pairs, and a few others that a bitmap of fixed size lets pass; the rest keeps out of the shuffle."""
    keys = pairs.select(F.explode(F.array("node", "pivot")).alias("node")).select(F.xxhash64("node").alias("key"))
    bitmap = sets.sparkSession.sparkContext.broadcast(common.key_filter(keys, "key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(common.in_filter(bitmap.value, batch["key"].to_numpy())))
            yield batch.select(["node", "items"])

    return sets.select("node", F.xxhash64("node").alias("key"), "items").mapInArrow(scan, "node bigint, items binary")


def common_items(x: np.ndarray, y: np.ndarray) -> int:
    """Number of common items of two sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.searchsorted(y, x).clip(0, len(y) - 1)] == x).sum()) if len(x) else 0


def distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """distance of every pair (node, pivot), and whether it is a link. Documents of one pivot are dealt into parts, each with the pivot's set."""
    sets = asked_sets(sets, pairs)
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    right = sets.join(parts, sets["node"] == parts["pivot"]).select(
        "pivot", F.col("items").alias("pivot_items"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, linked = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["items"], batch["pivot_items"], strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = common_items(x, y)
                whole = len(x) + len(y) - both
                found[i], linked[i] = 1 - both / whole, 100 * both >= percent * whole
            yield pa.RecordBatch.from_arrays([batch["node"], batch["pivot"], pa.array(found), pa.array(linked)], ["node", "pivot", "d", "linked"])

    joined = dealt.join(right, ["pivot", "part"]).join(sets, "node").select("node", "pivot", "items", "pivot_items")
    return joined.mapInArrow(compare, "node bigint, pivot bigint, d double, linked boolean")


def voronoi(met: DataFrame, chosen: DataFrame, found: DataFrame, roots: DataFrame, eps: float) -> DataFrame:
    """The regions of the next round. Where a region has one pivot, d may be less than the distance and `most` is not less than it."""
    own = met.join(found.select("node", "pivot", "d", "most"), ["node", "pivot"])
    own = own.groupBy("region", "node", "n", "index").agg(F.collect_list(F.struct("d", "pivot", "most")).alias("ds"))  # PIVOTS at most
    own = own.join(chosen.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti").withColumn("home", F.array_min("ds"))
    own = common.stored(own, "own")  # as several steps use it
    common.release(own.sparkSession)
    radius = own.groupBy("region", F.col("home.pivot").alias("pivot")).agg(F.max("home.d").alias("radius"))
    seen = own.select("region", "node", "n", "index", F.col("home.d").alias("home_d"), F.explode("ds").alias("e"))
    seen = seen.select("region", "node", "n", "index", "home_d", F.col("e.pivot").alias("pivot"), F.col("e.d").alias("d"), F.col("e.most").alias("most"))
    near = seen.join(radius, ["region", "pivot"]).where(
        (F.col("d") <= F.col("radius") + eps + SLACK) & (F.col("d") <= F.col("home_d") + 2 * eps + SLACK)
    )
    placed = common.stored(rooted(rooted(near, roots), roots, "pivot", "pivot_root"), "near")
    other = F.col("root") != F.col("pivot_root")
    edge = placed.groupBy("region", "pivot").agg(F.min(F.when(other, F.col("d"))).alias("edge"))
    open_ = common.stored(placed.join(edge, ["region", "pivot"]).where(other | (F.col("most") + eps + SLACK >= F.col("edge"))), "open")
    sizes = own.groupBy("region").agg(F.count("*").alias("size"))
    grown = open_.groupBy("region").agg(F.count("*").alias("total")).join(sizes, "region").where("total > size").select("region")
    split = open_.join(grown, "region", "left_anti").select(F.xxhash64("region", "pivot").alias("region"), "node", "n", "index")
    return split.union(own.join(grown, "region", "left_semi").select("region", "node", "n", "index"))


def sketches(sets: DataFrame) -> DataFrame:
    """node, the size of its set and the parity of the number of its items in each of SKETCH slots."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.frombuffer(x.as_buffer(), np.uint64) & np.uint64(SKETCH - 1) for x in batch["items"]]
            bits = [np.packbits((np.bincount(x.astype(np.int64), minlength=SKETCH) & 1).astype(bool)).tobytes() for x in slots]
            sizes = pa.array([len(x) for x in slots], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["node"], sizes, pa.array(bits, pa.binary())], ["node", "items", "sketch"])

    return sets.select("node", "items").mapInArrow(scan, "node bigint, items bigint, sketch binary")


def bounds(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """A lower bound `d` of the distance of every pair, and whether the pair may be a link. Sets differ in as many items at least as
    their parities or their sizes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for c in ("sketch", "pivot_sketch"))
            n, m = (batch[c].to_numpy() for c in ("items", "pivot_items"))
            differ = np.maximum(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), np.abs(n - m))
            columns = [pa.array(2 * differ / (n + m + differ)), pa.array(may_link(differ, n, m, percent))]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["pivot"], *columns], ["node", "pivot", "d", "near"])

    of_pivot = signs.select(F.col("node").alias("pivot"), F.col("items").alias("pivot_items"), F.col("sketch").alias("pivot_sketch"))
    return pairs.join(signs, "node").join(of_pivot, "pivot").mapInArrow(compare, "node bigint, pivot bigint, d double, near boolean")


def together(live: DataFrame) -> DataFrame:
    """Regions that share documents as one, where its square is not more than the sum of theirs."""
    groups = connected_components(live.select("region", "node"), release=False).select(F.col("node").alias("region"), F.col("root").alias("whole"))
    named = common.stored(live.join(groups, "region", "left").withColumn("whole", F.coalesce("whole", "region")), "whole")
    apart = named.groupBy("whole", "region").agg(F.pow(F.count("*"), F.lit(2)).alias("work")).groupBy("whole").agg(F.sum("work").alias("work"))
    members = named.groupBy("whole", "node", "n", "root").agg(F.max("index").alias("index"))
    less = members.groupBy("whole").agg(F.pow(F.count("*"), F.lit(2)).alias("square")).join(apart, "whole").where("square <= work").select("whole")
    merged = members.join(less, "whole").select(F.col("whole").alias("region"), "node", "n", "index", "root")
    rows = merged.union(named.join(less, "whole", "left_anti").select("region", "node", "n", "index", "root"))
    sizes = rows.groupBy("region").agg(F.count("*").alias("size"))
    return rows.join(sizes, "region")


def near_pairs(live: DataFrame, signs: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (node, pivot) of different components of a region that may be links: all of them, or of two components the nearest in each block."""
    dealt = live.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    with_signs = dealt.select("region", "low", "high", "own", "node", "n", "root", "index").join(signs.select("node", "sketch"), "node")

    def compare(group: pa.Table) -> pa.Table:
        node, root, own, n, index = (group[c].to_numpy() for c in ("node", "root", "own", "n", "index"))
        bits = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(len(node), -1)
        across = group["low"][0].as_py() != group["high"][0].as_py()
        names = np.unique(root, return_inverse=True)[1].astype(np.int64)
        # a pair's rows, and before them what these differ in; its components
        codes, keys, added = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def nearest() -> None:
            code, key = np.concatenate(codes), np.concatenate(keys)
            order = np.lexsort((code, key))
            order = order[np.diff(key[order], prepend=-1) > 0]
            codes[:], keys[:] = [code[order]], [key[order]]

        for i in range(len(node)):
            asked = (root != root[i]) & (index | index[i]) & ((own > own[i]) if across else (node > node[i]))
            js = np.flatnonzero(asked & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            odd = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = odd * (100 + percent) <= (100 - percent) * (n[js] + n[i])
            js, odd = js[near], odd[near]
            codes.append(i * len(node) + js if every else odd * len(node) ** 2 + i * len(node) + js)
            if every:
                continue
            keys.append(np.minimum(names[js], names[i]) * len(node) + np.maximum(names[js], names[i]))
            added += len(js)
            if added >= COUNTED:
                nearest()
                added = 0
        if not every:
            nearest()
        first, second = np.divmod(np.concatenate(codes) % max(1, len(node) ** 2), max(1, len(node)))
        return pa.table({"node": pa.array(node[first], pa.int64()), "pivot": pa.array(node[second], pa.int64())})

    return with_signs.groupBy("region", "low", "high").applyInArrow(compare, "node bigint, pivot bigint").distinct()


def joined(classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node and root of all classes that link with others."""
    spark, eps = docs.sparkSession, 1 - percent / 100
    regions = first_regions(classes, percent)
    common.release(spark)
    weights = common.compact(regions.groupBy("node").agg(F.count("*").alias("weight")))
    wanted = common.compact(classes.select("node", "doc_id", "name").join(weights, "node", "left_semi"))
    sets = common.stored(class_sets(docs, wanted, shingle), "sets")
    common.release(spark)
    signs = common.stored(sketches(sets), "sketches")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    # tables, as checkpoints would carry the constraints of their plans from round to round; what a step shuffled goes after it
    for done in range(ROUNDS):
        common.release(spark)
        live = common.stored(alive(regions, roots), "live")
        if live.isEmpty():
            return roots
        chosen = common.stored(pivots(live, weights, PIVOTS if done else 1), "pivots")
        met = live.join(chosen, "region").where("node <> pivot")
        pairs = common.stored(met.select("node", "pivot").distinct(), "met")
        common.release(spark)
        if done:
            found = distances(pairs, sets, percent).withColumn("most", F.col("d"))
        else:  # one pivot, which is the nearest one whatever its distance
            low = common.stored(bounds(pairs, signs, percent), "bounds")
            found = distances(low.where("near").select("node", "pivot"), sets, percent).withColumn("most", F.col("d"))
            found = found.union(low.where("not near").select("node", "pivot", "d", F.lit(False), F.lit(1.0)))
        found = common.stored(found, "distances")
        roots = connected_components(roots.union(found.where("linked").select("node", "pivot")))
        regions = voronoi(met, chosen, found, roots, eps)
    for every in (False, False, True):
        common.release(spark)
        live = common.stored(alive(regions, roots), "live")
        if live.isEmpty():
            break
        regions = common.stored(together(live), "together")
        pairs = common.stored(near_pairs(regions, signs, percent, every), "pairs")
        links = distances(pairs, sets, percent).where("linked").select("node", "pivot")
        roots = connected_components(roots.union(links))
        regions = regions.select("region", "node", "n", "index")
    return roots


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    with common.small_batches(docs.sparkSession):
        tables = shingle_levels(docs, shingle)
        common.release(docs.sparkSession)
        rows = prefixes(docs, tables, shingle, percent).withColumn("place", F.monotonically_increasing_id())
        rows = common.stored(rows, "prefixes")
        named = rows.where("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("node"))
        named = common.checkpointed(named)
        firsts = rows.select(F.col("place").alias("node"), "n_shingles", "keys", "n_index")
        roots = joined(named.join(firsts, "node"), docs, shingle, percent)
    placed = rooted(named, roots)
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = placed.join(least, "root").select("name", "component_id")
    component: Column = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", "name").join(found, "name", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))
