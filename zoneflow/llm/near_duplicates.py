"""MinHash near-duplicates: universal hash minima, banding, signature verification, components by large-star and small-star.

Documents with equal shingle sets are one class, and only classes are compared. In a first round each class of a band's bucket is
paired with the bucket's most central one. Pairs whose signatures and parities agree are confirmed on their full sets, and components
are formed. In buckets that still hold several components, whatever lies outside of the main one is then compared in blocks, with each
other and with the whole main component, of which one link is enough. No link between components is lost.

Parities tell of each of a fixed number of slots whether a set has an odd number of shingles there. The slots in which two of them differ
are at most the shingles in which the sets differ, so this bound never errs, and pages of one template that stay below the similarity
fall away without their sets. Of the blocks outside a main component first the nearest possible partner of each class is confirmed; what
then lies in different components is confirmed in full. So groups that link are not expanded into their pairs.

A pair at the least similarity of 0.8 shares no band with probability (1 - 0.8^4)^32 < 1e-7.

Results: null and wordless texts have no shingles and stand alone. A text of fewer words than a shingle is one shingle. Rows that
share an id are compared as rows of their own; repeated rows are copies. A null id is smaller than no other: its row is kept, with the smallest other id of its component. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import common
from zoneflow.llm.components import connected_components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Links have PERCENT of their union in common, or more.
PERCENT = 80
#: Least share of equal minima of a pair that goes on to the full sets: 4.5 deviations below 0.8.
SIGNATURE = 0.64
#: Slots of the parities.
SLOTS = 1024
#: Classes of a block in the second round.
BLOCK = 64
SEED = 11
#: Text bytes that a task cuts into shingles at once; the arrays on the way take up to fifty times as much.
SCAN_BYTES = 1 << 19
#: What is compared before full sets are.
SKETCH = ("n_shingles", "signature", "parity")


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the offsets of the texts in them."""
    data, offsets = common.utf8(texts)
    low = common.folded(data)
    hashes, offsets = common.words(low, ~((low == 32) | ((low >= 9) & (low <= 13))), offsets)
    sizes = np.diff(offsets)
    keys = common.grams(hashes, shingle)
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[: len(keys)] == text[shingle - 1 :][: len(keys)]
    keys, owner = keys[whole], text[: len(keys)][whole]
    for n in range(1, shingle):
        few = np.flatnonzero(sizes == n)
        if len(few):
            keys = np.concatenate([keys, common.grams(hashes, n)[offsets[few]]])
            owner = np.concatenate([owner, few])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.searchsorted(owner[new], np.arange(len(sizes) + 1))


def signatures(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minima of each set that is not empty."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, HASHES, np.uint64)
    starts = offsets[:-1][np.diff(offsets) > 0]
    found = np.zeros((len(offsets) - 1, HASHES), np.uint32)
    if len(starts):
        full = np.diff(offsets) > 0
        for i in range(HASHES):
            found[full, i] = np.minimum.reduceat(keys * factors[i] + shifts[i], starts) >> np.uint64(32)
    return found


def parities(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set a row of bits: whether it has an odd number of keys in each of SLOTS slots."""
    found = np.zeros((len(offsets) - 1, SLOTS // 8), np.uint8)
    slots = (keys >> np.uint64(20) & np.uint64(SLOTS - 1)).astype(np.int64)
    for a in range(0, len(found), BLOCK):
        ends = offsets[a : a + BLOCK + 1]
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        counts = np.bincount(owner * SLOTS + slots[ends[0] : ends[-1]], minlength=(len(ends) - 1) * SLOTS)
        found[a : a + len(ends) - 1] = np.packbits((counts & 1).astype(bool).reshape(-1, SLOTS), axis=1)
    return found


def may_link(odd: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles that differ in `odd` parities, so in as many shingles at least, can have the similarity."""
    return odd * (100 + percent) <= (100 - percent) * (n + m)


def as_rows(values: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def set_names(keys: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit names of sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mixed(keys), dtype=np.uint64)])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mixed(keys ^ common.BASE), dtype=np.uint64)])
    sums = np.stack([x[offsets[1:]] - x[offsets[:-1]] for x in (total, other)], axis=1)
    return [row.tobytes() for row in sums]


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, the name of the set, its signature and its parities, of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "text", SCAN_BYTES):
            keys, offsets = shingle_sets(batch["text"], shingle)
            found = [[row.tobytes() for row in x] for x in (signatures(keys, offsets), parities(keys, offsets))]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(offsets)), *(pa.array(x, pa.binary()) for x in (set_names(keys, offsets), *found))],
                ["doc_id", "n_shingles", "name", "signature", "parity"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n_shingles bigint, name binary, signature binary, parity binary")


def set_rows(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """doc_id, name and set, as a binary of sorted hashes, of the rows with an id of the `wanted` classes, and of a few others."""
    bitmap = docs.sparkSession.sparkContext.broadcast(common.key_filter(wanted.select(F.xxhash64("doc_id").alias("key")), "key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "text", SCAN_BYTES):
            batch = batch.filter(pa.array(common.in_filter(bitmap.value, batch["key"].to_numpy())))
            keys, offsets = shingle_sets(batch["text"], shingle)
            found = [keys[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(set_names(keys, offsets), pa.binary()), pa.array(found, pa.binary())], ["doc_id", "name", "items"]
            )

    return docs.select("doc_id", F.xxhash64("doc_id").alias("key"), "text").mapInArrow(scan, "doc_id bigint, name binary, items binary")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The sets of the `wanted` classes (node, doc_id, name), as binaries of sorted hashes."""
    rows = set_rows(docs, wanted, shingle)
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["name"] == wanted["name"])
    return rows.join(wanted, same).groupBy("node").agg(F.first("items").alias("items"))


def bucket_rows(classes: DataFrame) -> DataFrame:
    """key, band and node of every class in each of its bands."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
            keys = np.zeros(minima.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for i in range(ROWS):
                keys = common.mixed(keys * common.BASE + minima[:, :, i])
            nodes = np.repeat(batch["node"].to_numpy(), BANDS)
            bands = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(bands), pa.array(nodes)], ["key", "band", "node"])

    return classes.select("node", "signature").mapInArrow(deal, "key bigint, band int, node bigint")


def stars(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of every class with the most central one, b, of each of its buckets.

    Central is what meets the most others in all its bands: of an original and its copies, each changed elsewhere, the original."""
    weights = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = buckets.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("c")).select("key", F.col("c.node").alias("b"))
    return buckets.join(centre, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: first by their signatures and parities, then on their full sets."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (as_rows(batch[c].to_pylist(), np.uint32) for c in ("signature_a", "signature_b"))
            u, v = (as_rows(batch[c].to_pylist(), np.uint64) for c in ("parity_a", "parity_b"))
            odd = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
            near = may_link(odd, batch["n_shingles_a"].to_numpy(), batch["n_shingles_b"].to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(near & ((x == y).mean(axis=1) >= SIGNATURE)))

    signed = pairs
    for end in ("a", "b"):
        signed = signed.join(classes.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in SKETCH)), end)
    near = common.compact(signed.mapInArrow(agree, "a bigint, b bigint"))
    common.release(docs.sparkSession)
    nodes = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = full_sets(docs, common.compact(classes.select("node", "doc_id", "name").join(nodes, "node", "left_semi")), shingle)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    # a bucket's central class stands in many pairs: its set travels to the other one, which stands in few
    with_b = near.join(sets.select(F.col("node").alias("b"), F.col("items").alias("set_b")), "b")
    with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("items").alias("set_a")), "a")
    links = common.compact(with_both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a bigint, b bigint"))
    common.release(docs.sparkSession)
    return links


def mixed_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with the largest of them there (`main`)."""
    placed = buckets.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    spread = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed = placed.join(spread.select("key"), "key")
    main = mixed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"))
    return common.compact(mixed.join(main.select("key", F.col("m.root").alias("main")), "key"))


def blocked(rows: DataFrame, keys: list[str], more: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The rows of each key, with the columns that `more` has for their nodes, in lists of about BLOCK."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, keys).withColumn(f"{name}_block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")
    return dealt.join(more, "node").groupBy(*keys, f"{name}_block").agg(F.collect_list(F.struct(*columns)).alias(name))


def outside_pairs(mixed: DataFrame, classes: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of classes outside of the main component of a bucket whose sketches agree, each from the first band that it shares: all
    of different components, or of each class the nearest in each block."""
    outside = mixed.where("root <> main").select("key", "band", "node", "now")
    left = blocked(outside, ["key", "band"], classes.select("node", *SKETCH), ["node", "now", *SKETCH], "x")
    right = left.select("key", F.col("x_block").alias("y_block"), F.col("x").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, *sides in zip(batch["band"].to_pylist(), batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                (a, u, n, p, x), (b, v, m, q, y) = (
                    (*(np.array([r[c] for r in side]) for c in ("node", "now", "n_shingles")), as_rows([r["signature"] for r in side], np.uint32), as_rows([r["parity"] for r in side], np.uint64))
                    for side in sides
                )
                left, right = [], []
                for i in range(len(a)):
                    js = np.flatnonzero(u[i] != v)
                    odd = np.bitwise_count(y[js] ^ x[i]).sum(axis=1, dtype=np.int64)
                    near = may_link(odd, n[i], m[js], percent)
                    js, odd = js[near], odd[near]
                    same = q[js] == p[i]
                    first = same[:, : band * ROWS].reshape(len(js), band, ROWS).all(axis=2).sum(axis=1) == 0
                    near = first & (same.mean(axis=1) >= SIGNATURE)
                    js, odd = js[near], odd[near]
                    if not every:
                        js = js[np.argsort(odd, kind="stable")[:1]]
                    left += [a[i]] * len(js)
                    right += b[js].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right).astype(np.int64)), pa.array(np.maximum(left, right).astype(np.int64))], ["b", "a"])

    met = left.join(right, "key").where("x_block <= y_block")
    return met.select("band", "x", "y").mapInArrow(compare, "b bigint, a bigint").distinct().select("a", "b")


def outside_links(mixed: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links that tie all components outside of the main ones of their buckets which have links with each other."""
    nearest = common.compact(outside_pairs(mixed.withColumn("now", F.col("root")), classes, percent, False))
    common.release(docs.sparkSession)
    if nearest.isEmpty():
        return nearest
    links = confirmed(nearest, classes, docs, shingle, percent)
    # components of components: a link joins the roots that its ends have
    ends = mixed.select("node", "root").distinct()
    for end in ("a", "b"):
        links = links.join(ends.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end)
    merged = connected_components(links.select("root_a", "root_b")).select(F.col("node").alias("root"), F.col("root").alias("now"))
    placed = mixed.join(merged, "root", "left").withColumn("now", F.coalesce("now", "root"))
    rest = common.compact(outside_pairs(placed, classes, percent, True).join(nearest, ["a", "b"], "left_anti"))
    common.release(docs.sparkSession)
    links = links.select("a", "b")
    return links if rest.isEmpty() else links.union(confirmed(rest, classes, docs, shingle, percent))


def main_links(mixed: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """A link, if there is one, of each class outside to each block of the main component of a bucket, found on full sets."""
    asked = common.compact(mixed.where("root <> main").select("node", F.col("main").alias("to")).distinct())
    members = classes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("to")).join(asked.select("to").distinct(), "to")
    members = common.compact(members.select("node", "to"))
    nodes = members.select("node").union(asked.select("node")).distinct()
    known = common.compact(classes.join(nodes, "node", "left_semi"))
    rows = full_sets(docs, known.select("node", "doc_id", "name"), shingle).join(known.select("node", "signature"), "node")
    columns = ["node", "signature", "items"]
    left = blocked(asked, ["to"], rows, columns, "x")
    right = blocked(members, ["to"], rows, columns, "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = x.as_py(), y.as_py()
                p, q = (np.frombuffer(b"".join(r["signature"] for r in v), np.uint32).reshape(-1, HASHES) for v in (x, y))
                items = np.frombuffer(b"".join(r["items"] for r in y), np.uint64)
                sizes = np.array([len(r["items"]) // 8 for r in y])
                found = []
                for i, r in enumerate(x):
                    if (q == p[i]).mean(axis=1).max() < SIGNATURE:
                        continue
                    own = np.frombuffer(r["items"], np.uint64)
                    hits = own[np.searchsorted(own, items).clip(0, len(own) - 1)] == items
                    both = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
                    linked = np.flatnonzero(100 * both >= percent * (len(own) + sizes - both))
                    found += [(r["node"], y[j]["node"]) for j in linked[:1].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return left.join(right, "to").select("x", "y").mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = common.checkpointed(sketch(docs, shingle))
    classes = rows.where("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in SKETCH))
    classes = common.checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    dealt = bucket_rows(classes)
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = common.compact(dealt.join(shared, "key"))
    common.release(docs.sparkSession)
    links = confirmed(stars(buckets), classes, docs, shingle, percent)
    roots = connected_components(links)
    mixed = mixed_buckets(buckets, roots)
    more = outside_links(mixed, classes, docs, shingle, percent)
    roots = connected_components(links.union(more).union(main_links(mixed, roots, classes, docs, shingle, percent)))
    rooted = classes.select("name", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("name", "component_id")
    found = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", "name").join(named, "name", "left").select(
        "doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, shingle: int, percent: int = PERCENT) -> DataFrame:
    """The row of the smallest id of each component, with all columns of docs; of rows equal in id and text one."""
    kept = near_duplicates(docs, shingle, percent).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    stay = docs.join(common.small(kept), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    digest = "near_digest"
    return stay.withColumn(digest, F.xxhash64("text")).dropDuplicates(["doc_id", digest]).drop(digest)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=4)
