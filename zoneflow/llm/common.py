"""Helpers shared by the operators: Arrow batches as numpy arrays, inputs, shared folders."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a worker handles at once; a longer single text makes a block of its own.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`, or below the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder made by `shared_path`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which takes less room than a checkpoint."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints to which nothing refers any more.

    Its cleaner learns of them when the driver collects its garbage, which a driver with room to spare seldom does by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of a batch that Spark sends to a worker where `small_batches` holds; a longer single row makes a batch of its own.
BATCH_BYTES = 1 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends workers batches of BATCH_BYTES. By default they take up to 64 MB, which the executor and the worker both hold."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def restored(kind: type, fields: dict) -> object:
    """An object from its broadcast fields; plain values need no module on the executors."""
    made = kind.__new__(kind)
    vars(made).update(fields)
    return made


#: Narrow rows that one task takes of a compacted table.
COMPACT_ROWS = 50_000


def compact(df: DataFrame) -> DataFrame:
    """Checkpoints narrow rows and reads them in as few partitions as their number asks for, so that small steps make few files."""
    df = checkpointed(df)
    return df.coalesce(max(1, -(-df.count() // COMPACT_ROWS)))


#: Rows of a few bytes each up to which a table is sent to every executor.
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """Checkpoints narrow rows; marked for broadcast if they were counted to be few."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def is_held_out(doc_id: Column) -> Column:
    """One fold of five by the id; a row without id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts in `column` hold `limit` bytes at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 offsets between them; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts as code points, with their offsets."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, starts[offsets]


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between each two offsets; 0 where there are none."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def lanes(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts rows into pieces of `width` values at most, longest first: row, start and length of each piece."""
    sizes = np.diff(offsets)
    count = -(-sizes // width)
    row = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + at * width
    length = np.minimum(offsets[row + 1] - start, width)
    order = np.argsort(-length, kind="stable")
    return row[order], start[order], length[order]


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


#: Odd multiplier of the polynomial hash of a word's bytes.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def words(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of bytes marked as `inside`, which end where a text does, and the offsets of the texts in them."""
    follows = np.concatenate([[False], inside[:-1]])[: len(inside)]
    follows[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~follows)
    at = np.concatenate([[0], np.cumsum(inside)])
    firsts = np.append(at[starts], at[-1])
    sizes = np.diff(firsts)
    powers = np.cumprod(np.full(int(sizes.max(initial=0)), BASE, np.uint64))
    place = np.arange(at[-1]) - np.repeat(firsts[:-1], sizes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[inside].astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64)])
    return mixed(sums[firsts[1:]] - sums[firsts[:-1]] + sizes.astype(np.uint64)), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words that begin at each word; the last size - 1 have none."""
    n = max(0, len(hashes) - size + 1)
    total = np.full(n, np.uint64(size), np.uint64)
    for i in range(size):
        total = mixed(total * BASE + hashes[i : i + n])
    return total


#: Bits of the filters that `key_filter` makes, whatever the number of keys.
FILTER_BITS = 23


def key_filter(keys: DataFrame, name: str) -> np.ndarray:
    """A bitmap of fixed size in which the slot of every key (a bigint column) is set; slots shared by chance only let more rows pass."""
    slot = F.shiftrightunsigned(name, 64 - FILTER_BITS)
    bits = keys.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))).alias("bits"))
    found = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in bits.collect():
        found[row.word] = row.bits
    return found.view(np.uint64)


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
