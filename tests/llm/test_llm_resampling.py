import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from zoneflow.llm import resampling

from . import cases


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(cases.LOWER))


def brute(docs, target, percent, least, buckets, run):
    """The definition in plain Python: (n_features, weight, score, rank) by id."""
    runs = lambda ws: [" ".join(ws[i : i + n]) for n in range(1, run + 1) for i in range(len(ws) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for table, counts in ((docs, s), (target, t)):
        for _, text in table:
            for f in runs(words(text)):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    found = {}
    for i, text in docs:
        fs = runs(words(text))
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        found[i] = [len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    drawable = sorted((-found[i][2], i) for i, text in docs if len(words(text)) >= least)
    for rank, (_, i) in enumerate(drawable[: percent * len(drawable) // 100], 1):
        found[i][3] = rank
    return {i: tuple(v) for i, v in found.items()}


def drawn(docs, target, *args):
    return {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in resampling.resample(docs, target, *args).collect()}


def test_equals_brute_force(spark):
    draw = random.Random(3)
    text = lambda k, n: " ".join(draw.choice(["Größe", "a1", "B", "x-y", "…", "wörter"]) + str(draw.randint(0, k)) for _ in range(n))
    docs = [(i, text(60, draw.randint(0, 40))) for i in range(300)] + [(900, None), (901, "")]
    target = [(i, text(9, 30)) for i in range(12)]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), spark.createDataFrame(target, "item_id bigint, text string")
    for args in ((10, 20, 10_000, 1), (35, 5, 64, 2), (100, 0, 16, 1)):
        assert drawn(*tables, *args) == brute(docs, target, *args)


def test_cutoff_is_the_kth_key(spark):
    draw = random.Random(5)
    rows = [(draw.choice([1, 2, 2, 2, 9, draw.randint(-50, 50)]), draw.choice([None, 7, i]), i) for i in range(500)]
    keys = spark.createDataFrame(rows, "score bigint, doc_id bigint, place bigint").repartition(9, "place")
    order = sorted((-s, resampling.LAST if d is None else d, p) for s, d, p in rows)
    medians = resampling.side(resampling.halves(keys, None, None, None), "before")
    for k in (1, 2, 77, 250, 499, 500):
        assert resampling.cutoff(keys, medians, k) == order[k - 1]
    one = keys.where(F.col("place") == 3)
    assert resampling.cutoff(one, resampling.side(resampling.halves(one, None, None, None), "before"), 1)[2] == 3


def test_awkward_rows(spark):
    docs, items = cases.awkward(spark), spark.createDataFrame([(1, "the same words"), (1, "the same words"), (None, None)], cases.ITEMS)
    rows = resampling.resample(docs, items, 100, 0).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, docs.count() + 1))
    assert [r.weight for r in rows if r.doc_id in (1, 2, 6)] == [0, 0, 0]
    few = resampling.resample(docs, items, 100).collect()
    assert len(few) == docs.count() and [r.doc_id for r in few if r["rank"]] == [3]
    assert all(r["rank"] is None for r in resampling.resample(docs, items, 20).collect())
    assert resampling.resample(cases.empty(spark), items).count() == 0
    assert resampling.resample(docs, cases.empty(spark, cases.ITEMS)).count() == docs.count()
