import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zoneflow.llm import jaccard_join

from . import cases
from .test_llm_near_duplicates import brute, copies


def found(spark, texts, size):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], cases.DOCS).repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, size).collect()}


def test_equals_brute_force(spark):
    texts = copies(1, 260)
    assert found(spark, texts, 5) == brute(texts, 5)


def template(seed, n, kept, changed):
    """Pages of one template: `kept` common words and `changed` own ones, at the border of similarity or beyond."""
    draw = random.Random(seed)
    page = [f"t{i}" for i in range(kept)]
    return [(i, " ".join(page + [f"p{draw.randint(0, 10**9)}" for _ in range(changed)])) for i in range(n)]


@pytest.mark.parametrize("changed", [12, 14])
def test_pages_of_a_template(spark, changed):
    texts = template(2, 150, 100, changed)
    assert found(spark, texts, 5) == brute(texts, 5)


@pytest.mark.parametrize("rounds", [0, 2])
def test_large_group_with_outsiders(spark, monkeypatch, rounds):
    """Near copies of one text, changed more and more, so that some link to it only over others; regions are split and joined in blocks."""
    draw = random.Random(4)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    texts = []
    for i in range(170):
        text = list(base)
        for _ in range(draw.randint(0, 9)):
            text[draw.randrange(len(text))] = f"x{draw.randint(0, 50)}"
        texts.append((i, " ".join(text)))
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "PART", 8)
    assert found(spark, texts, 5) == brute(texts, 5)


def test_links_share_a_first_shingle_whatever_the_order():
    draw = random.Random(6)
    for _ in range(2000):
        n = draw.randint(1, 60)
        x = {draw.randint(0, 10**6) for _ in range(n)}
        y = set(draw.sample(sorted(x), max(1, len(x) - draw.randint(0, 6)))) | {draw.randint(0, 10**6) for _ in range(draw.randint(0, 6))}
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        small, large = sorted((x, y), key=len)
        order = lambda s: (hash((s, 5)), s)
        index = sorted(small, key=order)[: len(small) + 160 * len(small) // -180 + 1]
        probe = sorted(large, key=order)[: len(large) + 80 * len(large) // -100 + 1]
        assert set(index) & set(probe)


def test_levels_count_documents(spark):
    docs = spark.createDataFrame([(i, f"a b c d e own{i} x y z u v") for i in range(40)], "doc_id bigint, text string").repartition(3)
    levels, shared = jaccard_join.shingle_levels(docs, 5)
    assert np.unpackbits(shared).sum() == 2
    values = np.array([0, 1, 300, 70_000, 1 << 31], np.uint32)
    assert jaccard_join.from_planes(jaccard_join.planes(values)).tolist() == values.tolist()
    assert len(levels) == 1 << jaccard_join.SLOT_BITS and sorted(np.unique(levels).tolist()) == [0, 5]
    assert (levels == 5).sum() == 2


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].component_id == 4 and all(by_id[i].n_shingles == 0 and by_id[i].component_id == i for i in (1, 2, 6))
    assert by_id[None].n_shingles == 1 and by_id[None].component_id is None
    nulls = docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")).union(docs.where("doc_id = 4"))
    assert {r.component_id for r in jaccard_join.jaccard_components(nulls).collect()} == {4}
    assert jaccard_join.jaccard_components(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("step", ["levels", "prefixes"])
def test_scans_hold_little_memory(step):
    """Of batches with 48 MB of text."""
    texts = pa.array([" ".join(f"w{(i * 7919 + j) % 90001}" for j in range(300)) for i in range(8000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
    made = []
    rows = SimpleNamespace(mapInArrow=lambda scan, schema: made.append(scan) or SimpleNamespace(groupBy=lambda c: found))
    found = SimpleNamespace(applyInArrow=lambda f, schema: SimpleNamespace(toLocalIterator=lambda: iter(())))
    context = SimpleNamespace(broadcast=lambda tables: SimpleNamespace(value=tables))
    docs = SimpleNamespace(select=lambda *a: rows, rdd=SimpleNamespace(getNumPartitions=lambda: 8), sparkSession=SimpleNamespace(sparkContext=context))
    if step == "levels":
        jaccard_join.shingle_levels(docs, 5)
    else:
        tables = np.zeros(1 << jaccard_join.SLOT_BITS, np.uint8), np.zeros(1 << (jaccard_join.SHARED_BITS - 3), np.uint8)
        jaccard_join.prefixes(docs, tables, 5, 80)
    tracemalloc.start()
    for _ in made[0](iter([batch] * 3)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


def test_near_copies_share_one_region(spark):
    """Not one for each of their first shingles; an outsider with one of these makes a second region."""
    keys = list(range(40))
    rows = [(1, 200, keys, 20), (2, 200, keys, 0), (3, 200, keys[:1], 1)]
    classes = spark.createDataFrame(rows, "node bigint, n_shingles bigint, keys array<bigint>, n_index bigint")
    regions = jaccard_join.first_regions(classes, 80).collect()
    own = {}
    for r in regions:
        own.setdefault(r.region, []).append((r.node, r["index"]))
    assert sorted(sorted(v) for v in own.values()) == [[(1, True), (2, False)], [(1, True), (2, False), (3, True)]]


def some_sets(spark, n):
    draw = random.Random(8)
    base = [draw.getrandbits(64) for _ in range(150)]
    sets = [sorted(set(base[draw.randint(0, 20) :] + [draw.getrandbits(64) for _ in range(draw.randint(1, 40))])) for _ in range(n)]
    rows = [(i, np.array(x, np.uint64).tobytes()) for i, x in enumerate(sets)]
    return sets, spark.createDataFrame(rows, "node bigint, items binary")


def test_only_asked_sets_travel(spark):
    _, sets = some_sets(spark, 300)
    pairs = spark.createDataFrame([(1, 2), (7, 2)], "node bigint, pivot bigint")
    passed = {r.node for r in jaccard_join.asked_sets(sets, pairs).collect()}
    assert passed >= {1, 2, 7} and len(passed) < 10
    assert {(r.node, r.pivot) for r in jaccard_join.distances(pairs, sets, 80).collect()} == {(1, 2), (7, 2)}


def test_bounds_never_err(spark):
    sets, rows = some_sets(spark, 40)
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(i)], "node bigint, pivot bigint")
    found = jaccard_join.bounds(pairs, jaccard_join.sketches(rows), 80).collect()
    assert len(found) == 40 * 39 // 2 and {r.near for r in found} == {True, False}
    for r in found:
        x, y = set(sets[r.node]), set(sets[r.pivot])
        assert r.d <= 1 - len(x & y) / len(x | y) + 1e-12
        assert r.near or 100 * len(x & y) < 80 * len(x | y)


def test_batches_of_tasks_are_small(spark):
    """Of one partition with 8 MB of text; the session's own limit holds again afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def scan(batches):
        for batch in batches:
            assert batch.nbytes < 2 << 20
            yield batch

    rows = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('a', id, ' '), 400)").alias("text"))
    docs = rows.mapInArrow(scan, "doc_id bigint, text string")
    assert jaccard_join.jaccard_components(docs).where("component_id = doc_id").count() == 4000
    assert spark.conf.get(key) == before


def block(n, roots):
    """A block of n documents of so many components, and the function that a task calls for it."""
    draw = np.random.default_rng(3)
    base = draw.integers(0, 256, jaccard_join.SKETCH // 8, np.uint8)
    signs = np.tile(base, (n, 1))
    signs[:, :8] = draw.integers(0, 256, (n, 8), np.uint8)
    columns = {"low": np.zeros(n, np.int64), "high": np.zeros(n, np.int64), "own": np.zeros(n, np.int64), "node": draw.permutation(n), "n": np.full(n, 400)}
    columns |= {"root": draw.integers(0, roots, n), "index": np.ones(n, bool), "sketch": pa.array([x.tobytes() for x in signs], pa.binary())}
    return pa.table({k: pa.array(v) for k, v in columns.items()}), signs


def compared(group, every):
    made = []

    class Rows:
        def __getattr__(self, name):
            return lambda *a, **b: made.append(a[0]) or self if name == "applyInArrow" else self

    class Columns:
        def __getattr__(self, name):
            return lambda *a: self

        def __getitem__(self, name):
            return self

        def __add__(self, other):
            return self

        __sub__ = __truediv__ = __add__

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard_join, "F", Columns())
        jaccard_join.near_pairs(Rows(), Rows(), 80, every)
    tracemalloc.start()
    table = made[0](group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return table, peak


@pytest.mark.parametrize("every", [False, True])
def test_pairs_of_a_block_hold_little_memory(every):
    """Of 1,200 documents that may all link, each a component."""
    n = 1200
    group, _ = block(n, 1 << 40)
    table, peak = compared(group, every)
    assert table.num_rows == n * (n - 1) // 2
    assert peak < 90 * table.num_rows


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_nearest_pairs_of_a_block(monkeypatch, held):
    monkeypatch.setattr(jaccard_join, "COUNTED", held)
    group, signs = block(90, 12)
    rows = group.select(["node", "root"]).to_pylist()
    best = {}
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            if x["root"] < y["root"]:
                d = int(np.bitwise_count(signs[i] ^ signs[j]).sum())
                best[x["root"], y["root"]] = min(d, best.get((x["root"], y["root"]), d))
    at = {x["node"]: i for i, x in enumerate(rows)}
    found = {}
    for x in compared(group, False)[0].to_pylist():
        i, j = at[x["node"]], at[x["pivot"]]
        pair = tuple(sorted((rows[i]["root"], rows[j]["root"])))
        assert pair not in found
        found[pair] = int(np.bitwise_count(signs[i] ^ signs[j]).sum())
    assert found == best
    everything = compared(group, True)[0]
    assert everything.num_rows == sum(x["root"] != y["root"] for i, x in enumerate(rows) for y in rows[:i])
