import contextlib
import glob
import os
import random
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from zoneflow.llm import near_duplicates
from zoneflow.llm.components import connected_components

from . import cases


def brute(texts, size):
    sets = {i: cases.shingles(t, size) for i, t in texts}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), root) for i, root in cases.roots(ids, links).items()}


def copies(seed, n):
    """Texts and their copies, each changed in some words; copies of copies make chains."""
    draw = random.Random(seed)
    words = lambda k: [f"{draw.choice('bcdfg')}{draw.randint(0, 99)}" for _ in range(k)]
    texts = [words(draw.randint(0, 80)) for _ in range(n // 4)]
    while len(texts) < n:
        text = list(draw.choice(texts))
        for _ in range(draw.randint(0, 6)):
            if text:
                text[draw.randrange(len(text))] = draw.choice(words(1))
        texts.append(text)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_equals_brute_force(spark):
    texts = copies(1, 240)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], cases.DOCS)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, 4).collect()}
    assert found == brute(texts, 4)


def test_components_equal_union_find(spark):
    draw = random.Random(8)
    edges = [(draw.randint(0, 199), draw.randint(0, 199)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(40)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    nodes = {n for e in edges for n in e}
    assert {n: found.get(n, n) for n in nodes} == cases.roots(nodes, edges)


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    rows = near_duplicates.near_duplicates(docs, 5).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].component_id == 4 and not by_id[5].kept and by_id[4].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (1, 2, 6))
    left = near_duplicates.without_near_duplicates(docs, 5)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 8] and left.columns == docs.columns
    assert near_duplicates.near_duplicates(cases.empty(spark), 5).count() == 0


def test_one_template_below_the_similarity_makes_few_pairs(spark):
    """Pages of one template share most buckets; parities tell that none of them links, so hardly a pair of them is emitted."""
    draw = random.Random(3)
    frame = [f"t{i}" for i in range(150)]
    texts = [(i, " ".join(frame + [f"p{draw.randint(0, 10**6)}" for _ in range(24)])) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], cases.DOCS)
    sets = {i: cases.shingles(t, 4) for i, t in texts}
    alike = [len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in range(1, 120)]
    assert 0.7 < min(alike) and max(alike) < 0.8
    keys, offsets = near_duplicates.shingle_sets(pa.array([t for _, t in texts]), 4)
    bits = near_duplicates.parities(keys, offsets)
    sizes = np.diff(offsets)
    odd = np.unpackbits(bits[0] ^ bits, axis=1).sum(axis=1, dtype=np.int64)
    assert all(odd[i] <= len(sets[0] ^ sets[i]) for i in sets)
    assert near_duplicates.may_link(odd[1:], sizes[0], sizes[1:], 80).mean() < 0.05
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, 4).collect()}
    assert found == {i: (len(sets[i]), i) for i in sets}


def test_cliques_outside_of_the_main_component(spark):
    """Several families of near copies in the buckets of one template: each family is a component."""
    draw = random.Random(5)
    frame = [f"t{i}" for i in range(120)]
    texts = []
    for family, size in enumerate((30, 20, 12, 7, 3)):
        own = frame + [f"f{family}w{i}" for i in range(22)]
        for _ in range(size):
            text = list(own)
            for _ in range(draw.randint(0, 2)):
                text[draw.randrange(len(text))] = f"x{draw.randint(0, 10**6)}"
            texts.append(" ".join(text))
    draw.shuffle(texts)
    texts = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], cases.DOCS)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, 4).collect()}
    assert found == brute(texts, 4)


def shuffles(since):
    """Names of the shuffles whose files, written since then, are on disk."""
    found = set()
    for path in glob.glob(f"{os.environ.get('SPARK_LOCAL_DIRS', '/tmp')}/blockmgr-*/*/shuffle_*.index"):
        with contextlib.suppress(OSError):  # a file may go meanwhile
            if os.path.getmtime(path) >= since:
                found.add(os.path.basename(path).split("_")[1])
    return found


def test_shuffles_of_earlier_steps_go(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in copies(3, 200)], cases.DOCS).repartition(5)
    since = time.time()
    found = near_duplicates.near_duplicates(docs, 5)
    for _ in range(20):  # Spark deletes in the background
        left = shuffles(since)
        if len(left) <= 12:
            break
        time.sleep(0.5)
    assert len(left) <= 12
    assert found.count() == 200


def test_scans_hold_little_memory():
    """Of one batch of 16 MB of text."""
    texts = pa.array([" ".join(f"w{(i * 7919 + j) % 90001}" for j in range(300)) for i in range(8000)])
    made = []
    docs = SimpleNamespace(select=lambda *a: SimpleNamespace(mapInArrow=lambda scan, schema: made.append(scan)))
    near_duplicates.sketch(docs, 5)
    tracemalloc.start()
    rows = sum(b.num_rows for b in made[0](iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 64e6
