import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from zoneflow.llm import common, toxicity

from . import cases


def words_of(texts):
    return toxicity.Words(*common.utf8(pa.array(texts, pa.string())))


def test_words_and_windows():
    words = words_of(["One two ONE", None, "", "three-one", " ".join(["w"] * 150)])
    assert np.diff(words.offsets).tolist() == [3, 0, 0, 2, 150]
    assert words.hashes[0] == words.hashes[2] == words.hashes[4] != words.hashes[1]
    row, start, length = words.windows()
    covered = [set() for _ in range(5)]
    for r, s, n in zip(row, start, length, strict=True):
        covered[r] |= set(range(s - words.offsets[r], s + n - words.offsets[r]))
    assert [len(c) for c in covered] == [3, 0, 0, 2, 150]


def test_gradients():
    words = words_of(["a bad bad word here", "a good word", "bad day", "good good day"])
    hashes = np.unique(words.hashes)
    network = toxicity.Network(hashes, np.linspace(-1, 1, len(hashes)), np.zeros(1 << toxicity.PIECE_BITS))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    _, start, length = words.windows()
    y = np.array([1.0, 0.0, 0.0, 1.0])
    gates = network.inputs(words)

    def loss(g):
        logit = network.forward(g, start, length)
        return float(np.mean(np.log1p(np.exp(np.where(y == 1, -logit, logit)))))

    keep = {}
    logit = network.forward(gates, start, length, keep)
    grad, (where, what) = network.backward((1 / (1 + np.exp(-logit)) - y) / 4, keep, start, length)
    to_gates = np.zeros((len(gates), 2, 3 * toxicity.HIDDEN))
    for d in (0, 1):
        np.add.at(to_gates[:, d], where[d], what[d])
    to_gates = to_gates.reshape(len(gates), -1)
    step = 1e-3
    for at in ((0, 3), (2, 20), (5, 30), (8, 47)):
        up, down = gates.copy(), gates.copy()
        up[at] += step
        down[at] -= step
        assert abs((loss(up) - loss(down)) / (2 * step) - to_gates[at]) < 1e-4
    for name, at in (("hidden", (0, 1, 5)), ("hidden", (1, 3, 20)), ("look", (3,)), ("out", (9,)), ("level", (0,))):
        value = network.p[name][at]
        network.p[name][at] = value + step
        up = loss(gates)
        network.p[name][at] = value - step
        down = loss(gates)
        network.p[name][at] = value
        assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-4, name


def test_insults_at_the_end_of_long_texts_are_learned(spark):
    """Whole texts are read: what tells the labels apart stands behind thousands of equal words."""
    front = " ".join(f"plain{i % 60}" for i in range(3000))
    texts = [(i, f"{front} {'you wretched scoundrel of a fool' if i % 2 else 'you excellent friend of a person'} {i}", "en", "a", 1) for i in range(120)]
    docs = spark.createDataFrame(texts, cases.DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], cases.LABELS)
    network = toxicity.fit(docs, labels)
    rows = toxicity.predict(docs, network).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_holders_and_windows_equal_plain_counts(spark):
    texts = [(0, "bad word " * 100 + "worse", 1), (1, "good word", 0), (2, "", 0), (3, "bad good good", 0)]
    learned = spark.createDataFrame(texts, "doc_id bigint, text string, toxic int")
    found = {r.key: (r.bad, r.good) for r in toxicity.holders(learned).where("kind = 0").collect()}
    key = lambda w: int(words_of([w]).hashes.view(np.int64)[0])
    assert found == {key("bad"): (1, 1), key("word"): (1, 1), key("worse"): (1, 0), key("good"): (0, 2)}
    hashes = np.array([key("worse"), key("bad")]).view(np.uint64)
    network = toxicity.Network(hashes, np.array([5.0, 0.1]), np.zeros(1 << toxicity.PIECE_BITS))
    network.p["word"][0, 0] = 0
    rows = toxicity.worst_windows(learned, network).collect()
    assert [len([r for r in rows if r.doc_id == i]) for i in range(4)] == [toxicity.CANDIDATES, 1, 0, 1]
    assert any(bytes(r.words).endswith(b"bad word worse") for r in rows if r.doc_id == 0) and b"good word" in [bytes(r.words) for r in rows]


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.1")  # the smaller table has too few labels to learn from
    labels = common.table(spark, sf_dir, "labels")
    docs = common.table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    network = toxicity.fit(docs, labels.where(~common.is_held_out(F.col("doc_id"))))
    rows = toxicity.predict(docs.select("doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"), "text"), network).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    bad = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in bad) >= 0.8 * len(bad)


def test_awkward_rows(spark):
    docs = cases.awkward(spark).drop("score", "predicted")
    texts = [(i, "such an awful idiot of a text" if i % 2 else "such a fine piece of a text", "en", "a", 1) for i in range(100, 160)]
    known = spark.createDataFrame(texts, cases.DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100, 160)] + [(1, 1, 1), (2, None, None), (None, 1, 1), (101, 0, 0)], cases.LABELS)
    network = toxicity.fit(known.unionByName(docs.select(known.columns)), labels)
    rows = toxicity.predict(docs, network).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 and r.predicted == 0 for r in rows if r.doc_id in (1, 2, 6))
    assert toxicity.without_toxic(docs, network).columns == docs.columns
    assert toxicity.fit(docs, cases.empty(spark, cases.LABELS)) is None
    assert toxicity.predict(docs, None).agg(F.max("score")).first()[0] == 0
    assert toxicity.without_toxic(cases.empty(spark), network).count() == 0
