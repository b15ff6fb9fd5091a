from pyspark.sql import functions as F

import corpus_pipeline
from zoneflow.llm import common, mixing

from . import cases
from .test_llm_decontamination import brute as contaminated
from .test_llm_near_duplicates import brute as components
from .test_llm_pii import plain


def test_stages_against_brute_force(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").where("doc_id < 250")
    steps = dict(corpus_pipeline.STAGES)
    after = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = common.checkpointed(stage(spark, rows, sf_dir))
        after[name] = rows
    texts = lambda name: sorted((r.doc_id, r.text) for r in after[name].select("doc_id", "text").collect())
    assert list(steps) == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    assert all(after[n].columns == docs.columns for n in list(steps)[:-1])
    assert {i for i, _ in texts("toxicity")} <= {r.doc_id for r in docs.collect()}
    roots = components(texts("toxicity"), 5)
    assert [i for i, _ in texts("near_dedup")] == [i for i, (_, root) in sorted(roots.items()) if i == root]
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    dirty = contaminated(texts("near_dedup"), items)
    assert [i for i, _ in texts("decontamination")] == [i for i, _ in texts("near_dedup") if not dirty[i][-1]]
    before = dict(texts("decontamination"))
    for i, text in texts("pii"):
        assert not plain(text) and text.count("[") >= before[i].count("[") + bool(plain(before[i]))
    mixed = {r.doc_id: r["count"] for r in after["mixing"].groupBy("doc_id").count().collect()}
    assert set(mixed) <= {i for i, _ in texts("pii")}
    assert sum(mixed.values()) == mixing.mix(after["pii"]).count()


def test_awkward_rows(spark, sf_dir):
    rows = cases.awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = common.checkpointed(stage(spark, rows, sf_dir))
        assert rows.columns == cases.awkward(spark).columns
    assert {r.doc_id for r in rows.collect()} >= {1, 2, 4}
    corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).agg(F.count("*")).collect()


def test_empty_table(spark, sf_dir):
    rows = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf_dir)
    assert rows.count() == 0
