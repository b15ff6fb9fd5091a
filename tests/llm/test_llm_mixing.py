from pyspark.sql import functions as F

from zoneflow.llm import mixing

from . import cases


def test_counts_follow_the_target_rates(spark):
    rows = [(i, "x" * 9, "en", "big" if i % 10 else "small", 9) for i in range(20_000)]
    docs = spark.createDataFrame(rows, cases.DOCS)
    rates = {r[0]: r.rate for r in mixing.source_rates(docs).collect()}
    assert abs(rates["big"] / rates["small"] - (9**0.5 / 9)) < 1e-9
    found = {r.source: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    assert abs(found["big"] / (18_000 * rates["big"]) - 1) < 0.05
    assert abs(found["small"] / (2_000 * rates["small"]) - 1) < 0.08
    spread = mixing.mix(docs).where("source = 'small'").groupBy("doc_id").count().agg(F.var_samp("count"), F.avg("count")).first()
    assert spread[1] > 1


def test_large_rates_have_a_distribution(spark):
    rates = spark.createDataFrame([("s", 900.0), (None, 0.2)], f"{mixing.KEY} string, rate double")
    below = {r[0]: r.mix_below for r in mixing.quantile_tables(rates).collect()}
    assert abs(below["s"][-1] - 1) < 1e-9 and abs(below[None][0] - 0.8187307530779818) < 1e-12
    assert sum(x <= 0.5 for x in below["s"]) in range(895, 906)


def test_awkward_rows(spark):
    docs = cases.awkward(spark).selectExpr("*", "1 as shuffle_key")
    found = mixing.mix(docs)
    counts = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert set(counts) <= {r.doc_id for r in docs.collect()}
    assert counts.get(4, 0) % 2 == 0
    assert sorted(found.columns) == sorted({*docs.columns, "copy", "shuffle_key"})
    assert mixing.mix(cases.empty(spark)).count() == 0
