import hashlib

from pyspark.sql import functions as F

from zoneflow.llm import common, fingerprint

from . import cases


def five(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    found = {r.doc_id: r for r in fingerprint.op9_fingerprint(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    errors = []
    for k, (i, text) in enumerate(docs):
        following, r = docs[(k + 1) % len(docs)][1], found[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = five(text), five(edited), five(following)
        errors += [abs(r.near_edited - alike(a, b)), abs(r.near_next - alike(a, c))]
        if len(a | b) < fingerprint.SKETCH:
            assert abs(r.near_edited - alike(a, b)) < 1e-12
    assert sum(errors) / len(errors) < 0.02 and max(errors) < 0.25


def test_sketches_merge(spark):
    left, right = [" ".join(f"w{i * k % 3001}" for i in range(n)) for k, n in ((7, 900), (11, 1200))]
    df = spark.createDataFrame([(left, right)], "a string, b string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "sa"), "b", "sb")
    both = fingerprint.merged(F.col("sa"), F.col("sb"))
    r = df.select(fingerprint.distinct_shingles(both).alias("n"), fingerprint.containment(F.col("sa"), both).alias("in"), both.alias("both")).first()
    true = len(five(left) | five(right))
    assert abs(r.n / true - 1) < 0.3 and r["in"] > 0.7
    parts = df.select(F.explode(F.array("sa", "sb")).alias("s"), F.lit(1).alias("g"))
    assert fingerprint.merge_all(parts, ["g"], "s").first().s == r.both


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    rows = fingerprint.fingerprint_pairs(docs).select("doc_id", "n_chars", "sketch", "edited", fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near")).collect()
    assert len(rows) == docs.count()
    assert all(r.near == 1 and r.sketch == [] for r in rows if r.doc_id in (1, 2))
    assert fingerprint.fingerprint_pairs(cases.empty(spark)).count() == 0
    one = cases.documents(spark, ["only one text here of some words"])
    assert fingerprint.fingerprint_pairs(one).first().edited == one.first().text[:16] * 2


def test_no_python_in_the_plan(spark, sf_dir):
    plan = fingerprint.op9_fingerprint(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
