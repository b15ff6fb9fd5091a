import math
import random
import re

from zoneflow.llm import ranked_search

from . import cases


def terms(text):
    return [t.translate(cases.LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top):
    """The definition in plain Python: (item_id, rank, doc_id, score)."""
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, ts) for i, ts in docs if ts]
    n_docs, n_terms = len(docs), sum(len(ts) for _, ts in docs)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    found = set()
    for item, ts in asked.items():
        scores = []
        for i, own in docs:
            m, score = 50 + (50 * len(own) * n_docs) // n_terms, 0
            for t in ts & set(own):
                tf, df = own.count(t), sum(t in o for _, o in docs)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        found |= {(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)}
    return found


def corpus(seed, n, words):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice("aBcÄ") + str(int(draw.expovariate(0.05))) for _ in range(draw.randint(0, words)))) for i in range(n)]


def found(spark, docs, items, top):
    tables = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string")
    rows = ranked_search.search(*tables, top).collect()
    assert len(rows) == len({(r.item_id, r["rank"]) for r in rows})
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in rows}


def test_equals_brute_force(spark, monkeypatch):
    docs = corpus(1, 260, 60) + [(1000 + i, "c1 c2 c3 b4") for i in range(20)] + [(5000, None), (5001, "?!")]
    items = corpus(2, 25, 30) + [(700, "nowhere"), (701, None), (702, "c1 C2 c3")]
    assert found(spark, docs, items, 7) == brute(docs, items, 7)
    monkeypatch.setattr(ranked_search, "BUCKET_ROWS", 40)  # many buckets, thresholds, several blocks of queries and of cells
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", 60)
    monkeypatch.setattr(ranked_search, "CELLS", 500)
    assert found(spark, docs, items[-9:], 7) == brute(docs, items[-9:], 7)


def test_bounds_hold(spark):
    """A bucket is searched the same with and without thresholds that its best rows reach."""
    docs, items = corpus(3, 200, 50), corpus(4, 10, 20)
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    queries = ranked_search.Queries(ranked_search.item_terms(tables[1]).collect())
    rows = ranked_search.search_block(tables[0], queries, 5)
    top = {(r["query"], r["rank"], r.score) for r in ranked_search.best(rows, 5).collect()}
    names = {i: k for k, i in enumerate(queries.names)}
    assert top == {(names[item], rank, score) for item, rank, _, score in brute(docs, items, 5)}


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    items = spark.createDataFrame([(1, "the SAME words"), (1, "w5 end"), (None, "a text"), (2, None), (3, "")], cases.ITEMS)
    rows = {(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.search(docs, items).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows == brute(texts, [(1, "the SAME words"), (1, "w5 end"), (None, "a text")], 50)
    assert ranked_search.search(cases.empty(spark), items).count() == 0
    assert ranked_search.search(docs, cases.empty(spark, cases.ITEMS)).count() == 0
