import hashlib
import random
import re

from zoneflow.llm import decontamination

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, items):
    split = lambda t: WORD.findall((t or "").translate(cases.LOWER))
    found = {}
    for i, text in texts:
        words, hit, names = split(text), set(), set()
        for item, body in items:
            parts = split(body)
            n = min(10, len(parts))
            windows = {tuple(parts[k : k + n]) for k in range(len(parts) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add(str(item))
        listed = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found[i] = (len(words), len(hit), len(names), listed, bool(hit))
    return found


def check(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], cases.DOCS)
    rows = decontamination.decontaminate(docs, spark.createDataFrame(items, cases.ITEMS)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute(texts, items)


def test_equals_brute_force(spark):
    draw = random.Random(5)
    words = lambda n, k=6: " ".join(draw.choices("Alpha beta GAMMA delta éta zéta".split()[:k], k=n))
    items = [(i, words(n)) for i, n in enumerate([10, 11, 14, 30, 9, 6, 9, 12, 0, 25])] + [(70, ""), (71, None), (72, "solo!")]
    texts = [(i, words(draw.randint(0, 60))) for i in range(60)]
    texts += [(100 + i, f"{words(draw.randint(0, 12))}, {items[draw.randint(0, 9)][1].upper()}; {words(7)} Solo") for i in range(40)]
    check(spark, texts, items)


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    items = spark.createDataFrame([(1, "the same words here twice and once more for good measure"), (1, "x"), (None, "without id")], cases.ITEMS)
    rows = decontamination.decontaminate(docs, items).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if r.contaminated} == {4, 5, 8, None}
    assert [r.n_items for r in rows if r.doc_id is None] == [0]
    assert decontamination.without_contaminated(docs, items).count() == docs.count() - 5
    assert not any(r.contaminated for r in decontamination.decontaminate(docs, cases.empty(spark, cases.ITEMS)).collect())
    assert decontamination.decontaminate(cases.empty(spark), items).count() == 0
