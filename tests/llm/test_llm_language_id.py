import random

import numpy as np
from pyspark.sql import functions as F

from zoneflow.llm import common, language_id

from . import cases


def test_automaton_accepts_exactly_the_substrings():
    text = "abracadabraabcabd"
    moves = language_id.suffix_automaton(np.array([ord(c) for c in text]))
    parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    draw = random.Random(1)
    tried = parts | {"".join(draw.choices("abcdr", k=draw.randint(1, 5))) for _ in range(500)}
    for part in tried:
        state = 0
        for c in part:
            state = moves[state].get(ord(c)) if state is not None else None
        assert (state is not None) == (part in parts)


def greedy(text, known):
    """Phrases of a text, each the longest match in the known text."""
    count = 0
    for begin in range(0, len(text), language_id.PIECE):
        piece, at = text[begin : begin + language_id.PIECE], 0
        while at < len(piece):
            size = 1
            while at + size < len(piece) and piece[at : at + size + 1] in known:
                size += 1
            count, at = count + 1, at + size
    return count


def test_phrases_equal_greedy_parse():
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcde", k=draw.randint(1, 4)))
    samples = {name: [" ".join(word() for _ in range(40)) for _ in range(3)] for name in ("x", "y")}
    model = language_id.Model(samples)
    texts = [" ".join(word() for _ in range(n)) for n in (1, 3, 50, 900)] + ["zzz q", "a"]
    classes = model.classes()
    symbols = classes[np.array([ord(c) for t in texts for c in t])]
    found = model.phrases(symbols, np.cumsum([0, *map(len, texts)]))
    for i, name in enumerate(model.languages):
        known = "".join(t + " " for t in samples[name])
        known = "".join(c if c in model.symbols or c == " " else "\x00" for c in known)
        for j, t in enumerate(texts):
            plain = "".join(c if c in model.symbols or c == " " else "\x01" for c in t)
            assert found[i, j] == greedy(plain, known), (name, t)


def test_held_out_accuracy(spark, sf_dir):
    truth = common.table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("size"))
    rows = language_id.op1_language_id(spark, sf_dir).join(truth, "doc_id").where("held_out and size > 30").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    rows = language_id.predict(docs, language_id.fit(docs)).collect()
    assert len(rows) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 6))
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (4, 5)}) == 1
    assert language_id.predict(cases.empty(spark), language_id.fit(docs)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(cases.empty(spark))).collect()} == {"und"}
