import hashlib
import random

import numpy as np

from zoneflow.llm import suffix_dedup

from . import cases


def brute(texts):
    seen, found, own = set(), {}, {}
    for i in sorted(set(k for k, _ in texts)):
        new = set()
        for _, text in [t for t in texts if t[0] == i]:
            data = (text or "").encode()
            gone = bytearray(len(data))
            for p in range(len(data) - 49):
                if data[p : p + 50] in seen:
                    gone[p : p + 50] = b"\1" * 50
                new.add(data[p : p + 50])
            kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
            runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
            own.setdefault(i, []).append((len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
        seen |= new
    for i, rows in own.items():
        found[i] = sorted(rows)
    return found


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], cases.DOCS)
    found = {}
    for r in suffix_dedup.deduplicate(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert {i: sorted(rows) for i, rows in found.items()} == brute(texts)


def repeats(seed, n, letters):
    draw = random.Random(seed)
    piece = lambda size: "".join(draw.choices(letters, k=size))
    passages = [piece(s) for s in (49, 50, 51, 70, 130, 400)]
    return [(i, "".join(draw.choice([piece(draw.randint(0, 90)), draw.choice(passages), draw.choice(passages)[3:-5]]) for _ in range(draw.randint(0, 7)))) for i in range(n)]


def test_equals_brute_force(spark):
    check(spark, repeats(1, 80, "abcdefgh é") + [(200, None), (201, ""), (202, "x" * 49)])


def test_low_entropy(spark):
    check(spark, repeats(2, 40, "ab") + [(100, "a" * 300), (101, "a" * 80), (102, "ab" * 90), (103, "-" * 51), (104, "-" * 50)])


def test_repeated_ids_do_not_remove_each_other(spark):
    text = "".join(random.Random(4).choices("abcdef ", k=200))
    check(spark, [(1, text), (1, text), (2, text + "tail")])


def test_stretches_of_a_crowded_anchor_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_ROWS", 2)
    check(spark, repeats(3, 60, "abcdefgh "))


def test_suffix_array_and_common_prefixes():
    draw = random.Random(6)
    for letters in ("ab", "abcdefgh"):
        text = "".join(draw.choices(letters, k=300)) + "ab" * 40
        data = np.frombuffer(text.encode(), np.uint8)
        order, close = suffix_dedup.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        starts = np.array([0, 100, 150, 290])
        shared = suffix_dedup.common_prefixes(data, order, starts, np.diff(np.append(starts, len(text))), 20)
        for k in range(1, len(text)):
            a, b = text[order[k] :], text[order[k - 1] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, 20)
            assert close[order[k]] == (n >= suffix_dedup.CLOSE)


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    assert suffix_dedup.deduplicate(docs).count() == docs.count()
    assert suffix_dedup.deduplicate(cases.empty(spark)).count() == 0
