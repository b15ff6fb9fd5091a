import hashlib
import random
import re

from zoneflow.llm import common, pii

from . import cases

PLAIN = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
)]


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == 1:
        return all(int(x) <= 255 for x in found.split("."))
    if kind == 2:
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in p.finditer(text) if valid(k, m[0]))


def test_equals_the_plain_patterns():
    draw = random.Random(3)
    pieces = ["a@b.c", "@", ".", "-", "1", "25", "255", "256", "1.2.3.4", "+1 ", " ", "(555) 123-4567", "4111 1111 1111 1111", "x", "@x.y", "é", "..", "0", "٣", "\n"]
    for _ in range(4000):
        text = "".join(draw.choices(pieces, k=draw.randint(1, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_no_retries():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "1-" * 100_000):
        pii.base_spans(text)


def test_patterns_discover_identifiers(spark):
    texts = [f"some text, member contact: user{i}@mail{i}.org and more" for i in range(30)]
    texts += ["odd one, member contact: AB-1234-XY and more", "see AB-1234-XY elsewhere", "the year 19847 is not one"]
    texts += [f"the total was {1000 + i} units" for i in range(20)]
    docs = cases.documents(spark, texts)
    scanned = common.checkpointed(pii.scan(docs))
    assert {r.instance for r in pii.discover(scanned).collect()} == {"AB-1234-XY"}
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[0] == "some text, member contact: [EMAIL] and more"
    assert masked[30] == "odd one, member contact: [ID] and more" and masked[31] == "see [ID] elsewhere" and masked[32] == texts[32]


def test_unknown_numbers_do_not_count_against_their_pattern(spark):
    texts = [f"reach us by phone: +1 (555) 200-{1000 + i} today" for i in range(70)]
    texts += [f"reach us by phone: ({200 + i}) 123-{4000 + i} today" for i in range(100)]
    texts += [f"of the +44 20 7946 {1000 + i} lines" for i in range(6)] + [f"of the {20000 + i} units" for i in range(60)] + [f"the total was {30000 + i} units" for i in range(60)]
    docs = cases.documents(spark, texts)
    assert {r.instance for r in pii.discover(common.checkpointed(pii.scan(docs))).collect()} == {f"({200 + i}) 123-{4000 + i}" for i in range(100)}
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[75] == "reach us by phone: [ID] today" and masked[180] == texts[180]


def test_groups_take_no_retries():
    for text in ("1 " * 100_000, "1-" * 100_000 + "x", "(1" * 100_000, "1.1" * 100_000, "ab1" * 100_000):
        pii.candidates(text, [])


def test_query_columns(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in common.table(spark, sf_dir, "documents").collect()}
    for r in pii.op7_pii(spark, sf_dir).collect():
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) or not listed


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    found = pii.redact(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    assert [r.text for r in found.where("doc_id in (1, 2)").orderBy("doc_id").collect()] == [None, ""]
    assert pii.redact(cases.empty(spark)).count() == 0
