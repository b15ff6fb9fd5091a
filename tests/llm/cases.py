"""Small documents, awkward ones among them, and plain counterparts of the operators."""

from __future__ import annotations

import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
ITEMS = "item_id bigint, text string"
LABELS = "doc_id bigint, quality int, toxic int"
LOWER = {i: i + 32 for i in range(65, 91)}


def documents(spark, texts, **columns):
    """Documents 0, 1, ... of the given texts."""
    rows = [(i, t, columns.get("lang", "en"), columns.get("source", f"s{i % 2}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (None, "a text without id", "de", None, 3), (3, long, "en", "a", 1),
        (4, "the same words here twice and once more for good measure of it all", "en", "a", 1),
        (4, "the same words here twice and once more for good measure of it all", "en", "a", 1),
        (5, "the same words here twice and once more for good measure of it all", "fr", "b", 1),
        (6, " \n\t ", "en", "b", 4), (7, "🙂 Ünï çödé ﬁ \x00   end", "de", "b", 2), (8, "x", None, None, None),
    ]
    names = ("key", "score", "kept", "doc", "row", "mark", "copy", "name", "signature", "predicted", "held_out", "found", "words", "hash", "n", "path", "unit")
    df = spark.createDataFrame(rows, DOCS)
    for name in names:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def roots(nodes, links):
    """Smallest reachable node of each."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
