"""Personal data by bootstrapped contextual extraction.

Four kinds of identifiers have a fixed form: email, ip, card and phone. They are the seeds. What stands before a seed, two words or
a label such as `phone:`, is a pattern. Spark scores the graph of patterns and identifier-like words, or numbers of several
groups: a pattern by the sure identifiers after it against contrary words, a word by the patterns that it follows. A word is contrary
if it also stands after frequent patterns without any seed, or in part if words of its shape do; unknown words count neither way. In each
round sure words support further patterns.
Words that end above the threshold are added as kind `id`, wherever they stand.

Results: null counts as an empty text and has no spans. Rows that share an id keep their own results; repeated rows count once as
evidence. Empty tables give empty results. Extra columns are ignored, except by `redact`, which keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import common

KINDS = ("email", "ip", "card", "phone", "id")
#: Rounds of scoring, least confidence, and least number of sure words of a pattern.
ROUNDS, SURE, SUPPORT = 3, 0.7, 5.0

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Possessive forms of the fixed patterns: the same matches, without retries inside long runs.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\S*[0-9]\S*")
#: A number in groups, joined by spaces, dots, dashes, slashes and brackets.
GROUPS = re.compile(r"(?<![^\s\"'<,;:=#])[(\[]?[A-Za-z]{0,3}[0-9]++[)\]]?(?:[\x20./-]{0,3}[(\[]?(?<![0-9])[0-9]++[)\]]?){1,7}(?![^\s.,;:!?\"')\]}>])")
BEFORE = re.compile(r"(?:(\S+)\s+)?(\S+)\s*\Z")
LABEL = re.compile(r"\W*(\w+\s?[:=#])\W*")

SPAN = "start int, kind int, end int"
WORDS = "start int, end int, instance string, pattern string, seed int"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of each identifier of fixed form, sorted."""
    found, after, last = [], 0, -1
    at = text.find("@")
    while at >= 0:
        part = text[max(after, last + 1) : at]
        size = len(part) - len(part.rstrip(LOCAL))
        if size and (m := DOMAIN.match(text, at + 1)):
            found.append((at - size, 0, after := m.end()))
        last, at = at, text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def pattern_before(text: str, start: int) -> str | None:
    """The label that ends in front of a place, or else the two words there."""
    m = BEFORE.search(text, max(0, start - 60), start)
    if not m:
        return None
    last = m[2].lower()
    if label := LABEL.fullmatch(last):
        return label[1]
    return f"{m[1].lower()} {last}" if m[1] else None


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str | None, int]]:
    """Seeds and other words of four digits or more, with the patterns before them."""
    found = [(s, e, text[s:e], pattern_before(text, s), 1) for s, _, e in base]
    ends, i = sorted((e, s) for s, _, e in base), 0
    words = []
    for m in WORD.finditer(text):
        word = m[0].strip(".,;:!?\"'()[]{}<>")
        words.append((m.start() + m[0].find(word), word))
    single = set(words)
    words += [x for m in GROUPS.finditer(text) if re.search(r"\s", m[0]) or m[0][0] in "([" if (x := (m.start(), m[0])) not in single]
    for at, word in sorted(words):
        while i < len(ends) and ends[i][0] <= at:
            i += 1
        if sum("0" <= c <= "9" for c in word) < 4 or i < len(ends) and min(s for _, s in ends[i : i + 8]) < at + len(word):
            continue
        # a label inside the word belongs to the pattern
        label = re.match(r"(\w+[:=#])[\"']?(.{4,})", word)
        if label:
            found.append((at + label.start(2), at + len(word), label[2], label[1].lower(), 0))
        else:
            found.append((at, at + len(word), word, pattern_before(text, at), 0))
    return found


def base_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Of every row: doc_id, base spans, their digest, and the candidates."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        word = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("pattern", pa.string()), ("seed", pa.int32())])
        for batch in common.blocks(batches, "text"):
            texts = [t or "" for t in batch["text"].to_pylist()]
            base = [base_spans(t) for t in texts]
            words = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
            digest = [hashlib.sha256(base_text(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["mark"], pa.array(digest),
                    pa.array([[dict(zip(("start", "kind", "end"), x, strict=True)) for x in b] for b in base], pa.list_(span)),
                    pa.array([[dict(zip(("start", "end", "instance", "pattern", "seed"), x, strict=True)) for x in w] for w in words], pa.list_(word)),
                ],
                ["doc_id", "mark", "base_sha256", "base", "words"],
            )

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")
    return rows.mapInArrow(read, f"doc_id {dict(docs.dtypes)['doc_id']}, mark bigint, base_sha256 string, base array<struct<{SPAN}>>, words array<struct<{WORDS}>>")


def discover(scanned: DataFrame, rounds: int = ROUNDS, sure: float = SURE, support: float = SUPPORT) -> DataFrame:
    """Identifiers without fixed form (`instance`), from the scored graph of patterns and words."""
    words = scanned.select(F.explode("words").alias("w")).select("w.*").where("pattern is not null")
    edges = words.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    shape = F.regexp_replace(F.regexp_replace("instance", "[A-Za-z]+", "a"), "[0-9]+", "9")
    often = edges.groupBy("pattern").agg(F.count("*").alias("total"), F.sum("seed").alias("seeds")).where(F.col("total") >= support)
    edges = common.checkpointed(edges.join(often, "pattern").withColumn("idle", (F.col("seeds") == 0).cast("double")).withColumn("shape", F.xxhash64(shape)))
    shapes = common.small(edges.groupBy("shape").agg(F.count("*").alias("n"), F.avg("idle").alias("like")).where((F.col("n") >= support) & (F.col("like") > 0)).drop("n"))
    alone = edges.groupBy("instance").agg(F.max("idle").alias("also"))
    contrary = F.greatest("also", F.coalesce("like", F.lit(0.0)))
    edges = common.checkpointed(edges.join(alone, "instance").join(shapes, "shape", "left").select("pattern", "instance", "seed", contrary.alias("contrary")))
    confidence = edges.select("instance", F.col("seed").cast("double").alias("score")).groupBy("instance").agg(F.max("score").alias("score"))
    for _ in range(rounds):
        scored = edges.join(confidence, "instance").groupBy("pattern").agg(F.sum("score").alias("for"), F.sum(F.col("contrary") * (1 - F.col("score"))).alias("against"))
        strong = scored.where(F.col("for") >= support).select("pattern", (F.col("for") / (F.col("for") + F.col("against") + 1)).alias("weight")).where(F.col("weight") >= sure)
        doubt = F.sum(F.log1p(-F.coalesce("weight", F.lit(0.0))))
        confidence = edges.join(strong, "pattern", "left").groupBy("instance").agg(F.when(F.max("seed") == 1, 1.0).otherwise(1 - F.exp(doubt)).alias("score"))
    seeds = edges.where("seed = 1").select("instance").distinct()
    return confidence.where(F.col("score") >= sure).select("instance").join(seeds, "instance", "left_anti")


def added_spans(scanned: DataFrame) -> DataFrame:
    """Per row with discoveries: its mark and the spans added to it."""
    words = scanned.select("mark", F.explode("words").alias("w")).where("w.seed = 0").select("mark", "w.*")
    found = words.join(discover(scanned), "instance", "left_semi").distinct()
    return found.groupBy("mark").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end"))).alias("added"))


def span_text(spans) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets, and `n_chars` brought up to date."""
    added = common.small(added_spans(common.checkpointed(scan(docs))))
    names = docs.columns
    keyed = docs.withColumn("pii_mark", F.xxhash64("doc_id", "text"))
    marked = keyed.join(added.select(F.col("mark").alias("pii_mark"), F.col("added").alias("pii_added")), "pii_mark", "left").drop("pii_mark")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "text"):
            out = []
            for text, more in zip(batch["text"].to_pylist(), batch["pii_added"].to_pylist(), strict=True):
                if text is not None:
                    parts, at = [], 0
                    for s, k, e in sorted([*base_spans(text), *((x["start"], x["kind"], x["end"]) for x in more or [])]):
                        if s >= at:
                            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns = [pa.array(out, pa.string()) if name == "text" else batch[name] for name in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    masked = marked.select(*names, "pii_added").mapInArrow(mask, schema)
    return masked.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in names else masked


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = common.checkpointed(scan(common.table(spark, sf_dir, "documents")))
    rows = scanned.join(added_spans(scanned), "mark", "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array())))
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], "base_sha256", span_text(every).alias("spans")
    )
