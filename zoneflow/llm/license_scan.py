"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory above, with DataFrame functions only.

Every line of a file, and every file as a whole, that has a word of licensing is a sparse vector of its words, weighted by how few
templates have them. A line near a template is a header and licenses its file. A file that is near one as a whole is a licence
file and licenses its directory: files below without a license of their own take that of the nearest directory above.

Usual licence texts (`license_texts`) are met beside these one-line templates: each run of some consecutive lines and each whole file
is the set of its words, and the cosine of the sets is weighted likewise. A run near a notice or body is a header; a
file near one as a whole, or whose first lines are near the opening of a long license, is a licence file. What is near more than
a title counts before single lines.

Results: null and empty texts have no license of their own but may inherit one. Ties go to the higher score, then the template that
is first by name, then the smaller path. Files that share id and path are read as one. A null path
inherits nothing. Empty tables give empty results. Extra columns are kept out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import common
from zoneflow.llm.license_texts import TEXTS

#: License names and the phrases that name them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX License Identifier Apache 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the 3-Clause BSD License"),
    ("BSD-3-Clause", "SPDX License Identifier BSD 3 Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX License Identifier MIT"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("Proprietary", "All rights reserved"),
)
CUE = "(?i)licen[sc]e|copyright|rights reserved|creative commons"
#: Least cosine of a header line and of a licence file.
NEAR, NEAR_FILE = 0.7, 0.5
WORDS = "[a-z0-9]+"
#: One of these stands in the first two lines of every run compared with the licence texts, and in every such file.
TEXT_CUE = CUE + "|redistribut|permission|free software|source code form|attribution|hereby granted"
#: Lines of a run, without those that have no word; least cosine of a file with a licence text; lines above the opening of a license.
RUNS, NEAR_TEXT, ABOVE = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 20, 24, 28), 0.8, 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def template_weights(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Weight of each word, and the normed vector entries of every template: some hundred rows."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, phrase string")
    terms = rows.select("template", "license", F.explode(words_of(F.col("phrase"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))
    idf = terms.groupBy("word").agg((F.log(F.lit(1.0 + len(TEMPLATES)) / (1 + F.count("*"))) + 1).alias("idf"))
    entries = terms.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norms = entries.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return idf, entries.join(norms, "template").select("template", "license", "word", (F.col("w") / F.col("norm")).alias("t"))


def nearest_template(units: DataFrame, spark: SparkSession) -> DataFrame:
    """License and cosine of each unit (`unit`, `body`) that shares a word with a template."""
    idf, entries = template_weights(spark)
    unseen = F.log(F.lit(1.0 + len(TEMPLATES))) + 1
    terms = units.select("unit", F.explode(words_of(F.col("body"))).alias("word")).groupBy("unit", "word").agg(F.count("*").alias("tf"))
    weighed = terms.join(F.broadcast(idf), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.where("idf is not null").join(F.broadcast(entries), "word").groupBy("unit", "template", "license").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = dots.join(norms, "unit").select("unit", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("unit", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def text_weights() -> tuple[dict[str, float], list[tuple[str, int, str, str, float]], float]:
    """Weight of each word of the licence texts, the normed entries of their word sets, and the weight of any other word."""
    sets = [set(re.findall(WORDS, text.lower())) for _, _, text in TEXTS]
    idf = {w: math.log((1 + len(sets)) / (1 + n)) + 1 for w, n in sorted(Counter(w for s in sets for w in s).items())}
    norms = [math.sqrt(sum(idf[w] ** 2 for w in sorted(s))) for s in sets]
    entries = [(w, i, TEXTS[i][0], TEXTS[i][1], idf[w] / norms[i]) for i, s in enumerate(sets) for w in sorted(s)]
    return idf, entries, math.log(1 + len(sets)) + 1


def near_texts(files: DataFrame) -> DataFrame:
    """Runs of lines and whole files (line -1) that are near a licence text: file_id, path, line, license, score, whole, strong."""
    spark = files.sparkSession
    idf, entries, unseen = text_weights()
    cued = files.select("file_id", "path", "text").where(F.col("text").rlike(TEXT_CUE))
    cued = cued.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z0-9]")))
    cued = cued.withColumn("cues", F.transform("lines", lambda x: x.rlike(TEXT_CUE))).withColumn("sets", F.transform("lines", lambda x: F.array_distinct(words_of(x))))
    at = lambda i: F.coalesce(F.get("cues", i), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: at(i) | at(i + 1))
    begun = cued.where(F.size("lines") > 0).select("file_id", "path", "sets", F.explode(starts).alias("line"))
    runs = begun.select("file_id", "path", "line", "sets", F.explode(F.array(*map(F.lit, RUNS))).alias("n")).where(F.col("line") + F.col("n") <= F.size("sets"))
    runs = runs.select("file_id", "path", "line", "n", F.array_distinct(F.flatten(F.slice("sets", F.col("line") + 1, F.col("n")))).alias("words"))
    units = runs.union(cued.select("file_id", "path", F.lit(-1), F.lit(0), F.array_distinct(words_of(F.col("text")))))
    known = F.array_intersect("words", F.array(*map(F.lit, idf)))
    units = units.withColumn("known", known).withColumn("others", F.size("words") - F.size("known"))
    # no word weighs more than an unknown one, so others than these cannot be near
    least = F.when(F.col("line") < 0, NEAR_TEXT**2).otherwise(NEAR**2)
    units = units.where(F.size("known") >= least * F.size("words") - 1e-6)
    terms = units.select(F.struct("file_id", "path", "line", "n").alias("unit"), "others", F.explode("known").alias("word")).distinct()
    weights = spark.createDataFrame([*((w, -1, None, None, x) for w, x in idf.items()), *entries], "word string, template int, license string, kind string, t double")
    weights = weights.join(spark.createDataFrame(list(idf.items()), "word string, idf double"), "word")
    sums = terms.join(F.broadcast(weights), "word").groupBy("unit", "template", "license", "kind").agg(F.sum(F.col("idf") * F.col("t")).alias("dot"), F.max("others").alias("others"))
    norms = sums.where("template = -1").select("unit", F.sqrt(F.col("dot") + F.col("others") * unseen**2).alias("norm"))
    scored = sums.where("template >= 0").join(norms, "unit").select("unit.*", "license", "kind", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    scored = scored.where(F.col("score") >= F.when(F.col("line") < 0, NEAR_TEXT).otherwise(NEAR))
    whole = (F.col("line") < 0) | (F.col("kind") == "opening") & (F.col("line") <= ABOVE)
    return scored.select("file_id", "path", "line", "license", "score", whole.cast("int").alias("whole"), (F.col("kind") != "title").cast("int").alias("strong"))


def scan(files: DataFrame) -> DataFrame:
    """license, score, origin (`header`, `file`, `inherited` or null) and from_path of every row (`file_id`, `path`, `text`)."""
    spark = files.sparkSession
    cued = files.select("file_id", "path", "text").where(F.col("text").rlike(CUE))
    lines = cued.select("file_id", "path", F.posexplode(F.split("text", "\n")).alias("line", "body")).where(F.col("body").rlike(CUE))
    units = lines.union(cued.select("file_id", "path", F.lit(-1), "text")).select(F.struct("file_id", "path", "line").alias("unit"), "body").distinct()
    near = nearest_template(units, spark).select("unit.*", "license", "score")
    near = near.where(F.col("score") >= F.when(F.col("line") < 0, NEAR_FILE).otherwise(NEAR))
    near = near.select("file_id", "path", "line", "license", "score", (F.col("line") < 0).cast("int").alias("whole"), F.lit(0).alias("strong")).union(near_texts(files))
    rank = F.struct((-F.col("strong")).alias("weak"), (-F.col("score")).alias("s"), "license", "line")
    own = common.checkpointed(near.groupBy("file_id", "path").agg(F.min(rank).alias("b"), F.max("whole").alias("whole")))
    own = own.select("file_id", "path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "whole")

    parent = lambda path: F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    granted = own.where("whole = 1").select(parent(F.col("path")).alias("dir"), "license", "score", "path")
    granted = granted.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "path")).alias("g"))
    folders = files.select(parent(F.col("path")).alias("folder")).where("folder is not null").distinct()
    steps = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth")).withColumn("dir", F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = above.join(granted, "dir").groupBy("folder").agg(F.max_by("g", "depth").alias("g"))
    taken = nearest.select("folder", F.col("g.license").alias("their_license"), (-F.col("g.s")).alias("their_score"), F.col("g.path").alias("their_path"))

    rows = files.select("file_id", "path", parent(F.col("path")).alias("folder")).join(own.withColumnRenamed("path", "own_path"), "file_id", "left")
    rows = rows.join(taken, "folder", "left")
    mine = F.col("license").isNotNull()
    origin = F.when(mine & (F.col("whole") == 1), "file").when(mine, "header").when(F.col("their_license").isNotNull(), "inherited")
    return rows.select(
        "file_id", "path", F.coalesce("license", "their_license").alias("license"), F.coalesce("score", "their_score").alias("score"), origin.alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("their_path")).alias("from_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language, thousand and hundred of the id."""
    step = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), step(1000), step(100), F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_files(common.table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


_VALUES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
_ALL = f"regexp_extract_all(lower(%s), '{WORDS}')"
ORACLE_SQL = f"""
WITH templates(template, license, phrase) AS (VALUES {_VALUES}),
tterms AS (SELECT template, license, word, count(*) AS tf FROM (SELECT template, license, unnest({_ALL % 'phrase'}) AS word FROM templates) GROUP BY ALL),
idf AS (SELECT word, ln({1.0 + len(TEMPLATES)} / (1 + count(*))) + 1 AS idf FROM tterms GROUP BY word),
tw AS (SELECT template, license, word, tf * idf AS w FROM tterms JOIN idf USING (word)),
entries AS (SELECT template, license, word, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS t FROM tw),
files AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path,
    concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR)) AS folder
  FROM documents
),
cued AS (SELECT doc_id, path, folder, text FROM files WHERE regexp_matches(text, '{CUE}')),
lines AS (SELECT doc_id, path, folder, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS body FROM cued),
units AS (
  SELECT doc_id, path, folder, line, body FROM lines WHERE regexp_matches(body, '{CUE}')
  UNION ALL SELECT doc_id, path, folder, -1, text FROM cued
),
terms AS (SELECT doc_id, line, word, count(*) AS tf FROM (SELECT doc_id, line, unnest({_ALL % 'body'}) AS word FROM units) GROUP BY ALL),
weighed AS (SELECT doc_id, line, word, idf, tf * coalesce(idf, ln({1.0 + len(TEMPLATES)}) + 1) AS w FROM terms LEFT JOIN idf USING (word)),
norms AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
scored AS (
  SELECT doc_id, line, license, round(sum(w * t) / any_value(norm), 6) AS score
  FROM weighed JOIN entries USING (word) JOIN norms USING (doc_id, line) GROUP BY doc_id, line, template, license
),
best AS (SELECT doc_id, line, license, score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, license) = 1),
near AS (SELECT * FROM best WHERE score >= CASE WHEN line < 0 THEN {NEAR_FILE} ELSE {NEAR} END),
own AS (
  SELECT doc_id, license, score, max(line < 0) OVER (PARTITION BY doc_id) AS whole
  FROM near QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, line) = 1
),
granted AS (
  SELECT folder AS dir, license, score, path FROM own JOIN files USING (doc_id) WHERE whole
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, license, path) = 1
),
folders AS (SELECT DISTINCT folder FROM files),
above AS (SELECT folder, d AS depth, array_to_string(string_split(folder, '/')[1 : d], '/') AS dir FROM folders, unnest(range(1, 5)) AS r(d)),
nearest AS (SELECT folder, license, score, path FROM above JOIN granted USING (dir) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY depth DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, n.license) AS license, coalesce(o.score, n.score) AS score,
  CASE WHEN o.whole THEN 'file' WHEN o.license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN o.license IS NOT NULL THEN f.path ELSE n.path END AS from_path
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN nearest n ON f.folder = n.folder
"""
