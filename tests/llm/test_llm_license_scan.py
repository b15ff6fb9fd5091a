import textwrap

from zoneflow.llm import license_scan

from . import cases

FILES = "file_id bigint, path string, text string"


def scanned(spark, rows):
    return {r.path: (r.license, r.origin, r.from_path) for r in license_scan.scan(spark.createDataFrame(rows, FILES)).collect()}


def test_nearest_directory_wins(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    body = "\n".join(f"line {i} of code" for i in range(40))
    found = scanned(spark, [
        (1, "a/LICENSE", mit), (2, "a/b/LICENSE", gpl), (3, "a/x.py", body), (4, "a/b/c/y.py", body), (5, "a/b/z.py", mit + "\n" + body), (6, "q/w.py", body), (7, "a/bc/v.py", None),
    ])
    assert found["a/LICENSE"] == ("MIT", "file", "a/LICENSE")
    assert found["a/x.py"] == ("MIT", "inherited", "a/LICENSE")
    assert found["a/b/c/y.py"] == ("GPL-3.0", "inherited", "a/b/LICENSE")
    assert found["a/b/z.py"] == ("MIT", "header", "a/b/z.py")
    assert found["q/w.py"] == (None, None, None)
    assert found["a/bc/v.py"] == ("MIT", "inherited", "a/LICENSE")


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    assert license_scan.scan(license_scan.document_files(docs)).count() == docs.count()
    assert license_scan.scan(license_scan.document_files(cases.empty(spark))).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = license_scan.op3_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_usual_licence_texts(spark):
    texts = {(license, kind): text for license, kind, text in license_scan.TEXTS}
    wrap = lambda text, mark="": "\n".join(mark + line for line in textwrap.wrap(text, 72))
    code = "\n".join(f"def f{i}(x{i}): return x{i} + y{i}  # part {i}" for i in range(60))
    mit = "MIT License\n\nCopyright (c) 2019 Some Body\n\n" + wrap(texts["MIT", "body"].split("(c) ")[1])
    bsd = "Copyright (c) 2011, Some Body\nAll rights reserved.\n\n" + wrap(texts["BSD-3-Clause", "body"])
    gpl = "Copyright (C) 2020 Some Body\n\n" + wrap(license_scan.TEXTS[[t[:2] for t in license_scan.TEXTS].index(("GPL-3.0", "notice"))][2])
    long = wrap(texts["Apache-2.0", "opening"]) + "\n\n1. Definitions.\n" + code
    body = "\n".join(f"line {i} of code" for i in range(40))
    found = scanned(spark, [
        (1, "m/LICENSE", mit), (2, "m/x.py", code), (3, "b/LICENSE", bsd), (4, "b/x.py", code), (5, "a/LICENSE", long), (6, "a/x.py", code),
        (7, "g/x.c", wrap(gpl, " * ") + "\n" + body + code), (8, "g/y.c", code), (9, "t/x.py", "# MIT License\n" + code), (10, "r/x.py", wrap(texts["BSD-3-Clause", "notice"], "# ") + "\n" + code),
    ])
    assert found["m/LICENSE"][:2] == ("MIT", "file") and found["m/x.py"][:2] == ("MIT", "inherited")
    assert found["b/LICENSE"][:2] == ("BSD-3-Clause", "file") and found["b/x.py"][:2] == ("BSD-3-Clause", "inherited")
    assert found["a/LICENSE"][:2] == ("Apache-2.0", "file") and found["a/x.py"][:2] == ("Apache-2.0", "inherited")
    assert found["g/x.c"][:2] == ("GPL-3.0", "header") and found["g/y.c"][0] is None
    assert found["t/x.py"][:2] == ("MIT", "header") and found["r/x.py"][:2] == ("BSD-3-Clause", "header")
