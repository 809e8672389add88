from glyphmill.llm import licenses


def test_forms_of_a_licence(spark):
    mit = licenses.KNOWN["MIT"]
    variants = [
        mit,
        mit.upper(),
        mit.replace("\n\n", "\r\n  *  ").replace("sublicense", "sub-licence"),
        mit.replace("Copyright (c) <year> <copyright holders>", "© 2019-2021 Some Body\nCopyright 2022 Other <a@b.c>. All rights reserved."),
        mit.replace('"AS IS"', "“as is”").replace("NONINFRINGEMENT", "non-infringement"),
    ]
    others = [mit + " And more.", mit[:-40], "", None, " .,\n", "word " * 300_000, "Licenced under the APACHE licence version 2.0"]
    rows = [(i, t, "x") for i, t in enumerate(variants + others)] + [(0, mit, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = sorted((r.doc_id, r.license_id or "") for r in licenses.matched(docs).collect())
    want = [(i, "MIT") for i in range(5)] + [(0, "MIT")] + [(i, "") for i in range(5, 11)] + [(11, "notice:Apache-2.0")]
    assert got == sorted(want)
    assert licenses.matched(docs.limit(0)).count() == 0


def test_texts_are_told_apart(spark):
    docs = spark.createDataFrame([(k, v) for k, v in licenses.KNOWN.items()], "k string, text string")
    assert all(r.k == r.license_id for r in licenses.matched(docs).collect())


def test_no_python_in_the_plan(spark):
    plan = licenses.matched(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


def test_full_texts_and_titles(spark):
    from pathlib import Path

    home = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    rows = [(k, (home / v).read_text()) for k, v in files.items() if (home / v).exists()]
    mit, bsd = licenses.KNOWN["MIT"], licenses.KNOWN["BSD-2-Clause"]
    rows += [("MIT", mit.replace("MIT License", title, 1)) for title in ("", "The MIT License", "The MIT License (MIT)")]
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows += [("BSD-3-Clause", bsd.replace("BSD 2-Clause", "BSD 3-Clause").replace("THIS SOFTWARE IS", third + "\n\nTHIS SOFTWARE IS"))]
    assert all(r.k == r.license_id for r in licenses.matched(spark.createDataFrame(rows, "k string, text string")).collect())
