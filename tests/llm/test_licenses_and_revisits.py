import datetime as dt

import pytest
from pyspark.sql import functions as F

from zonestat.llm.license_scan import license_scan
from zonestat.llm.warc_revisits import canonical_url, resolve_revisits

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "plain words"), (3, "a/b/c/LICENSE.md", "Licensed under the Apache License, Version 2.0.\nmore"), (4, "a/b/c/d/y", "code"),
    (5, "z/y.txt", "nothing"), (6, "a/b/h.txt", "words\nThis work is licensed under the GNU General Public License, version 3.\nwords"), (7, None, None), (8, "", ""), (9, "a/LICENSE", "All rights reserved."),
    (10, "top.txt", "x"), (11, "a/b/c/notice/q", "a license to be silly and long " * 50),
]


def test_licences(spark):
    files = spark.createDataFrame(FILES, "doc_id long, path string, text string").select("*", F.lit(1).alias("own"), F.lit(2).alias("dir"), F.lit("x").alias("term"))
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in license_scan(files).collect()}
    assert got[1] == ("MIT", "file", None) and got[9] == ("Proprietary", "file", None)
    assert got[2] == ("MIT", "inherited", "a")
    assert got[4] == ("Apache-2.0", "inherited", "a/b/c") and got[6] == ("GPL-3.0", "header", None)
    assert [got[k] for k in (5, 7, 8, 10)] == [(None, "none", None)] * 4
    assert got[11] == ("Apache-2.0", "inherited", "a/b/c")
    assert license_scan(files.limit(0)).count() == 0
    assert license_scan(files.union(files)).count() == 2 * len(FILES)


def test_ids_that_are_null_or_repeat(spark):
    rows = [(None, "a/x", "Released under the MIT License."), (7, "a/y", "plain"), (7, "a/z", "Released under the MIT License."), (None, "b/LICENSE", "Licensed under CC BY 4.0."), (8, "b/q", None)]
    got = sorted((r["path"], r["license"], r["origin"]) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == [("a/x", "MIT", "header"), ("a/y", None, "none"), ("a/z", "MIT", "header"), ("b/LICENSE", "CC-BY-4.0", "file"), ("b/q", "CC-BY-4.0", "inherited")]


def test_licence_files_without_terms_and_terms_without_end(spark):
    """A licence file may hold no term at all (a norm of zero), and a term thousands of parts."""
    long = "a" + "-b" * 30_000
    rows = [
        (1, "a/LICENSE", ""), (2, "a/x", "plain"), (3, "b/COPYING", "---\n* * *"), (4, "b/c/LICENSE", "\u0414\u043e\u043c"), (5, "NOTICE", None), (6, "d/LICENSE", f"Released under the MIT License.\n{long}"), (7, "d/x", long),
        (8, "d/y", "All rights reserved."),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {k: (None, "none") for k in range(1, 6)} | {6: ("MIT", "file"), 7: ("MIT", "inherited"), 8: ("Proprietary", "header")}


def test_wrapped_headers_and_whole_files(spark):
    import os
    import textwrap

    from zonestat.llm.license_scan import TEMPLATES

    code = "\n".join(f"def function_{k}(argument_{k}): return value_{k}" for k in range(40))
    rows, want = [], {}
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "MPL-2.0"):
        wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(TEMPLATES[name][2], 60))
        want[f"src/{name}.c"] = (name, "header")
        rows.append((len(rows), f"src/{name}.c", f"#include <x>\n{wrapped}\n\n{code}"))
    for name, file in {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items():
        path = f"/usr/share/common-licenses/{file}"
        if os.path.exists(path):
            want[f"{name}/LICENSE"] = (name, "file")
            rows.append((len(rows), f"{name}/LICENSE", open(path, encoding="utf-8").read()))
    mit = "Copyright (c) 2031 A. Person\n\n" + "\n".join(textwrap.wrap(TEMPLATES["MIT"][2], 75)) + '\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'
    rows.append((len(rows), "m/COPYING", mit))
    want["m/COPYING"] = ("MIT", "file")
    prose = [(1000 + k, f"p/{k}.txt", f"the story of number {k} and of the house that you may see in the street\n" * 5) for k in range(60)]
    rows.append((999, "long/x.py", code * 400))
    got = {r["path"]: (r["license"], r["origin"]) for r in license_scan(spark.createDataFrame(rows + prose, "doc_id long, path string, text string")).collect()}
    assert {p: got[p] for p in want} == want
    assert {got[p] for p in got if p not in want} == {(None, "none")}


def test_relatives_are_told_apart(spark, sf):
    """Notices of licences that share most of their words, wrapped and beside ordinary documents, get their own names."""
    import textwrap

    gnu = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.".format
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    third = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    notices = {
        "GPL-2.0": gnu("program", ";", "", ";", "2"), "GPL-3.0": gnu("program", ":", "", ",", "3"), "LGPL-2.1": gnu("library", ";", "Lesser ", ";", "2.1"), "AGPL-3.0": gnu("program", ":", "Affero ", ",", "3"), "BSD-2-Clause": bsd,
        "BSD-3-Clause": bsd + third, "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
    }
    rows = [(-k - 1, f"n/{name}.c", "int x;\n" + "\n".join(f" * {line}" for line in textwrap.wrap(text, 70)) + "\nint y;") for k, (name, text) in enumerate(notices.items())]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "concat('d/', doc_id) AS path", "text")
    got = {r["path"]: r["license"] for r in license_scan(docs.unionByName(spark.createDataFrame(rows, docs.schema))).where("path LIKE 'n/%'").collect()}
    assert got == {f"n/{name}.c": name for name in notices}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Example.com:80/a/b/?utm_source=x&b=2&a=1#frag", "example.com/a/b?a=1&b=2"), ("https://example.com", "example.com"), ("https://example.com/?ref=x", "example.com"),
        ("example.com/Path", "example.com/Path"), ("", ""),
    ],
)
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0] == want


def at(minute):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)


def records(spark, rows):
    return spark.createDataFrame(rows, "id long, url string, at timestamp, kind string, etag string, last_modified string, headers map<string,string>")


def test_revisits(spark):
    full = {"content-type": "text/html", "date": "old", "Cache-Control": "one"}
    rows = [
        (1, "http://e.org/a", at(0), "response", '"x"', None, full), (2, "https://www.e.org/a/", at(5), "revisit", 'W/"x"', None, {"Date": "new", "set-cookie": "no", "cache-control": "two"}),
        (3, "http://e.org/a#f", at(9), "response", '"y"', "m", {}), (4, "http://e.org/a", at(9), "revisit", '"x"', "m", {}), (5, "http://e.org/a", at(-9), "revisit", '"x"', None, {"k": "v"}),
        (6, None, at(3), "revisit", '"x"', None, None), (7, "http://e.org/a", None, "revisit", '"x"', None, None), (8, "http://e.org/a", at(99999), "revisit", None, "m", None), (9, "http://e.org/a", at(20), "revisit", None, None, None),
    ]
    df = records(spark, rows).select("*", F.lit(1).alias("slice"), F.lit(2).alias("found"))
    got = {r["id"]: r for r in resolve_revisits(df).collect()}
    assert {k: (r["outcome"], r["response_id"]) for k, r in got.items()} == {
        1: ("response", 1), 2: ("resolved", 1), 3: ("response", 3), 4: ("mismatch", 3), 5: ("orphan", None), 6: ("orphan", None), 7: ("orphan", None), 8: ("resolved", 3), 9: ("unverified", 3)
    }
    assert got[2]["headers"] == {"content-type": "text/html", "Date": "new", "cache-control": "two"}
    assert resolve_revisits(df.limit(0)).count() == 0


def test_revisits_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(k, f"http://h{rng.choice([0, 0, 0, rng.randrange(40)])}.org/", at(rng.randrange(500)), rng.choice(["response", "revisit", "revisit"]), rng.choice(['"a"', '"b"', None]), None, None) for k in range(600)]
    got = {r["id"]: (r["outcome"], r["response_id"]) for r in resolve_revisits(records(spark, rows), slices=7).collect()}
    for r in rows:
        if r[3] == "response":
            assert got[r[0]] == ("response", r[0])
            continue
        earlier = [q for q in rows if q[3] == "response" and q[1] == r[1] and q[2] <= r[2]]
        if not earlier:
            assert got[r[0]] == ("orphan", None)
            continue
        q = max(earlier, key=lambda q: (q[2], q[0]))
        want = "unverified" if r[4] is None or q[4] is None else "resolved" if r[4] == q[4] else "mismatch"
        assert got[r[0]] == (want, q[0])


def test_revisits_with_null_and_repeated_ids(spark):
    """Each row is resolved by itself: ids that are null or repeat mix nothing up. Rows are told by a header."""
    import random

    rng = random.Random(5)
    rows = []
    for k in range(400):
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((rng.choice([None, 1, 2, k]), rng.choice([None, "http://a.org/", "http://b.org/", f"http://c{k}.org/"]), at(k * 7 % 400), kind, rng.choice(['"a"', '"b"']), None, {"row": str(k), "date": f"d{k}"}))
    got = {r["headers"].get("etag", "") + r["headers"]["date"]: r for r in resolve_revisits(records(spark, rows), slices=5).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        g = got[f"d{k}"]
        earlier = [q for q in rows if q[3] == "response" and q[1] == r[1] and q[2] <= r[2]]
        if r[3] == "response":
            assert (g["outcome"], g["response_id"], g["headers"]["row"]) == ("response", r[0], str(k))
        elif not earlier:
            assert (g["outcome"], g["response_id"]) == ("orphan", None)
        else:
            q = max(earlier, key=lambda q: q[2])
            assert g["response_id"] == q[0] and g["outcome"] == ("resolved" if q[4] == r[4] else "mismatch")
            assert g["headers"]["row"] == (q[6]["row"] if q[4] == r[4] else str(k))
