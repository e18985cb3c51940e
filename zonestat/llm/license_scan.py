"""License scans in DataFrame functions alone.

Headers are windows of 1, 2, 4, 8 and 16 lines (lines without a term don't count), so that a notice may be
wrapped; licence files (LICENSE, COPYING, NOTICE, with any extension) are compared as a whole besides.
Both are compared to licence templates by the cosine of sparse TF-IDF vectors; document frequencies are
counted over all documents for all terms. A file's own licence is its best window's best template, if
that reaches THRESHOLD; one whose text another licence holds and extends counts only where that one's own clause isn't there. A window begins at a line with one of the templates' anchors: a template's commonest
terms, its anchors left out, have less than THRESHOLD of its norm, so no line that could reach it is left
out, and a wider window begins where its first anchor is. Windows whose cosine can't reach THRESHOLD are
dropped in their own row before any shuffle: the dot products are exact there, and the norm is at least that
of the templates' terms and of one for each other term, as no inverse document frequency is under one.

A licence file gives its licence to its directory; files without their own inherit from the nearest
ancestor directory that has one, found by joining the paths of all ancestors of all directories (few
beside the files).

Licences are found by text, so rows that have no id or share one get each their own. A null text has no
licence of its own; a null path lies in the root. Of licence files in one directory the best score
counts, then the least id (null first), then the licence's name. Equal scores take the first template.
A licence file without a term (empty, or of signs alone) has none either.
Repeated rows are repeated in the result. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: Titles, notices and headers of public licences, in the order in which equal scores are decided.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": (
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}
#: Licences whose text holds another's: that one, and the text of their own clause (by place), which decides.
EXTENDS = {"BSD-3-Clause": ("BSD-2-Clause", 3)}
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: The same for Java, which would go one call deeper with each repeat that it may have to take back, until its stack is full.
TERM_AT_ONCE = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[^/]*)?$"
THRESHOLD = 0.5
#: Lines of a window.
WINDOWS = (1, 2, 4, 8, 16)
#: Squared norm that a template's terms may have together without being anchors: just under THRESHOLD squared.
WEAK = 0.249


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM_AT_ONCE), F.lit(0))


def inverse(df: int, n: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1


def template_model(df: DataFrame, n: int, templates: dict[str, tuple[str, ...]]) -> tuple[DataFrame, list[str], dict[str, tuple[float, list[float]]]]:
    """Weights of the templates' terms (template, rank, variant, term, weight), the anchors, and by term its inverse
    document frequency and its weight in each text; all as many as the templates' terms."""
    vocabulary = sorted({t for texts in templates.values() for text in texts for t in re.findall(TERM, text.lower())})
    known = {r["term"]: r["df"] for r in df.where(F.col("term").isin(vocabulary)).collect()}
    rows, anchors = [], set()
    for rank, (name, texts) in enumerate(templates.items()):
        for variant, text in enumerate(texts):
            x = {t: c * inverse(known.get(t, 0), n) for t, c in Counter(re.findall(TERM, text.lower())).items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            weight = {t: round(v / norm, 9) for t, v in x.items()}
            rows += [{"template": name, "rank": rank, "variant": variant, "term": t, "weight": w} for t, w in weight.items()]
            sofar = 0.0
            for t in sorted(weight, key=lambda t: (-known.get(t, 0), t)):  # the commonest go without
                sofar += weight[t] ** 2
                if sofar >= WEAK:
                    anchors.add(t)
    kinds = "array<struct<template: string, rank: int, variant: int, term: string, weight: double>>"
    model = df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), F.lit(kinds))).alias("m")).select("m.*")
    texts = sorted({(r["rank"], r["variant"]) for r in rows})
    by_text = {(r["rank"], r["variant"], r["term"]): r["weight"] for r in rows}
    table = {t: (inverse(known.get(t, 0), n), [by_text.get((*text, t), 0.0) for text in texts]) for t in vocabulary}
    return model, sorted(anchors), table


def promising(parts: DataFrame, table: dict[str, tuple[float, list[float]]]) -> DataFrame:
    """Parts whose best cosine may reach THRESHOLD, with all their terms; a row is judged by itself."""
    vocabulary = list(table)
    idf = F.array(*[F.lit(table[t][0]) for t in vocabulary])
    weights = F.from_json(F.lit(json.dumps([table[t][1] for t in vocabulary])), F.lit("array<array<double>>"))
    place = F.array(*[F.lit(t) for t in vocabulary])
    keys = ["unit", "line", "width"]
    read = parts.select(*keys, terms(F.col("words")).alias("terms"))
    known = read.select(*keys, "terms", F.filter("terms", lambda t: t.isin(vocabulary)).alias("known"))
    xs = F.transform(
        F.array_distinct("known"),
        lambda t: F.struct(F.array_position(place, t).cast("int").alias("at"), F.size(F.filter("known", lambda k: k == t)).alias("tf")),
    )
    counted = known.select(*keys, "terms", (F.size("terms") - F.size("known")).alias("others"), F.transform(xs, lambda x: F.struct(x["at"].alias("at"), (x["tf"] * F.element_at(idf, x["at"])).alias("x"))).alias("xs"))
    none = F.array_repeat(F.lit(0.0), len(next(iter(table.values()))[1])) if table else F.array().cast("array<double>")
    dots = F.aggregate("xs", none, lambda acc, x: F.zip_with(acc, F.element_at(weights, x["at"]), lambda a, w: a + w * x["x"]))
    low = F.sqrt(F.aggregate("xs", F.col("others").cast("double"), lambda acc, x: acc + x["x"] * x["x"]))
    # a generator, so that the test isn't pushed below the terms, which would then be parsed twice
    judged = counted.select(*keys, "terms", F.explode(F.array(F.coalesce(F.try_divide(F.array_max(dots), low), F.lit(0.0)))).alias("bound"))
    return judged.where(F.col("bound") >= THRESHOLD - 1e-5).select(*keys, "terms")


def own_licences(files: DataFrame, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """Best licence of each unit that has one (unit, own, score); units are texts, of licence files apart from others."""
    n = files.count()
    df = cut(files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    model, anchors, table = template_model(df, n, templates)
    lines = F.filter(F.split(lower_ascii(F.col("text")), "\n"), lambda x: x.rlike("[a-z0-9]"))
    anchored = lambda text: F.arrays_overlap(terms(text), F.array(*[F.lit(a) for a in anchors]))
    starts = files.where(anchored(F.col("text"))).select("unit", "is_file", lines.alias("lines")).select("unit", "lines", F.posexplode("lines").alias("line", "words"))
    near = F.slice("lines", F.col("line") + 1, max(WINDOWS))
    starts = starts.where(anchored(F.col("words"))).select("unit", "line", near.alias("near"))
    wide = starts.select("unit", "line", "near", F.explode(F.array(*[F.lit(w) for w in WINDOWS])).alias("width")).where("size(near) > width div 2")  # else a narrower one has all lines
    windows = wide.select("unit", "line", "width", F.array_join(F.slice("near", F.lit(1), F.col("width")), " ").alias("words"))
    whole = files.where("is_file and text is not null").select("unit", F.lit(-1).alias("line"), F.lit(0).alias("width"), F.col("text").alias("words"))
    parts = promising(windows.unionByName(whole), table).dropDuplicates(["unit", "line", "width"])  # texts may repeat
    tf = parts.select("unit", "line", "width", F.explode("terms").alias("term")).groupBy("unit", "line", "width", "term").agg(F.count("*").alias("tf"))
    idf = F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    vectors = cut(tf.join(df, "term", "left").select("unit", "line", "width", "term", (F.col("tf") * idf).alias("x")))
    norm = vectors.groupBy("unit", "line", "width").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    shared = vectors.join(F.broadcast(model), "term")  # the templates' terms
    dot = shared.groupBy("unit", "line", "width", "template", "rank", "variant").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    cosine = dot.join(norm, ["unit", "line", "width"]).select("unit", "template", "rank", "variant", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= THRESHOLD)
    one = F.struct((-F.col("score")).alias("low"), "rank", "template")
    found = cosine.groupBy("unit").agg(F.min(one).alias("best"), *[F.min(F.when(F.col("template") != held, one)).alias(f"but_{k}") for k, (held, _) in enumerate(EXTENDS.values())],
                                       *[F.max((F.col("template") == name) & (F.col("variant") == clause)).alias(f"clause_{k}") for k, (name, (_, clause)) in enumerate(EXTENDS.items())])
    best = F.col("best")
    for k, (held, _) in enumerate(EXTENDS.values()):
        best = F.when((F.col("best.template") == held) & F.col(f"clause_{k}"), F.col(f"but_{k}")).otherwise(best)
    return found.select("unit", best.alias("best")).select("unit", F.col("best.template").alias("own"), (-F.col("best.low")).alias("score"))


def ancestors(directory: Column) -> Column:
    """A directory and all above it, the root ('') last."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per file: doc_id, path, license, origin (file, header, inherited or none), score, license_dir."""
    files = docs.select(F.col(id_col).alias("id"), F.coalesce(path_col, F.lit("")).alias("path"), F.col(text_col).alias("text"))
    is_file = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    files = files.withColumn("is_file", is_file).withColumn("unit", F.md5(F.concat(F.col("is_file").cast("string"), "text")))
    own = own_licences(files, templates or TEMPLATES)
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    placed = files.select("id", "path", directory.alias("dir"), "is_file", "unit").join(own, "unit", "left").drop("unit")
    given = placed.where("is_file and own is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("low"), "id", "own")).alias("best"))
    given = given.select(F.col("dir").alias("above"), F.col("best.own").alias("dir_license"))
    dirs = placed.where("own is null").select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "above"))
    near = dirs.join(given, "above").groupBy("dir").agg(F.min(F.struct("up", "above", "dir_license")).alias("near"))
    out = placed.join(near.select("dir", F.col("near.above").alias("license_dir"), "near.dir_license"), "dir", "left")
    has, inherits = F.col("own").isNotNull(), F.col("own").isNull() & F.col("dir_license").isNotNull()
    origin = F.when(has & F.col("is_file"), "file").when(has, "header").when(inherits, "inherited").otherwise("none")
    return out.select(
        F.col("id").alias("doc_id"), "path", F.coalesce("own", "dir_license").alias("license"), origin.alias("origin"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(inherits, F.col("license_dir")).alias("license_dir"),
    )
