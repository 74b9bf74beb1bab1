"""License scans, in DataFrame operations only.

Words are runs of a-z and 0-9 (A-Z lower-cased). Texts and templates become sequences of hashed five-word shingles;
windows of 1, 2, 4, ... shingles overlap by half. For each window six MinHash values, each a band of one row, retrieve
templates that have a window with an equal value: templates are cut at every offset, into windows of the largest scale
of which an aligned one surely lies inside any copy, so a whole copy always collides, and a window at similarity
0.75 is missed with probability 0.25**6 = 0.0002. Retrieved templates are then verified: the share of the template's
distinct shingles that the whole text holds must be at least 0.75. A template of fewer than five words has one
shingle, its whole sequence, and is verified on shingles of that length.

The template list is the caller's and limited to MAX_SHINGLES, which bounds what is written into the plan; TEMPLATES has
short texts whole (MIT, ISC, BSD, zlib) and the notices of longer ones, other licenses are not looked for. Null and
empty texts match nothing; texts of any length are scanned whole, in arrays of a few longs a word. Repeated rows each get a result; an empty table or template list gives empty matches.
Other columns are kept as they are, one of the added name is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINMENT, MAX_SHINGLES = 5, 6, 0.75, 20_000

# License texts and notices in common use.
TEMPLATES = {
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def words_of(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), "[^a-z0-9]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, in order; empty if there are fewer."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)]))


def permuted(grams: Column, band: int) -> Column:
    return F.transform(grams, lambda g: F.xxhash64(F.lit(band), g))


def halved(values: Column, scale: int) -> Column:
    """Minima of windows twice as long as the given ones of 2**scale shingles; both start at every half of their length."""
    if scale == 0:
        least, gap = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: F.least(a, b)), 1
    else:
        places, gap = F.sequence(F.lit(0), F.size(values) - 3, F.lit(2)), 2
        least = F.transform(places, lambda i: F.least(F.get(values, i), F.get(values, i + 2)))
    return F.when(F.size(values) > gap, least).otherwise(F.array().cast("array<bigint>"))


def scale_of(n: int) -> int:
    """The exponent of the largest window of which an aligned one lies in any run of n shingles."""
    scale = 0
    while n >= (2 << scale) + (1 << scale) - 1:
        scale += 1
    return scale


def _template_rows(spark, templates: Mapping[str, str]) -> list[dict]:
    """Per template: name, shingle size, distinct shingles and, per scale, band values at every offset."""
    listed = spark.createDataFrame(sorted(templates.items()), "name string, body string")
    words = listed.select("name", words_of(F.col("body")).alias("words")).where(F.size("words") > 0)
    out = []
    for name, n in sorted((r[0], r[1]) for r in words.select("name", F.size("words")).collect()):
        size = min(SHINGLE, n)
        grams = words.where(F.col("name") == name).select(shingles(F.col("words"), size).alias("g"))
        hashed = grams.select("g", *[permuted(F.col("g"), b).alias(f"b{b}") for b in range(BANDS)]).first()
        scale = scale_of(len(hashed["g"]))
        width = 1 << scale
        windows = {(b, min(row[i : i + width])) for b in range(BANDS) for row in [hashed[f"b{b}"]] for i in range(len(row) - width + 1)}
        out.append({"name": name, "size": size, "grams": sorted(set(hashed["g"])), "scale": scale, "values": sorted(windows)})
    return out


def scan_licenses(df: DataFrame, text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, out_col: str = "licenses") -> DataFrame:
    """df with an array of (name, containment) of the matching templates, sorted by name."""
    empty = F.array().cast("array<struct<name:string,containment:double>>")
    rows = _template_rows(df.sparkSession, templates) if templates else []
    if sum(len(r["grams"]) + len(r["values"]) for r in rows) > MAX_SHINGLES * (BANDS + 1):
        raise ValueError("the templates are too long to be written into the plan; pass them in several lists")
    if not rows:
        return df.withColumn(out_col, empty)

    def literal(values) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<bigint>")

    out, found = df.withColumn("__words", words_of(F.col(text_col))).drop(out_col), []
    temporary = ["__words"]
    for size in sorted({r["size"] for r in rows}):
        own = [r for r in rows if r["size"] == size]
        grams = f"__g{size}"
        out, temporary = out.withColumn(grams, shingles(F.col("__words"), size)), [*temporary, grams]
        top = max(r["scale"] for r in own)
        hits = [f"__h{size}_{s}" for s in range(top + 1)]
        level = [permuted(F.col(grams), b) for b in range(BANDS)]
        for scale in range(top + 1):
            names = [f"__v{size}_{scale}_{b}" for b in range(BANDS)]
            out = out.withColumns(dict(zip(names, level, strict=True)))
            temporary += names
            wanted = {b: sorted({v for r in own if r["scale"] == scale for k, v in r["values"] if k == b}) for b in range(BANDS)}
            if any(wanted.values()):
                each = [F.array_intersect(names[b], literal(wanted[b])) for b in range(BANDS)]
                out = out.withColumn(hits[scale], F.concat(*each))
                temporary.append(hits[scale])
            level = [halved(F.col(n), scale) for n in names]
        for r in own:
            retrieved = F.size(F.array_intersect(hits[r["scale"]], literal([v for _, v in r["values"]]))) > 0
            share = F.size(F.array_intersect(grams, literal(r["grams"]))) / F.lit(float(len(r["grams"])))
            found.append(F.when(retrieved & (share >= CONTAINMENT), F.struct(F.lit(r["name"]).alias("name"), share.alias("containment"))))
    matches = F.array_sort(F.filter(F.array(*found), lambda m: m.isNotNull()))
    return out.withColumn(out_col, F.coalesce(matches.cast(out.select(empty.alias("e")).schema["e"].dataType), empty)).drop(*temporary)
