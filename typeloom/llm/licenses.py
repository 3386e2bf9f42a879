"""Licence scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts and templates are lower-cased and cut into words of letters and digits; shingles are five words (a template of
fewer words is one shingle). Templates are grouped by size: scale k has those of 2**(k-1) < shingles <= 2**k, windows of
2**(k+1) shingles and steps of 2**k, so every occurrence of a template lies in one window whole, and the Jaccard
similarity of that window and a whole occurrence is over 1/4. With BANDS bands of one row each, a band's minimum is equal
with at least that probability, so a whole occurrence is retrieved with probability at least 1 - (3/4)**BANDS (0.9999 at
32). An occurrence that has kept 80 % of the shingles only has a similarity over 0.19, and a probability of 0.9988.
A band's order of shingles is their 64-bit hash under exclusive or with the band's key.

A band of one row can only be equal in windows that hold one of the templates' own band minima. These are few and fixed
by the templates, so texts without any of them are set aside first; this changes no collision.

A window matches if it holds at least `least` percent of the template's shingles.

Edge cases: null and empty texts, and those of fewer than five words unless a template is as short, match nothing;
rows that repeat a doc_id and text count once; a null doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import let, text_of

#: Common licence notices, name and text.
TEMPLATES = (
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "Released under the MIT License."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gnu-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause-third", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
)
BANDS = 32
SHINGLE = 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(text: Column) -> Column:
    """64-bit hashes of the five-word shingles in order."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= SHINGLE, runs).otherwise(few)

    return let(words(text), of)


def band_minimum(hashes: Column, band: Column) -> Column:
    """The least hash under the band's order; the key moves the leading bits, so bands pick different shingles."""
    key = F.xxhash64(F.lit("band"), band)
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(key)))


def template_rows(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """license, n, scale and hashes of each template; a fixed list of literals, so its size is bounded."""
    array = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("t")) for a, b in templates])
    rows = spark.range(1).select(F.explode(array).alias("x")).select("x.license", F.array_distinct(shingles(F.col("x.t"))).alias("hashes"))
    return rows.withColumn("n", F.size("hashes")).withColumn("scale", F.ceil(F.log2(F.col("n"))).cast("int"))


def _windows(scale: int, fixed: Column) -> Column:
    """A scale's windows of the shingles h that hold one of the band minima: scale, place and distinct shingles.

    They are cut and set aside inside the row, so a long text is never copied along with each of its windows.
    """
    size = 1 << scale
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("h") - 1) / size).cast("int")), lambda j: F.struct(F.lit(scale).alias("scale"), (j * size).alias("at"), F.array_distinct(F.slice("h", j * size + 1, F.lit(2 * size))).alias("part")))
    return F.filter(cut, lambda x: F.arrays_overlap(x["part"], fixed))


def scan(docs: DataFrame, least: int = 80, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license, n_windows, containment (largest share of the template's shingles in a window), first_word."""
    spark = docs.sparkSession
    known = template_rows(spark, templates)
    bands = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    keys = known.select("license", "n", "scale", "hashes", bands).withColumn("low", band_minimum(F.col("hashes"), F.col("band")))
    # the few band minima as plain hashes: literals in the plan, bounded by templates * BANDS
    minima = sorted({r[0] for r in keys.select(F.col("low").bitwiseXOR(F.xxhash64(F.lit("band"), F.col("band")))).distinct().collect()})
    fixed = F.array(*[F.lit(m) for m in minima]).cast("array<bigint>")
    scales = sorted({r[0] for r in known.select("scale").distinct().collect()})
    rows = docs.select("doc_id", text_of("text").alias("text")).select("doc_id", F.md5("text").alias("digest"), shingles(F.col("text")).alias("h"))
    rows = rows.filter(F.arrays_overlap("h", fixed))
    cells = rows.select("doc_id", "digest", F.explode(F.flatten(F.array(*[_windows(k, fixed) for k in scales]))).alias("w")).select("doc_id", "digest", "w.*")
    banded = cells.select("*", bands).withColumn("low", band_minimum(F.col("part"), F.col("band")))
    # the template side is a fixed list of templates * BANDS rows
    hits = banded.join(F.broadcast(keys), ["scale", "band", "low"]).select("doc_id", "digest", "at", "license", "n", F.size(F.array_intersect("part", "hashes")).alias("common"))
    good = hits.filter(F.col("common") * 100 >= F.col("n") * least).groupBy("doc_id", "digest", "license", "at").agg(F.max(F.col("common") / F.col("n")).alias("share"))
    best = good.groupBy("doc_id", "digest", "license").agg(F.count("*").cast("long").alias("n_windows"), F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"))
    return best.select("doc_id", "license", "n_windows", "containment", "first_word")
