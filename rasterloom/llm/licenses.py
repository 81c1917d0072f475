"""Licence scans, with DataFrame functions only.

1. Texts become lower-case tokens, so line breaks, comment marks and
   punctuation play no part.  Around each anchor word (a token of ``ANCHORS``)
   stand the windows that a template would fill if that word were the
   template's first or last anchor; a header or licence file is thus compared
   as a whole, wrapped over lines or inside a long one.  Only windows that hold
   ``SHARED`` of the template's distinct tokens go on.
2. Equal windows are counted once, so a header that a third of all files carry
   is scored once.  Windows and templates become sparse TF-IDF vectors, with
   document frequencies over all those windows.
3. A window's licence is the template of the highest cosine, if that is
   ``LEVEL`` or more; a text's licence is that of its best window.
4. A file of which one window holds ``FILE_SHARE`` of the tokens, or that is
   named like one, speaks for its directory.  A file without a licence of its
   own inherits from the nearest ancestor directory that has one, by joins of
   paths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

LEVEL, SHARED = 0.6, 0.5
FILE_SHARE = 0.5
BROADCAST_ROWS = 100_000
#: Every template holds one of these tokens at least.
ANCHORS = ("license", "licence", "licensed", "licenced", "licenses", "spdx", "copyright", "permission", "permitted", "domain", "commons", "cc", "cc0", "warranty", "redistribute")
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)(\.(md|txt|rst))?$"
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "licensed under the GNU Lesser General Public License, version 3"),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "licensed under the GNU Affero General Public License, version 3"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the 3-Clause BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": ("Licensed under the 2-Clause Simplified BSD License", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": (
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal public domain dedication"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+"), 0)


def _templates(spark: SparkSession) -> DataFrame:
    """license, line: a constant of a few dozen rows, made from one literal."""
    flat = [f"{k}\t{t}" for k, own in TEMPLATES.items() for t in own]
    rows = spark.range(1).select(F.explode(F.split(F.lit("\n".join(flat)), "\n")).alias("x"))
    return rows.select(F.split_part("x", F.lit("\t"), F.lit(1)).alias("license"), F.split_part("x", F.lit("\t"), F.lit(2)).alias("line"))


def _slots(spark: SparkSession) -> DataFrame:
    """anchor, off, many and the distinct tokens ``own`` of each template by its first and its last anchor: a constant table."""
    rows = set()
    for line in {t for own in TEMPLATES.values() for t in own}:
        words = re.findall(r"[^\W_]+", line.lower())
        at = [k for k, w in enumerate(words) if w in ANCHORS]
        rows |= {(words[k], k, len(words), " ".join(sorted(set(words)))) for k in (at[0], at[-1])}
    flat = spark.range(1).select(F.explode(F.split(F.lit("\n".join("\t".join(map(str, r)) for r in sorted(rows))), "\n")).alias("x"))
    part = lambda k: F.split_part("x", F.lit("\t"), F.lit(k))
    return flat.select(part(1).alias("anchor"), part(2).cast("int").alias("off"), part(3).cast("int").alias("many"), F.split(part(4), " ").alias("own"))


def licence_windows(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, text_hash, line (a window's tokens) and its share of the text's tokens."""
    spark = docs.sparkSession
    slots = _slots(spark)
    longest = max(len(re.findall(r"[^\W_]+", t)) for own in TEMPLATES.values() for t in own)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), path.alias("path"), text.alias("text"))
    rows = rows.where(F.col("text").rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(ANCHORS)})(?![\p{{L}}\p{{N}}])"))
    rows = rows.select("doc_id", "path", F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("t"))
    # An anchor travels with the tokens that a window could reach, never with the whole text.
    near = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda k: F.get("t", k).isin(*ANCHORS)),
        lambda k: F.struct(
            F.get("t", k).alias("anchor"), F.least(k, F.lit(longest)).alias("at"),
            F.slice("t", F.greatest(k - longest, F.lit(0)) + 1, F.lit(2 * longest)).alias("around"),
        ),
    )
    rows = rows.where(F.size("t") > 0).select("doc_id", "path", "text_hash", F.size("t").alias("size"), F.explode(near).alias("x"))
    rows = rows.select("doc_id", "path", "text_hash", "size", "x.*").join(F.broadcast(slots), "anchor")
    begin = F.greatest(F.col("at") - F.col("off"), F.lit(0))
    rows = rows.withColumn("w", F.slice("around", begin + 1, F.col("at") - F.col("off") + F.col("many") - begin))
    rows = rows.where(F.size(F.array_intersect("w", "own")) >= SHARED * F.size("own"))
    share = F.size("w") / F.col("size")
    return rows.select("doc_id", "path", "text_hash", F.array_join("w", " ").alias("line"), share.alias("share")).distinct()


def score_lines(lines: DataFrame) -> DataFrame:
    """Distinct ``(line, n)`` to ``(line, license, score)`` of each line's best template, ties by name."""
    spark = lines.sparkSession
    shapes = _templates(spark)
    every = lines.select("line", "n").unionByName(shapes.groupBy("line").agg(F.lit(1).cast("long").alias("n")))
    total = every.agg(F.sum("n").alias("total"))
    words = every.select("line", "n", F.explode(tokens(F.col("line"))).alias("token"))
    tf = words.groupBy("line", "token").agg(F.count(F.lit(1)).alias("tf"), F.max("n").alias("n"))
    df = tf.groupBy("token").agg(F.sum("n").alias("df"))
    idf = F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1
    weights = tf.join(df.crossJoin(F.broadcast(total)).select("token", idf.alias("idf")), "token")
    weights = materialize(weights.select("line", "token", (F.col("tf") * F.col("idf")).alias("w")), "licence-weights")
    norms = weights.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # A template is a few words from a constant, so this side is bounded.
    t = shapes.withColumnRenamed("line", "shape").join(weights.withColumnRenamed("line", "shape"), "shape")
    t = t.join(norms.select(F.col("line").alias("shape"), F.col("norm").alias("t_norm")), "shape")
    t = t.select("license", "shape", "token", F.col("w").alias("t_w"), "t_norm")
    dots = weights.join(F.broadcast(t), "token").groupBy("line", "license", "shape").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"), F.first("t_norm").alias("t_norm"))
    score = F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6)
    scored = dots.join(norms, "line").select("line", "license", score.alias("score"))
    best = scored.groupBy("line").agg(F.max_by(F.struct("license", "score"), F.struct(F.col("score"), _before("license"))).alias("b"))
    return best.select("line", "b.license", "b.score").where(F.col("score") >= LEVEL)


def _before(name: str) -> Column:
    """Orders names downwards, so that a maximum prefers the first by name."""
    order = sorted(TEMPLATES)
    return -F.array_position(F.split(F.lit("\n".join(order)), "\n"), F.col(name))


def scan(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """doc_id, path, license, score, origin (own, inherited or none) and from_path of each row.

    ``path`` names a file by its directories, ``docs.path`` unless given.  Null
    and empty texts have no licence of their own; a null path has no ancestors;
    rows are told apart by doc_id, path and text, so different texts under one
    doc_id or none, or under one path, each have their own licence; repeated
    rows are all returned; ties fall to the licence first by name.
    """
    path = (F.col("path") if path is None else path).cast("string")
    found = materialize(licence_windows(docs, path), "licence-windows")
    distinct = found.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    scored = materialize(score_lines(distinct), "licence-scores")
    hits = found.join(scored, "line")
    key = ["doc_id", "path", "text_hash"]
    own = hits.groupBy(*key).agg(
        F.max_by(F.struct("license", "score"), F.struct(F.col("score"), _before("license"))).alias("b"), F.max("share").alias("share")
    )
    own = materialize(own.select(*key, "b.license", "b.score", "share"), "licence-own")
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    speaks = own.where(F.col("path").isNotNull() & ((F.col("share") >= FILE_SHARE) | F.col("path").rlike(FILE_NAME)))
    votes = speaks.groupBy(directory.alias("dir"), "license").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("from_path"), F.max("score").alias("score"))
    votes = votes.groupBy("dir").agg(F.max_by(F.struct("license", "from_path", "score"), F.struct(F.col("files"), _before("license"))).alias("v"))
    votes = materialize(votes.select("dir", "v.*"), "licence-dirs")
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    files = docs.select(F.col("doc_id").cast("long"), path.alias("path"), text_hash.alias("text_hash")).withColumn("dir", directory)
    dirs = files.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("up"), k.alias("depth")))
    chain = dirs.select("dir", F.explode(above).alias("a")).select("dir", F.col("a.up").alias("up"), F.col("a.depth").alias("depth"))
    near = chain.join(votes.withColumnRenamed("dir", "up"), "up")
    near = near.groupBy("dir").agg(F.max_by(F.struct("license", "score", "from_path"), "depth").alias("near"))
    near = materialize(near, "licence-near")
    mine = own.select(F.col("doc_id").alias("d"), F.col("path").alias("p"), F.col("text_hash").alias("h"), F.struct("license", "score").alias("own"))
    small = mine.count() <= BROADCAST_ROWS
    same = (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("path").eqNullSafe(F.col("p"))
    rows = files.join(F.broadcast(mine) if small else mine, same, "left")
    few = near.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(near) if few else near, "dir", "left")
    has, heir = F.col("own").isNotNull(), F.col("near").isNotNull()
    return rows.select(
        "doc_id",
        "path",
        F.coalesce("own.license", "near.license").alias("license"),
        F.coalesce("own.score", "near.score").alias("score"),
        F.when(has, "own").when(heir, "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).when(heir, F.col("near.from_path")).alias("from_path"),
    )
