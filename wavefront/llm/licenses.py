"""License scans: TF-IDF cosine to templates, then inheritance down directories.

A passage is a line of a file that speaks of licences, a run of neighbouring
lines (a wrapped header, comment marks stripped) that does, or the whole text of
a licence file. Equal passages are one row with a count from the start, so a
notice that is in every file costs no more than a rare one. Term weights are
``tf * (ln((1 + N) / (1 + df)) + 1)`` with N and df counted over the passages
of all files. Only terms that a passage shares with a template are joined with
it. For licences that are longer than a page, the templates hold the notice and
the head of the licence file, which is a passage of its own there. A file without a licence of its own takes that of the nearest directory above
it, its own included, that holds a licence file; this is resolved once for
each directory. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, durable

#: Notices of public licences, several for some.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MIT", "MIT License"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Fixed value: lines and runs that speak of licences. It only keeps other text from
#: being cut into terms; all templates match it, and the cosine decides.
CUE = r"(?i)licen[cs]e|copyright|spdx|public domain|redistribution|free software|permission is hereby|permission to use|hereby granted"
#: Fixed value: names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"

#: Fixed value: comment marks at the start of a line.
MARKS = r"(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--+)"


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), r"[^a-z0-9.]+|\.(?=\s|$)|(?<=\s|^)\."), "")


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _runs(text: Column) -> Column:
    """Runs of two and more lines that speak of licences, without comment marks.

    Three readings: between blank lines; between lines that hold a comment
    mark at most (a paragraph of a header); of lines with a mark (a header
    that code follows at once).
    """

    def bare(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, rf"(?m)^[ \t]*+{MARKS}", ""), r"(?m)(?:\*+/|--+>)[ \t\r]*$", "")

    def split(x: Column) -> Column:
        return F.split(x, r"\n[ \t\r\n]*\n")

    marked = F.regexp_replace(text, rf"(?m)^(?![ \t]*+{MARKS}).*$", "")
    runs = F.concat(F.transform(split(text), bare), split(bare(text)), F.transform(split(marked), bare))
    runs = F.filter(F.transform(runs, lambda x: F.regexp_replace(x, r"^\s++|\s++$", "")), lambda x: x.contains("\n"))
    return F.array_distinct(F.filter(F.transform(runs, lambda x: F.regexp_replace(x, r"\s++", " ")), lambda x: x.rlike(CUE)))


def _weights(passages: DataFrame, key: str, idf: DataFrame, none: Column) -> DataFrame:
    """(key, term, w) with vectors of length one; ``none``: the weight of terms without a count."""
    tf = passages.select(key, F.explode(_terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    weighted = tf.join(idf, "term", "left").select(key, "term", (F.col("tf") * F.coalesce(F.col("idf"), none)).alias("w"))
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", key_col: str | None = None, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """One row per input row: key, path, own_license, own_score, license, from_dir.

    ``key_col`` names the rows (None: the path does). ``own_license``: that of
    the template with the highest cosine of ``threshold`` or more to any
    passage of the whole text (ties: the first name), with ``own_score``, else
    null. ``license``: the own one, else that of the nearest directory
    (``from_dir``) with a licence file; of several there, the highest score,
    then the first name. Null texts have no passage. A null path is in no
    directory and inherits nothing. Repeated rows each get a row and have the
    same result; rows of one key and path share the best of their passages.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = files.sparkSession
    rows = files.select(F.col(f"`{key_col or path_col}`").alias("key"), F.col(f"`{path_col}`").alias("path"), F.col(f"`{text_col}`").alias("text"))
    is_file = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))
    whole = F.when(is_file, F.array("text")).otherwise(F.array().cast("array<string>"))
    # most texts speak of no licence; only the others are cut
    found = rows.where(F.coalesce(F.col("text").rlike(CUE), F.lit(False))).select("key", "path", is_file.alias("is_file"), F.explode(F.concat(lines, _runs(F.col("text")), whole)).alias("text"))
    found = durable(found.groupBy("key", "path", "is_file", "text").agg(F.count("*").alias("n")))

    passages = durable(found.groupBy("text").agg(F.sum("n").alias("n")).withColumn("p", F.monotonically_increasing_id()))
    total = passages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = passages.select("n", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    # a table of its own, so that the rows of a term that is everywhere can be split in the joins with it
    idf = bounded(durable(df.select("term", (F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))))
    rare = F.log(F.lit(total + 1.0)) + 1.0
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, name string, text string")
    models = F.broadcast(_weights(known, "t", idf, rare).join(known.select("t", "name"), "t").withColumnRenamed("w", "tw"))  # terms of the fixed templates
    dots = _weights(passages, "p", idf, rare).join(models, "term").groupBy("p", "t", "name").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    score = F.round(F.least(F.col("dot"), F.lit(1.0)), 6)
    best = dots.withColumn("score", score).where(F.col("score") >= threshold).groupBy("p").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    matched = passages.join(best, "p").select("text", "b")

    own = durable(found.join(matched, "text").groupBy("key", "path", "is_file").agg(F.min("b").alias("b")))
    directory = _directory(F.col("path"))
    holding = bounded(durable(own.where("is_file").groupBy(directory.alias("dir")).agg(F.min("b").alias("d")).select("dir", "d.s", "d.name")))
    all_rows = rows.select("key", "path").join(own.select(F.col("key").alias("k2"), F.col("path").alias("p2"), "b"), F.col("key").eqNullSafe(F.col("k2")) & F.col("path").eqNullSafe(F.col("p2")), "left")
    all_rows = all_rows.select("key", "path", directory.alias("own_dir"), "b")

    parts = F.split("own_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))
    places = rows.select(directory.alias("own_dir")).where("own_dir IS NOT NULL").distinct().select("own_dir", F.explode(above).alias("x")).select("own_dir", "x.*").distinct()
    nearest = places.join(holding, "dir").groupBy("own_dir").agg(F.max(F.struct("depth", "dir", F.struct("s", "name").alias("d"))).alias("x"))
    nearest = bounded(durable(nearest.select("own_dir", F.col("x.dir").alias("from_dir"), F.col("x.d.name").alias("from_name"))))
    out = all_rows.join(nearest, "own_dir", "left")
    return out.select(
        F.col("key").alias(key_col or path_col), *([F.col("path").alias(path_col)] if key_col else []), F.col("b.name").alias("own_license"), (-F.col("b.s")).alias("own_score"),
        F.coalesce("b.name", "from_name").alias("license"), F.when(F.col("b").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def drop_unlicensed(files: DataFrame, allowed: list[str], **columns: str) -> DataFrame:
    """The rows of :func:`scan` whose licence is one of ``allowed``."""
    return scan(files, **columns).where(F.col("license").isin(allowed))


__all__ = ["TEMPLATES", "drop_unlicensed", "scan"]
