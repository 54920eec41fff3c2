"""Licence statements in files, and licences that directories hand down; DataFrame functions only.

1. Each line of a text is a sparse TF-IDF vector over the templates' terms.  Words
   that no template has count towards a line's length with the weight of a term
   seen in none, so that prose which mentions a licence stays far from all of them.
2. Terms of lines meet the weighted terms of the templates in an equi-join; sums
   give the cosine of each line and template that share a term.  The templates are
   the constants below, so their broadcast has a fixed size.
3. A file's own licence is the template with the best cosine of at least
   ``THRESHOLD`` on any of its lines, ties by name.
4. A licence file, marked as such or made of licence lines for the most part, gives its
   licence to its directory: the best score, then the smallest path.  Files without a licence of their own take that
   of the nearest ancestor directory, by a join on the paths of their ancestors.

Null or empty texts have no licence of their own, but inherit.  Null paths
inherit nothing.  Rows that share a path share the inherited licence; each is
returned with the own licence of the path.  Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.6
#: A file at least so many of whose lines with words are licence statements is a licence file, where none are marked.
SHARE = 0.5

#: Common statements of licences, as their owners word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)

#: English words that carry no licence.
STOP = frozenset("a an and any are at by for from in is it of or that the this to with you be not may".split())


def terms(line: Column) -> Column:
    """The words of a line: letters, digits and inner dots and dashes, in lower case."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), 0)


def _template_terms(text: str) -> list[str]:
    import re

    return [w for w in re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower()) if w not in STOP]


def weights() -> tuple[list[tuple[int, str, str, float, float]], dict[str, float], float]:
    """(number, licence, term, weight, norm) of every template term; the weight of each term; that of an unknown one."""
    bags = [_template_terms(t) for _, t in TEMPLATES]
    seen: dict[str, int] = {}
    for bag in bags:
        for term in set(bag):
            seen[term] = seen.get(term, 0) + 1
    n = len(bags)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in seen.items()}
    out = []
    for i, bag in enumerate(bags):
        norm = math.sqrt(sum((bag.count(t) * idf[t]) ** 2 for t in set(bag)))
        out += [(i, TEMPLATES[i][0], t, bag.count(t) * idf[t], norm) for t in sorted(set(bag))]
    return out, idf, math.log(1 + n) + 1


def own_licenses(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score, share) of the files with a statement of their own.

    score has 6 digits; share is that of the lines with a statement among the lines with words.
    """
    spark: SparkSession = files.sparkSession
    table, idf, unknown = weights()
    index = spark.createDataFrame([(i, name, t, w * idf[t], norm, idf[t]) for i, name, t, w, norm in table], "template int, license string, term string, product double, norm double, idf double")
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\n")).alias("no", "line"))
    bags = lines.select("path", "no", terms(F.col("line")).alias("w"))
    bags = bags.withColumn("n", F.size("w") - F.size(F.filter("w", lambda x: x.isin(*sorted(STOP))))).where("n > 0")
    words = bags.select("path", "no", "n", F.explode("w").alias("term"))
    vocabulary = F.broadcast(index.groupBy("term").agg(F.max("idf").alias("idf")))
    known = words.join(vocabulary, "term").groupBy("path", "no", "n", "term", "idf").agg(F.count("*").alias("tf"))
    # a line of n terms that is this near to a template shares at least one of its terms; norms need all known ones
    norms = known.groupBy("path", "no").agg((F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2))) + (F.max("n") - F.sum("tf")) * F.lit(unknown**2)).alias("square"))
    dots = known.join(F.broadcast(index.select("template", "license", "term", "product", "norm")), "term")
    dots = dots.groupBy("path", "no", "template", "license", "norm").agg(F.sum(F.col("tf") * F.col("product")).alias("dot"))
    scored = dots.join(norms, ["path", "no"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.sqrt("square")), 6))
    # the best statement of each line, then of each file
    order = F.struct((-F.col("score")).alias("order"), "license")
    best = scored.where(F.col("score") >= threshold).groupBy("path", "no").agg(F.min(order).alias("b"))
    first = best.groupBy("path").agg(F.min("b").alias("b"), F.count("*").alias("stated"))
    counted = bags.groupBy("path").agg(F.count("*").alias("lines"))
    return first.join(counted, "path").select("path", F.col("b.license").alias("license"), (-F.col("b.order")).alias("score"), (F.col("stated") / F.col("lines")).alias("share"))


def scan(files: DataFrame, path: str = "path", text: str = "text", license_file: str | None = "license_file", threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """(path, license, score, origin, license_dir) of every file.

    ``license_file`` names the column that marks licence files; with None they are those
    of which ``share`` of the lines are statements.

    origin is ``license_file``, ``header``, ``inherited`` or ``none``; license_dir
    is the directory that an inherited licence comes from; the score of an
    inherited licence is that of the licence file.  Paths are parted by ``/``.
    """
    own = own_licenses(files, path, text, threshold).alias("own")
    marked = F.lit(None).cast("boolean") if license_file is None else F.coalesce(F.col(license_file), F.lit(False))
    told = files.select(F.col(path).alias("path"), marked.alias("marked")).join(own, "path", "left")
    told = told.withColumn("is_file", F.coalesce("marked", F.coalesce(F.col("share") >= share, F.lit(False)))).drop("marked", "share")
    parent = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    given = told.where("is_file and license is not null").groupBy(parent(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("order"), "path", "license")).alias("b"))
    given = given.select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.order")).alias("dir_score"))
    dirs = F.split(parent(F.col("path")), "/")
    up = told.where("license is null and path is not null").select("path", dirs.alias("parts")).distinct()
    up = up.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.array_join(F.slice("parts", 1, k), "/"))).alias("dir"))
    near = up.distinct().join(given, "dir").groupBy("path").agg(F.max(F.struct(F.length("dir").alias("deep"), "dir", "dir_license", "dir_score")).alias("g"))
    out = told.join(near.select("path", "g"), "path", "left")
    origin = F.when(F.col("license").isNotNull() & F.col("is_file"), "license_file").when(F.col("license").isNotNull(), "header").when(F.col("g").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("path").alias(path), F.coalesce("license", "g.dir_license").alias("license"), F.coalesce("score", "g.dir_score").alias("score"), origin.alias("origin"), F.col("g.dir").alias("license_dir"))
