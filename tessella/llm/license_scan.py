"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the
nearest ancestor directory by path joins.

Whole texts are held against the full texts of `licences/`, and they, their lines and their paragraphs (runs of lines with words, such
as a comment block) against the statements by which headers name a licence. A statement that names a version counts only in units that
name it too. Term counts are damped (1 + ln n), so that a long licence is told by its vocabulary and not by its most frequent words.

Two lossless filters keep other texts from being split into terms and counted: by Cauchy-Schwarz, the terms that a unit shares with a
template must hold the square of the threshold of the template's squared length. So a unit has one of a statement's heaviest
terms, and a whole text has at least as many of a licence's terms as its heaviest need to hold that much.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_about, stored

#: Statements of headers and short licence files: SPDX identifier, a term that the unit must have ("" for none), text. Several forms of
#: one licence may stand here.
STATEMENTS: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "2", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "3", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MPL-1.1", "1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1."),
    ("CC-BY-4.0", "4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "by-sa", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "by-nc", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "cc0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    *((name, name.lower(), f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "Zlib", "Unlicense")),
    *((name, form.lower(), f"SPDX-License-Identifier: {form}") for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for form in (f"{name}-only", f"{name}-or-later")),
)
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Lines without letters and digits, which part paragraphs.
GAP_LINES = r"\n(?:[^A-Za-z0-9\n]*\n)+"
#: Cosines from which a unit makes a statement, and from which a whole text is a licence's full text.
STATEMENT, FULL = 0.6, 0.8


@dataclass(frozen=True)
class Template:
    licence: str
    needs: str
    full: bool
    counts: tuple[tuple[str, int], ...]

    def weights(self, idf: dict[str, float]) -> dict[str, float]:
        """Its vector, of length one."""
        own = {t: (1 + math.log(n)) * idf[t] for t, n in self.counts}
        length = math.sqrt(sum(x * x for x in own.values()))
        return {t: x / length for t, x in own.items()}


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


@lru_cache
def templates() -> tuple[Template, ...]:
    files = sorted(Path(__file__).with_name("licences").glob("*.txt"))
    counted = lambda text: tuple(sorted(Counter(terms(text)).items()))
    return (*(Template(n, need, False, counted(text)) for n, need, text in STATEMENTS), *(Template(f.stem, "", True, counted(f.read_text("utf-8"))) for f in files))


def _vocabulary() -> list[str]:
    return sorted({t for x in templates() for t, _ in x.counts})


def _heaviest(weights: dict[str, float], share: float) -> list[str]:
    """The fewest terms that hold so much of a squared length of one."""
    out, total = [], 0.0
    for t, x in sorted(weights.items(), key=lambda i: (-i[1], i[0])):
        if total > share:
            break
        out.append(t)
        total += x * x
    return out


def _telling(full: list[Template], idf: dict[str, float]) -> tuple[list[str], int]:
    """Terms of full texts, without those of every twentieth document, and how many of them a text has at least that shares enough with one of
    the licences: what all common terms together hold of it is taken as given."""
    for common in ({t for t, x in idf.items() if x < 1 + math.log(20)}, set()):
        least = []
        for x in full:
            weights = x.weights(idf)
            rest = {t: w for t, w in weights.items() if t not in common}
            least.append(len(_heaviest(rest, FULL**2 - 1e-9 - sum(w * w for t, w in weights.items() if t in common))))
        if min(least) > 5 or not common:
            return sorted({t for x in full for t, _ in x.counts} - common), min(least)
    raise AssertionError


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def _known(found: Column, words: list[str]) -> Column:
    """Those of an array of terms that are among fixed words: a look-up in a set that the plan holds."""
    return F.filter(found, lambda t: t.isin(words))


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, float]]:
    """Rows, and 1 + ln((1 + N) / (1 + df)) over all documents for each term of the templates (a fixed set)."""
    vocabulary = _vocabulary()
    own = _known(F.array_distinct(_terms(F.col(text_col))), vocabulary)
    counted = docs.select(F.explode(own).alias("term")).groupBy("term").count().collect()  # at most a row for each template term
    n = docs.count()
    df = {r["term"]: r["count"] for r in counted}
    return n, {t: 1 + math.log((1 + n) / (1 + df.get(t, 0))) for t in vocabulary}


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def cosines(docs: DataFrame, text_col: str = "text", id_col: str = "path") -> DataFrame:
    """id_col, unit (-1: the whole text; 0 on: lines, then paragraphs of several lines), licence, score: the best template of each unit that
    reaches its threshold."""
    spark = docs.sparkSession
    n, idf = inverse_frequencies(docs, text_col)
    rare = 1 + math.log(1 + n)  # of any term that no template has
    statements, full = ([x for x in templates() if x.full == f] for f in (False, True))
    must = sorted({t for x in statements for t in _heaviest(x.weights(idf), 1 - STATEMENT**2 + 1e-9)})  # the rest holds too little
    words, least = _telling(full, idf)
    # Repeated paths are one file with all their texts: units are numbered by text, too.
    base = docs.select(id_col, F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("text_hash")).withColumn("_all", _terms(F.col("_text")))
    says, whole = F.size(_known(F.col("_all"), must)) > 0, F.size(_known(F.array_distinct("_all"), words)) >= least
    several = F.filter(F.split("_text", GAP_LINES), lambda x: x.contains("\n"))
    parts = F.transform(F.concat(F.split("_text", "\n"), several), lambda x, i: F.struct(i.alias("unit"), _terms(x).alias("terms")))
    parts = F.filter(parts, lambda x: F.size(_known(x["terms"], must)) > 0)
    every = F.array(F.struct(F.lit(-1).alias("unit"), F.col("_all").alias("terms")))
    units = F.when(says, F.concat(every, parts)).otherwise(every)
    unit = [id_col, "text_hash", "unit"]
    split = base.where(says | whole).select(id_col, "text_hash", F.explode(units).alias("_u")).select(id_col, "text_hash", "_u.unit", F.explode("_u.terms").alias("term"))
    weights = _table(spark, list(idf.items()), "term string, idf double")
    tf = split.groupBy(*unit, "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf")).join(weights, "term", "left")
    tf = stored(tf.select(*unit, "term", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("x"), F.col("idf").isNotNull().alias("known")), "licence-terms")
    norms = tf.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    rows = [(k, x.licence, x.full, t, w, t == x.needs) for k, x in enumerate(templates()) for t, w in x.weights(idf).items()]
    needs = [(k, x.needs != "") for k, x in enumerate(templates())]
    own = _table(spark, rows, "template int, licence string, full boolean, term string, w double, needed boolean")
    dots = tf.where("known").join(own, "term").where("unit = -1 or not full").groupBy(*unit, "template", "licence", "full").agg(F.sum(F.col("x") * F.col("w")).alias("dot"), F.max("needed").alias("named"))
    scored = dots.join(_table(spark, needs, "template int, needs boolean"), "template").where("named or not needs").join(norms, unit).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    reached = scored.where(F.col("score") >= F.when(F.col("full"), FULL).otherwise(STATEMENT))
    best = reached.groupBy(*unit).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select(*unit, F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def _ancestors(path: Column) -> Column:
    """Directories above a path, the root ("") included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, licence, score, origin, from_dir: one row for each path.

    origin is "file" (the whole text is a licence), "header" (its best line or paragraph is one), "inherited" or null. A directory's
    licence is that of its licence files. Files without their own
    take that of the nearest ancestor directory that has one; of several licence files the best score, then
    the first name, counts. Null texts have no licence of their own, texts of any length are read whole, rows without a path are left out,
    and rows that repeat a path are one file with all their texts: its licence is that of the whole text, else the unit, with the best score, of equal
    scores the first name. Other columns are ignored; no rows give no rows.
    """
    base = files.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    found = stored(cosines(base), "licence-found")
    rank = F.struct((F.col("unit") >= 0).alias("h"), (-F.col("score")).alias("s"), "licence")
    own = found.groupBy("path").agg(F.min(rank).alias("b")).select("path", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), F.when(F.col("b.h"), "header").otherwise("file").alias("origin"))
    placed = own.where("origin = 'file'").withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    dirs = placed.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select("dir", F.col("b.licence").alias("dir_licence"))
    paths = base.select("path").distinct().join(own, "path", "left")
    above = paths.where("licence is null").select("path", F.posexplode(_ancestors(F.col("path"))).alias("depth", "dir"))
    below = stored(dirs.join(above.groupBy("dir").count(), "dir"), "licence-dirs")  # the root and large folders are above most paths
    total = below.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    near = join_about(above, below, ["dir"], "count", total).where("dir_licence is not null")
    near = near.groupBy("path").agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("b")).select("path", F.col("b.dir").alias("from_dir"), F.col("b.dir_licence").alias("taken"))
    origin = F.coalesce("origin", F.when(F.col("taken").isNotNull(), "inherited"))
    return paths.join(near, "path", "left").select("path", F.coalesce("licence", "taken").alias("licence"), "score", origin.alias("origin"), "from_dir")


def document_path(source: str = "source", lang: str = "lang", doc_id: str = "doc_id") -> Column:
    """documents as a file tree: source / language / folders of 64 ids / id."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return F.concat_ws("/", named(source), named(lang), F.floor(F.col(doc_id) / 64).cast("string"), named(doc_id))


def oracle() -> str:
    """license_scan over documents in DuckDB SQL, with every unit scored and none filtered."""
    values = ", ".join(f"({k}, '{x.licence}', {x.full}, '{t}', {c}, {t == x.needs})" for k, x in enumerate(templates()) for t, c in x.counts)
    needs = ", ".join(f"({k}, {x.needs != ''})" for k, x in enumerate(templates()))
    return f"""
WITH tm(k, licence, whole, term, c, needed) AS (VALUES {values}),
nd(k, needs) AS (VALUES {needs}),
d AS (SELECT concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 64 AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'none')) AS path, text FROM documents),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT path, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM d) WHERE term IN (SELECT term FROM tm) GROUP BY 1),
idf AS (SELECT DISTINCT tm.term, 1 + ln((1.0 + n) / (1 + coalesce(df, 0))) AS idf FROM tm LEFT JOIN df USING (term), n),
tv AS (SELECT k, licence, whole, term, needed, (1 + ln(c)) * idf / sqrt(sum(pow((1 + ln(c)) * idf, 2)) OVER (PARTITION BY k)) AS x FROM tm JOIN idf USING (term)),
us AS (SELECT path, text, list_concat(string_split(text, chr(10)), list_filter(string_split_regex(text, '{GAP_LINES}'), lambda p: contains(p, chr(10)))) AS ls FROM d WHERE text IS NOT NULL),
u AS (SELECT path, -1 AS unit, text FROM us UNION ALL SELECT path, i, ls[i] FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM us)),
tf AS (SELECT path, unit, term, 1 + ln(count(*)) AS tf FROM (SELECT path, unit, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM u) GROUP BY ALL),
w AS (SELECT path, unit, term, tf * coalesce(idf, 1 + ln(1.0 + n)) AS y FROM tf LEFT JOIN idf USING (term), n),
nm AS (SELECT path, unit, sqrt(sum(y * y)) AS norm FROM w GROUP BY ALL),
dt AS (SELECT path, unit, k, licence, whole, sum(y * x) AS dot, max(needed) AS named FROM w JOIN tv USING (term) WHERE unit = -1 OR NOT whole GROUP BY ALL),
sc AS (SELECT path, unit, licence, whole, round(dot / norm, 6) AS score FROM dt JOIN nd USING (k) JOIN nm USING (path, unit) WHERE named OR NOT needs),
best AS (SELECT * FROM sc WHERE score >= CASE WHEN whole THEN {FULL} ELSE {STATEMENT} END QUALIFY row_number() OVER (PARTITION BY path, unit ORDER BY score DESC, licence) = 1),
own AS (SELECT path, licence, score, CASE WHEN unit < 0 THEN 'file' ELSE 'header' END AS origin, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM best
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY unit >= 0, score DESC, licence) = 1),
dirs AS (SELECT dir, licence AS dl FROM own WHERE origin = 'file' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1),
a AS (SELECT path, k AS depth, array_to_string(string_split(path, '/')[1 : k], '/') AS dir FROM (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS k FROM d WHERE path NOT IN (SELECT path FROM own))),
near AS (SELECT path, dir, dl FROM a JOIN dirs USING (dir) QUALIFY row_number() OVER (PARTITION BY path ORDER BY depth DESC) = 1)
SELECT d.path, coalesce(own.licence, dl) AS licence, score, coalesce(origin, CASE WHEN dl IS NOT NULL THEN 'inherited' END) AS origin, near.dir AS from_dir
FROM d LEFT JOIN own USING (path) LEFT JOIN near USING (path)"""
