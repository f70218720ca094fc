"""License of every document: TF-IDF cosine of its header, text and lines to templates, else the nearest ancestor directory's license.

Every text is compared as a whole, and its header (the comment block it begins with) beside it, with full license texts
and the headers these prescribe (folder ``licenses``); the best one at ``LEAST_BODY`` or more, or an SPDX line, names
the license before any notice does. Terms weigh by how few of these templates hold them.

Every line and sentence of every text is compared with each short notice in ``TEMPLATES`` by the cosine of TF-IDF
vectors; the best one at ``LEAST`` or more names the license; a bare "All rights reserved" does so only where nothing
else is named. Document frequencies of the notices' terms count all lines and sentences of the corpus and the notices;
a term that no notice holds weighs as one that no line holds. A line whose notice terms make up less than ``LEAST`` of
its length can't reach it and is passed over.

A file by a license file's name, or one that is notices for half of its characters or more, gives its license to its
directory (the license of most such files, then the first by name). A document without a license of its own inherits
from its directory or the nearest ancestor that has one: directories, not documents, are joined to their ancestors'
paths, as deep as the paths go.

Null and empty texts have no notice and can inherit; a null path has no directory; rows repeated are answered alike, and
rows of one id and path with several texts as one document. A very long line is one notice. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, slices, small_batches, split_join

# Short notices of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
]
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
LEAST = 0.6
LEAST_BODY = 0.8
BODIES = Path(__file__).parent / "licenses"
COMMENT = re.compile(r"\s*(?:/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3}|\'{3}.*?\'{3}|(?:[ \t]*(?:#|//|--|;|%|\*)[^\n]*(?:\n|$))+)", re.S)
PREFACE = re.compile(r"(?:\ufeff|#![^\n]*\n)*")
_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*\(?({_ID}(?:[ \t]+(?:OR|AND|WITH)[ \t]+{_ID})*)")
#: Rows of the directory table up to which it is sent to every executor (about 100 bytes a row).
MOST_SENT = 200_000


#: After a stop and blanks, and at line ends.
_UNIT = re.compile(r"(?<=[.!?;])[ \t]+|\n")


def vocabulary() -> list[str]:
    """The terms of the short notices."""
    return sorted({t for _, body_ in TEMPLATES for t in re.findall(TERM, body_.lower())})


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """How many lines and sentences with a term there are, notices included, and how many hold each term of the notices."""
    parts = F.split(F.regexp_replace("text", r"([.!?;])[ \t]+", "$1\n"), "\n", -1)
    terms = docs.select(F.explode(parts).alias("unit")).select(_terms(F.col("unit")).alias("terms")).where(F.size("terms") > 0)
    held = F.array_intersect("terms", F.array(*map(F.lit, vocabulary())))
    # "" stands for the line itself; at most one row a term comes to the driver
    found = {r["t"]: r["n"] for r in terms.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    own = [set(re.findall(TERM, body_.lower())) for _, body_ in TEMPLATES]
    return found.get("", 0) + len(own), {t: found.get(t, 0) + sum(t in o for o in own) for t in vocabulary()}


class Notices:
    """The short notices as unit vectors."""

    def __init__(self, size: int, df: dict[str, int], least: float):
        self.least, self.other = least, math.log(size + 1) + 1
        self.idf = {t: math.log((size + 1) / (n + 1)) + 1 for t, n in df.items()}
        self.vectors = []
        for name, body_ in TEMPLATES:
            w = {t: n * self.idf[t] for t, n in Counter(re.findall(TERM, body_.lower())).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.vectors.append((name, {t: x / norm for t, x in w.items()}))

    def best(self, terms: list[str]) -> tuple[float, str] | None:
        """Score and license of the line with these terms."""
        if not any(t in self.idf for t in terms):
            return None
        own, other = {}, 0.0
        for t, n in Counter(terms).items():
            if t in self.idf:
                own[t] = n * self.idf[t]
            else:
                other += (n * self.other) ** 2
        held = sum(x * x for x in own.values())
        if held < (self.least - 1e-6) ** 2 * (held + other):
            return None
        norm, found = math.sqrt(held + other), None
        for name, vector in self.vectors:
            score = round(sum(x * vector[t] for t, x in own.items() if t in vector) / norm, 6)
            if score >= self.least and (found is None or (-score, name) < (-found[0], found[1])):
                found = (score, name)
        return found


@cache
def _bodies() -> tuple[list[str], dict[str, float], float, dict[str, list[tuple[int, float]]]]:
    """Licenses of the full templates, weights of their terms, that of other terms, and the unit vectors by term."""
    files = sorted(BODIES.glob("*.txt"))
    counts = [Counter(re.findall(TERM, f.read_text().lower())) for f in files]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((len(files) + 1) / (n + 1)) + 1 for t, n in df.items()}
    by_term: dict[str, list[tuple[int, float]]] = {}
    for k, c in enumerate(counts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        for t, n in c.items():
            by_term.setdefault(t, []).append((k, n * idf[t] / norm))
    return [f.name.removesuffix(".txt").removesuffix(".header") for f in files], idf, math.log(len(files) + 1) + 1, by_term


def body(text: str, terms: Counter, least: float = LEAST_BODY, templates=None) -> tuple[str, float, bool] | None:
    """License, score, and whether half of the text or more says so: by SPDX line, header or the whole text, which has
    these ``terms``."""
    names, idf, other, by_term = templates or _bodies()
    if "SPDX" in text and (said := SPDX.search(text)):
        ids = [re.sub(r"(-only|-or-later|\+)$", "", x) for x in said[1].split()]
        return " ".join(ids), 1.0, 2 * len(said[0]) >= len(text)
    best = None
    begin = PREFACE.match(text).end()
    header = COMMENT.match(text, begin)
    blocks = [(len(text), terms)] + ([(len(header[0]), Counter(re.findall(TERM, header[0].lower())))] if header else [])
    for size, counts in blocks:
        dots, square, held = [0.0] * len(names), 0.0, 0.0
        for t, n in counts.items():
            w = n * idf.get(t, other)
            square += w * w
            if t in by_term:
                held += w * w
        if not square or held < (least - 1e-6) ** 2 * square:
            continue  # what the templates lack is too much of it
        for t, n in counts.items():
            for k, x in by_term.get(t, ()):
                dots[k] += n * idf[t] * x
        for k, dot in enumerate(dots):
            score = round(dot / math.sqrt(square), 6)
            if score >= least and (best is None or (-score, names[k]) < (-best[1], best[0])):
                best = (names[k], score, 2 * size >= len(text))
    return best


def named(text: str, notices: Notices, templates) -> tuple[int, str, float, bool] | None:
    """Tier, license, score, and whether half of the text or more says so.

    Tier 0: header, whole text or SPDX line; 1: a notice; 2: a notice that only reserves the rights."""
    counts, said, found = Counter(), 0, None
    for unit in _UNIT.split(text):
        terms = re.findall(TERM, unit.lower())
        counts.update(terms)
        if best := notices.best(terms):
            said += len(unit)
            key = (2 if best[1] == "Proprietary" else 1, -best[0], best[1])
            found = key if found is None else min(found, key)
    if whole := body(text, counts, templates=templates):
        return 0, whole[0], whole[1], whole[2] or (found is not None and 2 * said >= len(text))
    return (found[0], found[2], -found[1], 2 * said >= len(text)) if found else None


def own_licenses(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, path, tier, license, score, mostly of the rows whose text names a license."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((Notices(*frequencies(docs), least), _bodies()))

    def read(batches):
        notices, templates = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(k, b) for k, t in enumerate(part.column("text").to_pylist()) if t and (b := named(t, notices, templates))]
                own = part.take(pa.array([k for k, _ in found], pa.int64()))
                columns = [pa.array([b[i] for _, b in found], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.float64(), pa.bool_()))]
                yield pa.record_batch([own.column("doc_id"), own.column("path"), *columns], ["doc_id", "path", "tier", "license", "score", "mostly"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "path", "text").mapInArrow(read, f"doc_id {kind}, path string, tier int, license string, score double, mostly boolean")


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, path, license, how ('own', 'inherited' or null), score, from_dir of every row of docs (doc_id, path, text)."""
    docs = docs.select("doc_id", "path", "text")
    first = F.min(F.struct("tier", (-F.col("score")).alias("low"), "license")).alias("b")
    own = own_licenses(docs, least).groupBy("doc_id", "path").agg(first, F.bool_or("mostly").alias("mostly"))
    own = durable(own.select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.low")).alias("score"), "mostly"), "license_own")
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    files = own.where(F.col("path").isNotNull() & (F.col("mostly") | F.col("path").rlike(FILE_NAME))).select(folder.alias("dir"), "license")
    votes = files.groupBy("dir", "license").count().groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("low"), "license")).alias("v"))
    given = votes.select(F.col("dir").alias("from_dir"), F.col("v.license").alias("given"))
    dirs = docs.where("path IS NOT NULL").select(folder.alias("dir")).distinct()
    names = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(names))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, 1, k), "/").alias("from_dir")))
    # absolute paths: the root's name and depth 0 are both the empty string
    chains = dirs.select("dir", F.explode(up).alias("u")).select("dir", "u.depth", "u.from_dir")
    nearest = chains.join(given, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "given")).alias("n"))
    nearest = durable(nearest.select("dir", F.col("n.from_dir").alias("from_dir"), F.col("n.given").alias("given")), "license_dirs")
    own = own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), "license", "score")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path"))
    joined = docs.select("doc_id", "path").join(own, same, "left").withColumn("dir", folder)
    if nearest.count() <= MOST_SENT:
        joined = joined.join(F.broadcast(nearest), "dir", "left")
    else:
        joined = split_join(joined, nearest, "dir", "license_hot_dirs", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("license", "given").alias("license"), F.when(has, "own").when(F.col("given").isNotNull(), "inherited").alias("how"), "score", F.when(~has, F.col("from_dir")).alias("from_dir")
    )


_ROWS = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))

_VOCABULARY = ", ".join(f"'{t}'" for t in vocabulary())

# the given tables hold notices alone: no header, license text or SPDX line
ORACLE = rf"""
WITH d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, text FROM documents),
n AS (SELECT doc_id, path, length(text) AS n_text, notice, regexp_extract_all(lower(notice), '{TERM}') AS terms
      FROM (SELECT doc_id, path, text, unnest(string_split(regexp_replace(text, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS notice FROM d)),
m0 AS (SELECT DISTINCT notice, terms FROM n WHERE len(terms) > 0),
t(template, license, body) AS (VALUES {_ROWS}),
b AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM t) GROUP BY 1, 2, 3),
z AS (SELECT ((SELECT count(*) FROM n WHERE len(terms) > 0) + {len(TEMPLATES)} + 1)::DOUBLE AS size),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM n UNION ALL SELECT term FROM b) WHERE term IN ({_VOCABULARY}) GROUP BY 1),
v AS (SELECT notice, term, count(*) AS tf FROM (SELECT notice, unnest(terms) AS term FROM m0) GROUP BY 1, 2),
l AS (SELECT notice, v.term, tf * (ln((SELECT size FROM z) / (coalesce(df, 0) + 1)::DOUBLE) + 1) AS w FROM v LEFT JOIN f ON f.term = v.term),
r AS (SELECT template, license, b.term, tf * (ln((SELECT size FROM z) / (df + 1)::DOUBLE) + 1) AS w FROM b JOIN f ON f.term = b.term),
ln_ AS (SELECT notice, sqrt(sum(w * w)) AS norm FROM l GROUP BY 1),
rn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1),
s AS (SELECT l.notice, r.license, round(sum(l.w * r.w) / (any_value(ln_.norm) * any_value(rn.norm)), 6) AS score
      FROM l JOIN r USING (term) JOIN ln_ ON ln_.notice = l.notice JOIN rn ON rn.template = r.template GROUP BY l.notice, r.template, r.license),
m AS (SELECT notice, license, score FROM s WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY notice ORDER BY score DESC, license) = 1),
o0 AS (SELECT doc_id, path, license, score, sum(length(notice)) OVER w * 2 >= n_text AS mostly, row_number() OVER (PARTITION BY doc_id, path ORDER BY license = 'Proprietary', score DESC, license) AS k
       FROM n JOIN m USING (notice) WINDOW w AS (PARTITION BY doc_id, path, n_text)),
o AS (SELECT * FROM o0 WHERE k = 1),
g AS (SELECT regexp_replace(path, '(^|/)[^/]*$', '') AS dir, license, count(*) AS c FROM o WHERE mostly OR regexp_matches(path, '{FILE_NAME}') GROUP BY 1, 2),
h AS (SELECT dir AS from_dir, license AS given FROM g QUALIFY row_number() OVER (PARTITION BY dir ORDER BY c DESC, license) = 1),
a AS (SELECT DISTINCT regexp_replace(path, '(^|/)[^/]*$', '') AS dir FROM d),
x AS (SELECT dir, from_dir, given FROM (SELECT dir, unnest(range(0, CASE WHEN dir = '' THEN 1 ELSE len(string_split(dir, '/')) + 1 END)) AS depth FROM a) q
      JOIN h ON h.from_dir = array_to_string(list_slice(string_split(q.dir, '/'), 1, q.depth), '/')
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT d.doc_id, d.path, coalesce(o.license, x.given) AS license, CASE WHEN o.license IS NOT NULL THEN 'own' WHEN x.given IS NOT NULL THEN 'inherited' END AS how,
       o.score, CASE WHEN o.license IS NULL THEN x.from_dir END AS from_dir
FROM d LEFT JOIN o ON d.doc_id = o.doc_id AND d.path = o.path LEFT JOIN x ON x.dir = regexp_replace(d.path, '(^|/)[^/]*$', '')
"""
