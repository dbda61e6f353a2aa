"""License scans (operator 1), with DataFrame functions only.

Whole texts are cut into lines and sentences; those with a licence cue are notices. An SPDX line is its first identifier.
Of a licence file (by name) every paragraph and the whole text are notices too. Each different notice is a sparse TF-IDF
vector (document frequencies over all notices of the corpus) and is compared by cosine with licence templates, which are
header lines, titles, SPDX identifiers and, where they are short, whole licences. A document's own licence is the template
of its best notice at `least` or more, ties going to the smaller name. Directories get the licence that most of their
licence files have, ties again to the smaller name, and a document without one of its own inherits from the nearest
directory upwards that has one, by joins on the paths of all ancestors.

A null or blank text has no notice, a very long one is looked through whole; a null path has no directory, so nothing is
inherited; null or repeated doc_ids are rows of their own; without any notice all licences are null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.operators.joins import spread_join
from graphspark.session import cut

LEAST = 0.6
CUE = r"(?i)licen[cs]e|copyright|all rights reserved|spdx|public domain|redistribution and use|permission is hereby granted|permission to use, copy"
SPDX = r"(?i)spdx-license-identifier\s*:\s*\(?\s*([a-z0-9][a-z0-9.+-]*)"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"

#: How licences are referred to, and their titles.
LINES = (
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Licences short enough to be held whole.
WHOLE = (
    (
        "mit",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)

#: SPDX identifiers; those of the GNU family also stand with a suffix.
IDENTIFIERS = {"agpl-3.0": "AGPL-3.0", "apache-2.0": "Apache-2.0", "bsd-3-clause": "BSD-3-Clause", "cc-by-4.0": "CC-BY-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc0-1.0": "CC0-1.0", "gpl-2.0": "GPL-2.0", "gpl-3.0": "GPL-3.0", "isc": "ISC", "lgpl-3.0": "LGPL-3.0", "mit": "MIT", "mpl-2.0": "MPL-2.0", "unlicense": "Unlicense"}
SUFFIXES = ("", "-only", "-or-later")

TEMPLATES = (*LINES, *WHOLE, *((n, f"SPDX-License-Identifier: {i}{x}") for n, i in IDENTIFIERS.items() for x in (SUFFIXES if "gpl" in n else SUFFIXES[:1])))


def terms(text: Column) -> Column:
    """Words of a notice, one blank between; of an SPDX line one word made of its first identifier."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    identifier = F.regexp_replace(F.lower(F.regexp_extract(text, SPDX, 1)), "[^a-z0-9]", "")
    return F.when(text.rlike(SPDX), F.concat(F.lit("spdxid"), identifier)).otherwise(words)


def notices(text: Column, whole: Column | None = None) -> Column:
    """Array of the normalised lines and sentences that hold a cue; where `whole` is true also the paragraphs, and all of the text."""
    parts = F.split(F.regexp_replace(text, r"([.!?]) ", "$1\n"), "\n")
    found = F.transform(F.filter(parts, lambda p: p.rlike(CUE)), terms)
    if whole is not None:
        paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike(CUE))
        more = F.transform(F.concat(paragraphs, F.array(text)), lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " ")))
        found = F.when(whole, F.concat(found, more)).otherwise(found)
    return F.when(text.rlike(CUE), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(k).alias("template"), F.lit(t).alias("line")) for k, (n, t) in enumerate(TEMPLATES)))
    return spark.range(1).select(F.inline(rows)).select("licence", "template", terms(F.col("line")).alias("line"))


def _counted(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Term frequencies: keys, term, tf."""
    return df.select(*keys, F.explode(F.split(line, " ")).alias("term")).where(F.col("term") != "").groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def best_templates(lines: DataFrame, least: float = LEAST) -> DataFrame:
    """`lines` (notice, n: its occurrences) with the best template: (notice, licence, score), where one reaches `least`."""
    spark = lines.sparkSession
    tf = cut(_counted(lines, ["notice", "n"], "notice"))
    total = F.lit(lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    df = tf.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("rows"))
    ours = _counted(templates(spark), ["licence", "template"], "line")
    weights = cut(df.join(ours.select("term").distinct(), "term", "full").select("term", (F.log((1 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"), F.coalesce("rows", F.lit(0)).alias("rows")))
    # words such as "license" are in every notice
    theirs = spread_join(tf, weights, ["term"], "rows", tf.count()).select("notice", "term", (F.col("tf") * F.col("idf")).alias("w"))
    known = ours.join(weights, "term").select("licence", "template", "term", (F.col("tf") * F.col("idf")).alias("t"))
    norms = known.groupBy("licence", "template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("t_norm"))
    lengths = theirs.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w_norm"))
    # known and norms hold the terms of the fixed templates: both broadcasts are bounded.
    dots = theirs.join(F.broadcast(known), "term").groupBy("notice", "licence", "template").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scores = dots.join(F.broadcast(norms), ["licence", "template"]).join(lengths, "notice").select("notice", "licence", F.round(F.col("dot") / (F.col("t_norm") * F.col("w_norm")), 6).alias("score"))
    best = scores.where(F.col("score") >= least).groupBy("notice").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("licence"))).alias("b"))
    return best.select("notice", "b.licence", (-F.col("b.s")).alias("score"))


def licence_scan(files: DataFrame, licence_file: Column | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, path, own_licence, own_score, licence, inherited_from of every row of files (doc_id, path, text).

    `licence_file` says which files speak for their directory: by default, those so named. Only those so named are also read
    as a whole.
    """
    named = F.coalesce(F.element_at(F.split(files["path"], "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    speaks = licence_file if licence_file is not None else named
    folder = F.when(files["path"].contains("/"), F.regexp_replace(files["path"], "/[^/]*$", ""))
    slim = cut(files.select(files["doc_id"].cast("long").alias("doc_id"), files["path"], folder.alias("folder"), F.coalesce(speaks, F.lit(False)).alias("speaks"), notices(files["text"], named).alias("notices")))
    row = ["doc_id", "path", "folder", "speaks"]
    some = slim.where(F.size("notices") > 0).groupBy(*row, "notices").agg(F.count("*").alias("rows"))
    said = some.select(*row, "notices", "rows", F.explode("notices").alias("notice"))
    best = best_templates(said.groupBy("notice").agg(F.sum("rows").alias("n")), least)
    own = said.join(best, "notice", "left").groupBy(*row, "notices", "rows").agg(F.min(F.when(F.col("licence").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l")))).alias("b"))
    own = own.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(*row, F.col("b.l").alias("own_licence"), (-F.col("b.s")).alias("own_score"))
    every = cut(own.union(slim.where(F.size("notices") == 0).select(*row, F.lit(None).cast("string"), F.lit(None).cast("double"))))
    votes = every.where(F.col("speaks") & F.col("own_licence").isNotNull() & F.col("folder").isNotNull()).groupBy("folder", "own_licence").agg(F.count("*").alias("n"))
    folders = votes.groupBy("folder").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("own_licence").alias("l"))).alias("b")).select(F.col("folder").alias("ancestor"), F.col("b.l").alias("folder_licence"))
    parts = F.split("folder", "/")
    upwards = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor")))
    bare = every.where(F.col("own_licence").isNull())
    placed = cut(bare.where(F.col("folder").isNotNull()).groupBy("folder").agg(F.count("*").alias("n")))
    above = placed.select("folder", F.inline(upwards))
    nearest = above.join(folders, "ancestor").groupBy("folder").agg(F.max(F.struct("depth", "ancestor", "folder_licence")).alias("b")).select("folder", F.col("b.ancestor").alias("from"), F.col("b.folder_licence").alias("folder_licence"))
    lookup = cut(placed.join(nearest, "folder", "left"))
    inherited = spread_join(bare.where(F.col("folder").isNotNull()), lookup, ["folder"], "n", placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    columns = ["doc_id", "path", "own_licence", "own_score"]
    none = F.lit(None).cast("string")
    own = every.where(F.col("own_licence").isNotNull()).select(*columns, F.col("own_licence").alias("licence"), none.alias("inherited_from"))
    return own.union(inherited.select(*columns, "folder_licence", "from")).union(bare.where(F.col("folder").isNull()).select(*columns, none, none))


def document_paths(docs: DataFrame) -> DataFrame:
    """`documents` has no paths: source and doc_id stand for them, in folders of 64 within folders of 4,096 within the source's.

    Of three documents one is in each kind of folder, so licences are inherited over up to two levels.
    """
    d = docs["doc_id"].cast("long")
    upper, lower = (F.concat(F.lit("/"), F.floor(d / n).cast("string")) for n in (4096, 64))
    place = F.pmod(d, F.lit(3))
    folder = F.concat(docs["source"], F.when(place == 0, "").when(place == 1, upper).otherwise(F.concat(upper, lower)))
    return docs.select("doc_id", F.concat(folder, F.lit("/"), d.cast("string"), F.lit(".txt")).alias("path"), "text")


def oracle_sql() -> str:
    values = ", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate(TEMPLATES))
    cue, spdx = CUE.removeprefix("(?i)"), SPDX.removeprefix("(?i)")

    def norm(c: str) -> str:
        return f"CASE WHEN regexp_matches({c}, '{spdx}', 'i') THEN 'spdxid' || regexp_replace(lower(regexp_extract({c}, '{spdx}', 1, 'i')), '[^a-z0-9]', '', 'g') ELSE trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')) END"

    return f"""
WITH files AS (
  SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/' || CAST(doc_id // 4096 AS VARCHAR) ELSE '/' || CAST(doc_id // 4096 AS VARCHAR) || '/' || CAST(doc_id // 64 AS VARCHAR) END AS folder, text FROM documents),
ours AS (SELECT template, licence, unnest(string_split({norm('line')}, ' ')) AS term FROM (VALUES {values}) v(template, licence, line)),
ourtf AS (SELECT template, licence, term, count(*) AS tf FROM ours WHERE term <> '' GROUP BY ALL),
lines AS (SELECT doc_id, folder, unnest(string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))) AS line FROM files WHERE regexp_matches(text, '{cue}', 'i')),
said AS (SELECT DISTINCT doc_id, folder, {norm('line')} AS notice FROM lines WHERE regexp_matches(line, '{cue}', 'i')),
distinct_notices AS (SELECT notice, count(*) AS n FROM said GROUP BY notice),
tf AS (SELECT notice, n, term, count(*) AS tf FROM (SELECT notice, n, unnest(string_split(notice, ' ')) AS term FROM distinct_notices) WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT coalesce(sum(n), 0) FROM distinct_notices)) / (1 + coalesce(df, 0))) + 1 AS idf FROM df FULL JOIN (SELECT DISTINCT term FROM ourtf) USING (term)),
w AS (SELECT notice, term, tf * idf AS w FROM tf JOIN idf USING (term)),
t AS (SELECT template, licence, term, tf * idf AS t FROM ourtf JOIN idf USING (term)),
score AS (
  SELECT notice, licence, round(dot / (tn * wn), 6) AS score
  FROM (SELECT notice, template, licence, sum(w * t) AS dot FROM w JOIN t USING (term) GROUP BY ALL)
  JOIN (SELECT template, sqrt(sum(t * t)) AS tn FROM t GROUP BY template) USING (template)
  JOIN (SELECT notice, sqrt(sum(w * w)) AS wn FROM w GROUP BY notice) USING (notice)),
best AS (SELECT notice, licence, score FROM score WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY notice ORDER BY score DESC, licence) = 1),
own AS (SELECT doc_id, licence AS own_licence, score AS own_score FROM said JOIN best USING (notice) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
every AS (SELECT doc_id, folder, own_licence, own_score FROM files LEFT JOIN own USING (doc_id)),
folders AS (
  SELECT folder AS ancestor, own_licence AS folder_licence FROM (SELECT folder, own_licence, count(*) AS n FROM every WHERE own_licence IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, own_licence) = 1),
above AS (
  SELECT folder, k AS depth, array_to_string(list_slice(string_split(folder, '/'), 1, k), '/') AS ancestor
  FROM (SELECT DISTINCT folder FROM every WHERE own_licence IS NULL) CROSS JOIN (VALUES (1), (2), (3)) ks(k)),
nearest AS (SELECT folder, ancestor, folder_licence FROM above JOIN folders USING (ancestor) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY depth DESC) = 1)
SELECT doc_id, folder || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, own_licence, own_score,
  coalesce(own_licence, folder_licence) AS licence, CASE WHEN own_licence IS NULL THEN ancestor END AS inherited_from
FROM every LEFT JOIN nearest USING (folder)
"""
