"""Operator 4, licence scans (native: SQL functions only).

Header lines (lines with a licence marker), the paragraphs that hold them, all from
the first such line to the last, and licence files (whole texts) become sparse
TF-IDF vectors; terms meet the template terms in a join, and the cosine to each
template is a grouped sum. A licence has several templates (notice, headers, titles,
SPDX lines, whole text); its score is the best of them. Files without a licence of their own take that
of the nearest ancestor directory with a licence file: directories are made
distinct, their ancestors exploded and joined to the licensed directories, the
deepest wins, and files join their directory's result.

Defined cases: null and empty texts have no licence of their own but may inherit;
null paths inherit nothing; equal scores prefer the first template by name, equal
licence files of a directory the least path; repeated rows are judged each on
its own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save
from .license_wordings import HEADERS, spdx, whole_texts

# Fixed templates: the usual notice of each licence. The SQL oracle knows these only: all licence lines of
# the tables are such notices, which score 1 whatever further templates there are.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, all rights are dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
}
MARKER = r"(?i)licen[sc]e|spdx|copyright|public domain"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"  # lines of white space or comment signs between paragraphs
LEAST = 0.6
FILE_SHARE = 0.8


def wordings() -> dict[str, list[str]]:
    """All templates of each licence."""
    texts = whole_texts()
    return {k: [*([TEMPLATES[k]] if k in TEMPLATES else []), *v, *spdx(k), *([texts[k]] if k in texts else [])] for k, v in HEADERS.items()}


def _terms(text: str) -> dict[str, int]:
    import re

    out: dict[str, int] = {}
    for t in re.findall(TERM, text.lower()):
        out[t] = out.get(t, 0) + 1
    return out


def weights(templates: dict[str, str] = TEMPLATES) -> tuple[dict[str, float], float, list[tuple[str, str, float]]]:
    """idf of template terms, idf of other terms, and rows (term, template, weight / norm)."""
    vectors = {k: _terms(v) for k, v in templates.items()}
    n = len(vectors)
    df: dict[str, int] = {}
    for v in vectors.values():
        for t in v:
            df[t] = df.get(t, 0) + 1
    idf = {t: round(math.log((1 + n) / (1 + d)) + 1, 6) for t, d in df.items()}
    rows = []
    for k, v in sorted(vectors.items()):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in v.items()))
        rows += [(t, k, round(c * idf[t] / norm, 9)) for t, c in sorted(v.items())]
    return idf, round(math.log(1 + n) + 1, 6), rows


def _tables(spark: SparkSession, templates: dict[str, list[str]]) -> tuple[DataFrame, DataFrame, float]:
    """Template weights and idf as literal tables: as many rows as the templates have terms."""
    numbered = {f"{k}#{i}": (k, t) for k, v in sorted(templates.items()) for i, t in enumerate(v)}
    idf, other, rows = weights({n: t for n, (_, t) in numbered.items()})

    def literal(values: list[tuple], schema: str) -> DataFrame:  # one string, as thousands of literals are slow to plan
        names = [c.split()[0] for c in schema.split(", ")]
        text = json.dumps([dict(zip(names, v)) for v in values])
        return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))

    return literal([(t, n, numbered[n][0], w) for t, n, w in rows], "term string, template string, license string, weight double"), literal(sorted(idf.items()), "term string, idf double"), other


def scan_licenses(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, id_col: str = "id", path_col: str = "path", text_col: str = "text", file_col: str = "is_license_file") -> DataFrame:
    """id, path, license, score, origin (own or inherited), from_path of every row; file_col marks licence files."""
    spark = files.sparkSession
    template, idf, other = _tables(spark, wordings() if templates is None else templates)
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.coalesce(F.col(file_col), F.lit(False)).alias("whole"))
    rows = rows.withColumn("content", F.xxhash64("text"))  # rows of one id and path may have different texts
    marked = rows.where(F.col("text").rlike(MARKER))
    marked = marked.withColumn("lines", F.split("text", "\n", -1)).withColumn("hits", F.transform("lines", lambda x: x.rlike(MARKER)))
    first, size = F.array_position("hits", True).cast("int"), F.size("hits")
    span = F.array_join(F.slice("lines", first, size - F.array_position(F.reverse("hits"), True).cast("int") + 2 - first), "\n")
    blocks = F.filter(F.concat("lines", F.split("text", BLANK, -1)), lambda x: x.rlike(MARKER))
    parts = F.array_distinct(F.concat(blocks, F.array(span), F.when(F.col("whole"), F.array("text")).otherwise(F.array().cast("array<string>"))))
    units = save(marked.select("id", "path", "whole", "content", F.explode(parts).alias("t")).withColumn("unit", F.md5("t")), "license-units")
    # equal units are scored once; all sums stay within the partition of their unit
    texts = units.groupBy("unit").agg(F.first("t").alias("t"))
    terms = texts.select("unit", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(TERM), F.lit(0))).alias("term"))
    counts = terms.groupBy("unit", "term").agg(F.count("*").alias("tf"))
    weighted = counts.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    normed = weighted.select("unit", "term", "w", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("unit"))).alias("norm"))
    dots = normed.join(F.broadcast(template), "term").groupBy("unit", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"))
    scored = dots.select("unit", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    best = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license")))
    of_unit = scored.groupBy("unit").agg(best.alias("b")).select("unit", "b.license", "b.score")
    own = save(units.select("id", "path", "whole", "content", "unit").join(of_unit, "unit").groupBy("id", "path", "whole", "content").agg(best.alias("b")).select("id", "path", "whole", "content", "b.license", "b.score"), "own-licenses")

    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    licensed = own.where("whole and path is not null").groupBy(folder.alias("dir")).agg(F.min_by(F.struct("license", "score", "path"), F.struct(-F.col("score"), F.col("path"), F.col("license"))).alias("l"))
    dirs = rows.where("path is not null").select(folder.alias("of")).distinct()
    parts = F.split("of", "/")
    ancestors = dirs.select("of", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))).alias("dir")).distinct()
    nearest = ancestors.join(licensed, "dir").groupBy("of").agg(F.max_by("l", F.length("dir")).alias("l"))
    mine = own.select(F.col("id").alias("i"), F.col("path").alias("p"), F.col("whole").alias("w"), F.col("content").alias("c"), "license", "score")
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("whole") == F.col("w")) & (F.col("content") == F.col("c"))
    out = rows.select("id", "path", "whole", "content", folder.alias("folder")).join(mine, same, "left").join(nearest, F.col("folder") == F.col("of"), "left")
    has = F.col("license").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("license", "l.license").alias("license"),
        F.coalesce("score", "l.score").alias("score"),
        F.when(has, "own").when(F.col("l").isNotNull(), "inherited").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("l.path")).alias("from_path"),
    )


def text_share(text):
    """The greatest share of a text's distinct terms that one licence's whole text holds."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    known = [F.from_json(F.lit(json.dumps(sorted(_terms(t)))), "array<string>") for t in whole_texts().values()]
    return F.greatest(*[F.size(F.array_intersect(terms, k)) for k in known]) / F.size(terms)


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree source/lang/id; those with a marker stand for licence files if they are short (under 400 characters, as in the SQL) or, at any length, mostly a licence's text."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    text = F.col("text")
    whole = F.when(text.rlike(MARKER), F.when(F.length(text) < 400, True).otherwise(text_share(text) >= FILE_SHARE)).otherwise(False)
    return docs.select(F.col("doc_id"), path.alias("path"), "text", whole.alias("is_license_file"))


def oracle() -> str:
    idf, other, rows = weights()
    template = ", ".join(f"('{t}', '{k}', {w}::double)" for t, k, w in rows)
    terms = ", ".join(f"('{t}', {v}::double)" for t, v in sorted(idf.items()))
    return rf"""
with template(term, license, weight) as (values {template}), idf(term, idf) as (values {terms}),
f as (select doc_id, coalesce(source, '') || '/' || coalesce(lang, '') as dir, coalesce(source, '') as top, text, coalesce(regexp_matches(text, '{MARKER}') and length(text) < 400, false) as whole from documents),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{MARKER}')) as p from f where regexp_matches(text, '{MARKER}')),
u as (select doc_id, whole, unnest(case when whole then p || [text] else p end) as t, unnest(range(len(p) + whole::int)) as unit from l),
c as (select doc_id, whole, unit, term, count(*) as tf from (select *, unnest(regexp_extract_all(lower(t), '{TERM}')) as term from u) group by all),
w as (select c.*, tf * coalesce(idf, {other}) as w from c left join idf using (term)),
n as (select doc_id, unit, sqrt(sum(w * w)) as norm from w group by all),
s as (select w.doc_id, whole, license, round(sum(w.w * weight) / any_value(norm), 6) as score from w join template using (term) join n on w.doc_id = n.doc_id and w.unit = n.unit group by w.doc_id, whole, w.unit, license),
own as (select doc_id, whole, license, score from s where score >= {LEAST} qualify row_number() over (partition by doc_id order by score desc, license) = 1),
files as (select f.doc_id, dir, top, dir || '/' || f.doc_id as path, license, score, f.whole from f left join own using (doc_id)),
lic as (select dir, license, score, path from files where whole and license is not null qualify row_number() over (partition by dir order by score desc, path) = 1)
select doc_id, files.path, coalesce(files.license, lic.license) as license, coalesce(files.score, lic.score) as score,
  case when files.license is not null then 'own' when lic.license is not null then 'inherited' end as origin,
  case when files.license is not null then files.path else lic.path end as from_path
from files left join lic on files.dir = lic.dir"""
