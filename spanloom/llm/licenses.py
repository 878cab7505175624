"""License scans: TF-IDF cosine of headers and licence files to templates, then directory inheritance.

Lines, and blocks of several lines without a blank one between, are compared with notices as headers; a text as
a whole is compared with notices and short licences, and its first block with the titles of long ones, to tell
licence files.  Inverse document frequencies of template terms are counted over all documents.  A unit can only
be like a template if the terms that they share hold most of the template's weight, so every template has
some rare terms of which such a unit must have one; texts and units without any such term are passed over, and no
unit that could reach the limit is.  Documents are read twice: for the counts, and for those units.

A licence file speaks for its directory.  Directories without one take the licence of their nearest ancestor
that has one, by a join on ancestor paths; that is settled once per directory, so files then meet one row of
their own directory.  Only DataFrame functions are used.

Defined cases: null texts have no licence of their own, null ids are judged like others; null parts of a path
read as ``-``; ties between templates go to the first name, ties between licence files of one directory to the
first path, then the first name; rows with equal ids or paths are judged each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import cut, table

from .license_texts import TAGS, TEMPLATES

NAME = "op2_license_scan"

HEADER_LIKENESS, FILE_LIKENESS = 0.7, 0.7
TERM = r"[a-z0-9]+(?:\.[0-9]+)?"
#: What parts blocks: a line break, nothing but signs, and another.
BLANK = r"\n[^A-Za-z0-9\n]*\n"
#: Which kinds of templates each kind of unit is compared with, and what it is evidence of.
UNITS = {"line": ("header", ("notice",)), "block": ("header", ("notice",)), "whole": ("file", ("notice", "text")), "opening": ("file", ("title",))}


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))


def _terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def _weights(templates, idf: dict[str, float]) -> list[dict[str, float]]:
    return [{t: n * idf[t] for t, n in _terms(text).items()} for _, _, text in templates]


def cover(weights: list[dict[str, float]], least: float, idf: dict[str, float]) -> set[str]:
    """Terms of which any text must have one to reach a cosine of ``least`` to some template: the rarest ones
    of each, until what is left is shorter than that share of it."""
    found = set()
    for of in weights:
        left = sum(w * w for w in of.values())
        enough = left * (least * 0.999) ** 2
        for term, w in sorted(of.items(), key=lambda x: (-idf[x[0]], x[0])):
            if left < enough:
                break
            found.add(term)
            left -= w * w
    return found


def _among(text: Column, words: set[str]) -> Column:
    return F.coalesce(F.arrays_overlap(terms_of(text), F.array(*map(F.lit, sorted(words)))), F.lit(False))


def _units(rows: DataFrame, words: set[str]) -> DataFrame:
    """row, unit, pos, term, tf of every unit that has one of the words."""
    blocks = F.split("text", BLANK)
    opening = F.split(F.regexp_replace("text", r"^[ \t\n\r\f]+", ""), BLANK, 2)[0]
    named = [("line", F.split("text", "\n")), ("block", F.filter(blocks, lambda x: x.contains("\n"))), ("whole", F.array("text")), ("opening", F.array(opening))]
    as_units = lambda unit, of: F.transform(of, lambda x, i: F.struct(F.lit(unit).alias("unit"), i.alias("pos"), x.alias("text")))  # noqa: E731
    every = F.concat(*(as_units(unit, of) for unit, of in named))
    of = rows.select("row", F.explode(F.filter(every, lambda x: _among(x["text"], words))).alias("u"))
    terms = of.select("row", "u.unit", "u.pos", F.explode(terms_of(F.col("u.text"))).alias("term"))
    return terms.groupBy("row", "unit", "pos", "term").agg(F.count(F.lit(1)).alias("tf"))


def _best(found: DataFrame, kind: str, least: float) -> DataFrame:
    """The template most like a unit of each row, where it is like enough."""
    units = [u for u, (of, _) in UNITS.items() if of == kind]
    top = found.where(F.col("unit").isin(units) & (F.col("likeness") >= least)).groupBy("row").agg(F.min(F.struct((-F.col("likeness")).alias("less"), "name")).alias("top"))
    return top.select("row", F.col("top.name").alias(f"{kind}_license"), (-F.col("top.less")).alias(f"{kind}_likeness"))


def scan(files: DataFrame, keep: tuple[str, ...] = (), templates=TEMPLATES + TAGS) -> DataFrame:
    """files: path, text.  path, license, origin (file, header, inherited, none), likeness, and the columns named
    in keep."""
    spark = files.sparkSession
    words = sorted({t for _, _, text in templates for t in _terms(text)})
    # One row for each template term, and one for all files under a name that is no term.
    held = F.concat(F.array(F.lit("")), F.array_intersect(terms_of(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, words))))
    df = {r.term: r.df for r in files.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    n_files = df.pop("", 0)
    idf = {t: math.log((n_files + 1) / (df.get(t, 0) + 1)) + 1 for t in words}
    unseen = math.log(n_files + 1) + 1
    weights = _weights(templates, idf)
    hints = cover(weights, min(HEADER_LIKENESS, FILE_LIKENESS), idf)

    # A number for each row, fixed by the checkpoint; only texts with a hint are written.
    text = F.when(_among(F.col("text"), hints), F.col("text"))
    rows = cut(files.select(F.monotonically_increasing_id().alias("row"), "path", text.alias("text"), *(F.col(c).alias(f"kept_{c}") for c in keep)))
    flat = [(v, name, kind, t, w, math.sqrt(sum(x * x for x in of.values()))) for v, ((name, kind, _), of) in enumerate(zip(templates, weights)) for t, w in of.items()]
    weighed = F.broadcast(spark.createDataFrame(flat, "variant int, name string, kind string, term string, weight double, norm double"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    units = cut(_units(rows.where("text IS NOT NULL").select("row", "text"), hints)).join(known, "term", "left")
    at = ["row", "unit", "pos"]
    square = units.groupBy(*at).agg(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(unseen)), F.lit(2.0))).alias("square"))
    fits = F.lit(False)
    for unit, (_, kinds) in UNITS.items():
        fits = fits | (F.col("unit") == unit) & F.col("kind").isin(*kinds)
    dots = units.join(weighed, "term").where(fits).groupBy(*at, "variant", "name", "norm").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    found = cut(dots.join(square, at).select("row", "unit", "name", F.round(F.col("dot") / (F.sqrt("square") * F.col("norm")), 6).alias("likeness")).where(F.col("likeness") >= min(HEADER_LIKENESS, FILE_LIKENESS)))

    placed = rows.drop("text").withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    marked = placed.join(_best(found, "file", FILE_LIKENESS), "row", "left").join(_best(found, "header", HEADER_LIKENESS), "row", "left")
    of_dir = marked.where("file_license IS NOT NULL").groupBy("dir").agg(F.min(F.struct("path", "file_license")).alias("by"))
    of_dir = of_dir.select(F.col("dir").alias("from_dir"), F.col("by.file_license").alias("dir_license"))
    dirs = placed.select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("from_dir"))
    nearest = above.join(of_dir, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "dir_license")).alias("near")).select("dir", F.col("near.dir_license").alias("inherited"))
    out = marked.join(nearest, "dir", "left")
    origin = F.when(F.col("file_license").isNotNull(), "file").when(F.col("header_license").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    kept = (F.col(f"kept_{c}").alias(c) for c in keep)
    return out.select(*kept, "path", F.coalesce("file_license", "header_license", "inherited").alias("license"), origin.alias("origin"), F.coalesce("file_likeness", "header_likeness").alias("likeness"))


def paths_of(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: source/lang/hundreds/doc_id."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("-"))  # noqa: E731
    path = F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(F.floor(F.col("doc_id") / 100)), part(F.col("doc_id")))
    return docs.select("doc_id", path.alias("path"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(paths_of(table(spark, sf_dir, "documents")), ("doc_id",))


def _values() -> str:
    quoted = ", ".join("({}, '{}', '{}', '{}')".format(v, n, k, t.replace("'", "''")) for v, (n, k, t) in enumerate(TEMPLATES + TAGS))
    return f"(VALUES {quoted}) AS v(variant, name, kind, notice)"


ORACLE_SQL = rf"""
WITH t AS (
  SELECT variant, name, kind, term, count(*) AS tf FROM (SELECT variant, name, kind, unnest(regexp_extract_all(lower(notice), '{TERM}')) AS term FROM {_values()}) GROUP BY ALL
), f AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, text, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce(floor(doc_id / 100)::BIGINT::VARCHAR, '-'), coalesce(doc_id::VARCHAR, '-')) AS path FROM documents
), df AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{TERM}'))) AS term FROM f) GROUP BY term
), n AS (SELECT count(*) AS n_files FROM f),
idf AS (
  SELECT v.term, ln((n_files + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) + 1 AS idf, ln(n_files + 1.0::DOUBLE) + 1 AS unseen
  FROM (SELECT DISTINCT term FROM t) v LEFT JOIN df USING (term), n
), w AS (SELECT variant, name, kind, term, tf * idf AS weight FROM t JOIN idf USING (term)),
norm AS (SELECT variant, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY variant),
s AS (
  SELECT row, 'line' AS unit, string_split(text, chr(10)) AS l FROM f WHERE text IS NOT NULL
  UNION ALL SELECT row, 'block', list_filter(string_split_regex(text, '{BLANK}'), lambda x: contains(x, chr(10))) FROM f WHERE text IS NOT NULL
  UNION ALL SELECT row, 'whole', [text] FROM f WHERE text IS NOT NULL
  UNION ALL SELECT row, 'opening', [string_split_regex(regexp_replace(text, '^[ 	

]+', ''), '{BLANK}')[1]] FROM f WHERE text IS NOT NULL
), p AS (SELECT row, unit, generate_subscripts(l, 1) AS pos, unnest(l) AS text FROM s),
u AS (SELECT row, unit, pos, term, count(*) AS tf FROM (SELECT row, unit, pos, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM p) GROUP BY ALL),
ui AS (SELECT u.*, idf, (SELECT max(unseen) FROM idf) AS unseen FROM u LEFT JOIN idf USING (term)),
sq AS (SELECT row, unit, pos, sum((tf * coalesce(idf, unseen)) ** 2) AS square FROM ui GROUP BY ALL),
dot AS (SELECT row, unit, pos, variant, name, sum(tf * idf * weight) AS dot FROM ui JOIN w USING (term)
        WHERE (unit IN ('line', 'block') AND kind = 'notice') OR (unit = 'whole' AND kind IN ('notice', 'text')) OR (unit = 'opening' AND kind = 'title') GROUP BY ALL),
l AS (SELECT row, unit, name, round(dot / (sqrt(square) * norm), 6) AS likeness FROM dot JOIN sq USING (row, unit, pos) JOIN norm USING (variant)),
fl AS (SELECT row, arg_min(name, (-likeness, name)) AS license, max(likeness) AS likeness FROM l WHERE unit IN ('whole', 'opening') AND likeness >= {FILE_LIKENESS} GROUP BY row),
hl AS (SELECT row, arg_min(name, (-likeness, name)) AS license, max(likeness) AS likeness FROM l WHERE unit IN ('line', 'block') AND likeness >= {HEADER_LIKENESS} GROUP BY row),
m AS (
  SELECT f.row, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, fl.license AS fl, fl.likeness AS fk, hl.license AS hl, hl.likeness AS hk
  FROM f LEFT JOIN fl ON f.row = fl.row LEFT JOIN hl ON f.row = hl.row
), od AS (SELECT dir AS from_dir, arg_min(fl, (path, fl)) AS dl FROM m WHERE fl IS NOT NULL GROUP BY dir),
near AS (
  SELECT d.dir, arg_max(dl, length(from_dir)) AS inherited
  FROM (SELECT DISTINCT dir FROM m) d JOIN od ON d.dir = from_dir OR starts_with(d.dir, from_dir || '/') GROUP BY d.dir
)
SELECT doc_id, path, coalesce(fl, hl, inherited) AS license,
       CASE WHEN fl IS NOT NULL THEN 'file' WHEN hl IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       coalesce(fk, hk) AS likeness
FROM m LEFT JOIN near USING (dir)
"""
