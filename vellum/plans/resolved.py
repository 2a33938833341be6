"""Queries that look things up: works and journals by similar titles, styles over their chains, settings over their layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import formats, settings, similarity, styles
from vellum.operators.specs import PRESETS
from vellum.plans.scalar import A, B, lit, query, read

#: Ratios of pairs (id, x, y) by longest common runs, as SQL: each step takes the first longest run of every open interval,
#: and opens those before and after it.
RATIOS = """
cx AS (SELECT id, unnest(range(1, length(x) + 1)) AS i, unnest(string_split(x, '')) AS c FROM pairs),
cy AS (SELECT id, unnest(range(1, length(y) + 1)) AS j, unnest(string_split(y, '')) AS c FROM pairs),
same AS (SELECT cx.id, i, j FROM cx JOIN cy ON cx.id = cy.id AND cx.c = cy.c),
cut(id, i0, i1, j0, j1, size) AS (
  SELECT id, 1, length(x), 1, length(y), 0 FROM pairs
  UNION ALL
  SELECT id, CASE WHEN side = 0 THEN i0 ELSE s + n END, CASE WHEN side = 0 THEN s - 1 ELSE i1 END,
         CASE WHEN side = 0 THEN j0 ELSE s - d + n END, CASE WHEN side = 0 THEN s - d - 1 ELSE j1 END, CASE WHEN side = 0 THEN n ELSE 0 END
  FROM (
    SELECT *, row_number() OVER (PARTITION BY id, i0, i1, j0, j1 ORDER BY n DESC, s, s - d) AS place FROM (
      SELECT id, i0, i1, j0, j1, d, min(i) AS s, count(*) AS n FROM (
        SELECT cut.id, i0, i1, j0, j1, i, i - j AS d, i - row_number() OVER (PARTITION BY cut.id, i0, i1, j0, j1, i - j ORDER BY i) AS island
        FROM cut JOIN same ON cut.id = same.id AND i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1
      ) GROUP BY id, i0, i1, j0, j1, d, island
    )
  ), (VALUES (0), (1)) v(side) WHERE place = 1
), ratio AS (SELECT p.id, p.x, p.y, 2.0::DOUBLE * sum(size) / (length(p.x) + length(p.y)) AS similarity FROM pairs p JOIN cut ON p.id = cut.id GROUP BY p.id, p.x, p.y)
"""

#: The beginning of each document as a title, and the same changed as citations change titles: capitals, letters and words.
_TITLE = "trim(substr(replace(text, chr(10), ' '), 1, 40 + CAST(doc_id % 50 AS INTEGER)))"
_CITED = f"""CASE doc_id % 6 WHEN 0 THEN translate({_TITLE}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 1 THEN 'On ' || substr({_TITLE}, 4) || ' revisited' WHEN 2 THEN replace({_TITLE}, 'e', 'o')
  WHEN 3 THEN substr({_TITLE}, 1, 16) || ' and what else there is to say' WHEN 4 THEN replace(substr({_TITLE}, 8), ',', ' -') ELSE substr({_TITLE}, 1, 18) END"""
_FOLDED = "lower(regexp_replace(translate({c}, " + f"{lit(A)}, {lit(B)}" + r"), '\p{{Mn}}', '', 'g'))"


@query(rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_TITLE} AS title, {_CITED} AS cited, '10.5555/' || doc_id AS doi, CASE WHEN doc_id % 7 = 0 THEN '10.5555/own' ELSE '' END AS own FROM documents
), t AS (SELECT *, {_FOLDED.format(c='title')} AS x, CASE WHEN own = '' AND length(cited) >= 20 THEN {_FOLDED.format(c='cited')} END AS y FROM w),
k AS (SELECT t.x, min(t.doi) AS doi, arg_min(t.title, t.doi) AS title FROM t WHERE t.x <> '' GROUP BY t.x),
r AS (SELECT x, unnest(list_distinct(list_transform(range(0, greatest(length(x) - 8, 0) + 1), lambda i: substr(x, i + 1, 8)))) AS run FROM k),
q AS (SELECT y, unnest(list_distinct(list_transform(range(0, greatest(length(y) - 8, 0) + 1), lambda i: substr(y, i + 1, 8)))) AS run FROM (SELECT DISTINCT y FROM t WHERE y <> '')),
pairs AS (SELECT row_number() OVER () AS id, x, y FROM (SELECT DISTINCT x, y FROM r JOIN q USING (run))),
{RATIOS},
best AS (SELECT y, arg_min(x, (-similarity, x)) AS x, max(similarity) AS similarity FROM ratio WHERE similarity >= 0.75 GROUP BY y)
SELECT t.doc_id, CAST(0 AS BIGINT) AS k, coalesce(k.doi, t.own) AS doi, coalesce(k.title, t.cited) AS title, best.similarity, k.doi IS NOT NULL AS verified
FROM t LEFT JOIN best USING (y) LEFT JOIN k ON k.x = best.x
""")  # fmt: skip
def title_match(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    own = F.when(F.col("doc_id") % 7 == 0, "10.5555/own").otherwise("")
    nothing = {c: F.lit("") for c in ("container", "volume", "year")}
    works = docs.select(F.concat(F.lit("10.5555/"), "doc_id").alias("doi"), F.expr(_TITLE).alias("title"), *[c.alias(n) for n, c in nothing.items()])
    refs = docs.select("doc_id", F.lit(0).cast("bigint").alias("k"), own.alias("doi"), F.expr(_CITED).alias("title"), *[c.alias(n) for n, c in nothing.items()])
    return similarity.enrich_by_title(refs, works).drop("container", "volume", "year")


_PUBLISHERS = ["Springer Nature", "MDPI", "IEEE", "Acme Press", "Wiley"]
_OF_PART = "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(_PUBLISHERS)) + " END"
_ASKED = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 's and ' || substr(p_name, 1, 4) WHEN 2 THEN 'Sensors' WHEN 3 THEN substr(p_name, 3) || ' ' || lower(substr(p_type, 1, 5)) ELSE p_brand || ' ' || p_type END"


@query(f"""
WITH RECURSIVE j AS (SELECT lower(p_name) AS x, min((p_name, {_OF_PART}, 'issn ' || p_name)) AS o FROM part GROUP BY 1),
n AS (SELECT DISTINCT trim({_ASKED}) AS name, lower(trim({_ASKED})) AS y FROM part),
pairs AS (SELECT row_number() OVER () AS id, x, y FROM j, (SELECT DISTINCT y FROM n)),
{RATIOS},
best AS (SELECT y, arg_min(x, (-similarity, x)) AS x, max(similarity) AS similarity FROM ratio GROUP BY y HAVING max(similarity) > 0.6)
SELECT name, coalesce(o[1], name) AS title, coalesce(o[2], '') AS publisher, coalesce(o[3], '') AS issn, similarity,
  CASE WHEN name = 'Sensors' THEN 'mdpi' ELSE CASE o[2] WHEN 'Springer Nature' THEN 'springer_numeric' WHEN 'MDPI' THEN 'mdpi' WHEN 'IEEE' THEN 'ieee_journal' WHEN 'Wiley' THEN 'wiley' END END AS preset,
  CASE WHEN name = 'Sensors' THEN 'name' WHEN o[2] IN ('Springer Nature', 'MDPI', 'IEEE', 'Wiley') THEN 'publisher' ELSE '' END AS source
FROM n LEFT JOIN best USING (y) LEFT JOIN j USING (x)
""")  # fmt: skip
def journal_match(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    journals = parts.select(F.col("p_name").alias("title"), F.expr(_OF_PART).alias("publisher"), F.concat(F.lit("issn "), "p_name").alias("issn"))
    return similarity.lookup_journals(parts.select(F.expr(_ASKED).alias("name")), journals)


#: For each document 4 to 17 styles; each builds on a later one, the last on nothing, itself, the first or a missing one. Which
#: state something comes from the letters of the text.
_STYLES = """
SELECT doc_id, 's' || i AS style,
  CASE WHEN i < n - 1 THEN 's' || (i + 1 + CASE WHEN (doc_id + i) % 5 = 0 AND i < n - 2 THEN 1 ELSE 0 END) ELSE CASE doc_id % 4 WHEN 1 THEN 's' || i WHEN 2 THEN 's0' WHEN 3 THEN 'gone' END END AS based_on,
  CASE WHEN ascii(substr(text, CAST(i * 7 + 1 AS INTEGER), 1)) % 9 = 0 THEN true WHEN ascii(substr(text, CAST(i * 7 + 1 AS INTEGER), 1)) % 9 = 1 THEN false END AS numbered,
  CASE WHEN ascii(substr(text, CAST(i * 5 + 2 AS INTEGER), 1)) % 13 = 0 THEN true END AS caps,
  CASE WHEN ascii(substr(text, CAST(i * 3 + 3 AS INTEGER), 1)) % 17 = 0 THEN true END AS hidden
FROM (SELECT doc_id, text, 4 + doc_id % 14 AS n FROM {documents}) d JOIN {counts} ON i < n
"""
_NUMBERS = "(VALUES " + ", ".join(f"({i})" for i in range(17)) + ")"


@query(f"""
WITH RECURSIVE s AS ({_STYLES.format(documents='documents', counts=_NUMBERS + ' c(i)')}),
walk AS (
  SELECT doc_id, style, based_on, numbered, caps, hidden, 0 AS far FROM s
  UNION ALL SELECT w.doc_id, w.style, s.based_on, s.numbered, s.caps, s.hidden, w.far + 1 FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.style = w.based_on WHERE w.far < 9
), r AS (
  SELECT doc_id, style, arg_min(numbered, far) FILTER (numbered IS NOT NULL) AS numbered, arg_min(caps, far) FILTER (caps IS NOT NULL) AS caps, arg_min(hidden, far) FILTER (hidden IS NOT NULL AND far < 9) AS hidden
  FROM walk GROUP BY doc_id, style
)
SELECT doc_id, pos, style, coalesce(own, numbered, false) AS numbered, coalesce(caps, false) AS caps, coalesce(hidden, false) AS hidden
FROM (SELECT doc_id, CAST(i AS BIGINT) AS pos, 's' || (doc_id + i * 3) % 19 AS style, CASE WHEN (doc_id + i) % 6 = 0 THEN true END AS own FROM documents, (VALUES (0), (1), (2), (3), (4)) v(i)) p
LEFT JOIN r USING (doc_id, style)
""")  # fmt: skip
def style_chains(spark, sf_dir):
    """Numbering, capitals and hiding of paragraphs as their styles' chains have it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = spark.sql(_STYLES.format(documents="{docs}", counts="{counts}"), docs=docs, counts=spark.range(17).select(F.col("id").cast("int").alias("i")))
    own = docs.select("doc_id", F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("pos", "i"))
    own = own.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("s"), (F.col("doc_id") + F.col("i") * 3) % 19).alias("style"))
    own = own.withColumns({"numbered": F.when((F.col("doc_id") + F.col("pos")) % 6 == 0, True), "caps": F.lit(None).cast("boolean"), "hidden": F.lit(None).cast("boolean")})
    return styles.inherited(own, made)


_KEYS = list(PRESETS)
_PRESET = "CASE doc_id % 15 " + " ".join(f"WHEN {i} THEN {lit(k)}" for i, k in enumerate(_KEYS)) + " END"
#: Guidelines, a template and the author's own settings, each as (path, value); null states nothing. In one document of eleven a
#: plain value takes the place of the group font, in another a group that of a plain value.
_LAYERS = [
    [("font.size", "CAST(9 + doc_id % 4 AS STRING) || '.0'"), ("limits.abstract_words", "CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS STRING) END"), ("references.style", "CASE WHEN doc_id % 4 = 1 THEN 'vancouver' END")],
    [("headings.levels[0].bold", "CASE WHEN doc_id % 2 = 0 THEN 'false' END"), ("headings.levels[5].size", "CASE WHEN doc_id % 5 = 0 THEN '7.5' END"), ("font.family", "lang"), ("font", "CASE WHEN doc_id % 11 = 3 THEN source END")],
    [("font.family", "CASE WHEN doc_id % 3 = 1 THEN source END"), ("headings.levels[0].case", "CASE WHEN doc_id % 6 = 2 THEN 'upper' END"), ("title.note", "source"), ("page.size.name", "CASE WHEN doc_id % 11 = 5 THEN lang END")],
]


def _rows(layer: list[tuple[str, str]], prefix: str = "") -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {prefix}{lit(p)} AS path, {v.replace('STRING', 'VARCHAR')} AS value FROM documents" for p, v in layer)


def _settings_sql() -> str:
    stated = ", ".join(f"({lit(k)}, {lit(p)}, {'NULL' if v is None else lit(v)})" for k in _KEYS for p, v in settings.flat(formats.preset(k)))
    layers = " UNION ALL ".join(_rows(layer, f"{n} AS layer, ") for n, layer in enumerate(_LAYERS, 1))
    return f"""
WITH p(preset, path, value) AS (VALUES {stated}),
r AS (SELECT doc_id, 0 AS layer, path, value FROM documents JOIN p ON p.preset = {_PRESET} UNION ALL SELECT doc_id, layer, path, value FROM ({layers})),
l AS (SELECT doc_id, path, layer, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY layer DESC) AS n FROM r WHERE value IS NOT NULL) WHERE n = 1)
SELECT doc_id, path, layer, value FROM l
WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND (starts_with(l.path, o.path || '.') OR starts_with(l.path, o.path || '[')) AND o.layer > l.layer)
  AND NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND (starts_with(o.path, l.path || '.') OR starts_with(o.path, l.path || '[')) AND o.layer >= l.layer)
"""


def _in_force(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("preset", F.expr(_PRESET))
    layers = [docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.expr(v).alias("value")) for p, v in layer])).alias("x")).select("doc_id", "x.*") for layer in _LAYERS]
    return settings.for_documents(docs.select("doc_id", "preset"), layers)


@query(_settings_sql())
def settings_layers(spark, sf_dir):
    """Every setting of every document, with the layer that states it."""
    return _in_force(spark, sf_dir)


@query(f"""
SELECT doc_id, max(value) FILTER (path = 'page.size') AS page_size, max(value) FILTER (path = 'font.family') AS font, max(value) FILTER (path = 'font.size')::DOUBLE AS font_size,
  max(value) FILTER (path = 'references.style') AS ref_style, max(value) FILTER (path = 'citations.mode') AS cite_mode, max(value) FILTER (path = 'limits.abstract_words')::INTEGER AS abstract_words, count(*) AS n
FROM ({_settings_sql()}) GROUP BY doc_id
""")  # fmt: skip
def settings_of_documents(spark, sf_dir):
    """The settings in force as typed columns, a row a document."""
    made = settings.as_struct(_in_force(spark, sf_dir), ["doc_id"])
    return made.select("doc_id", "page_size", "font", "font_size", "ref_style", "cite_mode", "abstract_words", F.size("settings").cast("bigint").alias("n"))


@query(f"""
SELECT doc_id, n + 1 AS n, max(value) FILTER (name = 'size')::DOUBLE AS size, max(value) FILTER (name = 'bold')::BOOLEAN AS bold, max(value) FILTER (name = 'italic')::BOOLEAN AS italic,
  max(value) FILTER (name = 'case') AS "case", max(value) FILTER (name = 'align') AS align
FROM (SELECT *, regexp_extract(path, '\\[(\\d+)\\]', 1)::INTEGER AS n, regexp_extract(path, '\\.(\\w+)$', 1) AS name FROM ({_settings_sql()}) WHERE path LIKE 'headings.levels[%') GROUP BY doc_id, n
""")  # fmt: skip
def settings_levels(spark, sf_dir):
    """The heading levels in force, a row a level."""
    return settings.levels(_in_force(spark, sf_dir), ["doc_id"])
