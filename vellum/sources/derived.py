"""Deterministic manuscripts derived from the documents table.

The prose tables hold no scholarly structure, so references, citations, headings, captions and floats are generated
around each document's own lines, with one SQL text that Spark and other engines read alike (integer arithmetic, CASE,
joins and concatenation only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.sources.shared import once

FAMILIES = ["García", "Müller", "Smith", "Kowalski", "Dubois", "O''Brien", "Nguyen", "Sánchez", "Larsen", "Rossi", "Ivanov", "Okafor"]
INITIALS = [("A.B.", "A. B.", "AB"), ("C.", "C.", "C"), ("D.E.", "D. E.", "DE"), ("F.", "F.", "F"), ("G.", "G.", "G"), ("H.J.", "H. J.", "HJ"), ("K.", "K.", "K")]
ADJECTIVES = ["robust", "scalable", "hybrid", "Bayesian", "lightweight", "distributed", "causal", "sparse"]
NOUNS = ["anomaly detection", "traffic forecasting", "image retrieval", "energy storage", "crop monitoring", "speech synthesis", "fraud screening", "route planning", "drug discovery", "wind estimation"]
FIELDS = ["Applied", "Nordic", "Embedded", "Marine", "Urban", "Digital"]


def values(rows: list) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(quote(x) for x in (i, *(r if isinstance(r, tuple) else (r,)))) + ")" for i, r in enumerate(rows)) + ")"


REFS = f"""
WITH fam AS (SELECT * FROM {values(FAMILIES)} AS t(i, family)), ini AS (SELECT * FROM {values(INITIALS)} AS t(i, dotted, spaced, bare)),
adj AS (SELECT * FROM {values(ADJECTIVES)} AS t(i, adj)), noun AS (SELECT * FROM {values(NOUNS)} AS t(i, noun)), fld AS (SELECT * FROM {values(FIELDS)} AS t(i, fld)),
ks AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) AS t(k)),
base AS (
  SELECT d.doc_id, CAST(ks.k AS BIGINT) AS k, CASE WHEN d.doc_id % 5 < 2 AND ks.k = 1 THEN 0 ELSE ks.k END AS kk
  FROM {{documents}} d JOIN ks ON ks.k <= 5 + d.doc_id % 4
), pick AS (
  SELECT doc_id, k, CASE WHEN doc_id % 5 < 2 AND k < 2 THEN 2 ELSE 1 + (doc_id + k) % 3 END AS na,
    (doc_id * 7 + kk * 5) % 12 AS f1, (doc_id * 5 + k * 11 + 1) % 12 AS f2, (doc_id * 3 + k * 7 + 2) % 12 AS f3,
    (doc_id + k) % 7 AS i1, (doc_id + 2 * k + 1) % 7 AS i2, (2 * doc_id + k + 3) % 7 AS i3,
    (doc_id + k) % 8 AS ia, (doc_id + 3 * k) % 10 AS ino, (doc_id + k) % 6 AS ifl,
    CAST(1990 + (doc_id * 3 + kk * 7) % 33 AS STRING) AS year,
    CASE WHEN doc_id % 5 = 0 AND k = 0 THEN 'a' WHEN doc_id % 5 = 0 AND k = 1 THEN 'b' ELSE '' END AS suffix,
    CAST(1 + (doc_id + k * 3) % 40 AS STRING) AS volume, CAST(1 + (doc_id + k) % 6 AS STRING) AS issue,
    CAST(100 + (doc_id * 11 + k * 13) % 800 AS STRING) || '–' || CAST(109 + (doc_id * 11 + k * 13) % 800 AS STRING) AS pages,
    '10.1234/' || CAST(doc_id AS STRING) || '.' || CAST(k AS STRING) AS doi
  FROM base
), named AS (
  SELECT p.doc_id, p.k, p.na, a.family AS family1, b.family AS family2, c.family AS family3, x.dotted AS ini1, y.dotted AS ini2, z.dotted AS ini3,
    x.spaced AS sp1, y.spaced AS sp2, z.spaced AS sp3, x.bare AS br1, y.bare AS br2, z.bare AS br3,
    'A ' || adj.adj || ' approach to ' || noun.noun AS title,
    CASE WHEN p.k % 4 = 3 THEN 'Proceedings of the ' || fld.fld || ' Conference' ELSE 'Journal of ' || fld.fld || ' Systems' END AS container,
    CASE WHEN p.k % 4 = 3 THEN 'conference' ELSE 'journal' END AS kind, p.year, p.suffix, p.volume, p.issue, p.pages, p.doi
  FROM pick p JOIN fam a ON a.i = p.f1 JOIN fam b ON b.i = p.f2 JOIN fam c ON c.i = p.f3 JOIN ini x ON x.i = p.i1 JOIN ini y ON y.i = p.i2 JOIN ini z ON z.i = p.i3
    JOIN adj ON adj.i = p.ia JOIN noun ON noun.i = p.ino JOIN fld ON fld.i = p.ifl
)
SELECT n.doc_id, n.k, CAST(n.na AS BIGINT) AS na, n.family1, n.family2, n.family3, n.ini1, n.ini2, n.ini3, n.title, n.container, n.kind, n.year, n.suffix, n.volume, n.issue, n.pages, n.doi,
  CASE n.doc_id % 6
    WHEN 0 THEN '[' || CAST(n.k + 1 AS STRING) || '] ' || CASE n.na WHEN 1 THEN sp1 || ' ' || family1 WHEN 2 THEN sp1 || ' ' || family1 || ' and ' || sp2 || ' ' || family2
           ELSE sp1 || ' ' || family1 || ', ' || sp2 || ' ' || family2 || ', and ' || sp3 || ' ' || family3 END
           || ', “' || title || ',” ' || CASE WHEN kind = 'conference' THEN 'in ' ELSE '' END || container || ', vol. ' || volume || ', no. ' || issue || ', pp. ' || pages || ', ' || year || suffix || ', doi: ' || doi || '.'
    WHEN 1 THEN CASE n.na WHEN 1 THEN family1 || ', ' || sp1 WHEN 2 THEN family1 || ', ' || sp1 || ', ' || family2 || ', ' || sp2
           ELSE family1 || ', ' || sp1 || ', ' || family2 || ', ' || sp2 || ', and ' || family3 || ', ' || sp3 END
           || ' ' || year || suffix || '. “' || title || '.” ' || container || ' ' || volume || ' (' || issue || '): ' || pages || '. https://doi.org/' || doi
    WHEN 2 THEN CAST(n.k + 1 AS STRING) || '. ' || family1 || ', ' || ini1 || CASE WHEN n.na > 1 THEN ', ' || family2 || ', ' || ini2 ELSE '' END || CASE WHEN n.na > 2 THEN ', ' || family3 || ', ' || ini3 ELSE '' END
           || ': ' || title || '. ' || container || ' ' || volume || '(' || issue || '), ' || pages || ' (' || year || suffix || '). https://doi.org/' || doi
    WHEN 3 THEN family1 || ', ' || sp1 || CASE WHEN n.na = 2 THEN ', & ' || family2 || ', ' || sp2 WHEN n.na = 3 THEN ', ' || family2 || ', ' || sp2 || ', & ' || family3 || ', ' || sp3 ELSE '' END
           || ' (' || year || suffix || '). ' || title || '. ' || container || ', ' || volume || '(' || issue || '), ' || pages || '. https://doi.org/' || doi
    WHEN 4 THEN family1 || ', ' || ini1 || CASE WHEN n.na = 2 THEN ' and ' || family2 || ', ' || ini2 WHEN n.na = 3 THEN ', ' || family2 || ', ' || ini2 || ' and ' || family3 || ', ' || ini3 ELSE '' END
           || ' ' || year || suffix || '. ' || title || '. ' || container || ', ' || volume || '(' || issue || '), pp. ' || pages || '. doi: ' || doi
    ELSE CAST(n.k + 1 AS STRING) || '. ' || family1 || ' ' || br1 || CASE WHEN n.na > 1 THEN ', ' || family2 || ' ' || br2 ELSE '' END || CASE WHEN n.na > 2 THEN ', ' || family3 || ' ' || br3 ELSE '' END
           || '. ' || title || '. ' || container || '. ' || year || suffix || ';' || volume || '(' || issue || '):' || pages || '. doi:' || doi
  END AS raw
FROM named n
"""

#: The one part that engines write differently: a document's lines with their numbers.
LINES_SPARK = "SELECT doc_id, CAST(ln AS BIGINT) AS ln, line FROM {documents} LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n', -1)) l AS ln, line"
LINES_OTHER = "SELECT doc_id, CAST(i - 1 AS BIGINT) AS ln, u AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS u, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {documents}) s"

SECTIONS = ["Introduction", "Methods", "Results", "Discussion", "Acknowledgements"]

BLOCKS = f"""
WITH refs AS (SELECT doc_id, k, na, family1, family2, year, suffix, raw FROM ({{refs}}) r0),
lines AS (SELECT doc_id, ln, trim(line) AS line FROM ({{lines}}) l0 WHERE trim(line) <> ''),
sec AS (SELECT * FROM {values(SECTIONS)} AS t(i, section)),
cited AS (
  SELECT l.doc_id, l.ln, l.line, 6 + l.doc_id % 4 AS n, (l.doc_id + l.ln) % (6 + l.doc_id % 4) AS k1, (l.doc_id * 3 + l.ln * 5 + 1) % (6 + l.doc_id % 4) AS k2 FROM lines l
), body AS (
  SELECT c.doc_id, c.ln, c.line, c.k1, c.k2, c.n,
    a.family1 || CASE WHEN a.na = 2 THEN ' and ' || a.family2 WHEN a.na > 2 THEN ' et al.' ELSE '' END AS cite1, a.year || a.suffix AS y1,
    b.family1 || CASE WHEN b.na = 2 THEN ' & ' || b.family2 WHEN b.na > 2 THEN ' et al.' ELSE '' END AS cite2, b.year || b.suffix AS y2
  FROM cited c JOIN refs a ON a.doc_id = c.doc_id AND a.k = c.k1 JOIN refs b ON b.doc_id = c.doc_id AND b.k = c.k2
)
SELECT doc_id, CAST(0 AS BIGINT) AS pos, 'title' AS role, 'A study of manuscript number ' || CAST(doc_id AS STRING) AS text, CAST(NULL AS BIGINT) AS level, CAST(NULL AS STRING) AS cap_kind, CAST(NULL AS BIGINT) AS cap_num FROM {{documents}}
UNION ALL SELECT doc_id, 1, 'author', 'Maria Lopez¹, John Doe² and Wei Chen¹', NULL, NULL, NULL FROM {{documents}}
UNION ALL SELECT doc_id, 2, 'affiliation', '¹Department of Computing, University of Nowhere, India', NULL, NULL, NULL FROM {{documents}}
UNION ALL SELECT doc_id, 3, 'abstract', 'Abstract: We study document ' || CAST(doc_id AS STRING) || ' in detail and report what was found.', NULL, NULL, NULL FROM {{documents}}
UNION ALL SELECT doc_id, 4, 'keywords', CASE doc_id % 3 WHEN 0 THEN 'Keywords: alpha; Beta gamma; IoT; delta' WHEN 1 THEN 'Keywords: Alpha, beta (x, y), GAMMA' ELSE 'Index Terms: one · two · Three word term' END, NULL, NULL, NULL FROM {{documents}}
UNION ALL SELECT b.doc_id, 100 + b.ln * 10 + 1, 'heading', CASE WHEN b.ln % 15 = 12 THEN '' WHEN b.ln % 2 = 0 THEN '1. ' ELSE 'II. ' END || s.section, 1, NULL, NULL FROM body b JOIN sec s ON s.i = (b.ln / 3) % 5 WHERE b.ln % 3 = 0
UNION ALL SELECT b.doc_id, 100 + b.ln * 10 + 2, 'heading', '2.1 Data preparation', 2, NULL, NULL FROM body b WHERE b.ln % 4 = 2
UNION ALL SELECT b.doc_id, 100 + b.ln * 10 + 3, 'heading', '2.1.3 Further details', 3, NULL, NULL FROM body b WHERE b.ln % 8 = 6
UNION ALL SELECT b.doc_id, 100 + b.ln * 10 + 5, 'para',
  b.line || ' See Figure ' || CAST(1 + (b.ln + 2) % 5 AS STRING) || ' and Tables ' || CAST(1 + b.ln % 3 AS STRING) || ' and ' || CAST(2 + b.ln % 3 AS STRING) || ' for it' ||
  CASE WHEN b.doc_id % 2 = 0 THEN CASE b.ln % 4 WHEN 0 THEN ' [' || CAST(b.k1 + 1 AS STRING) || ', ' || CAST(b.k2 + 1 AS STRING) || '].' WHEN 1 THEN ' [1–4] and [' || CAST(b.k2 + 1 AS STRING) || '].'
         WHEN 2 THEN ' [' || CAST(b.k2 + 1 AS STRING) || '].' ELSE ' [99].' END
       ELSE CASE b.ln % 4 WHEN 0 THEN ' (' || b.cite1 || ', ' || b.y1 || '; ' || b.cite2 || ', ' || b.y2 || ').' WHEN 1 THEN ', whereas ' || b.cite1 || ' (' || b.y1 || ') disagreed (' || b.cite2 || ', ' || b.y2 || ').'
         WHEN 2 THEN ' (e.g., ' || b.cite2 || ', ' || b.y2 || ').' ELSE ' (Unknown, 2031).' END END, NULL, NULL, NULL FROM body b
UNION ALL SELECT b.doc_id, 100 + b.ln * 10 + 6, 'figure', '', NULL, NULL, NULL FROM body b WHERE b.ln % 4 = 1
UNION ALL SELECT b.doc_id, 100 + b.ln * 10 + 7, 'caption', 'Figure ' || CAST(1 + (b.ln * 3 + 4) % 7 AS STRING) || '. Course of training' || CASE WHEN b.ln % 8 = 1 THEN '.' ELSE '' END, NULL, 'figure', 1 + (b.ln * 3 + 4) % 7 FROM body b WHERE b.ln % 4 = 1
UNION ALL SELECT b.doc_id, 100 + b.ln * 10 + 8, 'caption', 'Table ' || CAST(1 + (b.ln * 2 + 1) % 5 AS STRING) || ': Summary of data', NULL, 'table', 1 + (b.ln * 2 + 1) % 5 FROM body b WHERE b.ln % 4 = 3
UNION ALL SELECT b.doc_id, 100 + b.ln * 10 + 9, 'table', '', NULL, NULL, NULL FROM body b WHERE b.ln % 4 = 3
UNION ALL SELECT doc_id, 100000000, 'heading', 'References', 1, NULL, NULL FROM {{documents}} WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id, 100000001 + k, 'reference', raw, NULL, NULL, NULL FROM refs
"""


def refs_sql(documents: str) -> str:
    return REFS.format(documents=documents)


def blocks_sql(documents: str, lines: str = LINES_OTHER) -> str:
    return BLOCKS.format(documents=documents, refs=refs_sql(documents), lines=lines.format(documents=documents))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, na, family1.., ini1.., title, container, kind, year, suffix, volume, issue, pages, doi, raw."""
    return once(spark, "refs", sf_dir, lambda: spark.sql(refs_sql("{d}"), d=documents(spark, sf_dir).select("doc_id", "text")))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, role (the true one), text, level, cap_kind, cap_num. Written once: its many branches would be planned anew
    under every operator above."""
    return once(spark, "blocks", sf_dir, lambda: made_blocks(spark, documents(spark, sf_dir).select("doc_id", "text")))


def made_blocks(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of BLOCKS. What a line cites follows from its document's id and its place, so each document gives its blocks by
    itself and no text is shuffled; where ids are null, negative or repeated, the joins decide."""
    odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL OR doc_id < 0")
    if odd.limit(1).count():
        return spark.sql(blocks_sql("{d}", LINES_SPARK), d=docs)
    return spark.sql(OF_EACH.format(lines=LINES_SPARK.format(documents="{d}"), refs=REFS.format(documents="{d}")), d=docs)


def cited(k: str) -> dict[str, str]:
    """The columns of REFS that a citation shows, for reference k of a document."""
    kk = f"CASE WHEN doc_id % 5 < 2 AND {k} = 1 THEN 0 ELSE {k} END"
    family = lambda i: f"element_at(array({', '.join(f"'{f}'" for f in FAMILIES)}), CAST({i} AS INT) + 1)"
    return {
        "na": f"CASE WHEN doc_id % 5 < 2 AND {k} < 2 THEN 2 ELSE 1 + (doc_id + {k}) % 3 END", "family1": family(f"((doc_id * 7 + {kk} * 5) % 12)"), "family2": family(f"((doc_id * 5 + {k} * 11 + 1) % 12)"),
        "year": f"CAST(1990 + (doc_id * 3 + {kk} * 7) % 33 AS STRING) || CASE WHEN doc_id % 5 = 0 AND {k} = 0 THEN 'a' WHEN doc_id % 5 = 0 AND {k} = 1 THEN 'b' ELSE '' END",
    }


def block(pos: str, role: str, text: str, level: str = "NULL", kind: str = "NULL", num: str = "NULL", when: str = "true") -> str:
    return f"IF({when}, named_struct('pos', CAST({pos} AS BIGINT), 'role', '{role}', 'text', {text}, 'level', CAST({level} AS BIGINT), 'cap_kind', CAST({kind} AS STRING), 'cap_num', CAST({num} AS BIGINT)), NULL)"


_SHOWN = ", ".join(f"{sql} AS {name}_{k}" for k in ("k1", "k2") for name, sql in cited(k).items())
_AT = "100 + ln * 10 + "
_CITING = """line || ' See Figure ' || CAST(1 + (ln + 2) % 5 AS STRING) || ' and Tables ' || CAST(1 + ln % 3 AS STRING) || ' and ' || CAST(2 + ln % 3 AS STRING) || ' for it' ||
  CASE WHEN doc_id % 2 = 0 THEN CASE ln % 4 WHEN 0 THEN ' [' || CAST(k1 + 1 AS STRING) || ', ' || CAST(k2 + 1 AS STRING) || '].' WHEN 1 THEN ' [1–4] and [' || CAST(k2 + 1 AS STRING) || '].' WHEN 2 THEN ' [' || CAST(k2 + 1 AS STRING) || '].' ELSE ' [99].' END
  ELSE CASE ln % 4 WHEN 0 THEN ' (' || cite1 || ', ' || year_k1 || '; ' || cite2 || ', ' || year_k2 || ').' WHEN 1 THEN ', whereas ' || cite1 || ' (' || year_k1 || ') disagreed (' || cite2 || ', ' || year_k2 || ').'
    WHEN 2 THEN ' (e.g., ' || cite2 || ', ' || year_k2 || ').' ELSE ' (Unknown, 2031).' END END"""
_FIGURE, _TABLE = "1 + (ln * 3 + 4) % 7", "1 + (ln * 2 + 1) % 5"
_OF_LINE = [
    block(_AT + "1", "heading", f"CASE WHEN ln % 15 = 12 THEN '' WHEN ln % 2 = 0 THEN '1. ' ELSE 'II. ' END || element_at(array({', '.join(f"'{x}'" for x in SECTIONS)}), CAST(ln DIV 3 % 5 AS INT) + 1)", "1", when="ln % 3 = 0"),
    block(_AT + "2", "heading", "'2.1 Data preparation'", "2", when="ln % 4 = 2"),
    block(_AT + "3", "heading", "'2.1.3 Further details'", "3", when="ln % 8 = 6"),
    block(_AT + "5", "para", _CITING),
    block(_AT + "6", "figure", "''", when="ln % 4 = 1"),
    block(_AT + "7", "caption", f"'Figure ' || CAST({_FIGURE} AS STRING) || '. Course of training' || CASE WHEN ln % 8 = 1 THEN '.' ELSE '' END", "NULL", "'figure'", _FIGURE, "ln % 4 = 1"),
    block(_AT + "8", "caption", f"'Table ' || CAST({_TABLE} AS STRING) || ': Summary of data'", "NULL", "'table'", _TABLE, "ln % 4 = 3"),
    block(_AT + "9", "table", "''", when="ln % 4 = 3"),
]
_OF_DOCUMENT = [
    block("0", "title", "'A study of manuscript number ' || CAST(doc_id AS STRING)"), block("1", "author", "'Maria Lopez¹, John Doe² and Wei Chen¹'"), block("2", "affiliation", "'¹Department of Computing, University of Nowhere, India'"),
    block("3", "abstract", "'Abstract: We study document ' || CAST(doc_id AS STRING) || ' in detail and report what was found.'"),
    block("4", "keywords", "CASE doc_id % 3 WHEN 0 THEN 'Keywords: alpha; Beta gamma; IoT; delta' WHEN 1 THEN 'Keywords: Alpha, beta (x, y), GAMMA' ELSE 'Index Terms: one · two · Three word term' END"),
    block("100000000", "heading", "'References'", "1", when="doc_id % 7 <> 0"),
]
#: BLOCKS for ids that are different and not negative, each row from one document's row alone.
OF_EACH = f"""
WITH lines AS (SELECT doc_id, ln, trim(line) AS line, (doc_id + ln) % (6 + doc_id % 4) AS k1, (doc_id * 3 + ln * 5 + 1) % (6 + doc_id % 4) AS k2 FROM ({{lines}}) l0 WHERE trim(line) <> ''),
shown AS (SELECT *, {_SHOWN} FROM lines),
body AS (SELECT *, family1_k1 || CASE WHEN na_k1 = 2 THEN ' and ' || family2_k1 WHEN na_k1 > 2 THEN ' et al.' ELSE '' END AS cite1, family1_k2 || CASE WHEN na_k2 = 2 THEN ' & ' || family2_k2 WHEN na_k2 > 2 THEN ' et al.' ELSE '' END AS cite2 FROM shown)
SELECT doc_id, b.* FROM (SELECT doc_id, explode(array_compact(array({', '.join(_OF_LINE)}))) AS b FROM body)
UNION ALL SELECT doc_id, b.* FROM (SELECT doc_id, explode(array_compact(array({', '.join(_OF_DOCUMENT)}))) AS b FROM {{{{d}}}})
UNION ALL SELECT doc_id, 100000001 + k, 'reference', raw, CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT) FROM ({{refs}}) r0
"""


def with_authors(refs: DataFrame) -> DataFrame:
    """The authors as array<struct<family, initials>>."""
    from pyspark.sql import functions as F

    all_three = F.array(*[F.struct(F.col(f"family{i}").alias("family"), F.col(f"ini{i}").alias("initials")) for i in (1, 2, 3)])
    return refs.withColumn("authors", F.slice(all_three, 1, F.col("na").cast("int")))
