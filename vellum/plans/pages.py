"""Queries over text boxes: a page for each document, built by one SQL text that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import layout, page_code
from vellum.plans.scalar import query, read
from vellum.sources import derived

#: Blocks of a page in reading order: y, x0, x1. A title, two columns, a wide block, two columns again.
PLACES = [(50, 60, 530), (100, 60, 280), (200, 60, 280), (300, 60, 280), (100, 310, 530), (210, 310, 530), (310, 310, 530), (400, 60, 530), (450, 60, 280), (520, 60, 280), (450, 310, 530)]


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


_BOXES = f"""SELECT d.doc_id, CAST(0 AS BIGINT) AS page, CAST((v.i * 7 + d.doc_id) % 11 AS BIGINT) AS block, CAST(v.i AS BIGINT) AS i, CAST(v.y + d.doc_id % 3 AS DOUBLE) AS y0, CAST(v.y + 60 + d.doc_id % 3 AS DOUBLE) AS y1,
CAST(v.x0 AS DOUBLE) AS x0, CAST(v.x1 AS DOUBLE) AS x1, 'a block of some words ' || CAST(v.i AS STRING) AS text FROM {{documents}} d JOIN (SELECT * FROM {values([(i, *p) for i, p in enumerate(PLACES)])} AS t(i, y, x0, x1)) v ON v.i <= 6 + d.doc_id % 5"""


@query(f"SELECT doc_id, block, i + 1 AS place FROM ({_BOXES.format(documents='documents')}) b")
def reading_order(spark, sf_dir):
    """Blocks of two-column pages in the order in which they are read."""
    b = spark.sql(_BOXES, documents=derived.documents(spark, sf_dir))
    return layout.reading_order(b).select("doc_id", "block", "place")


_WORDS = f"""SELECT d.doc_id, CAST(0 AS BIGINT) AS page, CAST(100 + c.c * 130 + w.w * 44 + d.doc_id % 5 AS DOUBLE) AS x0, CAST(140 + c.c * 130 + w.w * 44 + d.doc_id % 5 AS DOUBLE) AS x1, CAST(100 + r.r * 20 + w.w AS DOUBLE) AS y0, CAST(110 + r.r * 20 + w.w AS DOUBLE) AS y1,
'r' || CAST(r.r AS STRING) || 'c' || CAST(c.c AS STRING) || CASE w.w WHEN 1 THEN 'b' ELSE '' END AS text
FROM {{documents}} d JOIN (SELECT * FROM {values([(0,), (1,), (2,), (3,)])} AS t(r)) r ON r.r <= 1 + d.doc_id % 3 JOIN (SELECT * FROM {values([(0,), (1,), (2,)])} AS t(c)) c ON c.c <> 1 OR r.r <> 1 JOIN (SELECT * FROM {values([(0,), (1,)])} AS t(w)) w ON w.w = 0 OR c.c = 2"""
_RULES = f"""SELECT d.doc_id, CAST(0 AS BIGINT) AS page, CAST(90 + v.i AS DOUBLE) AS x0, CAST(560 + v.i AS DOUBLE) AS x1, CAST(v.y AS DOUBLE) AS y0, CAST(v.y + 1 AS DOUBLE) AS y1 FROM {{documents}} d, (SELECT * FROM {values([(0, 95), (1, 118), (0, 190)])} AS t(i, y)) v"""


@query("""SELECT doc_id, 'r0c0|r0c1|r0c2 r0c2b/r1c0||r1c2 r1c2b' || CASE WHEN doc_id % 3 > 0 THEN '/r2c0|r2c1|r2c2 r2c2b' ELSE '' END || CASE WHEN doc_id % 3 > 1 THEN '/r3c0|r3c1|r3c2 r3c2b' ELSE '' END AS cells FROM documents""")
def ruled_tables(spark, sf_dir):
    """Cells of tables that only have horizontal rules, from the places of their words."""
    docs = derived.documents(spark, sf_dir)
    boxes = layout.ruled_boxes(spark.sql(_RULES, documents=docs))
    t = layout.word_tables(spark.sql(_WORDS, documents=docs), boxes)
    return t.select("doc_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("cells"))


#: A page: sentence, formula with its number in a block of its own, sentence, formula with the number in the line.
FORMULAS = [
    (0, 0, 100, 60, 500, 112, "The energy of a node is given by the sum below.", "Times", 0), (1, 0, 130, 200, 300, 142, "E = P t", "CMMI10", 2), (2, 0, 131, 480, 500, 143, "(1)", "Times", 0),
    (3, 0, 170, 60, 500, 182, "After this the delay follows from it as well here.", "Times-Bold", 16), (4, 0, 200, 200, 300, 212, "D = x", "CMSY10", 0), (4, 1, 200, 480, 500, 212, "(2)", "Times", 0), (5, 0, 240, 60, 90, 252, "x2", "NimbusRomNo9L-Regu", 1),
]
_SPANS = f"""SELECT d.doc_id, CAST(0 AS BIGINT) AS page, CAST(v.b AS BIGINT) AS block, CAST(0 AS BIGINT) AS line, CAST(v.s AS BIGINT) AS span, CAST(v.y0 + d.doc_id % 7 AS DOUBLE) AS y0, CAST(v.x0 AS DOUBLE) AS x0, CAST(v.x1 AS DOUBLE) AS x1, CAST(v.y1 + d.doc_id % 7 AS DOUBLE) AS y1,
v.text, v.font, CAST(v.flags AS INT) AS flags, CAST(10 AS DOUBLE) AS size FROM {{documents}} d, (SELECT * FROM {values(FORMULAS)} AS t(b, s, y0, x0, x1, y1, text, font, flags)) v"""


@query("""SELECT doc_id, CAST(n AS BIGINT) AS n, eq_num, x0, y0 + doc_id % 7 AS y0, x1, y1 + doc_id % 7 AS y1 FROM documents, (VALUES (1, '1', CAST(198 AS DOUBLE), CAST(128 AS DOUBLE), CAST(302 AS DOUBLE), CAST(144 AS DOUBLE)), (2, '2', 198, 198, 302, 214)) v(n, eq_num, x0, y0, x1, y1)""")
def page_equations(spark, sf_dir):
    """Formulas on pages with their numbers and boxes."""
    return layout.equations(spark.sql(_SPANS, documents=derived.documents(spark, sf_dir))).drop("page")


@query("SELECT doc_id, CAST(b AS BIGINT) AS block, m AS is_math FROM documents, (VALUES (0, false), (1, true), (2, true), (3, false), (4, true), (5, false)) v(b, m)")
def math_blocks(spark, sf_dir):
    return layout.math_blocks(spark.sql(_SPANS, documents=derived.documents(spark, sf_dir))).drop("page")


@query("SELECT doc_id, CAST(b AS BIGINT) AS block, bold, italic, sup FROM documents, (VALUES (0, false, false, false), (1, false, true, false), (2, false, false, false), (3, true, false, false), (4, false, false, false), (5, false, false, true)) v(b, bold, italic, sup)")
def span_marks(spark, sf_dir):
    """Emphasis of lines by the flags and fonts of their spans."""
    lines = layout.line_runs(spark.sql(_SPANS, documents=derived.documents(spark, sf_dir)))
    first = F.get("runs", F.lit(0))
    return lines.select("doc_id", "block", first["bold"].alias("bold"), first["italic"].alias("italic"), first["sup"].alias("sup"))


_LINES = """SELECT doc_id, CAST(0 AS BIGINT) AS page, CAST(0 AS BIGINT) AS block, CAST(v.i AS BIGINT) AS line, CAST(v.i * 12 + v.dy AS DOUBLE) AS y0, CAST(v.i * 12 + v.dy + 10 AS DOUBLE) AS y1, CAST(v.x AS DOUBLE) AS x0, CAST(v.x + 90 AS DOUBLE) AS x1, v.t || CASE v.i WHEN 0 THEN CAST(d.doc_id AS STRING) ELSE '' END AS text
FROM {documents} d, (SELECT * FROM (VALUES (0, 0, 60, 'Number '), (1, 0, 60, 'of a hyphen-'), (2, 0, 60, 'ated word'), (3, 0, 60, '• first point'), (4, 0, 72, 'goes on'), (5, 0, 60, '[2] A reference'), (6, -11, 160, 'beside it'), (7, 0, 60, 'Keywords: a; b')) AS t(i, dy, x, t)) v"""


@query("""SELECT doc_id, CAST(p AS BIGINT) AS part, t || CASE p WHEN 0 THEN doc_id || ' of a hyphenated word' ELSE '' END AS text FROM documents, (VALUES (0, 'Number '), (1, '• first point goes on'), (2, '[2] A reference beside it'), (3, 'Keywords: a; b')) v(p, t)""")
def page_paragraphs(spark, sf_dir):
    """Lines of a block as paragraphs."""
    lines = spark.sql(_LINES, documents=derived.documents(spark, sf_dir))
    return layout.paragraphs(lines, F.lit(True)).select("doc_id", "part", "text")


@query("""SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(r AS BIGINT) AS "row", CAST(s AS BIGINT) AS indent FROM documents, (VALUES (0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0), (4, 5, 1), (5, 6, 0), (6, 6, 8), (7, 7, 0)) v(line, r, s)""")
def line_rows(spark, sf_dir):
    """Fragments on one baseline as rows, and the indents of their steps."""
    lines = spark.sql(_LINES, documents=derived.documents(spark, sf_dir))
    return layout.code_indents(layout.baselines(lines)).select("doc_id", "line", "row", "indent")


@query("""SELECT doc_id, to_block AS joined, CAST(b AS BIGINT) AS block FROM (SELECT doc_id, v.b, CAST(v.j AS BIGINT) AS to_block FROM documents, (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 4), (7, 4)) v(b, j)) z""")
def joined_baselines(spark, sf_dir):
    """Blocks that go on on the baseline of another one."""
    docs = derived.documents(spark, sf_dir)
    more = """SELECT doc_id, CAST(0 AS BIGINT) AS page, CAST(v.b AS BIGINT) AS block, CAST(0 AS BIGINT) AS line, CAST(v.y AS DOUBLE) AS y0, CAST(v.y + 10 AS DOUBLE) AS y1, CAST(v.x0 AS DOUBLE) AS x0, CAST(v.x1 AS DOUBLE) AS x1
    FROM {documents} d, (SELECT * FROM (VALUES (0, 10, 60, 200), (1, 40, 60, 200), (2, 40, 300, 400), (3, 70, 60, 90), (4, 100, 60, 100), (5, 130, 60, 100), (6, 101, 105, 150), (7, 99, 160, 200)) AS t(b, y, x0, x1)) v"""
    return layout.joined_baselines(spark.sql(more, documents=docs)).select("doc_id", "joined", "block")


@query("""SELECT doc_id, 'A4' AS page_size, CASE WHEN doc_id % 5 >= 3 THEN 1 ELSE 2 END AS columns FROM documents""")
def sample_format(spark, sf_dir):
    """Paper and columns of sample pages; fewer columns where most blocks are wide."""
    docs = derived.documents(spark, sf_dir)
    b = spark.sql(_BOXES, documents=docs).withColumn("text", F.repeat(F.col("text"), 2))
    wide = (F.col("doc_id") % 5 >= 3)
    b = b.withColumn("x1", F.when(wide, F.lit(530.0)).otherwise(F.col("x1"))).withColumn("x0", F.when(wide, F.lit(60.0)).otherwise(F.col("x0")))
    return layout.sample_format(b, spark.sql(_SPANS, documents=docs)).select("doc_id", "page_size", "columns")


#: Four rows a page of 1 to 40 pieces each, as wide as the document says, with a gap before one of them; the numbers of the
#: blocks don't follow their places.
_PIECES = """
SELECT doc_id, CAST(0 AS BIGINT) AS page, CAST(r * 100 + (p * 7) % 41 AS BIGINT) AS block, CAST(0 AS BIGINT) AS line, CAST(r * 50 + 10 + (doc_id + p) % 3 AS DOUBLE) AS y0, CAST(r * 50 + 20 + (doc_id + p) % 3 AS DOUBLE) AS y1,
  CAST(10 + p * (12 + doc_id % 5) + CASE WHEN p >= m THEN 60 ELSE 0 END AS DOUBLE) AS x0, CAST(20 + p * (12 + doc_id % 5) + CASE WHEN p >= m THEN 60 ELSE 0 END AS DOUBLE) AS x1, r, p, m
FROM (SELECT doc_id, 1 + n_chars % 30 AS m FROM {documents}) d JOIN {rows} ON true JOIN {pieces} ON p < 1 + (doc_id * 7 + r * 13) % 40
"""


@query(f"SELECT doc_id, block, CAST(r * 100 + CASE WHEN p >= m THEN (m * 7) % 41 ELSE 0 END AS BIGINT) AS joined FROM ({_PIECES.format(documents='documents', rows='(VALUES (0), (1), (2), (3)) a(r)', pieces='range(40) b(p)')})")
def baseline_chains(spark, sf_dir):
    """Rows of many pieces, each a block of its own, as one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.sql(_PIECES.format(documents="{docs}", rows="{rows}", pieces="{pieces}"), docs=docs, rows=spark.range(4).toDF("r"), pieces=spark.range(40).toDF("p"))
    return layout.joined_baselines(more.drop("r", "p", "m")).select("doc_id", "block", "joined")


#: Each document's whole text in pieces of 40 letters, every piece a row of a page of two columns; what a row is and how far it is
#: indented come from its letters. Some rows have their numbers as pieces of their own.
_CODE_ROWS = """
SELECT doc_id, i, (i - i % 20) / 20 AS page, i - i % 10 % (2 + doc_id % 4) AS block, h, h % 4 = 0 AS numbered, i >= 10 OR doc_id % 6 <> 0 AS holds,
  60 + 260 * ((i % 20 - i % 10) / 10) + 7 * (h % 6) + doc_id % 3 AS x, 100 + i % 10 * 14 + CASE WHEN i % 10 >= 3 + doc_id % 6 THEN 25 ELSE 0 END AS y,
  h IN (1, 5, 9, 13) AND i % 10 % (2 + doc_id % 4) = 0 AS head, h % 7 = 3 OR h = 22 AS other,
  CASE WHEN h IN (1, 5, 9, 13) AND i % 10 % (2 + doc_id % 4) = 0 THEN 'Algorithm ' || CAST(i + 1 AS STRING) || ': ' || p WHEN h = 22 THEN 'Figure 3. ' || p WHEN h = 14 THEN ' '
    WHEN h % 7 = 3 THEN 'prose ' || p || ' and ' || p || ' again' WHEN h % 3 = 0 THEN 'for each ' || p || ' do' WHEN h % 3 = 1 THEN 'return ' || p ELSE 'x ← ' || p END AS t
FROM {pieces} r
"""
_CUT = "(SELECT doc_id, i, replace(substr(text, CAST(i * 40 + 1 AS INTEGER), 40), chr(10), ' ') AS p, ascii(substr(text, CAST(i * 40 + 3 AS INTEGER), 1)) % 23 AS h FROM {rows})"
#: The rules below heads: two, one far below, one near.
_CODE_RULES = "SELECT doc_id, page, x - 5 AS x0, x + 200 AS x1, y + 10 + d AS y0, y + 11 + d AS y1 FROM {items} JOIN (VALUES (5, 2), (5, 47), (9, 40), (13, 5)) v(k, d) ON head AND h = k"
_EACH = "(SELECT doc_id, text, unnest(range(0, (length(text) + 39) // 40)) AS i FROM documents)"


@query(rf"""
WITH a AS ({_CODE_ROWS.format(pieces=_CUT.format(rows=_EACH))}),
b AS (
  SELECT doc_id, i, page, block, head, holds, other, numbered, y, x AS hx, CASE WHEN numbered AND trim(t) = '' THEN x - 20 ELSE x END AS x,
    trim(CASE WHEN numbered THEN i % 1000 || ': ' ELSE '' END || trim(t)) AS text FROM (SELECT * REPLACE (head AND NOT numbered AS head) FROM a)
),
q AS (SELECT * FROM b WHERE text <> ''),
g AS (SELECT q.doc_id, q.i, list_sort(list(r.y0)) AS ys, any_value(q.y) AS y FROM q JOIN ({_CODE_RULES.format(items='a')}) r ON q.head AND q.holds AND r.doc_id = q.doc_id AND r.page = q.page AND r.x0 BETWEEN q.hx - 50 AND q.hx + 20 AND r.y0 > q.y + 9 GROUP BY 1, 2),
s AS (
  SELECT q.* REPLACE (head AND holds AS head), CASE WHEN len(ys) >= 2 THEN ys[2] + 1 WHEN ys[1] > g.y + 30 THEN ys[1] + 1 END AS stop,
    regexp_matches(text, '(?i)←|<-|:=|\+\+|==|!=|≤|≥|to.*do') AS marked FROM q LEFT JOIN g USING (doc_id, i)
),
n AS (SELECT *, sum(head::INT) OVER w AS session, lag(y + 10) OVER w AS above FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT *, first(stop) OVER (PARTITION BY doc_id, session ORDER BY i) AS till FROM n),
e AS (
  SELECT *, NOT head AND (NOT holds OR coalesce(y > till, false) OR (till IS NULL AND y - above > 16) OR (NOT numbered AND text LIKE 'Figure%')
    OR (till IS NULL AND other AND NOT numbered AND NOT marked AND length(text) > 60)) AS ends FROM m
),
f AS (SELECT *, session > 0 AND max(ends::INT) OVER (PARTITION BY doc_id, session ORDER BY i) = 0 AS taken FROM e),
k AS (SELECT *, CASE WHEN taken AND NOT head THEN x END AS tx FROM f),
z AS (SELECT *, min(tx) OVER w AS least, min(tx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM k WINDOW w AS (PARTITION BY doc_id, session ORDER BY i)),
v AS (SELECT *, CASE WHEN tx < prior THEN round_even((prior - tx) / 12.0::DOUBLE, 0) ELSE 0 END AS moved FROM z)
SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(block AS BIGINT) AS block, CASE WHEN head THEN 0 ELSE CAST(sum((NOT head)::INT) OVER (PARTITION BY doc_id, block ORDER BY i) AS BIGINT) END AS row, head, text,
  CAST(CASE WHEN taken THEN session END AS BIGINT) AS code,
  CAST(CASE WHEN tx IS NOT NULL THEN round_even((tx - least) / 12.0::DOUBLE, 0) + coalesce(sum(moved) OVER (PARTITION BY doc_id, session ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) END AS BIGINT) AS indent
FROM v
""")  # fmt: skip
def page_code_sessions(spark, sf_dir):
    """Pseudo-code that goes on over blocks, columns and pages, and what is given back."""
    docs = read(spark, sf_dir, "documents")
    # a text is cut in one go: a row for each piece that carries the whole text takes the square of its length
    cut = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0))).alias("i", "p"))
    pieces = cut.select("doc_id", F.col("i").cast("bigint").alias("i"), F.replace("p", F.lit("\n"), F.lit(" ")).alias("p"), (F.ascii(F.substr("p", F.lit(3), F.lit(1))) % 23).alias("h"))
    items = spark.sql(_CODE_ROWS.format(pieces="{pieces}"), pieces=pieces)
    double = lambda c: F.expr(c).cast("double")
    boxed = items.select(
        "doc_id", F.col("page").cast("bigint").alias("page"), "block", F.col("block").alias("place"), "holds", F.lit(None).cast("boolean").alias("bold"), F.col("numbered"),
        F.explode(F.array(F.struct((F.col("i") * 2 + 1).alias("line"), double("x").alias("x0"), F.col("t").alias("text")), F.struct((F.col("i") * 2).alias("line"), double("x - 20").alias("x0"), F.concat((F.col("i") % 1000).cast("string"), F.lit(":")).alias("text")))).alias("p"),
        double("y").alias("y0"), double("y + 10").alias("y1"),
    )
    lines = boxed.where("numbered OR p.line % 2 = 1").select("*", "p.*", (F.col("p.x0") + 15).alias("x1")).drop("p", "numbered")
    rules = spark.sql(_CODE_RULES.format(items="{items}"), items=items).withColumn("page", F.col("page").cast("bigint"))
    return page_code.sessions(lines, rules)
