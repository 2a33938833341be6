"""Queries of the relational layer: references, citations, numbering, specs, learning, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import bibliography as bib
from vellum.operators import checks, citations, guidelines, learning, numbering, specs
from vellum.plans.scalar import BLOCKS, REFS, A, B, O, Q, lit, query, read
from vellum.sources import derived


def refs_of(spark, sf_dir):
    r = derived.with_authors(derived.refs(spark, sf_dir))
    return r.withColumn("old_num", F.when(F.col("doc_id") % 6 != 1, F.when((F.col("doc_id") % 6).isin(0, 2, 5), (F.col("k") + 1).cast("int"))))


def parsed_refs(spark, sf_dir):
    """References as parsed from raw text, under the plain names."""
    p = bib.parse_references(derived.refs(spark, sf_dir).select("doc_id", "k", "raw"))
    return p.select("doc_id", "k", "raw", "old_num", "confident", *[F.col(f"p_{c}").alias(c) for c in ("authors", "etal", "year", "suffix", "title", "container", "kind", "volume", "issue", "pages", "doi", "url")])


def labelled_refs(spark, sf_dir):
    """References with the number of their own label, if they have one."""
    return derived.refs(spark, sf_dir).withColumn("old_num", bib.old_number(F.col("raw")))


def names_text(c):
    return F.array_join(F.transform(c, lambda a: F.concat(a["family"], F.lit("|"), a["initials"])), ";")


_LOST = "(doc_id % 6 = 1 AND suffix <> '')"  # a year with a letter hides from the dated grammar behind the quoted one
_NAMES = "family1 || '|' || ini1 || CASE WHEN na > 1 AND NOT {lost} THEN ';' || family2 || '|' || ini2 ELSE '' END || CASE WHEN na > 2 THEN ';' || family3 || '|' || ini3 ELSE '' END".format(lost=_LOST)


@query(f"SELECT doc_id, k, {_NAMES} AS authors FROM {REFS} r")
def parse_authors(spark, sf_dir):
    return parsed_refs(spark, sf_dir).select("doc_id", "k", names_text(F.col("authors")).alias("authors"))


@query(f"SELECT doc_id, k, container, volume, issue, pages, kind FROM {REFS} r")
def parse_container(spark, sf_dir):
    return parsed_refs(spark, sf_dir).select("doc_id", "k", "container", "volume", "issue", "pages", "kind")


@query(f"SELECT doc_id, k, CASE WHEN doc_id % 6 IN (0, 2, 5) THEN CAST(k + 1 AS INTEGER) END AS old_num, title, CASE WHEN {_LOST} THEN '' ELSE year END AS year, CASE WHEN {_LOST} THEN '' ELSE suffix END AS suffix, doi, NOT {_LOST} AS confident FROM {REFS} r")
def parse_reference(spark, sf_dir):
    return parsed_refs(spark, sf_dir).select("doc_id", "k", "old_num", "title", "year", "suffix", "doi", "confident")


def ref_columns() -> dict:
    cols = {c: F.col(c) for c in ("authors", "title", "container", "kind", "volume", "issue", "pages", "doi", "year", "suffix", "raw")}
    return cols | {"etal": F.lit(False), "url": F.lit(""), "confident": F.lit(True)}


_I = {n: f"regexp_replace(ini{n}, '\\.([A-Z])', '. \\1', 'g')" for n in (1, 2, 3)}
_N = {n: f"replace(ini{n}, '.', '')" for n in (1, 2, 3)}


def _list(one: str, last2: str, last3: str, sep: str = ", ") -> str:
    a = [one.format(f=f"family{n}", i=f"ini{n}", s=_I[n], n=_N[n]) for n in (1, 2, 3)]
    return f"(CASE na WHEN 1 THEN {a[0]} WHEN 2 THEN {a[0]} || {lit(last2)} || {a[1]} ELSE {a[0]} || {lit(sep)} || {a[1]} || {lit(last3)} || {a[2]} END)"


_Y = "year || suffix"
_CONF = "CASE WHEN kind = 'conference' THEN 'in ' ELSE '' END"
_CHI = f"(family1 || ', ' || {_I[1]} || CASE na WHEN 1 THEN '' WHEN 2 THEN ' and ' || {_I[2]} || ' ' || family2 ELSE ', ' || {_I[2]} || ' ' || family2 || ', and ' || {_I[3]} || ' ' || family3 END)"
_MLA = f"(CASE na WHEN 1 THEN family1 || ', ' || {_I[1]} WHEN 2 THEN family1 || ', ' || {_I[1]} || ', and ' || {_I[2]} || ' ' || family2 ELSE family1 || ', ' || {_I[1]} || ', et al' END)"
_END = lambda x: f"(CASE WHEN {x} LIKE '%.' THEN {x} ELSE {x} || '.' END)"
_SPR = f"{_list('{f} || chr(32) || {n}', ', ', ', ')} || ' (' || {_Y} || ') ' || title || '. ' || container || ' ' || volume || '(' || issue || '):' || pages || '. https://doi.org/' || doi"
_VAN = f"{_list('{f} || chr(32) || {n}', ', ', ', ')} || '. ' || title || '. ' || container || '. ' || {_Y} || ';' || volume || '(' || issue || '):' || pages || '. doi:' || doi"
_NUM = "CAST(k + 1 AS STRING)"
STYLE_SQL = {
    "ieee": f"'[' || {_NUM} || ']' || chr(9) || {_list('{s} || chr(32) || {f}', ' and ', ', and ')} || ', “' || title || ',” ' || {_CONF} || container || ', vol. ' || volume || ', no. ' || issue || ', pp. ' || pages || ', ' || {_Y} || ', doi: ' || doi || '.'",
    "apa": f"{_list('{f} || chr(44) || chr(32) || {s}', ', & ', ', & ')} || ' (' || {_Y} || '). ' || title || '. ' || container || ', ' || volume || '(' || issue || '), ' || pages || '. https://doi.org/' || doi",
    "harvard": f"{_list('{f} || chr(44) || chr(32) || {i}', ' and ', ' and ')} || ' (' || {_Y} || ') ‘' || title || '’, ' || container || ', ' || volume || '(' || issue || '), pp. ' || pages || '. doi: ' || doi || '.'",
    "emerald-harvard": f"{_list('{f} || chr(44) || chr(32) || {i}', ' and ', ' and ')} || ' (' || {_Y} || '), “' || title || '”, ' || container || ', Vol. ' || volume || ' No. ' || issue || ', pp. ' || replace(pages, '–', '-') || ', doi: ' || doi || '.'",
    "vancouver": f"{_NUM} || '. ' || {_VAN}",
    "ama": f"{_NUM} || '. ' || {_VAN}",
    "chicago": f"{_END(_CHI)} || ' ' || {_Y} || '. “' || title || '.” ' || container || ' ' || volume || ' (' || issue || '): ' || pages || '. https://doi.org/' || doi || '.'",
    "springer-basic": _SPR,
    "springer-vancouver": f"{_NUM} || '. ' || {_SPR}",
    "lncs": f"{_NUM} || '. ' || {_list('{f} || chr(44) || chr(32) || {i}', ', ', ', ')} || ': ' || title || '. ' || container || ' ' || volume || '(' || issue || '), ' || pages || ' (' || {_Y} || '). https://doi.org/' || doi",
    "mdpi": f"{_NUM} || '. ' || {_list('{f} || chr(44) || chr(32) || {i}', '; ', '; ', '; ')} || ' ' || title || '. ' || container || ' ' || {_Y} || ', ' || volume || ', ' || pages || '. https://doi.org/' || doi || '.'",
    "elsevier-numeric": f"'[' || {_NUM} || ']' || chr(9) || {_list('{i} || chr(32) || {f}', ', ', ', ')} || ', ' || title || ', ' || container || ' ' || volume || ' (' || {_Y} || ') ' || pages || '. https://doi.org/' || doi || '.'",
    "mla": f"{_END(_MLA)} || ' “' || title || '.” ' || container || ', vol. ' || volume || ', no. ' || issue || ', ' || {_Y} || ', pp. ' || pages || '.'",
}


def _style_query(style: str):
    def run(spark, sf_dir):
        r = derived.with_authors(derived.refs(spark, sf_dir))
        return r.select("doc_id", "k", bib.format_reference(style, ref_columns(), F.col("k") + 1).alias("entry"))

    run.__name__ = "format_reference_" + style.replace("-", "_")
    return run


for _style, _sql in STYLE_SQL.items():
    query(f"SELECT doc_id, k, {_sql} AS entry FROM {REFS} r")(_style_query(_style))


@query(f"SELECT doc_id, k, {_list('{f} || chr(44) || chr(32) || {i}', ', ', ', ')} AS lncs, {_MLA} AS mla, {_CHI} AS chicago FROM {REFS} r")
def format_authors(spark, sf_dir):
    r = derived.with_authors(derived.refs(spark, sf_dir))
    return r.select("doc_id", "k", *[bib.format_authors(F.col("authors"), F.lit(False), s).alias(s) for s in ("lncs", "mla", "chicago")])


@query(f"""SELECT doc_id, k, '@' || CASE kind WHEN 'conference' THEN 'inproceedings' ELSE 'article' END || '{{r' || {_NUM} || ',' || chr(10) || '  author = {{' || {_list('{f} || chr(44) || chr(32) || {s}', ' and ', ' and ', ' and ')} || '}},' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  ' || CASE kind WHEN 'conference' THEN 'booktitle' ELSE 'journal' END || ' = {{' || container
|| '}},' || chr(10) || '  year = {{' || year || '}},' || chr(10) || '  volume = {{' || volume || '}},' || chr(10) || '  number = {{' || issue || '}},' || chr(10) || '  pages = {{' || replace(pages, '–', '--') || '}},' || chr(10) || '  doi = {{' || doi || '}}' || chr(10) || '}}' AS entry FROM {REFS} r""")
def bibtex_export(spark, sf_dir):
    r = derived.with_authors(derived.refs(spark, sf_dir))
    return r.select("doc_id", "k", bib.bibtex(ref_columns(), F.concat(F.lit("r"), (F.col("k") + 1).cast("string"))).alias("entry"))


@query(f"SELECT doc_id, k, doi, CASE WHEN k % 2 = 0 THEN title || ' (revised)' ELSE title END AS title, container, CASE WHEN k % 2 = 0 THEN volume ELSE volume END AS volume, CASE WHEN k % 2 = 0 THEN '2000' ELSE year END AS year, k % 2 = 0 AS verified FROM {REFS} r")
def enrich_lookup(spark, sf_dir):
    r = derived.refs(spark, sf_dir)
    known = r.where("k % 2 = 0").select(F.upper("doi").alias("doi"), F.concat("title", F.lit(" (revised)")).alias("title"), F.lit("").alias("container"), F.lit(None).cast("string").alias("volume"), F.lit("2000").alias("year"))
    return citations.enrich(r, known)


# What the derived paragraphs cite, from their construction.
CITES = f"""SELECT l.doc_id, 100 + l.ln * 10 + 5 AS pos, l.ln, (l.doc_id + l.ln) % (6 + l.doc_id % 4) AS k1, (l.doc_id * 3 + l.ln * 5 + 1) % (6 + l.doc_id % 4) AS k2 FROM ({derived.LINES_OTHER.format(documents='documents')}) l WHERE trim(l.line) <> ''"""
NUMERIC = f"""SELECT doc_id, pos, m AS mention, i AS item, n AS number FROM (
  SELECT doc_id, pos, 0 AS m, 0 AS i, k1 + 1 AS n FROM ({CITES}) c WHERE ln % 4 = 0 UNION ALL SELECT doc_id, pos, 0, 1, k2 + 1 FROM ({CITES}) c WHERE ln % 4 = 0
  UNION ALL SELECT doc_id, pos, 0, v.i, v.i + 1 FROM ({CITES}) c, (VALUES (0), (1), (2), (3)) v(i) WHERE ln % 4 = 1 UNION ALL SELECT doc_id, pos, 1, 0, k2 + 1 FROM ({CITES}) c WHERE ln % 4 = 1
  UNION ALL SELECT doc_id, pos, 0, 0, k2 + 1 FROM ({CITES}) c WHERE ln % 4 = 2 UNION ALL SELECT doc_id, pos, 0, 0, 99 FROM ({CITES}) c WHERE ln % 4 = 3) n WHERE doc_id % 2 = 0"""
DATED = f"""SELECT doc_id, pos, p AS parenthetical, m AS mention, i AS item, k FROM (
  SELECT doc_id, pos, 1 AS p, 0 AS m, 0 AS i, k1 AS k FROM ({CITES}) c WHERE ln % 4 = 0 UNION ALL SELECT doc_id, pos, 1, 0, 1, k2 FROM ({CITES}) c WHERE ln % 4 = 0
  UNION ALL SELECT doc_id, pos, 0, 0, 0, k1 FROM ({CITES}) c WHERE ln % 4 = 1 UNION ALL SELECT doc_id, pos, 1, 1, 0, k2 FROM ({CITES}) c WHERE ln % 4 = 1
  UNION ALL SELECT doc_id, pos, 1, 0, 0, k2 FROM ({CITES}) c WHERE ln % 4 = 2 UNION ALL SELECT doc_id, pos, 1, 0, 0, NULL FROM ({CITES}) c WHERE ln % 4 = 3) n WHERE doc_id % 2 = 1"""
SIZES = "SELECT doc_id, 6 + doc_id % 4 AS n FROM documents"


def _renumbered(found: str, order: str) -> str:
    return f"""SELECT r.doc_id, r.k, row_number() OVER (PARTITION BY r.doc_id ORDER BY f.seen IS NULL, f.seen, r.k) AS new_num, f.seen IS NOT NULL AS cited
FROM {REFS} r LEFT JOIN (SELECT doc_id, k, min({order}) AS seen FROM ({found}) m GROUP BY ALL) f ON f.doc_id = r.doc_id AND f.k = r.k"""


NUMERIC_K = f"SELECT n.*, CASE WHEN number <= s.n THEN number - 1 END AS k FROM ({NUMERIC}) n JOIN ({SIZES}) s USING (doc_id)"
NEW_NUMERIC = _renumbered(f"SELECT * FROM ({NUMERIC_K}) z WHERE number <> 99", "[pos, mention, item]")
NEW_DATED = _renumbered(DATED, "[pos, parenthetical, mention, item]")


@query(f"SELECT doc_id, pos, CAST(mention AS BIGINT) AS mention, CAST(item AS BIGINT) AS item, CAST(number AS BIGINT) AS number, CAST(k AS BIGINT) AS k FROM ({NUMERIC_K}) z")
def cite_match_numeric(spark, sf_dir):
    b, r = derived.blocks(spark, sf_dir), labelled_refs(spark, sf_dir)
    return citations.match_numbers(citations.bracket_mentions(b), r).select("doc_id", "pos", "mention", "item", "number", "k")


@query(f"SELECT doc_id, pos, parenthetical, CAST(mention AS BIGINT) AS mention, CAST(item AS BIGINT) AS item, CAST(k AS BIGINT) AS k FROM ({DATED}) z")
def cite_match_author_year(spark, sf_dir):
    b, r = derived.blocks(spark, sf_dir), refs_of(spark, sf_dir)
    return citations.match_author_years(citations.author_year_items(b), r).select("doc_id", "pos", "parenthetical", "mention", "item", "k")


@query(f"SELECT doc_id, k, new_num, cited FROM ({NEW_NUMERIC}) z")
def cite_renumber(spark, sf_dir):
    """Flagship: labels read from raw references, bracketed citations found and matched, references renumbered by first citation."""
    return citations.numeric_order(derived.blocks(spark, sf_dir), labelled_refs(spark, sf_dir))


@query(f"SELECT doc_id, k, new_num, cited FROM ({NEW_DATED}) z")
def cite_renumber_author_year(spark, sf_dir):
    return citations.author_year_order(derived.blocks(spark, sf_dir), refs_of(spark, sf_dir))


def _compressed(found: str, keys: str) -> str:
    """Runs of numbers of each group as text, by islands."""
    return f"""SELECT {keys}, string_agg(part, ', ' ORDER BY lo) AS numbers FROM (
  SELECT {keys}, min(n) AS lo, CASE WHEN count(*) >= 3 THEN min(n) || '–' || max(n) ELSE string_agg(CAST(n AS STRING), ', ' ORDER BY n) END AS part FROM (
    SELECT *, n - row_number() OVER (PARTITION BY {keys} ORDER BY n) AS island FROM (SELECT DISTINCT {keys}, n FROM ({found}) f0) f1) f2 GROUP BY {keys}, island) f3 GROUP BY {keys}"""


_NM = _compressed(f"SELECT m.doc_id, m.pos, m.mention, w.new_num AS n FROM ({NUMERIC_K}) m JOIN ({NEW_NUMERIC}) w ON w.doc_id = m.doc_id AND w.k = m.k", "doc_id, pos, mention")
_LEAD = "regexp_replace(b.text, '( \\[[0-9, –]+\\]| and \\[[0-9]+\\])+\\.$', '')"


@query(f"""WITH n AS ({_NM}), b AS (SELECT b.*, c.ln FROM {BLOCKS} b JOIN ({CITES}) c ON c.doc_id = b.doc_id AND c.pos = b.pos WHERE b.role = 'para')
SELECT b.doc_id, b.pos, CASE WHEN b.ln % 4 = 3 OR b.doc_id % 2 = 1 THEN b.text WHEN b.ln % 4 = 1 THEN {_LEAD} || ' [' || x.numbers || '] and [' || y.numbers || '].' ELSE {_LEAD} || ' [' || x.numbers || '].' END AS text
FROM b LEFT JOIN n x ON x.doc_id = b.doc_id AND x.pos = b.pos AND x.mention = 0 LEFT JOIN n y ON y.doc_id = b.doc_id AND y.pos = b.pos AND y.mention = 1""")
def cite_convert(spark, sf_dir):
    b, r = derived.blocks(spark, sf_dir), refs_of(spark, sf_dir).withColumn("etal", F.lit(False))
    out = citations.convert_numeric(b, r, citations.numeric_order(b, r))
    return out.join(b.where("role = 'para'").select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")


_AY = f"family1 || CASE WHEN na > 2 THEN ' et al.' WHEN na = 2 THEN ' and ' || family2 ELSE '' END || ', ' || year || suffix"


@query(f"""WITH t AS (SELECT doc_id, pos, mention, '(' || string_agg({_AY}, '; ' ORDER BY item) || ')' AS t FROM ({NUMERIC_K}) m JOIN {REFS} r USING (doc_id, k) GROUP BY ALL), b AS (SELECT b.*, c.ln FROM {BLOCKS} b JOIN ({CITES}) c ON c.doc_id = b.doc_id AND c.pos = b.pos WHERE b.role = 'para')
SELECT b.doc_id, b.pos, CASE WHEN b.ln % 4 = 3 OR b.doc_id % 2 = 1 THEN b.text WHEN b.ln % 4 = 1 THEN {_LEAD} || ' ' || x.t || ' and ' || y.t || '.' ELSE {_LEAD} || ' ' || x.t || '.' END AS text
FROM b LEFT JOIN t x ON x.doc_id = b.doc_id AND x.pos = b.pos AND x.mention = 0 LEFT JOIN t y ON y.doc_id = b.doc_id AND y.pos = b.pos AND y.mention = 1""")
def cite_convert_to_author_year(spark, sf_dir):
    b, r = derived.blocks(spark, sf_dir), refs_of(spark, sf_dir).withColumn("etal", F.lit(False))
    out = citations.convert_numeric(b, r, citations.numeric_order(b, r), target="author-year")
    return out.join(b.where("role = 'para'").select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")


_DM = _compressed(f"SELECT m.doc_id, m.pos, m.mention, w.new_num AS n FROM ({DATED}) m JOIN ({NEW_DATED}) w ON w.doc_id = m.doc_id AND w.k = m.k", "doc_id, pos, mention")


@query(f"""WITH n AS ({_DM}), b AS (SELECT b.*, c.ln FROM {BLOCKS} b JOIN ({CITES}) c ON c.doc_id = b.doc_id AND c.pos = b.pos WHERE b.role = 'para')
SELECT b.doc_id, b.pos, CASE CASE WHEN b.doc_id % 2 = 0 THEN 3 ELSE b.ln % 4 END WHEN 3 THEN b.text WHEN 1 THEN regexp_replace(b.text, ' \\([^()]*\\) disagreed \\([^()]*\\)\\.$', ' [' || x.numbers || '] disagreed [' || y.numbers || '].') ELSE regexp_replace(b.text, '\\([^()]*\\)\\.$', '[' || x.numbers || '].') END AS text
FROM b LEFT JOIN n x ON x.doc_id = b.doc_id AND x.pos = b.pos AND x.mention = 0 LEFT JOIN n y ON y.doc_id = b.doc_id AND y.pos = b.pos AND y.mention = 1""")
def cite_convert_to_numeric(spark, sf_dir):
    b = derived.blocks(spark, sf_dir)
    out = citations.convert_author_year(b, refs_of(spark, sf_dir))
    return out.join(b.where("role = 'para'").select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")


@query(f"""SELECT doc_id, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 + CAST(ln % 4 = 1 AS INTEGER) ELSE 0 END) AS BIGINT) AS n_bracket, CAST(sum(CASE WHEN doc_id % 2 = 1 THEN 1 + 2 * CAST(ln % 4 = 1 AS INTEGER) ELSE 0 END) AS BIGINT) AS n_author_year,
CASE WHEN doc_id % 2 = 0 THEN 'numeric' ELSE 'author-year' END AS mode FROM ({CITES}) c GROUP BY doc_id""")
def citation_mode(spark, sf_dir):
    return citations.citation_mode(derived.blocks(spark, sf_dir))


@query(f"SELECT r.doc_id, r.k FROM {REFS} r ANTI JOIN ({NUMERIC_K}) m ON m.doc_id = r.doc_id AND m.k = r.k")
def uncited_refs(spark, sf_dir):
    b, r = derived.blocks(spark, sf_dir), refs_of(spark, sf_dir)
    return citations.uncited(r, citations.match_numbers(citations.bracket_mentions(b), r))


_F = lambda x: f"lower(translate({x}, {lit(A)}, {lit(B)}))"


@query(f"""SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY {_F('family1')}, CASE na WHEN 1 THEN '' WHEN 2 THEN {_F('family2')} ELSE {_F("family2 || ' ' || family3")} END, year, suffix, k) AS place FROM {REFS} r""")
def ref_sort(spark, sf_dir):
    return citations.sort_references(derived.with_authors(derived.refs(spark, sf_dir)))


_SPEC = "SELECT doc_id, CAST(1 + doc_id % 7 AS STRING) || CASE doc_id % 4 WHEN 0 THEN '-' || CAST(4 + doc_id % 9 AS STRING) || ', 3' WHEN 1 THEN ', 5, 6,7' WHEN 2 THEN '–200' ELSE ' , 9-11' END AS spec, 1 + doc_id % 7 AS a FROM {documents} d"


@query(f"""SELECT doc_id, spec, array_to_string(CASE doc_id % 4 WHEN 0 THEN list_concat(CASE WHEN 4 + doc_id % 9 >= a THEN generate_series(a, 4 + doc_id % 9) ELSE [a, 4 + doc_id % 9] END, [3]) WHEN 1 THEN [a, 5, 6, 7] WHEN 2 THEN [a, 200] ELSE [a, 9, 10, 11] END, ',') AS numbers FROM ({_SPEC.format(documents='documents')}) s""")
def expand_ranges(spark, sf_dir):
    s = spark.sql(_SPEC, documents=derived.documents(spark, sf_dir))
    return s.select("doc_id", "spec", F.array_join(F.transform(citations.expand(F.col("spec")), lambda x: x.cast("string")), ",").alias("numbers"))


@query(_compressed("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_suppkey % 20 AS BIGINT) FROM lineitem", "l_orderkey"))
def compress_ranges(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    n = li.select("l_orderkey", F.explode(F.array(F.col("l_linenumber").cast("bigint"), (F.col("l_suppkey") % 20).cast("bigint"))).alias("n"))
    return n.groupBy("l_orderkey").agg(citations.compress(F.collect_set("n")).alias("numbers"))


_CAPS = f"SELECT doc_id, pos, cap_kind, cap_num, row_number() OVER (PARTITION BY doc_id, cap_kind ORDER BY pos) AS new_num, text FROM {BLOCKS} b WHERE role = 'caption'"


@query(f"""SELECT doc_id, pos, cap_kind, cap_num, new_num, CASE cap_kind WHEN 'figure' THEN 'Fig. ' || new_num ELSE 'Table ' || repeat('C', CAST(new_num // 100 AS INTEGER)) || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[new_num // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[new_num % 10 + 1] END || '. ' AS prefix,
CASE cap_kind WHEN 'figure' THEN 'Course of training.' ELSE 'Summary of data.' END AS body, cap_num <> new_num AS changed FROM ({_CAPS}) c""")
def caption_numbering(spark, sf_dir):
    return numbering.number_captions(derived.blocks(spark, sf_dir), figure_label="Fig.", roman_tables=True)


@query(f"""WITH m AS (SELECT doc_id, cap_kind, cap_num, min(new_num) AS new_num FROM ({_CAPS}) c GROUP BY ALL), b AS (SELECT b.doc_id, b.pos, b.text, (b.pos - 105) // 10 AS ln FROM {BLOCKS} b WHERE role = 'para'),
x AS (SELECT b.*, 1 + (ln + 2) % 5 AS f, 1 + ln % 3 AS t1, 2 + ln % 3 AS t2 FROM b)
SELECT x.doc_id, x.pos, replace(x.text, ' See Figure ' || x.f || ' and Tables ' || x.t1 || ' and ' || x.t2 || ' for it', ' See Fig. ' || coalesce(mf.new_num, x.f) || ' and Tables ' || coalesce(m1.new_num, x.t1) || ' and ' || coalesce(m2.new_num, x.t2) || ' for it') AS text
FROM x LEFT JOIN m mf ON mf.doc_id = x.doc_id AND mf.cap_kind = 'figure' AND mf.cap_num = x.f LEFT JOIN m m1 ON m1.doc_id = x.doc_id AND m1.cap_kind = 'table' AND m1.cap_num = x.t1 LEFT JOIN m m2 ON m2.doc_id = x.doc_id AND m2.cap_kind = 'table' AND m2.cap_num = x.t2""")
def xref_rewrite(spark, sf_dir):
    b = derived.blocks(spark, sf_dir)
    out = numbering.rewrite_xrefs(b.where("role IN ('para', 'caption')"), numbering.number_captions(b), figure="Fig.")
    return out.join(b.where("role = 'para'").select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")


_LABELS = "SELECT doc_id, pos, CASE WHEN role = 'caption' AND pos % 20 > 10 THEN regexp_replace(text, '[.:] .*', '') ELSE text END AS text, role FROM {blocks} b WHERE role IN ('caption', 'para', 'heading')"


@query(f"""WITH b AS ({_LABELS.format(blocks=BLOCKS)}), n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT *, role = 'caption' AND regexp_full_match(text, '(Figure|Table) [0-9]+') AND coalesce(nr IN ('para', 'heading') AND length(nt) BETWEEN 1 AND 299, false) AS takes FROM n), g AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM t)
SELECT doc_id, pos, role, CASE WHEN takes THEN text || ' ' || nt ELSE text END AS text FROM g WHERE NOT gone""")
def caption_label_join(spark, sf_dir):
    b = spark.sql(_LABELS, blocks=derived.blocks(spark, sf_dir))
    return numbering.join_label_captions(b).select("doc_id", "pos", "role", "text")


@query(f"""SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, role = 'caption' AS paired FROM {BLOCKS} b""")
def float_pairing(spark, sf_dir):
    return numbering.pair_floats(derived.blocks(spark, sf_dir), figure_above=False, table_above=True)


@query(f"""SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN role = 'caption' AND cap_kind = 'figure' THEN pos - 1.5 WHEN role = 'caption' THEN pos + 1.5 ELSE pos END) AS place, role = 'caption' AS paired FROM {BLOCKS} b""")
def float_pairing_swapped(spark, sf_dir):
    return numbering.pair_floats(derived.blocks(spark, sf_dir), figure_above=True, table_above=False)


_HEADS = f"SELECT doc_id, pos, level, text, NOT contains(text, 'Acknowledgements') AND text <> 'References' AS counts FROM {BLOCKS} b WHERE role = 'heading'"


@query(f"""WITH h AS ({_HEADS}), a AS (SELECT *, sum(CASE WHEN counts AND level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS c1 FROM h),
b AS (SELECT *, sum(CASE WHEN counts AND level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, c1 ORDER BY pos) AS c2 FROM a), c AS (SELECT *, sum(CASE WHEN counts AND level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, c1, c2 ORDER BY pos) AS c3 FROM b)
SELECT doc_id, pos, level, CASE WHEN NOT counts THEN '' WHEN level = 1 THEN c1 || '. ' WHEN level = 2 THEN greatest(c1, 1) || '.' || c2 || ' ' ELSE greatest(c1, 1) || '.' || greatest(c2, 1) || '.' || c3 || ' ' END AS prefix, text FROM c""")
def heading_numbering(spark, sf_dir):
    return numbering.number_headings(derived.blocks(spark, sf_dir), sub_dot=False)


@query(f"""SELECT doc_id, pos, role, text, level FROM (SELECT doc_id, pos, role, text, level FROM {BLOCKS} b UNION ALL SELECT doc_id, 100000000, 'heading', 'References', 1 FROM documents WHERE doc_id % 7 = 0) z""")
def ensure_ref_heading(spark, sf_dir):
    return numbering.ensure_reference_heading(derived.blocks(spark, sf_dir))


@query("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) e")
def ordered_distinct(spark, sf_dir):
    return checks.ordered_distinct(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""WITH t AS (SELECT l_suppkey, l_linenumber AS v, sum(CAST(l_quantity AS BIGINT)) AS w, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL)
SELECT l_suppkey, v AS mode, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, first) AS r FROM t) z WHERE r = 1""")
def weighted_mode(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("v"), F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return learning.weighted_mode(li, "l_suppkey", "v", "q", "o")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 100 AS BIGINT) AS w, sum(CAST(l_quantity * 100 AS BIGINT)) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN total > 9000 THEN w * 9000 // total ELSE w END AS width FROM w""")
def fit_table_widths(spark, sf_dir):
    from pyspark.sql import Window

    w = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 100).cast("bigint").alias("w"))
    total = F.sum("w").over(Window.partitionBy("l_orderkey"))
    return w.select("l_orderkey", "l_linenumber", F.when(total > 9000, F.expr("w * 9000 div sum(w) over (partition by l_orderkey)")).otherwise(F.col("w")).cast("bigint").alias("width"))


_KW = {"as-is": ("alpha; Beta gamma; IoT; delta", "Alpha; beta (x, y); GAMMA", "one; two; Three word term"), "title": ("Alpha; Beta Gamma; IoT; Delta", "Alpha; Beta (x, Y); Gamma", "One; Two; Three Word Term"), "lower-first": ("Alpha; beta gamma; IoT; delta", "Alpha; beta (x, y); GAMMA", "One; two; three word term")}


@query("SELECT doc_id, " + ", ".join(f"CASE doc_id % 3 WHEN 0 THEN {lit(v[0])} WHEN 1 THEN {lit(v[1])} ELSE {lit(v[2])} END AS {c.replace('-', '_')}" for c, v in _KW.items()) + ", CAST(CASE doc_id % 3 WHEN 0 THEN 4 ELSE 3 END AS BIGINT) AS n FROM documents")
def keywords_normalise(spark, sf_dir):
    line = F.regexp_replace("text", r"^(Keywords|Index Terms): ", "")
    k = derived.blocks(spark, sf_dir).where("role = 'keywords'")
    return k.select("doc_id", *[learning.keywords(line, c)[0].alias(c.replace("-", "_")) for c in _KW], learning.keywords(line)[1].alias("n"))


def _sql_value(v) -> str:
    return "NULL" if v is None else lit(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


_PRESETS = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([lit(k), _sql_value(p.get("base")), *(_sql_value(p.get(f)) for f in specs.FIELDS)]) + ")" for k, p in specs.PRESETS.items()) + f") v(preset, base, {', '.join(specs.FIELDS)})"
_DUCK = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
_RESOLVED = f"WITH p AS ({_PRESETS}) SELECT a.preset, " + ", ".join(f"CAST(coalesce(a.{f}, b.{f}, {_sql_value(specs.DEFAULTS.get(f))}) AS {_DUCK[t]}) AS {f}" for f, t in specs.FIELDS.items()) + " FROM p a LEFT JOIN p b ON b.preset = a.base"


@query(_RESOLVED)
def spec_merge(spark, sf_dir):
    return specs.resolve_presets(spark)


_KEYS = ", ".join(lit(k) for k in specs.PRESETS)


@query(f"""SELECT d.doc_id, s.preset, CASE WHEN doc_id % 5 = 0 THEN 9.5 WHEN doc_id % 3 = 0 THEN 11.0 ELSE s.font_size END AS font_size, CASE WHEN doc_id % 4 = 0 THEN 'apa' ELSE s.ref_style END AS ref_style, CASE WHEN doc_id % 2 = 0 THEN 180 ELSE s.abstract_words END AS abstract_words, s.scheme
FROM documents d JOIN ({_RESOLVED}) s ON s.preset = [{_KEYS}][doc_id % 15 + 1]""")
def spec_precedence(spark, sf_dir):
    d = derived.documents(spark, sf_dir).select("doc_id", F.element_at(F.array(*[F.lit(k) for k in specs.PRESETS]), (F.col("doc_id") % 15 + 1).cast("int")).alias("preset"))
    s = d.join(F.broadcast(specs.resolve_presets(spark)), "preset")
    i = F.col("doc_id")
    said = {"font_size": F.when(i % 3 == 0, 11.0), "abstract_words": F.when(i % 2 == 0, 180)}
    template = {"ref_style": F.when(i % 4 == 0, "apa")}
    manual = {"font_size": F.when(i % 5 == 0, 9.5), "abstract_words": F.lit(None).cast("int")}
    full = specs.merge({f: F.col(f) for f in ("font_size", "ref_style", "abstract_words", "scheme")}, said, template, manual)
    return s.select("doc_id", "preset", *[c.alias(f) for f, c in full.items()])


@query("""SELECT s_suppkey, ['IEEE Access', 'Proceedings of the IEEE Symposium on X', 'Elsevier B.V.', 'Lecture Notes in Computer Science', 'Nature Energy', 'Unknown Press', 'PLOS ONE', 'Wiley-Blackwell', 'Sensors'][s_suppkey % 9 + 1] AS name,
['ieee_journal', 'ieee_conference', 'elsevier', 'springer_lncs', 'springer_numeric', NULL, 'plos', 'wiley', 'mdpi'][s_suppkey % 9 + 1] AS preset FROM supplier""")
def publisher_rule_join(spark, sf_dir):
    names = ["IEEE Access", "Proceedings of the IEEE Symposium on X", "Elsevier B.V.", "Lecture Notes in Computer Science", "Nature Energy", "Unknown Press", "PLOS ONE", "Wiley-Blackwell", "Sensors"]
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % 9 + 1).cast("int")).alias("name"))
    return s.select("s_suppkey", "name", specs.preset_for(F.col("name")).alias("preset"))


_GUIDE = """SELECT doc_id, 'Manuscripts should be typed in ' || CASE doc_id % 3 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN 'Arial' ELSE 'Palatino' END || ', ' || CAST(9 + doc_id % 4 AS STRING) || ' pt, ' || CASE doc_id % 2 WHEN 0 THEN 'double' ELSE 'single' END || '-spaced on A4 paper. Margins of ' || CASE doc_id % 2 WHEN 0 THEN '2.5 cm' ELSE '1 inch' END
|| ' are needed. The abstract should not exceed ' || CAST(150 + doc_id % 100 AS STRING) || ' words. Give three to ' || CAST(5 + doc_id % 3 AS STRING) || ' keywords. The title may have up to ' || CAST(10 + doc_id % 9 AS STRING) || ' words. The manuscript must be within 8,000 words. Use '
|| CASE doc_id % 3 WHEN 0 THEN 'APA' WHEN 1 THEN 'Vancouver' ELSE 'numbers in square brackets for' END || ' references. Headings should ' || CASE doc_id % 2 WHEN 0 THEN 'not ' ELSE '' END || 'be numbered. The paper must include a Funding statement.' AS text FROM {documents} d"""


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN 'Arial' ELSE 'Palatino Linotype' END AS font, CAST(9 + doc_id % 4 AS DOUBLE) AS font_size, CAST(CASE doc_id % 2 WHEN 0 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS line_spacing, CAST(CASE doc_id % 2 WHEN 0 THEN 2.5 ELSE 2.54 END AS DOUBLE) AS margin_cm, 'A4' AS page_size,
CAST(150 + doc_id % 100 AS INTEGER) AS abstract_words, 3 AS keywords_min, CAST(5 + doc_id % 3 AS INTEGER) AS keywords_max, CAST(10 + doc_id % 9 AS INTEGER) AS title_words, 8000 AS total_words, CASE doc_id % 3 WHEN 0 THEN 'apa' ELSE 'vancouver' END AS ref_style, CASE doc_id % 3 WHEN 0 THEN 'author-year' ELSE 'numeric' END AS cite_mode,
CASE doc_id % 2 WHEN 0 THEN 'none' ELSE 'decimal' END AS scheme, 'Funding' AS required_sections FROM documents""")
def guidelines_extract(spark, sf_dir):
    g = spark.sql(_GUIDE, documents=derived.documents(spark, sf_dir))
    fields = {k: v for k, v in guidelines.fields(F.col("text")).items() if k not in ("columns", "line_numbers", "structured")}
    return g.select("doc_id", *[c.alias(k) for k, c in fields.items()])


@query("SELECT doc_id, ['ieee', 'chicago', 'lncs', 'apa', NULL, 'vancouver'][doc_id % 6 + 1] AS style FROM documents")
def detect_ref_style(spark, sf_dir):
    return learning.detect_ref_style(derived.refs(spark, sf_dir))


_SCHEME = f"""SELECT doc_id, bool_or(level = 1 AND text LIKE 'II.%') AS roman, bool_or(level = 1 AND text LIKE '1. %') AS dec, bool_or(level = 2) AS two FROM {BLOCKS} b WHERE role = 'heading' GROUP BY doc_id"""


@query(f"SELECT doc_id, CASE WHEN roman THEN 'ieee' WHEN dec THEN 'decimal' ELSE 'none' END AS scheme, CASE WHEN NOT roman AND dec THEN true END AS trailing_dot, CASE WHEN NOT roman AND dec AND two THEN false END AS sub_dot FROM ({_SCHEME}) s")
def heading_scheme(spark, sf_dir):
    return learning.heading_scheme(derived.blocks(spark, sf_dir).where("role = 'heading'"))


@query(f"SELECT DISTINCT doc_id, cap_kind, CASE cap_kind WHEN 'figure' THEN 'Figure' ELSE 'Table' END AS label, 'arabic' AS numbering, CASE cap_kind WHEN 'figure' THEN '. ' ELSE ': ' END AS separator FROM {BLOCKS} b WHERE role = 'caption'")
def caption_form(spark, sf_dir):
    return learning.caption_form(derived.blocks(spark, sf_dir).where("role = 'caption'"))


@query(f"""SELECT doc_id, ['ieee', 'chicago', 'lncs', 'apa', NULL, 'vancouver'][doc_id % 6 + 1] AS ref_style, CASE WHEN roman THEN 'ieee' WHEN dec THEN 'decimal' ELSE 'none' END AS scheme, m.mode AS cite_mode
FROM ({_SCHEME}) s JOIN (SELECT DISTINCT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'numeric' ELSE 'author-year' END AS mode FROM ({CITES}) c) m USING (doc_id)""")
def learn_format(spark, sf_dir):
    b = derived.blocks(spark, sf_dir)
    style = learning.detect_ref_style(derived.refs(spark, sf_dir)).withColumnRenamed("style", "ref_style")
    scheme = learning.heading_scheme(b.where("role = 'heading'")).select("doc_id", "scheme")
    mode = citations.citation_mode(b).select("doc_id", F.col("mode").alias("cite_mode"))
    return scheme.join(style, "doc_id").join(mode, "doc_id")


_WC = r"len(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_''’-]*'))"
_MENTIONED = "SELECT DISTINCT doc_id, 'figure' AS kind, 1 + (ln + 2) % 5 AS n FROM ({c}) c UNION SELECT doc_id, 'table', 1 + ln % 3 FROM ({c}) c UNION SELECT doc_id, 'table', 2 + ln % 3 FROM ({c}) c".format(c=CITES)
_CHECKS = f"""WITH b AS {BLOCKS}, miss AS (SELECT doc_id, string_agg(CASE cap_kind WHEN 'figure' THEN 'Fig. ' ELSE 'Table ' END || cap_num, ', ' ORDER BY pos) AS missing FROM b ANTI JOIN ({_MENTIONED}) m ON m.doc_id = b.doc_id AND m.kind = b.cap_kind AND m.n = b.cap_num WHERE role = 'caption' GROUP BY doc_id),
a AS (SELECT doc_id, sum({_WC}) FILTER (role = 'title') AS title, sum({_WC}) FILTER (role = 'abstract') - 1 AS abstract, sum({_WC}) FILTER (role IN ('para', 'heading', 'abstract')) AS total, count(*) FILTER (role = 'figure') AS figures, count(*) FILTER (role = 'table') AS tables,
  count(*) FILTER (role = 'caption' AND cap_kind = 'figure') AS fcaps, count(*) FILTER (role = 'caption' AND cap_kind = 'table') AS tcaps, count(*) FILTER (role = 'reference') AS refs, bool_or(role = 'heading' AND contains(lower(text), 'introd')) AS s0, bool_or(role = 'heading' AND contains(lower(text), 'result')) AS s1 FROM b GROUP BY doc_id),
j AS (SELECT a.*, coalesce(missing, '') AS missing, CASE a.doc_id % 3 WHEN 0 THEN 4 ELSE 3 END AS terms FROM a LEFT JOIN miss USING (doc_id))
SELECT doc_id, CAST(0 AS BIGINT) AS seq, 'Title length' AS name, title <= 15 AS ok, title || ' words (limit 15)' AS detail FROM j
UNION ALL SELECT doc_id, 2, 'Abstract length', abstract <= 250, abstract || ' words (limit 250)' FROM j
UNION ALL SELECT doc_id, 4, 'Keyword count', true, terms || ' keywords (required 3–6)' FROM j
UNION ALL SELECT doc_id, 6, 'Manuscript length', total <= 3000, total || ' words excl. references (limit 3000)' FROM j
UNION ALL SELECT doc_id, 7, 'Section “Introduction”', s0, CASE WHEN s0 THEN 'present' ELSE 'missing — required by the guidelines' END FROM j
UNION ALL SELECT doc_id, 8, 'Section “Results”', s1, CASE WHEN s1 THEN 'present' ELSE 'missing — required by the guidelines' END FROM j
UNION ALL SELECT doc_id, 9, 'Section “Conclusion”', false, 'missing — required by the guidelines' FROM j
UNION ALL SELECT doc_id, 10, 'Figure captions', fcaps >= 1, figures || ' image(s), ' || fcaps || ' figure caption(s)' FROM j WHERE figures > 0
UNION ALL SELECT doc_id, 11, 'Table captions', tcaps >= tables, tables || ' table(s), ' || tcaps || ' table caption(s)' FROM j WHERE tables > 0
UNION ALL SELECT doc_id, 12, 'Figures/tables cited in text', missing = '', CASE WHEN missing = '' THEN 'all cited' ELSE 'not cited: ' || missing END FROM j WHERE fcaps + tcaps > 0
UNION ALL SELECT doc_id, 13, 'Reference list', refs > 0, refs || ' references' FROM j"""


@query(_CHECKS)
def compliance_checks(spark, sf_dir):
    return checks.checks(derived.blocks(spark, sf_dir))


@query(f"SELECT doc_id, '# Report' || chr(10) || chr(10) || '## Checks' || chr(10) || string_agg('- ' || CASE WHEN ok THEN '✅' ELSE '⚠️' END || ' **' || name || '**: ' || detail, chr(10) ORDER BY seq) || chr(10) AS report FROM ({_CHECKS}) c GROUP BY doc_id")
def report_markdown(spark, sf_dir):
    return checks.report_markdown(checks.checks(derived.blocks(spark, sf_dir)))


@query()
def latex_render(spark, sf_dir):
    return checks.render_latex(derived.blocks(spark, sf_dir))


@query(f"""SELECT preset, CASE page_size WHEN 'A4' THEN (21.0 - 2 * margin_cm - 0.5 * (columns - 1)) / columns ELSE (21.59 - 2 * margin_cm - 0.5 * (columns - 1)) / columns END AS width_cm FROM ({_RESOLVED}) s""")
def column_width(spark, sf_dir):
    s = specs.resolve_presets(spark)
    width = F.when(F.col("page_size") == "A4", 21.0).otherwise(21.59)
    return s.select("preset", specs.column_width_cm(width, F.col("margin_cm"), F.col("margin_cm"), F.col("columns"), F.lit(0.5)).alias("width_cm"))


QUERIES, ORACLES = Q, O
