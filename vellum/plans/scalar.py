"""Queries of the scalar layer: normalising, casing, numerals, predicates, escaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import bibliography as bib
from vellum.functions import text as tx
from vellum.operators import classify as cl
from vellum.operators import latex, learning, runs, specs
from vellum.sources import derived


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BLOCKS = f"({derived.blocks_sql('documents')})"
REFS = f"({derived.refs_sql('documents')})"
A, B = tx.fold_table()
SMALL = ", ".join(lit(w) for w in tx.SMALL_WORDS)
Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', ' ', 'g')) AS norm FROM documents")
def norm_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.norm(F.col("text")).alias("norm"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_''’-]*')) AS BIGINT) AS words FROM documents")
def word_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


_HTML = r"regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<header.*?</header>', ' ', 'g')"
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '(?i)<br\s*/?>|</(?:p|li|h[0-9]|div)>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
#: The references that occur in the pages, the ampersand last.
for _k, _v in {"&nbsp;": 160, "&lt;": 60, "&gt;": 62, "&quot;": 34, "&#39;": 39, "&#x27;": 39, "&apos;": 39, "&copy;": 169, "&middot;": 183, "&ndash;": 8211, "&mdash;": 8212, "&hellip;": 8230, "&eacute;": 233, "&amp;": 38}.items():
    _HTML = f"replace({_HTML}, {lit(_k)}, chr({_v}))"


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({_HTML}, '\n\s*\n+', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS text FROM pages")
def html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query(f"""WITH l AS (SELECT d.source, l.doc_id, l.line FROM ({derived.LINES_OTHER.format(documents='documents')}) l JOIN documents d USING (doc_id)),
k AS (SELECT source, doc_id, substr(regexp_replace(trim(line), '[0-9]+', '#', 'g'), 1, 80) AS key FROM l WHERE trim(line) <> ''),
n AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM k GROUP BY ALL), s AS (SELECT source, count(DISTINCT doc_id) AS docs FROM l GROUP BY 1)
SELECT source, key, n FROM n JOIN s USING (source) WHERE docs >= 3 AND n >= greatest(2, ceil(docs * 0.02))""")
def boilerplate_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    return learning.boilerplate(lines, "source", share=0.02)


@query("""WITH n AS (SELECT DISTINCT p_size AS n FROM part), r AS (SELECT n, repeat('C', n // 100) || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] AS roman FROM n)
SELECT CAST(n AS BIGINT) AS n, roman, CAST(n AS BIGINT) AS back FROM r""")
def roman_numerals(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("n")).distinct().withColumn("roman", tx.int_to_roman(F.col("n")))
    return n.withColumn("back", tx.roman_to_int(F.col("roman")))


_UP = "(w = upper(w) AND w <> lower(w) AND length(w) > 1)"
_INNER = "(substr(w, 2) <> lower(substr(w, 2)))"
_CAP = "(CASE WHEN regexp_matches(substr(w, 1, 1), '^[\\x00-\\x7FÀ-ɏ]') THEN upper(substr(w, 1, 1)) ELSE substr(w, 1, 1) END)"


@query(f"""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' of the IoT' WHEN 1 THEN ' and iPhone' WHEN 2 THEN ' VIA a Bus' ELSE '' END AS t FROM part),
u AS (SELECT p_partkey, CASE WHEN t = upper(t) AND t <> lower(t) AND length(t) > 4 THEN lower(t) ELSE t END AS b, t FROM t)
SELECT p_partkey, array_to_string(list_transform(string_split(b, ' '), lambda w, i: CASE WHEN {_UP} THEN w WHEN i > 1 AND lower(w) IN ({SMALL}) THEN lower(w) WHEN {_INNER} THEN {_CAP} || substr(w, 2) ELSE {_CAP} || lower(substr(w, 2)) END), ' ') AS title,
array_to_string(list_transform(string_split(b, ' '), lambda w, i: CASE WHEN {_UP} OR {_INNER} THEN w WHEN i = 1 THEN {_CAP} || lower(substr(w, 2)) ELSE lower(w) END), ' ') AS sentence, upper(t) AS upper FROM u""")
def apply_case(spark, sf_dir):
    extra = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' of the IoT' WHEN 1 THEN ' and iPhone' WHEN 2 THEN ' VIA a Bus' ELSE '' END")
    t = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", extra).alias("t"))
    return t.select("p_partkey", *[tx.apply_case(F.col("t"), c).alias(c) for c in ("title", "sentence", "upper")])


@query(rf"""WITH h AS (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN upper(text) WHEN 1 THEN text ELSE lower(text) END AS t FROM {BLOCKS} b WHERE role = 'heading'),
w AS (SELECT *, regexp_extract_all(t, '[A-Za-z][\p{{L}}\p{{N}}_''-]*') AS ws FROM h), g AS (SELECT *, list_filter(ws, lambda x: length(x) > 3) AS big FROM w)
SELECT doc_id, pos, CASE WHEN t = upper(t) AND t <> lower(t) THEN 'upper' WHEN len(big) > 1 AND len(list_filter(big, lambda x: regexp_matches(x, '^[A-Z]'))) > 0.8 * len(big) THEN 'title' WHEN len(ws) > 0 AND regexp_matches(ws[1], '^[A-Z]') THEN 'sentence' ELSE 'as-is' END AS text_case FROM g""")
def text_case(spark, sf_dir):
    h = derived.blocks(spark, sf_dir).where("role = 'heading'")
    t = F.expr("CASE pos % 3 WHEN 0 THEN upper(text) WHEN 1 THEN text ELSE lower(text) END")
    return h.select("doc_id", "pos", tx.text_case(t).alias("text_case"))


@query(rf"""SELECT doc_id, pos, CAST(CASE WHEN regexp_matches(text, '^\d') THEN len(string_split(regexp_extract(text, '^([\d.]*\d)\.?\s', 1), '.')) WHEN text LIKE 'II. %' THEN 1 ELSE 0 END AS INTEGER) AS level,
regexp_replace(regexp_replace(text, '^[\d.]+\s+', ''), '^II\.\s+', '') AS bare FROM {BLOCKS} b WHERE role = 'heading'""")
def heading_number(spark, sf_dir):
    level, bare = cl.heading_number(F.col("text"))
    return derived.blocks(spark, sf_dir).where("role = 'heading'").select("doc_id", "pos", level.alias("level"), bare.alias("bare"))


@query(f"SELECT doc_id, pos, CAST(CASE WHEN role = 'heading' THEN level ELSE 0 END AS INTEGER) AS level FROM {BLOCKS} b WHERE role IN ('heading', 'para', 'caption')")
def heading_detect(spark, sf_dir):
    b = derived.blocks(spark, sf_dir).where("role IN ('heading', 'para', 'caption')")
    return b.select("doc_id", "pos", cl.heading_level(F.col("text"), F.lit(False), F.lit(11.0), F.lit(11.0), F.lit("")).alias("level"))


_DECOYS = "SELECT doc_id, pos, role, text FROM {blocks} b WHERE role IN ('caption', 'para') UNION ALL SELECT doc_id, pos + 1000000000, 'decoy', 'Figure ' || CAST(pos % 9 AS STRING) || CASE pos % 3 WHEN 0 THEN ' shows the growth.' WHEN 1 THEN ' is below, see there.' ELSE '. the results are' END FROM {blocks} b WHERE role = 'caption'"


@query(f"SELECT doc_id, pos, role = 'caption' AS is_caption FROM ({_DECOYS.format(blocks=BLOCKS)}) d")
def caption_detect(spark, sf_dir):
    b = spark.sql(_DECOYS, blocks=derived.blocks(spark, sf_dir))
    return b.select("doc_id", "pos", cl.is_caption(F.col("text"), F.lit("")).alias("is_caption"))


_ALGO = """SELECT d.doc_id, CAST(d.doc_id * 100 + v.i AS BIGINT) AS pos, CASE WHEN v.i % 10 = 0 THEN 'Algorithm ' || CAST(v.i / 10 + 1 AS STRING) || ': Search of order ' || CAST(d.doc_id AS STRING) ELSE v.t END AS text, v.head, v.line
FROM {documents} d JOIN (SELECT * FROM (VALUES (0, '', true, true), (1, 'Input: a graph G', false, true), (2, '1: initialise the queue', false, true), (3, 'while queue is not empty do', false, true), (4, 'x ← x + 1', false, true), (5, 'return x', false, true), (6, 'The search was repeated often in the city.', false, false), (7, 'Algorithm 3 shows the main loop of it.', false, false), (8, 'Step 2) update weights', false, true), (9, 'They walked home.', false, false)) AS t(i, t, head, line)) v ON v.i <= 9 - d.doc_id % 3"""


@query(f"SELECT doc_id, pos, head AS is_head, line AND NOT head AS is_line FROM ({_ALGO.format(documents='documents')}) a")
def algo_detect(spark, sf_dir):
    a = spark.sql(_ALGO, documents=derived.documents(spark, sf_dir))
    no = F.lit(False)
    head = cl.is_algorithm_head(F.col("text"), no)
    return a.select("doc_id", "pos", head.alias("is_head"), (cl.is_algorithm_line(F.col("text"), no, no, no, F.lit(""), no) & ~head).alias("is_line"))


@query("SELECT doc_id, doc_id * 100 AS first, CAST(5 AS BIGINT) AS n_lines FROM documents")
def algo_blocks(spark, sf_dir):
    a = spark.sql(_ALGO, documents=derived.documents(spark, sf_dir)).withColumn("bold", F.lit(False)).withColumn("indented", F.lit(False)).withColumn("numbered", F.lit(False))
    return cl.algorithm_blocks(a)


# without a heading the automaton never enters its reference state, so the entries of such manuscripts are paragraphs
@query(f"""SELECT doc_id, pos, CASE WHEN doc_id % 7 = 0 AND role = 'reference' THEN 'para' ELSE role END AS role FROM {BLOCKS} b WHERE role NOT IN ('figure', 'table')""")
def role_classify(spark, sf_dir):
    """Roles from the text alone: no paragraph has a style, and all have one size and weight."""
    b = derived.blocks(spark, sf_dir).where("role NOT IN ('figure', 'table')")
    p = b.select("doc_id", "pos", "text", F.lit("").alias("style"), F.lit(11.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("is_list"))
    return cl.classify(p).select("doc_id", "pos", "role")


@query(f"SELECT DISTINCT family1 AS family, lower(translate(family1, {lit(A)}, {lit(B)})) AS folded FROM {REFS} r")
def fold_names(spark, sf_dir):
    return derived.refs(spark, sf_dir).select(F.col("family1").alias("family"), tx.fold(F.col("family1")).alias("folded")).distinct()


_GIVEN = "SELECT DISTINCT CASE k % 4 WHEN 0 THEN 'Anna ' || family1 WHEN 1 THEN 'Jean-Paul' WHEN 2 THEN 'AB' ELSE ini1 END AS given, CASE k % 4 WHEN 0 THEN 'A.' || substring(family1, 1, 1) || '.' WHEN 1 THEN 'J.-P.' WHEN 2 THEN 'A.B.' ELSE ini1 END AS truth FROM {refs} r"


@query(f"SELECT given, truth AS initials FROM ({_GIVEN.format(refs=REFS)}) g")
def initials(spark, sf_dir):
    return spark.sql(_GIVEN, refs=derived.refs(spark, sf_dir)).select("given", bib.initials(F.col("given")).alias("initials"))


@query("SELECT doc_id, [{'name': 'Maria Lopez', 'marks': '1'}, {'name': 'John Doe', 'marks': '2'}, {'name': 'Wei Chen', 'marks': '1'}][i].name AS name, ['1', '2', '1'][i] AS marks, CAST(i - 1 AS BIGINT) AS place FROM documents, (VALUES (1), (2), (3)) v(i)")
def author_markers(spark, sf_dir):
    a = derived.blocks(spark, sf_dir).where("role = 'author'").select("doc_id", F.posexplode(bib.author_markers(F.col("text"))).alias("place", "a"))
    return a.select("doc_id", "a.name", "a.marks", F.col("place").cast("bigint").alias("place"))


_TEX = "text"
for _k, _v in (("\\", "\x01"), ("{", "\x02"), ("}", "\x03")):
    _TEX = f"replace({_TEX}, {lit(_k)}, chr({ord(_v)}))"
for _k, _v in tx.TEX_SPECIAL.items():
    if _k not in "\\{}":
        _TEX = f"replace({_TEX}, {lit(_k)}, {lit(_v)})"
for _k, _v in (("\x01", "\\textbackslash{}"), ("\x02", "\\{"), ("\x03", "\\}")):
    _TEX = f"replace({_TEX}, chr({ord(_k)}), {lit(_v)})"


@query(f"SELECT doc_id, {_TEX} AS latex FROM (SELECT doc_id, replace(text, '$', '') AS text FROM documents) d WHERE regexp_full_match(text, '[\\x09\\x0A\\x20-\\x7EÀ-ÖØ-öø-ſ]*')")
def tex_escape(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"^[\x09\x0A\x20-\x7EÀ-ÖØ-öø-ſ]*\z"))
    return d.select("doc_id", tx.tex_escape(F.replace("text", F.lit("$"), F.lit(""))).alias("latex"))


@query()
def tex_unknown_chars(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.tex_unknown(F.col("text")), "").alias("unknown")).where("unknown <> ''")


@query(r"SELECT doc_id, replace(regexp_replace(regexp_replace(replace(text, ' ', '-' || chr(10)), '([\p{Ll}])-\n([\p{Ll}])', '\1\2', 'g'), '', ''), chr(10), ' ') AS text FROM documents")
def dehyphenate(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", tx.dehyphenate(F.replace("text", F.lit(" "), F.lit("-\n"))).alias("text"))


_LINES = derived.LINES_OTHER.format(documents="documents")
_RUNS = f"SELECT doc_id, ln, string_split(line, ' ') AS ws FROM ({_LINES}) l"


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's words as runs; every word of five letters or more is bold."""
    r = F.transform(F.split("line", " ", -1), lambda w: runs.run(w, F.length(w) >= 5, F.lit(False), F.lit(False), F.lit(False)))
    return spark.sql(derived.LINES_SPARK, documents=derived.documents(spark, sf_dir)).select("doc_id", "ln", r.alias("runs"))


@query(f"""WITH w AS ({_RUNS}), e AS (SELECT doc_id, ln, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w), f AS (SELECT *, length(w) >= 5 AS b, lag(length(w) >= 5) OVER (PARTITION BY doc_id, ln ORDER BY i) AS before FROM e),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ln ORDER BY i) AS run FROM f)
SELECT doc_id, ln, CAST(run - 1 AS BIGINT) AS run, string_agg(w, '' ORDER BY i) AS text, any_value(b) AS bold FROM g GROUP BY doc_id, ln, run""")
def merge_runs(spark, sf_dir):
    m = word_runs(spark, sf_dir).select("doc_id", "ln", F.posexplode(runs.merge_runs(F.col("runs"))).alias("run", "r"))
    return m.select("doc_id", "ln", F.col("run").cast("bigint").alias("run"), "r.text", "r.bold")


@query(f"WITH w AS ({_RUNS}), f AS (SELECT doc_id, ln, list_filter(ws, lambda w: trim(w) <> '') AS ws FROM w) SELECT doc_id, ln, len(list_filter(ws, lambda w: length(w) >= 5)) BETWEEN 1 AND len(ws) - 1 AS kept FROM f")
def partial_emphasis(spark, sf_dir):
    return word_runs(spark, sf_dir).select("doc_id", "ln", runs.partial_emphasis(F.col("runs"), "bold").alias("kept"))


@query(f"SELECT doc_id, ln, substr(line, 1, 7) || CASE WHEN length(line) > 7 THEN '<new>' ELSE '' END || substr(line, 30) AS text FROM ({_LINES}) l")
def span_replace(spark, sf_dir):
    """The span crosses runs: a line as three runs of eleven characters, eleven, and the rest."""
    part = lambda a, n, bold: runs.run(F.substring("line", F.lit(a), n), F.lit(bold), F.lit(False), F.lit(False), F.lit(False))
    lines = spark.sql(derived.LINES_SPARK, documents=derived.documents(spark, sf_dir))
    three = F.array(part(1, F.lit(11), False), part(12, F.lit(11), True), part(23, F.length("line"), False))
    return lines.select("doc_id", "ln", runs.plain(runs.replace_span(three, F.lit(7), F.lit(29), F.lit("<new>"))).alias("text"))


@query()
def latex_runs(spark, sf_dir):
    return word_runs(spark, sf_dir).select("doc_id", "ln", runs.to_latex(runs.merge_runs(F.col("runs")), tx.tex_escape).alias("latex"))


_TEXDOC = r"""SELECT doc_id, 'Intro $x_' || CAST(doc_id AS STRING) || '$ text % note
\begin{equation}\label{eq:a} a=' || CAST(doc_id AS STRING) || ' \end{equation} then
\begin{align} b &= 1 \\ c &= 2 \nonumber \\ d &= 3 \label{eq:b} \end{align}
\begin{equation*} z \end{equation*} See \ref{eq:a}, \eqref{eq:b} and \ref{eq:none}; \(q\) ends.' AS text FROM {documents} d"""
_TEXDOC_SPARK = _TEXDOC.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}").replace("{{documents}}", "{documents}")


@query("""SELECT doc_id, CAST(v.i AS BIGINT) AS idx, v.env, v.starred, CASE v.i WHEN 0 THEN 'a=' || doc_id WHEN 1 THEN 'b &= 1 \\\\ c &= 2 \\nonumber \\\\ d &= 3' ELSE 'z' END AS body, v.label, CAST(v.a AS BIGINT) AS first_num, CAST(v.b AS BIGINT) AS last_num
FROM documents, (VALUES (0, 'equation', false, 'eq:a', 1, 1), (1, 'align', false, 'eq:b', 2, 3), (2, 'equation', true, NULL, NULL, NULL)) v(i, env, starred, label, a, b)""")
def latex_env_extract(spark, sf_dir):
    return latex.environments(spark.sql(_TEXDOC_SPARK, documents=derived.documents(spark, sf_dir)))


@query(r"""SELECT doc_id, regexp_extract(t, 'See .*$') AS text FROM (SELECT doc_id, 'See 1, (2) and \ref{eq:none}; \(q\) ends.' AS t FROM documents) d""")
def latex_ref_resolve(spark, sf_dir):
    d = spark.sql(_TEXDOC_SPARK, documents=derived.documents(spark, sf_dir))
    return latex.resolve_refs(d, latex.environments(d)).select("doc_id", F.regexp_extract("text", "See .*$", 0).alias("text"))


@query(r"""SELECT doc_id, CAST(v.i AS BIGINT) AS idx, CASE v.i WHEN 1 THEN 'x_' || doc_id WHEN 3 THEN 'q' ELSE v.t END AS text, v.math FROM documents, (VALUES (0, 'Intro ', false), (1, '', true), (2, ' and ', false), (3, '', true), (4, ' end', false)) v(i, t, math)""")
def inline_math_split(spark, sf_dir):
    d = derived.documents(spark, sf_dir).select("doc_id", F.concat(F.lit("Intro $x_"), F.col("doc_id").cast("string"), F.lit("$ and \\(q\\) end")).alias("t"))
    return d.select("doc_id", F.posexplode(latex.inline_math(F.col("t"))).alias("idx", "p")).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "p.text", "p.math")


@query(r"""SELECT doc_id, CAST(v.i AS BIGINT) AS idx, v.indent, replace(v.line, '@', CAST(doc_id AS STRING)) AS line FROM documents, (VALUES (0, 0, '\Procedure Find'), (1, 1, 'x = @'), (2, 1, '\While x>0'), (3, 2, '\If odd'), (4, 3, 'x -= 1'), (5, 2, '\Else'), (6, 3, 'x /= 2'), (7, 2, '\EndIf'), (8, 1, '\EndWhile'), (9, 0, '\EndProcedure')) v(i, indent, line)""")
def pseudocode_indent(spark, sf_dir):
    src = "\\Procedure{Find}\n\\State x = @\n\\While{x>0}\n\\If{odd}\n\\State x -= 1\n\\Else\n\\State x /= 2\n\\EndIf\n\\EndWhile\n\\EndProcedure"
    d = derived.documents(spark, sf_dir).select("doc_id", F.replace(F.lit(src), F.lit("@"), F.col("doc_id").cast("string")).alias("t"))
    return d.select("doc_id", F.posexplode(latex.pseudocode(F.col("t"))).alias("idx", "p")).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "p.indent", "p.line")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN 'Arial' WHEN 2 THEN 'Computer Modern' WHEN 3 THEN 'Foo' ELSE 'Times New Roman' END AS family FROM part""")
def font_map(spark, sf_dir):
    name = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'ABCDEF+TimesNewRomanPS-Bold' WHEN 1 THEN 'Helvetica-Light' WHEN 2 THEN 'XYZABC+CMR10' WHEN 3 THEN 'Foo-Italic' ELSE '' END")
    return read(spark, sf_dir, "part").select("p_partkey", specs.font_family(name).alias("family"))
