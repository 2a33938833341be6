"""Compliance checks, reports and ordered text output of whole manuscripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import tex_escape, word_count
from vellum.operators.learning import keywords

LIMITS = {"title_words": 15, "abstract_words": 250, "keywords_min": 3, "keywords_max": 6, "total_words": 3000}


def checks(blocks: DataFrame, limits: dict[str, int | Column] | None = None, sections: tuple[str, ...] = ("Introduction", "Results", "Conclusion")) -> DataFrame:
    """doc_id, name, ok, detail. One grouped pass over the blocks and one anti-join for captions that no text mentions."""
    lim = LIMITS | (limits or {})
    role, words = F.col("role"), word_count(F.col("text"))
    of = lambda *names: role.isin(*names)
    count = lambda *names: F.count_if(of(*names)).cast("bigint")
    _, terms = keywords(F.regexp_replace("text", r"(?is)^\s*(?:key\s*-?\s*words?|index\s+terms)\s*(?:[:\-–—.]\s*)?", ""))
    title = F.min_by(words, F.when(of("title"), F.col("pos")))
    abstract = F.sum(F.when(of("abstract"), word_count(F.regexp_replace("text", r"(?is)^\s*abstract\s*[:\-–—.]?\s*", ""))))
    a = blocks.groupBy("doc_id").agg(
        title.alias("title"), abstract.alias("abstract"), F.min_by(terms, F.when(of("keywords"), F.col("pos"))).alias("terms"), F.sum(F.when(of("para", "list", "heading", "abstract"), words)).alias("total"),
        count("figure").alias("figures"), count("table").alias("tables"), F.count_if(of("caption") & (F.col("cap_kind") == "figure")).alias("fcaps"), F.count_if(of("caption") & (F.col("cap_kind") == "table")).alias("tcaps"),
        count("reference").alias("refs"), *[F.coalesce(F.bool_or(of("heading") & F.contains(F.lower("text"), F.lit(s.lower()[:6]))), F.lit(False)).alias(f"s{i}") for i, s in enumerate(sections)],
    )
    a = a.join(unmentioned(blocks), "doc_id", "left").withColumn("missing", F.coalesce("missing", F.lit("")))
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    col = F.col
    rows = [
        (col("title").isNotNull(), "Title length", col("title") <= lim["title_words"], c(col("title"), f" words (limit {lim['title_words']})")),
        (col("title").isNull(), "Title present", F.lit(False), F.lit("No title detected")),
        (col("abstract").isNotNull(), "Abstract length", col("abstract") <= lim["abstract_words"], c(col("abstract"), f" words (limit {lim['abstract_words']})")),
        (col("abstract").isNull(), "Abstract present", F.lit(False), F.lit("No abstract detected")),
        (col("terms").isNotNull(), "Keyword count", col("terms").between(lim["keywords_min"], lim["keywords_max"]), c(col("terms"), f" keywords (required {lim['keywords_min']}–{lim['keywords_max']})")),
        (col("terms").isNull(), "Keywords present", F.lit(False), F.lit("No keywords line detected")),
        (F.lit(True), "Manuscript length", F.coalesce("total", F.lit(0)) <= lim["total_words"], c(F.coalesce("total", F.lit(0)), f" words excl. references (limit {lim['total_words']})")),
        *[(F.lit(True), f"Section “{s}”", col(f"s{i}"), F.when(col(f"s{i}"), "present").otherwise("missing — required by the guidelines")) for i, s in enumerate(sections)],
        (col("figures") > 0, "Figure captions", col("fcaps") >= 1, c(col("figures"), " image(s), ", col("fcaps"), " figure caption(s)")),
        (col("tables") > 0, "Table captions", col("tcaps") >= col("tables"), c(col("tables"), " table(s), ", col("tcaps"), " table caption(s)")),
        (col("fcaps") + col("tcaps") > 0, "Figures/tables cited in text", col("missing") == "", F.when(col("missing") == "", "all cited").otherwise(c("not cited: ", col("missing")))),
        (F.lit(True), "Reference list", col("refs") > 0, c(col("refs"), " references")),
    ]
    packed = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(i).cast("bigint").alias("seq"), F.lit(name).alias("name"), ok.alias("ok"), detail.alias("detail"))) for i, (when, name, ok, detail) in enumerate(rows)]))
    return a.select("doc_id", F.explode(packed).alias("r")).select("doc_id", "r.seq", "r.name", "r.ok", "r.detail")


def unmentioned(blocks: DataFrame) -> DataFrame:
    """doc_id, missing: captions that no paragraph mentions, by name, in order."""
    pattern = r"(?i)\b((?:Fig(?:ure)?s?\.?|Tables?)\s*\d+(?:\s*(?:[-–,]|and)\s*\d+)?)\b"
    said = blocks.where(F.col("role").isin("para", "list")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("m"))
    kind = F.when(F.lower("m").startswith("t"), "table").otherwise("figure")
    said = said.select("doc_id", kind.alias("cap_kind"), F.explode(F.regexp_extract_all("m", F.lit(r"(\d+)"), F.lit(1))).alias("cap_num")).select("doc_id", "cap_kind", F.col("cap_num").cast("bigint").alias("cap_num")).distinct()
    caps = blocks.where("role = 'caption'").select("doc_id", "pos", "cap_kind", "cap_num")
    left = caps.join(said, ["doc_id", "cap_kind", "cap_num"], "left_anti")
    name = F.concat(F.when(F.col("cap_kind") == "figure", "Fig. ").otherwise("Table "), F.col("cap_num").cast("string"))
    return left.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", name.alias("n")))), lambda x: x["n"]), ", ").alias("missing"))


def report_markdown(checked: DataFrame, title: str = "Report") -> DataFrame:
    """doc_id, report: the checks of each document as Markdown, in order."""
    line = F.concat(F.lit("- "), F.when(F.col("ok"), "✅").otherwise("⚠️"), F.lit(" **"), "name", F.lit("**: "), "detail")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n")
    return checked.groupBy("doc_id").agg(F.concat(F.lit(f"# {title}\n\n## Checks\n"), lines, F.lit("\n")).alias("report"))


def ordered_distinct(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each value once, in order of its first occurrence: group, value, place."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("first"))
    return first.select(group, value, F.row_number().over(Window.partitionBy(group).orderBy("first")).cast("bigint").alias("place"))


def render_latex(blocks: DataFrame) -> DataFrame:
    """doc_id, latex: the body in order; each block is rendered by its role in columns, then joined once per document."""
    t = tex_escape(F.col("text"))
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    section = F.element_at(F.array(*[F.lit(x) for x in ("\\section{", "\\subsection{", "\\subsubsection{", "\\paragraph{")]), F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(4)).cast("int"))
    body = (
        F.when(F.col("role") == "title", c("\\title{", t, "}"))
        .when(F.col("role") == "author", c("\\author{", t, "}"))
        .when(F.col("role") == "abstract", c("\\begin{abstract}\n", t, "\n\\end{abstract}"))
        .when(F.col("role") == "heading", c(section, t, "}"))
        .when(F.col("role") == "caption", c("\\caption{", t, "}"))
        .when(F.col("role") == "reference", c("\\bibitem{r", F.col("pos").cast("string"), "} ", t))
        .when(F.col("role").isin("figure", "table"), F.lit("% float"))
        .otherwise(t)
    )
    return blocks.select("doc_id", "pos", body.alias("b")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "\n\n").alias("latex"))
