"""LaTeX sources as text columns: comments, environments, equation numbers, references to labels, inline maths, pseudo-code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATH_ENV = r"(?s)\\begin\{(equation|align|gather|multline|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}"
#: As one capture for lists of matches.
MATH_ENV_ALL = r"(?s)(\\begin\{(equation|align|gather|multline|eqnarray)(\*?)\}.*?\\end\{\2\3\})"


def strip_comments(c: Column) -> Column:
    """From an unescaped % to the end of its line."""
    return F.regexp_replace(c, r"(?m)(?<!\\)%.*$", "")


def environments(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, idx, env, starred, body, label, first_num, last_num: display maths in order. Each row of a multi-line environment
    has a number unless it says otherwise; starred ones have none."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all(strip_comments(F.col(text)), F.lit(MATH_ENV_ALL), F.lit(1))).alias("idx", "src"))
    part = lambda i: F.regexp_extract("src", MATH_ENV, i)
    e = found.select("doc_id", F.col("idx").cast("bigint").alias("idx"), part(1).alias("env"), (part(2) == "*").alias("starred"), part(3).alias("body"))
    rows = F.filter(F.split("body", r"\\\\"), lambda r: ~r.rlike(r"\\nonumber|\\notag") & (F.trim(r) != ""))
    n = F.when(F.col("starred"), 0).when(F.col("env").isin("equation", "multline"), F.when(F.col("body").rlike(r"\\nonumber|\\notag"), 0).otherwise(1)).otherwise(F.size(rows))
    e = e.withColumn("n", n).withColumn("last", F.sum("n").over(Window.partitionBy("doc_id").orderBy("idx")))
    label = F.nullif(F.regexp_extract("body", r"\\label\{([^}]*)\}", 1), F.lit(""))
    return e.select("doc_id", "idx", "env", "starred", F.trim(F.regexp_replace("body", r"\\label\{[^}]*\}", "")).alias("body"), label.alias("label"), F.when(F.col("n") > 0, F.col("last") - F.col("n") + 1).cast("bigint").alias("first_num"), F.when(F.col("n") > 0, F.col("last")).cast("bigint").alias("last_num"))


def resolve_refs(docs: DataFrame, envs: DataFrame, text: str = "text") -> DataFrame:
    r"""doc_id, text with \ref and \eqref as numbers; unknown labels stay."""
    kv = F.map_from_entries(F.collect_list(F.struct("label", F.col("first_num").cast("string"))))
    labels = envs.where("label is not null and first_num is not null").dropDuplicates(["doc_id", "label"]).groupBy("doc_id").agg(kv.alias("labels"))
    d = docs.select("doc_id", F.col(text).alias("t")).join(labels, "doc_id", "left")
    pattern = r"\\(?:eq)?ref\{[^}]*\}"
    found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))

    def one(m: Column) -> Column:
        n = F.element_at(F.col("labels"), F.regexp_extract(m, r"\{([^}]*)\}", 1))
        return F.coalesce(F.when(m.startswith("\\eqref"), F.concat(F.lit("("), n, F.lit(")"))).otherwise(n), m)

    return d.select("doc_id", F.array_join(F.transform(F.split("t", pattern, -1), lambda g, i: F.concat(g, F.coalesce(F.when(i < F.size(found), one(F.get(found, i))), F.lit("")))), "").alias("text"))


def inline_math(c: Column) -> Column:
    r"""array<struct<text, math>>: $...$ and \(...\) apart from the text around."""
    pattern = r"\$[^$]+\$|\\\(.+?\\\)"
    gaps, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    inner = lambda m: F.regexp_replace(m, r"^\$|\$$|^\\\(|\\\)$", "")
    piece = lambda t, m: F.struct(t.alias("text"), F.lit(m).alias("math"))
    all_pieces = F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(found), F.array(piece(g, False), piece(inner(F.get(found, i)), True))).otherwise(F.array(piece(g, False)))))
    return F.filter(all_pieces, lambda p: p["text"] != "")


OPENS = r"^\\(?:For|ForAll|While|If|Procedure|Function|Repeat|Loop)\b"
CLOSES = r"^\\(?:EndFor|EndWhile|EndIf|EndProcedure|EndFunction|Until|EndLoop)\b"
MIDDLE = r"^\\(?:Else|ElsIf)\b"


def pseudocode(c: Column) -> Column:
    """array<struct<indent, line>>: algorithmic commands with the depth of their blocks, by one fold over the lines."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<indent:int,line:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.greatest(F.when(x.rlike(CLOSES) | x.rlike(MIDDLE), acc["depth"] - 1).otherwise(acc["depth"]), F.lit(0))
        after = F.when(x.rlike(OPENS) | x.rlike(MIDDLE), here + 1).otherwise(here)
        return F.struct(after.alias("depth"), F.concat(acc["out"], F.array(F.struct(here.cast("int").alias("indent"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^\\State\s*", ""), r"\{([^{}]*)\}", " $1")).alias("line")))).alias("out"))

    return F.aggregate(lines, start, step, lambda a: a["out"])
