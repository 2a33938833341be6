"""Pseudo-code of pages: a head and the rows that go on it, over blocks, columns and pages, with how far each is indented.

Rows stand in reading order over the whole document. A head opens a session, and the first row that can't belong to it ends it:
that row and all that follow are given back as text until the next head. What ends a session depends on its head alone (a
rule below it) and on the row before, so sessions are islands of windows and no row waits for another's result. A document's
rows are the largest group that a task sorts; they are read in order and never held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.classify import CAPTION, LINE_NUMBER, is_algorithm_head, is_algorithm_line
from vellum.operators.layout import PAGE, baselines

#: The least em in points; how many of them part a row without a rule from the one above; letters of a row of prose.
LEAST_EM, APART, PROSE = 6.0, 1.6, 60
#: Fixed value: ems of one step of indentation.
STEP_EMS = 1.2


def rows_of(lines: DataFrame, marked: DataFrame, body: float) -> DataFrame:
    """doc_id, page, block, place, row (0 for a head), head, holds, text, x0, text_x, y0, y1, stop: each block's lines as rows on one
    baseline, a head by itself. text_x: where the statement begins, after a number that stands apart. Lines are dealt by page
    once, for their rules and for the windows of their blocks."""
    t = F.trim("text")
    own = lines.where(t != "").withColumn("text", t).withColumn("holds", F.coalesce("holds", F.lit(True)))
    own = own.join(marked, PAGE, "left")
    first = F.row_number().over(Window.partitionBy(*PAGE, "block").orderBy("line")) == 1
    own = own.withColumn("_first", first).withColumn("head", F.col("_first") & F.col("holds") & is_algorithm_head(F.col("text"), F.coalesce("bold", F.lit(False))))
    rows = baselines(own, keys=(*PAGE, "block", "head")).withColumn("row", F.when(F.col("head"), F.lit(0).cast("bigint")).otherwise(F.col("row")))
    pieces = F.array_sort(F.collect_list(F.struct("x0", "line", "text", "y0", "y1")))
    rules = F.first(F.when(F.col("head"), F.col("rules"))).alias("rules")
    whole = rows.groupBy(*PAGE, "block", "head", "row").agg(F.min("place").alias("place"), F.bool_and("holds").alias("holds"), pieces.alias("p"), rules)
    start, last = F.element_at("p", 1), F.element_at("p", -1)
    number = F.concat(start["text"], F.lit(" ")).rlike(rf"{LINE_NUMBER}$")
    text_x = F.when((F.size("p") > 1) & number, F.element_at("p", F.least(F.lit(2), F.size("p")))["x0"]).otherwise(start["x0"])
    text = F.array_join(F.transform("p", lambda x: x["text"]), " ")
    out = whole.select(*PAGE, "block", "place", "row", "head", "holds", text.alias("text"), start["x0"].alias("x0"), text_x.alias("text_x"), start["y0"].alias("y0"), last["y1"].alias("y1"), "rules")
    return out.withColumn("stop", F.when(F.col("head"), stop(body))).drop("rules")


def rules_of(rules: DataFrame) -> DataFrame:
    """doc_id, page, rules: the places of each page's long thin rules."""
    return rules.where("y1 - y0 < 2.5 AND x1 - x0 > 60").groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0")).alias("rules"))


def stop(body: float) -> Column:
    """How far down the rules of its page let a head's code go: to the second rule below it, or to a single one more than two body
    sizes below; null without such rules."""
    near = lambda r: (r["x0"] >= F.col("x0") - 50) & (r["x0"] <= F.col("x0") + 20) & (r["y0"] > F.col("y0")) & (r["y0"] > F.col("y1") - 1)
    below = F.array_sort(F.transform(F.filter("rules", near), lambda r: r["y0"]))
    second, only = F.get(below, F.lit(1)), F.get(below, F.lit(0))
    return F.when(second.isNotNull(), second + 1).when(only > F.col("y1") + body * 2, only + 1)


def sessions(lines: DataFrame, rules: DataFrame, body: float = 10.0) -> DataFrame:
    """doc_id, page, block, row, head, text, code (number of the session in its document, null for rows that are given back) and
    indent (steps right of the leftmost row; null for heads and rows given back).

    lines: doc_id, page, block, place (of the block in the whole document's reading order), line, x0, y0, x1, y1, text, bold, holds
    (false where code can't stand: front matter, references, figures; null counts as true). rules: doc_id, page and their
    boxes. A rule's height counts on the pages after its head's as well. Lines of white space or null don't count, equal
    places follow page, block and row."""
    r = rows_of(lines, rules_of(rules), body)
    order = Window.partitionBy("doc_id").orderBy("place", "page", "block", F.desc("head"), "row")
    em = max(LEAST_EM, body)
    r = r.withColumn("_session", F.sum(F.col("head").cast("int")).over(order)).withColumn("_above", F.lag("y1").over(order))
    inside = Window.partitionBy("doc_id", "_session").orderBy("place", "page", "block", F.desc("head"), "row")
    r = r.withColumn("_stop", F.first("stop").over(inside))
    code = is_algorithm_line(F.col("text"), F.lit(False), F.lit(False), F.lit(False), F.lit(""), F.lit(False))
    free = F.col("_stop").isNull()
    over = F.coalesce(F.col("y0") > F.col("_stop"), F.lit(False)) | (free & (F.col("y0") - F.col("_above") > em * APART)) | (free & (F.length("text") > PROSE) & ~code)
    ends = ~F.col("head") & (~F.col("holds") | over | F.col("text").rlike(CAPTION))
    r = r.withColumn("_taken", (F.col("_session") > 0) & (F.coalesce(F.max(ends.cast("int")).over(inside), F.lit(0)) == 0))
    # a row left of all before it moves those by as many steps
    rows = F.when(F.col("_taken") & ~F.col("head"), F.col("text_x"))
    least = F.min(rows).over(inside)
    r = r.withColumn("_x", rows).withColumn("_least", least).withColumn("_before", F.min(rows).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    step = F.lit(em * STEP_EMS)
    moved = F.coalesce(F.when(F.col("_x") < F.col("_before"), F.bround((F.col("_before") - F.col("_x")) / step)), F.lit(0.0))
    r = r.withColumn("_moved", moved)
    # whole numbers: what follows is the sum less what came so far, without a sum anew for each row
    r = r.withColumn("_all", F.sum("_moved").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    later = F.col("_all") - F.sum("_moved").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    indent = F.when(F.col("_x").isNotNull(), (F.bround((F.col("_x") - F.col("_least")) / step) + later).cast("bigint"))
    return r.select(*PAGE, "block", "row", "head", "text", F.when(F.col("_taken"), F.col("_session")).cast("bigint").alias("code"), indent.alias("indent"))
