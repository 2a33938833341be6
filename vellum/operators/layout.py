"""Pages as text boxes: reading order, lines on one baseline, tables under rules, formulas, emphasis; for any source of boxes.

spans: doc_id, page, block, line, span, x0, y0, x1, y1, text, font, size, flags; blocks, lines and rules are made of the same
columns. Coordinates are points from the top left. A page is the largest group that one task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.runs import run

PAGE = ["doc_id", "page"]
#: Fixed pattern: fonts of mathematics.
MATH_FONT = r"(?i)cmmi|cmsy|cmex|msam|msbm|symbol|math|stix|mt\s?extra|euclid|lmmi|lmsy|lmex|rsfs|esint|txsy|txex|pxsy|pxex|eufm|mtmi|mtsy|newtxmath|ntxmi|ntxsy|cambria"
NUMBER = r"^\s*\(\s*\d+[a-z]?(?:\.\d+)?\s*\)\s*$"
#: What the codes of an old font encoding stand for.
LIGATURES = {"\x0b": "ff", "\x0c": "fi", "\x0d": "fl", "\x0e": "ffi", "\x0f": "ffl", "\x10": "“", "\x11": "”", "\x13": "’", "\x14": "‘", "\x15": "–", "\x16": "—", "\x1b": "ff", "\x1c": "fi", "\x1d": "fl"}
#: Bits of a span's flags.
SUPERSCRIPT, ITALIC, BOLD = 1, 2, 16


def clean(c: Column) -> Column:
    """Text without control characters; those that stood for ligatures, quotes and dashes become them."""
    for code, text in LIGATURES.items():
        c = F.replace(c, F.lit(code), F.lit(text))
    return F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", "")


def marks(flags: Column, font: Column) -> tuple[Column, Column, Column]:
    """(bold, italic, superscript) of a span, by its flags or its font's name."""
    name = F.lower(F.coalesce(font, F.lit("")))
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) > 0
    return has(BOLD) | name.rlike("bold|black|semibold"), has(ITALIC) | name.rlike("italic|oblique"), has(SUPERSCRIPT)


def line_runs(spans: DataFrame) -> DataFrame:
    """doc_id, page, block, line with the box, text and runs of each line."""
    bold, italic, sup = marks(F.col("flags"), F.col("font"))
    t = clean(F.col("text"))
    one = run(t, bold, italic, sup & (F.length(F.trim("text")) <= 4))
    keys = [*PAGE, "block", "line"]
    in_order = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("span", one.alias("r")))))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    lines = spans.groupBy(*keys).agg(*box, F.transform(in_order, lambda s: s["r"]).alias("runs"))
    return lines.withColumn("text", F.trim(F.array_join(F.transform("runs", lambda r: r["text"]), "")))


def blocks_of(lines: DataFrame) -> DataFrame:
    """doc_id, page, block with the box and text of each block."""
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return lines.groupBy(*PAGE, "block").agg(*box, F.trim(text).alias("text"))


def reading_order(blocks: DataFrame, width: float = 595.0) -> DataFrame:
    """blocks with `place`: full-width blocks cut a page into bands, and in each the left column comes before the right one. Pages
    without two columns (two blocks a side, those on the right of more than 12 letters) go from top to bottom."""
    mid = width / 2
    wide = (F.col("x1") - F.col("x0") > width * 0.55) | ((F.col("x0") < mid - 20) & (F.col("x1") > mid + 20))
    b = blocks.withColumn("side", F.when(wide, "full").when(F.col("x1") <= mid + 20, "left").otherwise("right"))
    page = Window.partitionBy(*PAGE)
    n = lambda cond: F.sum(cond.cast("int")).over(page)
    two = (n(F.col("side") == "left") >= 2) & (n((F.col("side") == "right") & (F.length(F.trim("text")) > 12)) >= 2)
    b = b.withColumn("two", two)
    # the band of a block: how many full-width blocks begin above it (one point of grace)
    events = b.select(*PAGE, "block", "side", F.col("y0").alias("y"), F.lit(1).alias("kind")).unionByName(b.where("side = 'full'").select(*PAGE, "block", F.lit("cut").alias("side"), (F.col("y0") + 1).alias("y"), F.lit(0).alias("kind")))
    down = Window.partitionBy(*PAGE).orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = events.withColumn("above", F.sum((F.col("side") == "cut").cast("int")).over(down)).where("side <> 'cut'").select(*PAGE, "block", "above")
    b = b.join(bands, [*PAGE, "block"])
    fulls = F.row_number().over(Window.partitionBy(*PAGE, "side").orderBy("y0", "block"))
    band = F.when(F.col("side") == "full", fulls - 1).otherwise(F.col("above"))
    rank = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    b = b.withColumns({"band": band, "rank": rank})
    key = F.when(F.col("two"), F.struct(F.col("band").cast("double").alias("a"), F.col("rank").cast("double").alias("b"), F.col("y0").alias("c"))).otherwise(F.struct(F.bround("y0").alias("a"), F.col("x0").alias("b"), F.lit(0.0).alias("c")))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(key, "block"))
    return b.withColumn("place", place.cast("bigint")).drop("side", "two", "above", "band", "rank")


def baselines(lines: DataFrame, tolerance: float = 2.5, keys: tuple[str, ...] = (*PAGE, "block")) -> DataFrame:
    """lines with `row`: fragments whose bottoms are within the tolerance of the one before are one row, from left to right."""
    # the rounded bottom is a column, so that both windows go by one sort
    w = Window.partitionBy(*keys).orderBy("_bottom", "x0")
    before = F.lag(F.struct("x0", "y1")).over(w)
    new = before.isNull() | (F.abs(before["y1"] - F.col("y1")) >= tolerance) | (F.col("x0") < before["x0"])
    return lines.withColumn("_bottom", F.bround("y1")).withColumn("row", F.sum(new.cast("int")).over(w).cast("bigint")).drop("_bottom")


def joined_baselines(lines: DataFrame, body: float = 10.0) -> DataFrame:
    """lines with `joined`: the block whose text a block's first line goes on, on the same baseline and close to its end; its own
    block where there is none. Lines meet in cells of a grid about as large as what counts as close, so pairs grow with
    the lines; chains of any length are followed to their first block, the links of a page in one row."""
    middle = lambda t: (F.col(f"{t}y0") + F.col(f"{t}y1")) / 2
    high, wide = max(3.0, body * 0.45), body * 3
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE, "block").orderBy("line"))).where("n = 1")
    # cells four times as large as what is close, so that most lines begin in one; with a margin, so that rounding leaves no pair out
    row, col = (lambda y: F.floor(y / (high * 4))), (lambda x: F.floor(x / (wide * 4)))
    ends = lines.select(*PAGE, "block", "x0", "x1", "y0", "y1", row(middle("")).alias("_row"), col(F.col("x1")).alias("_col"))
    begins = first.select(*PAGE, "block", "x0", "y0", "y1", F.explode(F.sequence(row(middle("") - high - 0.5), row(middle("") + high + 0.5))).alias("_row"), F.sequence(col(F.col("x0") - wide - 0.5), col(F.col("x0") + 1.5)).alias("_cols"))
    begins = begins.select(*PAGE, "block", "x0", "y0", "y1", "_row", F.explode("_cols").alias("_col"))
    gap = F.col("b.x0") - F.col("a.x1")
    near = (F.abs(middle("a.") - middle("b.")) < high) & (gap >= -1) & (gap < wide) & (F.col("a.block") != F.col("b.block"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*PAGE, "_row", "_col"]]
    # to the left only, so that no chain comes back to itself; the nearest end, and of equal ones the smallest block
    pairs = ends.alias("a").join(begins.alias("b"), [*same, near]).where("a.x0 < b.x0")
    left = pairs.groupBy(*[F.col(f"b.{k}").alias(k) for k in PAGE], F.col("b.block").alias("block")).agg(F.max_by("a.block", F.struct("a.x1", -F.col("a.block"))).alias("to"))
    of_page = left.groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("block").cast("bigint").alias("block"), F.col("to").cast("bigint").alias("to"))).alias("links"))
    kinds = dict(of_page.dtypes)
    followed = of_page.mapInArrow(follow, ", ".join(f"{c} {kinds[c]}" for c in [*PAGE, "links"]))
    now = followed.select(*PAGE, F.explode("links").alias("_x")).select(*PAGE, F.col("_x.block").alias("block"), F.col("_x.to").alias("to"))
    return lines.join(now, [*PAGE, "block"], "left").withColumn("joined", F.coalesce(F.col("to").cast(dict(lines.dtypes)["block"]), F.col("block"))).drop("to")


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their links (block, to), each link to the end of its chain: each round doubles how far all are followed."""
    for b in batches:
        links = b.column(len(PAGE))
        flat = links.flatten()
        page = np.repeat(np.arange(len(links)), links.value_lengths().to_numpy(zero_copy_only=False))
        block, to = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        names, code = np.unique(np.concatenate([block, to]), return_inverse=True)
        own, aim = page * len(names) + code[: len(block)], page * len(names) + code[len(block) :]
        order = np.argsort(own)
        at = np.minimum(np.searchsorted(own[order], aim), max(len(own) - 1, 0))
        up = np.where(own[order][at] == aim, order[at], -1)
        while (more := up >= 0).any():
            to = np.where(more, to[up], to)
            up = np.where(more, up[up], -1)
        both = pa.StructArray.from_arrays([pa.array(block), pa.array(to)], names=["block", "to"])
        ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns[: len(PAGE)], pa.ListArray.from_arrays(pa.array(ends), both)], names=[*PAGE, "links"])


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes meet; a rule of no height counts."""
    return (b["x1"] >= a["x0"]) & (b["x0"] <= a["x1"]) & (b["y1"] >= a["y0"] - 1) & (b["y0"] <= a["y1"] + 1)


def ruled_boxes(rules: DataFrame) -> DataFrame:
    """doc_id, page, box, x0, y0, x1, y1: what lies between horizontal rules of one left edge (3 points) and width (4 points)."""
    flat = rules.where("y1 - y0 < 2.5 AND x1 - x0 > 40")
    w = Window.partitionBy(*PAGE).orderBy("x0", (F.col("x1") - F.col("x0")), "y0")
    before = F.lag(F.struct("x0", (F.col("x1") - F.col("x0")).alias("w"))).over(w)
    new = before.isNull() | (F.abs(before["x0"] - F.col("x0")) >= 3) | (F.abs(before["w"] - (F.col("x1") - F.col("x0"))) >= 4)
    g = flat.withColumn("box", F.sum(new.cast("int")).over(w))
    top = lambda c: F.min_by(c, "y0").alias(c)
    return g.groupBy(*PAGE, "box").agg(F.count("*").alias("n"), top("x0"), F.min("y0").alias("top"), top("x1"), F.max("y1").alias("bottom")).where("n >= 2").select(*PAGE, "box", "x0", F.col("top").alias("y0"), "x1", (F.col("bottom") + 1).alias("y1"))


def word_tables(words: DataFrame, boxes: DataFrame, gap: float = 8.0) -> DataFrame:
    """doc_id, page, box, rows: cells of the words whose middle lies in a box. Bottoms within 3 points are a row, gaps over 8
    points part cells, and the fullest row gives the columns. Boxes of fewer than two rows or columns have none."""
    inside = ((F.col("w.x0") + F.col("w.x1")) / 2).between(F.col("b.x0"), F.col("b.x1")) & ((F.col("w.y0") + F.col("w.y1")) / 2).between(F.col("b.y0"), F.col("b.y1"))
    w = words.alias("w").join(boxes.alias("b"), [*[F.col(f"w.{k}") == F.col(f"b.{k}") for k in PAGE], inside]).select("w.*", "b.box")
    box = [*PAGE, "box"]
    down = Window.partitionBy(*box).orderBy("y1", "x0")
    w = w.withColumn("row", F.sum((F.coalesce(F.col("y1") - F.lag("y1").over(down), F.lit(99.0)) >= 3).cast("int")).over(down))
    right = Window.partitionBy(*box, "row").orderBy("x0")
    w = w.withColumn("cell", F.sum((F.coalesce(F.col("x0") - F.lag("x1").over(right), F.lit(99.0)) > gap).cast("int")).over(right))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    cells = w.groupBy(*box, "row", "cell").agg(F.min("x0").alias("l"), F.max("x1").alias("r"), text.alias("text")).withColumn("middle", (F.col("l") + F.col("r")) / 2)
    sizes = cells.groupBy(*box, "row").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("middle")).alias("middles"))
    anchor = sizes.groupBy(*box).agg(F.max("n").alias("columns"), F.count("*").alias("rows"), F.max_by("middles", F.struct("n", -F.col("row"))).alias("middles")).where("columns >= 2 AND rows >= 2")
    c = cells.join(anchor, box)
    away = F.transform("middles", lambda m: F.abs(m - F.col("middle")))
    c = c.withColumn("column", F.array_position(away, F.array_min(away)))
    put = c.groupBy(*box, "row", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "text"))), lambda x: x["text"]), " ").alias("text"))
    by_row = put.groupBy(*box, "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("m")).join(anchor.select(*box, "columns"), box)
    filled = by_row.withColumn("cells", F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("columns")), lambda k: F.coalesce(F.element_at("m", k), F.lit(""))))
    return filled.groupBy(*box).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))


def in_table(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """The blocks that lie in a table's box, two points aside."""
    inside = (F.col("t.x0") >= F.col("b.x0") - 2) & (F.col("t.y0") >= F.col("b.y0") - 2) & (F.col("t.x1") <= F.col("b.x1") + 2) & (F.col("t.y1") <= F.col("b.y1") + 2)
    same = [F.col(f"t.{k}") == F.col(f"b.{k}") for k in PAGE]
    return blocks.alias("t").join(boxes.alias("b"), [*same, inside], "left_semi")


def math_blocks(spans: DataFrame) -> DataFrame:
    """doc_id, page, block, is_math: blocks of formulas, told by fonts, signs and the lack of a sentence."""
    t = clean(F.col("text"))
    size = F.length(F.trim("text"))
    b = spans.where(F.trim("text") != "").groupBy(*PAGE, "block").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "span", t.alias("t")))), lambda x: x["t"]), " ")).alias("text"),
        F.sum(size).alias("n"), F.sum(F.when(F.col("font").rlike(MATH_FONT), size).otherwise(0)).alias("m"),
    )
    words, share = F.regexp_count("text", F.lit(r"\b[a-z]{3,}\b")), F.col("m") / F.greatest(F.lit(1), F.col("n"))
    sentence = (words >= 5) | ((words >= 3) & F.col("text").rlike("[.:]$") & (share < 0.3))
    signs = (F.length("text") < 90) & F.col("text").rlike("[=∑∫∏≤≥±×∂√∈→←⇒∀∃≈∞]") & (words <= 2)
    told = F.when(sentence | (F.length("text") > 220), False).otherwise(F.col("text").rlike(NUMBER) | (share >= 0.3) | signs)
    return b.select(*PAGE, "block", told.alias("is_math"))


def equations(spans: DataFrame, body: float = 10.0) -> DataFrame:
    """doc_id, page, n, eq_num, x0, y0, x1, y1: formulas in clusters (closer than 0.9 of the body size), each with the number at its
    right and the box of the rest, two points wider. A number alone joins the cluster above."""
    math = math_blocks(spans).where("is_math").select(*PAGE, "block")
    s = spans.where(F.trim("text") != "").join(math, [*PAGE, "block"])
    b = s.groupBy(*PAGE, "block").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.min("x0").alias("left"), F.bool_and(F.col("text").rlike(NUMBER)).alias("lone"))
    w = Window.partitionBy(*PAGE).orderBy("top", "left")
    reach = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("n", F.sum((reach.isNull() | ((F.col("top") - reach > body * 0.9) & ~F.col("lone"))).cast("int")).over(w))
    s = s.join(b.select(*PAGE, "block", "n"), [*PAGE, "block"])
    cluster = Window.partitionBy(*PAGE, "n")
    mid = (F.min("x0").over(cluster) + F.max("x1").over(cluster)) / 2
    s = s.withColumn("is_number", F.col("text").rlike(NUMBER) & (F.col("x0") > mid))
    of = lambda c: F.when(~F.col("is_number"), F.col(c))
    number = F.max(F.when(F.col("is_number"), F.regexp_replace("text", r"[()\s]", "")))
    out = s.groupBy(*PAGE, "n").agg(number.alias("eq_num"), F.min(of("x0")).alias("x0"), F.min(of("y0")).alias("y0"), F.max(of("x1")).alias("x1"), F.max(of("y1")).alias("y1")).where("x0 is not null")
    return out.select(*PAGE, F.col("n").cast("bigint").alias("n"), "eq_num", (F.col("x0") - 2).alias("x0"), (F.col("y0") - 2).alias("y0"), (F.col("x1") + 2).alias("x1"), (F.col("y1") + 2).alias("y1"))


def code_indents(rows: DataFrame, body: float = 10.0) -> DataFrame:
    """rows (doc_id, page, block, row, x0) with `indent`: how many steps of 1.2 body sizes a row stands right of the leftmost one."""
    least = F.min("x0").over(Window.partitionBy(*PAGE, "block"))
    return rows.withColumn("indent", F.greatest(F.lit(0), F.bround((F.col("x0") - least) / (max(6.0, body) * 1.2))).cast("bigint"))


def paragraphs(lines: DataFrame, in_references: Column | None = None) -> DataFrame:
    """doc_id, page, block, part, text: lines as paragraphs, hyphens at line ends undone; bullets, and labels of abstract and
    keywords, begin one, and in the reference list every entry does."""
    t = F.col("text")
    bullet = t.rlike("^\\s*[•▪◦●•▪]\\s*") | t.rlike(r"(?i)^\s*(?:key\s*-?\s*words?|index\s+terms|abstract)\b")
    entry = t.rlike(r"^\s*(\[\d{1,3}\]|\d{1,3}\.\s|\d{1,3}\s(?=[A-Z]))")
    w = Window.partitionBy(*PAGE, "block").orderBy("line")
    new = bullet | (entry & (F.lit(False) if in_references is None else in_references))
    p = lines.where(t != "").withColumn("part", F.sum(new.cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    whole = F.regexp_replace(F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2"), r"\s+", " ")
    return p.groupBy(*PAGE, "block", F.col("part").cast("bigint").alias("part")).agg(F.trim(whole).alias("text"))


def sample_format(blocks: DataFrame, spans: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """doc_id with what a sample's pages show: size, margins_cm, columns, font and its size."""
    long = blocks.where(F.length(F.trim("text")) >= 40)
    inner = long.groupBy("doc_id").agg(
        F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("right"), F.max(F.when(F.col("y1") < height * 0.93, F.col("y1"))).alias("bottom"),
        F.count_if(F.col("x1") < width / 2 + 10).alias("l"), F.count_if((F.col("x1") >= width / 2 + 10) & (F.col("x0") > width / 2 - 10)).alias("r"), F.count("*").alias("n"),
    )
    columns = F.when((F.col("l") >= 3) & (F.col("r") >= 3) & (F.col("l") + F.col("r") > F.col("n") - F.col("l") - F.col("r")), 2).otherwise(1)
    mode = lambda value: spans.groupBy("doc_id", value.alias("v")).agg(F.sum(F.length("text")).alias("n")).groupBy("doc_id").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    fonts, sizes = mode(F.col("font")).withColumnRenamed("v", "font"), mode(F.bround(F.col("size") * 2) / 2).withColumnRenamed("v", "font_size")
    cm = lambda pt: F.bround(pt * 2.54 / 72, 2)
    paper = F.lit("A4" if abs(width - 595) < 8 else "Letter" if abs(width - 612) < 8 else f"{width:.0f}x{height:.0f}pt")
    margins = F.array(cm(F.col("top")), cm(height - F.col("bottom")), cm(F.col("left")), cm(width - F.col("right")))
    return inner.join(fonts, "doc_id").join(sizes, "doc_id").select("doc_id", paper.alias("page_size"), margins.alias("margins_cm"), columns.alias("columns"), "font", "font_size")
