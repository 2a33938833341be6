"""Formatted runs: an array of structs, edited in place by higher-order functions. A run is text with marks, or mathematics
(omml, latex) or an object (raw) without text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import let

OBJECT = "struct<kind:string,data:binary,ext:string,width_in:double,height_in:double,inline:boolean>"
RUN = f"struct<text:string,bold:boolean,italic:boolean,sup:boolean,sub:boolean,omml:string,latex:string,cite:boolean,size:double,raw:string,object:{OBJECT}>"


def run(text: Column, bold: Column | bool = False, italic: Column | bool = False, sup: Column | bool = False, sub: Column | bool = False, cite: Column | bool = False, latex: Column | None = None) -> Column:
    flag = lambda x, n: (F.lit(x) if isinstance(x, bool) else x).alias(n)
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    math = none("latex", "string") if latex is None else latex.alias("latex")
    return F.struct(
        text.alias("text"), flag(bold, "bold"), flag(italic, "italic"), flag(sup, "sup"), flag(sub, "sub"),
        none("omml", "string"), math, flag(cite, "cite"), none("size", "double"), none("raw", "string"), none("object", OBJECT),
    )


def no_runs() -> Column:
    return F.array().cast(f"array<{RUN}>")


def is_math(r: Column) -> Column:
    """Mathematics, or an object that stands for it."""
    return r["omml"].isNotNull() | r["latex"].isNotNull() | r["raw"].isNotNull()


def same_format(a: Column, b: Column) -> Column:
    same = (a["bold"] == b["bold"]) & (a["italic"] == b["italic"]) & (a["sup"] == b["sup"]) & (a["sub"] == b["sub"])
    return same & ~a["cite"] & ~b["cite"] & ~is_math(a) & ~is_math(b)


def merge_runs(runs: Column) -> Column:
    """Neighbours of equal format as one run; citations stay apart. Islands by their first places, so no run is copied twice."""

    def of(runs: Column) -> Column:
        first = F.filter(F.transform(runs, lambda r, i: F.when((i == 0) | ~same_format(r, F.get(runs, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())

        def islands(first: Column) -> Column:
            def island(at: Column, k: Column) -> Column:
                own = F.slice(runs, at + 1, F.coalesce(F.get(first, k + 1), F.size(runs)) - at)
                return F.get(runs, at).withField("text", F.array_join(F.transform(own, lambda r: r["text"]), ""))

            return F.transform(first, island)

        return let(first, islands)

    return let(runs, of)


def plain(runs: Column) -> Column:
    """The text, with mathematics as its LaTeX or a mark."""
    return F.array_join(F.transform(runs, lambda r: F.when(is_math(r), F.coalesce(r["latex"], F.lit("[math]"))).otherwise(r["text"])), "")


def text_of(runs: Column) -> Column:
    """The text without mathematics."""
    return F.array_join(F.transform(F.filter(runs, lambda r: ~is_math(r)), lambda r: r["text"]), "")


def starts(runs: Column) -> Column:
    """Where each run begins in the text."""
    lengths = F.transform(runs, lambda r: F.when(is_math(r), 0).otherwise(F.length(r["text"])))
    return F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x))


def drop_chars(runs: Column, n: Column) -> Column:
    """The first n characters gone, across runs; mathematics stays."""

    def of(x: Column) -> Column:
        cut = lambda r, i: r.withField("text", F.substring(r["text"], F.greatest(x["n"] - F.get(x["begin"], i), F.lit(0)) + 1, F.length(r["text"])))
        kept = F.transform(x["runs"], lambda r, i: F.when(is_math(r), r).otherwise(cut(r, i)))
        return F.filter(kept, lambda r: (r["text"] != "") | is_math(r))

    return let(let(runs, lambda runs: F.struct(runs.alias("runs"), starts(runs).alias("begin"), n.cast("int").alias("n"))), of)


def trim_leading(runs: Column, rest: Column) -> Column:
    """Runs from where `rest` begins on, told by its first letters, blanks aside; the rest as one run where it isn't found."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")

    def places(x: Column) -> Column:
        probe = F.substring(x["target"], 1, 12)
        return F.struct(x["runs"].alias("runs"), x["target"].alias("target"), x["full"].alias("full"), F.instr(x["full"], probe).alias("exact"), (F.instr(bare(x["full"]), bare(probe)) - 1).alias("before"))

    def cut(x: Column) -> Column:
        pattern = F.concat(F.lit(r"^(?:\s*\S){"), F.greatest(x["before"], F.lit(0)).cast("string"), F.lit(r"}\s*"))
        loose = F.length(F.call_function("regexp_extract", x["full"], pattern, F.lit(0)))
        kept = drop_chars(x["runs"], F.when(x["exact"] > 0, x["exact"] - 1).otherwise(loose))
        stripped = F.transform(kept, lambda r, i: F.when((i == 0) & ~is_math(r), r.withField("text", F.ltrim(r["text"]))).otherwise(r))
        return F.when(x["target"] == "", no_runs()).when((x["exact"] == 0) & (x["before"] < 0), F.array(run(x["target"]))).otherwise(stripped)

    target = F.trim(F.regexp_replace(rest, r"(?U)\s+", " "))
    told = let(runs, lambda runs: F.struct(runs.alias("runs"), target.alias("target"), text_of(runs).alias("full")))
    return let(let(told, places), cut)


def solid(r: Column) -> Column:
    """A run that is more than blanks and tabs."""
    return F.coalesce(is_math(r) | r["text"].rlike(r"[^ \t]"), F.lit(False))


def strip_trailing(runs: Column) -> Column:
    """Blanks and tabs at the end gone, across runs, up to the last mathematics."""

    def told(runs: Column) -> Column:
        last = F.array_max(F.filter(F.transform(runs, lambda r, i: F.when(solid(r), i)), lambda i: i.isNotNull()))
        return F.struct(runs.alias("runs"), F.coalesce(last, F.lit(-1)).alias("last"))

    def cut(x: Column) -> Column:
        bare = lambda r: r.withField("text", F.regexp_replace(r["text"], r"[ \t]+$", ""))
        return F.transform(F.slice(x["runs"], F.lit(1), x["last"] + 1), lambda r, i: F.when((i == x["last"]) & ~is_math(r), bare(r)).otherwise(r))

    return let(let(runs, told), cut)


def partial_emphasis(runs: Column, mark: str) -> Column:
    """Whether emphasis is kept: some runs of the text have it, not all."""
    filled = F.filter(runs, lambda r: (F.trim(r["text"]) != "") & ~is_math(r))
    return F.exists(filled, lambda r: r[mark]) & ~F.forall(filled, lambda r: r[mark])


def without_whole_emphasis(runs: Column) -> Column:
    """Runs whose bold or italic covers the whole text have it no more: the style of a title or heading gives it."""
    filled = F.filter(runs, lambda r: (F.trim(r["text"]) != "") & ~is_math(r))
    all_of = lambda mark: (F.size(filled) > 0) & F.forall(filled, lambda r: r[mark])
    bold, italic = all_of("bold"), all_of("italic")
    return F.transform(runs, lambda r: r.withField("bold", r["bold"] & ~bold).withField("italic", r["italic"] & ~italic))


def replace_spans(runs: Column, spans: Column) -> Column:
    """Each span array<struct<start, end, new: array of runs>> (places in the text, ascending, apart from each other) gives way
    to its runs, with the marks of the run it begins in; a cited run keeps only bold. Mathematics inside a span stays."""

    def of(x: Column) -> Column:
        def pieces(r: Column, i: Column) -> Column:
            at = F.get(x["begin"], i)
            told = F.struct(at.alias("at"), F.filter(x["spans"], lambda s: (s["start"] < at + F.length(r["text"])) & (s["end"] > at)).alias("own"))
            return F.when(is_math(r), F.array(r)).otherwise(let(told, lambda y: cut(r, y)))

        def cut(r: Column, y: Column) -> Column:
            part = lambda a, b: r.withField("text", F.substring(r["text"], F.greatest(a - y["at"], F.lit(0)) + 1, F.greatest(b - F.greatest(a, y["at"]), F.lit(0))))
            marked = lambda n: n.withField("bold", r["bold"]).withField("italic", r["italic"] & ~n["cite"])

            def one(s: Column, k: Column) -> Column:
                before = F.when(k == 0, y["at"]).otherwise(F.get(y["own"], F.greatest(k - 1, F.lit(0)))["end"])
                made = F.when(s["start"] >= y["at"], F.transform(s["new"], marked)).otherwise(no_runs())
                return F.concat(F.array(part(before, s["start"])), made)

            last = F.get(y["own"], F.size(y["own"]) - 1)["end"]
            tail = F.array(part(last, y["at"] + F.length(r["text"])))
            return F.when(F.size(y["own"]) == 0, F.array(r)).otherwise(F.concat(F.flatten(F.transform(y["own"], one)), tail))

        return F.filter(F.flatten(F.transform(x["runs"], pieces)), lambda r: (r["text"] != "") | is_math(r))

    return let(let(runs, lambda runs: F.struct(runs.alias("runs"), starts(runs).alias("begin"), spans.alias("spans"))), of)


def replace_span(runs: Column, start: Column, end: Column, new: Column) -> Column:
    """Characters start to end (0-based, over the whole text) replaced; the new text has the format of the run it begins in."""
    one = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.array(run(new)).alias("new"))
    return replace_spans(runs, F.array(one))


def to_latex(runs: Column, escape) -> Column:
    def one(r: Column) -> Column:
        t = escape(r["text"])
        wrap = lambda c, flag, cmd: F.when(flag, F.concat(F.lit("\\" + cmd + "{"), c, F.lit("}"))).otherwise(c)
        t = wrap(wrap(t, r["sup"], "textsuperscript"), r["sub"], "textsubscript")
        return F.when(F.trim(r["text"]) == "", t).otherwise(wrap(wrap(t, r["italic"], "emph"), r["bold"], "textbf"))

    return F.array_join(F.transform(runs, one), "")
