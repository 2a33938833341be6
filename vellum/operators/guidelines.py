"""What author guidelines ask for, as columns.

The text is taken apart into clauses: at full stops and semicolons, and after each count of words or keywords, so that a
clause says at most one quantity. Numbers are written in digits first and thousands without commas. A field is then the
first clause that speaks of its subject and, where a bare number would say too little, has a word for an upper bound.
Texts without a demand, empty and null ones give null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order: the first font that a text names counts.
FONTS = ["Times New Roman", "Arial", "Calibri", "Cambria", "Palatino Linotype", "Palatino", "Garamond", "Helvetica", "Georgia", "Book Antiqua", "Verdana", "Computer Modern"]
#: Fixed values, in order: reference styles by their names.
STYLES = {
    "ieee": ["ieee reference", "ieee citation", "ieee style"], "apa": ["apa"], "harvard": ["harvard"], "vancouver": ["vancouver"], "chicago": ["chicago"],
    "ama": ["ama", "american medical association"], "mla": ["mla"], "springer-basic": ["springer basic", "sn-basic"],
}
#: Styles that number their citations.
NUMBERED = ["ieee", "vancouver", "ama"]
#: Sections that guidelines may require, in this order.
REQUIRED = ["Introduction", "Literature Review", "Methodology", "Methods", "Results", "Discussion", "Conclusion", "Acknowledgements", "Data Availability", "Conflict of Interest", "Funding", "Author Contributions", "Declaration of Competing Interest", "Ethics Statement"]
NUMERALS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "fifteen": 15}
#: Words for an upper bound and for an obligation.
AT_MOST = ["exceed", "maximum", "max", "more than", "longer than", "at most", "up to", "within", "limited to"]
OBLIGED = ["must", "should", "required", "include", "mandatory"]
#: Centimetres of the units in which margins are given.
CM = {"cm": 1.0, "mm": 0.1, "inches": 2.54, "inch": 2.54, "in": 2.54, '"': 2.54}
#: What a count of words may be of; a clause that names several speaks of the first here.
SUBJECTS = {"abstract": ["abstract"], "title": ["title"], "total": ["manuscript", "paper", "article", "text"]}


def words(names: list[str], tail: str = r"\b") -> str:
    """A pattern of any of these names, blanks or hyphens between their words; longest first."""
    return r"\b(?:" + "|".join(n.replace(" ", "[ -]") for n in sorted(names, key=len, reverse=True)) + ")" + tail


def in_digits(text: Column) -> Column:
    for name, n in NUMERALS.items():
        text = F.regexp_replace(text, rf"\b{name}\b", str(n))
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3}\b)", "")


def clauses(text: Column) -> Column:
    """array<string>, of a text in small letters with single blanks."""
    counted = r"(\d[ -]?(?:key ?)?words?\b(?: (?:" + "|".join(n for names in SUBJECTS.values() for n in names) + r")\b)?)"
    return F.split(F.regexp_replace(in_digits(text), counted, "$1\n"), r"\n|[.;](?!\d)")


def counts(parts: Column) -> Column:
    """array<struct<of, bound, low, high>>: what is counted (keywords or one of SUBJECTS), whether as an upper bound, and the numbers."""
    number = r"(?:(?<!\d)(\d{1,6}) ?(?:to|and|-|–) ?)?(?<!\d)(\d{1,6})[ -]?((?:key ?)?)words?\b"

    def count(s: Column) -> Column:
        get = lambda g: F.regexp_extract(s, number, g)
        of = F.when(get(3) != "", "keywords")
        for subject, names in SUBJECTS.items():
            of = of.when(s.rlike(words(names, "s?" + r"\b")), subject)
        return F.struct(of.alias("of"), s.rlike(words(AT_MOST, "")).alias("bound"), F.nullif(get(1), F.lit("")).cast("int").alias("low"), F.nullif(get(2), F.lit("")).cast("int").alias("high"))

    return F.filter(F.transform(parts, count), lambda x: x["of"].isNotNull() & x["high"].isNotNull())


def first(of: Column, meets) -> Column:
    """The first element of an array that meets a condition; null if none does."""
    return F.try_element_at(F.filter(of, meets), F.lit(1))


def named(text: Column, names: dict[object, list[str]], tail: str = r"\b") -> Column:
    """The first key one of whose names the text holds; tail: what ends a name."""
    return F.coalesce(*[F.when(text.rlike(words(known, tail)), F.lit(key)) for key, known in names.items()])


def margin(parts: Column) -> Column:
    length = r"margin.*?(\d+(?:\.\d+)?) ?(" + "|".join(CM) + r")(?!\w)"
    said = first(parts, lambda s: s.rlike(length))
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in CM.items() for x in kv]), F.regexp_extract(said, length, 2))
    return F.bround(F.regexp_extract(said, length, 1).try_cast("double") * unit, 2)


def numbered_headings(parts: Column) -> Column:
    """"none" if a clause says that headings have no numbers, "decimal" if one says that they have."""
    about = F.filter(parts, lambda s: s.rlike(r"\b(?:heading|section)s?\b") & s.rlike(r"\b(?:un)?numbered\b"))
    denied = F.exists(about, lambda s: s.rlike(r"\bunnumbered\b|\b(?:not|never|without)\b"))
    return F.when(denied, "none").when(F.size(about) > 0, "decimal")


def required(parts: Column) -> Column:
    """Names of required sections, those that stand behind a word of obligation in a clause, joined by "; "."""
    obliged = F.concat_ws("\n", F.transform(parts, lambda s: F.regexp_extract(s, words(OBLIGED, r"\w*\b(.*)"), 1)))
    return F.nullif(F.array_join(F.array_compact(F.array(*[F.when(obliged.rlike(r"\b" + name.lower()), name) for name in REQUIRED])), "; "), F.lit(""))


def fields(c: Column) -> dict[str, Column]:
    """The fields that guidelines ask for, a column each; null where they are silent."""
    text = F.lower(F.regexp_replace(c, r"(?U)\s+", " "))
    parts = clauses(text)
    counted = counts(parts)
    of = lambda subject, least, bound=True: first(counted, lambda x: (x["of"] == subject) & (x["high"] >= least) & (x["bound"] | F.lit(not bound)))["high"]
    span = first(counted, lambda x: (x["of"] == "keywords") & x["low"].isNotNull())
    style = named(text, STYLES)
    in_order = text.rlike(words(["square brackets", "numbered in order", "numbered in the order", "numbered consecutively in order", "numbered consecutively in the order"]))
    return {
        "font": named(text, {"Palatino Linotype" if f == "Palatino" else f: [f.lower()] for f in FONTS}),
        "font_size": F.regexp_extract(text, r"\b(\d{1,2}(?:\.\d)?)[ -]*(?:pt|points?)\b", 1).try_cast("double"),
        "line_spacing": named(text, {2.0: ["double spac"], 1.5: ["1[.]5 ?spac", "1[.]5 line spac", "one and a half"], 1.0: ["single spac"]}, ""),
        "margin_cm": margin(parts),
        "page_size": named(text, {"A4": ["a4"], "Letter": ["us letter", "letter size", "letter sized", r"8[.]5 ?[x×] ?11"]}),
        "columns": named(text, {2: ["two column", "double column"], 1: ["single column", "one column"]}),
        "line_numbers": F.when(text.contains("line number"), True),
        "abstract_words": of("abstract", 10, False),
        "structured": F.when(text.contains("structured abstract") | text.contains("design/methodology/approach"), True),
        "keywords_min": span["low"],
        "keywords_max": F.coalesce(span["high"], of("keywords", 1)),
        "title_words": of("title", 1),
        "total_words": of("total", 1000),
        "ref_style": F.coalesce(style, F.when(in_order, "vancouver")),
        "cite_mode": F.when(style.isin(NUMBERED), "numeric").when(style.isNotNull(), "author-year").when(in_order, "numeric"),
        "scheme": numbered_headings(parts),
        "required_sections": required(parts),
    }
