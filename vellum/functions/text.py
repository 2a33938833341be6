"""Scalar text functions as Columns: normalising, counting, casing, numerals, folding, escaping."""

from __future__ import annotations

import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word tokens, alike in the regular expressions of all engines.
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_'’-]*"
#: Words that titles keep in lower case.
SMALL_WORDS = ["a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "nor", "of", "on", "or", "over", "the", "to", "via", "vs", "with", "without"]


def let(c: Column, body) -> Column:
    """body(c) with c evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("bigint")


def fold_table() -> tuple[str, str]:
    """Letters of U+00C0..U+017F and the single letters that remain of them without marks, by decomposition."""
    pairs = [(chr(i), "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))) for i in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.lower(F.regexp_replace(F.translate(c, *fold_table()), r"\p{Mn}", ""))


def is_upper(c: Column) -> Column:
    """Some cased letter and none in lower case."""
    return (c == F.upper(c)) & (c != F.lower(c))


def has_upper(c: Column) -> Column:
    return c != F.lower(c)


def cap(w: Column) -> Column:
    """The first letter in upper case, if it is Latin."""
    first = F.substring(w, 1, 1)
    return F.when(first.rlike(r"^[\x00-\x7FÀ-ɏ]"), F.concat(F.upper(first), rest(w))).otherwise(w)


def rest(w: Column) -> Column:
    return F.substring(w, F.lit(2), F.length(w))


def cap_lower(w: Column) -> Column:
    return cap(F.concat(F.substring(w, F.lit(1), F.lit(1)), F.lower(rest(w))))


def apply_case(c: Column, case: Column | str) -> Column:
    """upper, title, sentence or as-is."""
    case = F.lit(case) if isinstance(case, str) else case
    base = F.when(is_upper(c) & (F.length(c) > 4), F.lower(c)).otherwise(c)
    acronym = lambda w: is_upper(w) & (F.length(w) > 1)

    def title(w: Column, i: Column) -> Column:
        return F.when(acronym(w), w).when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).when(has_upper(rest(w)), cap(w)).otherwise(cap_lower(w))

    def sentence(w: Column, i: Column) -> Column:
        return F.when(acronym(w) | has_upper(rest(w)), w).when(i == 0, cap_lower(w)).otherwise(F.lower(w))

    words = F.split(base, " ", -1)
    return (
        F.when(case == "upper", F.upper(c))
        .when(case == "title", F.array_join(F.transform(words, title), " "))
        .when(case == "sentence", F.array_join(F.transform(words, sentence), " "))
        .otherwise(c)
    )


def text_case(c: Column) -> Column:
    """The case that a heading is written in."""
    words = F.regexp_extract_all(c, F.lit(r"[A-Za-z][\p{L}\p{N}_'-]*"), F.lit(0))
    big = F.filter(words, lambda w: F.length(w) > 3)
    capital = lambda w: F.substring(w, 1, 1).rlike("^[A-Z]")
    return (
        F.when(is_upper(c), "upper")
        .when((F.size(big) > 1) & (F.size(F.filter(big, capital)) * 10 > F.size(big) * 8), "title")
        .when((F.size(words) > 0) & capital(F.get(words, F.lit(0))), "sentence")
        .otherwise("as-is")
    )


#: Fixed values of Roman numerals.
ROMAN = [(100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
ROMAN_DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def int_to_roman(n: Column) -> Column:
    """Hundreds are repeated C; digits of tens and ones come from tables."""
    tens = F.array(*[F.lit(x) for x in ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")])
    ones = F.array(*[F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")])
    n = n.cast("int")
    at = lambda table, x: F.get(table, x.cast("int"))
    return F.concat(F.repeat(F.lit("C"), F.floor(n / 100).cast("int")), at(tens, F.floor(n / 10) % 10), at(ones, n % 10))


def roman_to_int(c: Column) -> Column:
    """A digit counts negative before a greater one; other characters count 0."""
    value = lambda ch: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROMAN_DIGITS.items() for x in kv]), ch), F.lit(0))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    step = lambda acc, ch: F.struct((acc["total"] + F.when(value(ch) < acc["most"], -value(ch)).otherwise(value(ch))).alias("total"), F.greatest(acc["most"], value(ch)).alias("most"))
    return F.aggregate(F.split(F.reverse(F.upper(c)), ""), start, step, lambda acc: acc["total"]).cast("bigint")


#: A character reference: by number, or by one of the names that the standard library knows.
REFERENCE = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,30};)"


def unescape_html(c: Column) -> Column:
    """Character references as characters; unknown names and numbers out of range stay. Names come from html.entities."""
    names = F.create_map(*[F.lit(x) for name, char in html5.items() if name.endswith(";") for x in (f"&{name}", char)])

    def one(m: Column) -> Column:
        digits = F.regexp_extract(m, r"^&#([0-9]+)", 1)
        code = F.when(digits != "", digits.cast("int")).otherwise(F.conv(F.regexp_extract(m, r"^&#[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("int"))
        return F.when(m.startswith("&#"), F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), utf8(code)).otherwise(m)).otherwise(F.coalesce(F.element_at(names, m), m))

    found = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    zipped = lambda found: F.array_join(F.transform(F.split(c, REFERENCE, -1), lambda g, i: F.concat(g, F.coalesce(F.when(i < F.size(found), one(F.get(found, i))), F.lit("")))), "")
    return let(found, zipped)


def utf8(code: Column) -> Column:
    """The character of a code point."""
    byte = lambda lead, shift: lead + F.shiftright(code, shift) % (64 if lead == 128 else 256)
    parts = F.when(code < 0x80, F.array(code)).when(code < 0x800, F.array(byte(192, 6), byte(128, 0))).when(code < 0x10000, F.array(byte(224, 12), byte(128, 6), byte(128, 0))).otherwise(F.array(byte(240, 18), byte(128, 12), byte(128, 6), byte(128, 0)))
    return F.decode(F.unhex(F.array_join(F.transform(parts, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8")


def html_to_text(c: Column) -> Column:
    """Markup to lines: navigation and code dropped, block ends as line breaks, one empty line where there were more."""
    c = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<header.*?</header>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|li|h\d|div)>", "\n")
    c = unescape_html(F.regexp_replace(c, r"<[^>]+>", " "))
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"\n\s*\n+", "\n\n"), r"[ \t]+", " "), F.lit(" \t\n\r\f\u000b\u00a0"))


#: Characters that LaTeX text must write otherwise.
TEX_SPECIAL = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "<": r"\textless{}", ">": r"\textgreater{}", "|": r"\textbar{}"}
TEX_TEXT = {"–": "--", "—": "---", "‘": "`", "’": "'", "“": "``", "”": "''", "…": r"\ldots{}", " ": "~", "©": r"\textcopyright{}", "®": r"\textregistered{}", "™": r"\texttrademark{}", "°": r"\textdegree{}", "·": r"\textperiodcentered{}", "•": r"\textbullet{}", "€": r"\texteuro{}", "£": r"\pounds{}", "§": r"\S{}", "¶": r"\P{}"}
TEX_MATH = {"×": r"\times", "÷": r"\div", "±": r"\pm", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "→": r"\rightarrow", "←": r"\leftarrow", "∞": r"\infty", "∑": r"\sum", "∈": r"\in"}


def greek() -> dict[str, str]:
    """Greek letters and their commands, from their Unicode names."""
    out = {}
    for code in [*range(0x391, 0x3AA), *range(0x3B1, 0x3CA)]:
        name = unicodedata.name(chr(code), "").split()
        if len(name) == 4 and name[3] not in ("OMICRON", "FINAL"):
            letter = {"LAMDA": "lambda"}.get(name[3], name[3].lower())
            out[chr(code)] = "\\" + (letter.capitalize() if name[1] == "CAPITAL" else letter)
    return out


def tex_table() -> dict[str, str]:
    return TEX_SPECIAL | TEX_TEXT | {k: f"${v}$" for k, v in {**TEX_MATH, **greek()}.items()}


def tex_escape(c: Column) -> Column:
    """Text for LaTeX: one pass over the characters with a table; neighbouring formulas join; unknown characters become "?"."""
    table = F.create_map(*[F.lit(x) for kv in tex_table().items() for x in kv])
    one = lambda ch: F.when(ch.rlike(r"^[A-Za-z0-9 .,;:!?'()\[\]/@=+*\"`\n\t-]$"), ch).otherwise(F.coalesce(F.element_at(table, ch), F.when(ch.rlike(r"^[À-ÖØ-öø-ſ¿¡ªº]$"), ch), F.lit("?")))
    return F.replace(F.array_join(F.transform(F.split(c, ""), one), ""), F.lit("$$"), F.lit(""))


def tex_unknown(c: Column) -> Column:
    """The characters that tex_escape can't write, distinct, in order."""
    known = "".join(tex_table())
    odd = F.filter(F.split(c, ""), lambda ch: (ch != "") & ~ch.rlike(r"^[\x00-\x7FÀ-ÖØ-öø-ſ¿¡ªº]$") & (F.instr(F.lit(known), ch) == 0))
    return F.array_distinct(odd)


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([\p{Ll}])-\n([\p{Ll}])", "$1$2"), "\n", " ")
