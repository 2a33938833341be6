"""Author guidelines: demands found in clauses, whatever the order and wording."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import guidelines

CASES = {
    "The abstract of the manuscript must have no more than 250 words; the title up to twelve words.": {"abstract_words": 250, "title_words": 12},
    "Submit a 150-word abstract and three to five key words.": {"abstract_words": 150, "keywords_min": 3, "keywords_max": 5},
    "An abstract (200 words) is needed. A maximum of 6 keywords is allowed.": {"abstract_words": 200, "keywords_max": 6},
    "The title should not exceed 15 words and the abstract is limited to 300 words, articles are within 8,000 words.": {"title_words": 15, "abstract_words": 300, "total_words": 8000},
    "Title pages have 10 words. A text of 500 words is a letter.": {},
    "Use 12-point Cambria, one and a half line spacing, margins of 25 mm, two-column, with line numbers.": {"font": "Cambria", "font_size": 12.0, "line_spacing": 1.5, "margin_cm": 2.5, "columns": 2, "line_numbers": True},
    "Palatino 10.5 pt, 1.5 spacing, margins one inch, US letter.": {"font": "Palatino Linotype", "font_size": 10.5, "line_spacing": 1.5, "margin_cm": 2.54, "page_size": "Letter"},
    "References are numbered consecutively in the order of appearance.": {"ref_style": "vancouver", "cite_mode": "numeric"},
    "Follow the IEEE citation style": {"ref_style": "ieee", "cite_mode": "numeric"},
    "We publish with IEEE. American Medical Association style applies": {"ref_style": "ama", "cite_mode": "numeric"},
    "Section headings must not be numbered.": {"scheme": "none"},
    "Headings should be numbered. Tables are not boxed.": {"scheme": "decimal"},
    "A structured abstract is required, with Methods, Results and a Conflict of Interest.": {"structured": True, "required_sections": "Methods; Results; Conflict of Interest"},
    "The introduction is short. Papers must include a Discussion.": {"required_sections": "Discussion"},
    "A number with 999999999999999999 words and an abstract of 99999999999 words.": {},
    "": {},
    None: {},
}


@pytest.fixture(scope="module")
def found(spark):
    texts = spark.createDataFrame(list(enumerate(CASES)), "i int, text string")
    rows = texts.select("i", *[c.alias(k) for k, c in guidelines.fields(F.col("text")).items()]).collect()
    return {r["i"]: {k: v for k, v in r.asDict().items() if v is not None and k != "i"} for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_demands(found, i):
    assert found[i] == list(CASES.values())[i]


def test_white_space_of_any_kind_and_long_texts(spark):
    text = "filler text. " * 20_000 + "The abstract\nshould not exceed\t175 words."
    got = spark.createDataFrame([(text,)], "text string").select(guidelines.fields(F.col("text"))["abstract_words"].alias("n")).first()["n"]
    assert got == 175
