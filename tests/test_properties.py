"""Round trips and rules that SQL doesn't show."""

from pyspark.sql import functions as F

from vellum.functions import bibliography as bib
from vellum.functions import text as tx
from vellum.operators import citations, runs


def test_roman_numerals_round_trip(spark):
    n = spark.range(1, 400).withColumn("r", tx.int_to_roman(F.col("id")))
    assert n.where(tx.roman_to_int(F.col("r")) != F.col("id")).count() == 0


def test_expand_undoes_compress(spark):
    sets = spark.range(200).select(F.expr("transform(sequence(1, 5), x -> cast(pmod(hash(id, x), 30) as int))").alias("s"))
    back = F.array_sort(citations.expand(F.replace(citations.compress(F.col("s")), F.lit("–"), F.lit("-"))))
    assert sets.where(back != F.array_sort(F.array_distinct("s"))).count() == 0


def test_drop_chars_and_merge_keep_the_text(spark):
    r = spark.range(1).select(F.array(*[runs.run(F.lit(t), F.lit(b), F.lit(False), F.lit(False), F.lit(False)) for t, b in (("ab", True), ("cd", True), ("ef", False))]).alias("r"))
    got = r.select(runs.plain(runs.drop_chars(F.col("r"), F.lit(3))).alias("a"), runs.plain(runs.merge_runs(F.col("r"))).alias("b"), F.size(runs.merge_runs(F.col("r"))).alias("n")).first()
    assert (got["a"], got["b"], got["n"]) == ("def", "abcdef", 2)


def test_tex_escape_joins_formulas_and_marks_unknown(spark):
    got = spark.createDataFrame([("αβ & 50% – x", "漢")], "t string, u string").select(tx.tex_escape(F.col("t")).alias("t"), tx.tex_escape(F.col("u")).alias("u"), tx.tex_unknown(F.col("u")).alias("k")).first()
    assert (got["t"], got["u"], got["k"]) == (r"$\alpha\beta$ \& 50\% -- x", "?", ["漢"])


def test_four_references_of_a_draft(spark):
    raw = [
        "Brown, T. (2021). Machine learning for network security. IEEE Access, 9, 1123–1135. https://doi.org/10.1109/ACCESS.2021.1234567",
        "Kumar, R. (2022). Lightweight intrusion detection for medical devices. Computers & Security, 115, 102611.",
        "Lee, J., & Park, S. (2019). Shallow classifiers for anomaly detection. Expert Systems with Applications, 120(3), 45–58. https://doi.org/10.1016/j.eswa.2019.01.010",
        "Smith, A. B., Jones, C., & Patel, D. (2020). Deep learning in the Internet of Medical Things. Journal of Network and Computer Applications, 150, 102480. https://doi.org/10.1016/j.jnca.2020.102480",
    ]
    got = bib.parse_references(spark.createDataFrame(list(enumerate(raw)), "k int, raw string")).orderBy("k").collect()
    assert [(len(r["p_authors"]), r["p_year"], r["p_container"], r["p_volume"], r["p_issue"], r["p_pages"]) for r in got] == [
        (1, "2021", "IEEE Access", "9", "", "1123–1135"), (1, "2022", "Computers & Security", "115", "", "102611"), (2, "2019", "Expert Systems with Applications", "120", "3", "45–58"), (3, "2020", "Journal of Network and Computer Applications", "150", "", "102480"),
    ]
