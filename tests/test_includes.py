"""Files that take in files, and chains of pieces, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from vellum.operators import includes, layout
from vellum.sources import latex


def expand(text, files, depth=0):
    def put(m):
        found = next((files[n] for n in (m[1].strip(), m[1].strip() + ".tex") if n in files), None)
        return m[0] if found is None else expand(found, files, depth + 1)

    return text if depth > 5 else re.sub(includes.TAKES_IN, put, text)


def test_projects_of_any_shape(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for d in range(40):
        n = rng.randint(1, 7)
        files = {f"f{i}" + rng.choice(["", ".tex"]): "".join(rng.choice(["x", " y\n", "", f"\\input{{f{rng.randrange(n + 1)}}}", f"\\include{{ f{rng.randrange(n)}.tex }}", "\\input{}", "\\inputs{f1}"]) for _ in range(rng.randint(0, 4))) for i in range(n)}
        files["main.tex"] = "\\documentclass{a}" + rng.choice(["", "\\input{f0}", "\\input{f0} and \\input{f1}", "\\input{main}"])
        rows += [(d, k, v) for k, v in files.items()]
        want[d] = expand(files["main.tex"], files)
    df = spark.createDataFrame(rows, "doc_id int, name string, text string").repartition(4)
    assert {r["doc_id"]: r["text"] for r in latex.expanded(df).collect()} == want
    odd = spark.createDataFrame([(1, "a.tex", None), (1, None, "x"), (2, "b.tex", "\\input{b}"), (2, "b.tex", "z")], "doc_id int, name string, text string")
    assert {r["doc_id"]: r["text"] for r in latex.expanded(odd).collect()} == {1: "", 2: "\\input{b}"}
    assert latex.expanded(df.limit(0)).count() == 0


def test_chains_of_pieces(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for page in range(3):
        for row in range(4):
            n, first = rng.choice([1, 2, 40, 130]), None
            numbers = rng.sample(range(row * 1000, row * 1000 + 999), n)
            for p, block in enumerate(numbers):
                first = block if first is None or p == n // 2 else first
                x0 = p * 20.0 + (100 if p >= n // 2 else 0)
                rows.append((1, page, block, 0, row * 40.0, row * 40.0 + 10, x0, x0 + 15))
                want[page, block] = first
    df = spark.createDataFrame(rows, "doc_id int, page int, block int, line int, y0 double, y1 double, x0 double, x1 double").repartition(3)
    assert {(r["page"], r["block"]): r["joined"] for r in layout.joined_baselines(df).collect()} == want
    assert layout.joined_baselines(df.limit(0)).select(F.col("joined")).count() == 0


def test_rows_of_pieces_meet_in_cells(spark):
    """One page of 300 rows of pieces: no join compares all of its pieces, and chains are followed without a round for each doubling."""
    rows = [(1, 0, r * 100 + p, 0, p * 14.0, p * 14.0 + 10, r * 20.0, r * 20.0 + 10) for r in range(300) for p in range(9)]
    df = spark.createDataFrame(rows, "doc_id int, page int, block int, line int, x0 double, x1 double, y0 double, y1 double")
    found = layout.joined_baselines(df)
    assert {(r["block"], r["joined"]) for r in found.collect()} == {(r * 100 + p, r * 100) for r in range(300) for p in range(9)}
    assert dict(found.dtypes)["joined"] == "int"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_row" in plan and "_col" in plan and plan.count("collect_list") == 1
