"""Derived manuscripts: made document by document, they are what the joins of the SQL text give, and no text is shuffled."""

import pytest

from vellum.sources import derived


@pytest.mark.parametrize("ids", ["id", "id * 1000003 + 12345678901", "CASE WHEN id % 5 = 0 THEN id - 40 WHEN id % 7 > 1 THEN id DIV 2 END"])
def test_blocks_equal_the_joins(spark, ids):
    docs = spark.range(90).selectExpr(f"{ids} AS doc_id", "CASE WHEN id % 13 <> 0 THEN array_join(transform(sequence(0, id % 41), i -> IF((i + id) % 6 = 5, '  ', concat('line ', i))), '\\n') END AS text")
    joined = spark.sql(derived.blocks_sql("{d}", derived.LINES_SPARK), d=docs)
    made = derived.made_blocks(spark, docs)
    assert made.dtypes == joined.dtypes
    assert made.exceptAll(joined).count() == joined.exceptAll(made).count() == 0 < made.count()


def test_no_text_is_shuffled(spark, sf_dir):
    made = derived.made_blocks(spark, derived.documents(spark, sf_dir).select("doc_id", "text"))
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_task_are_left_in_several_files(spark, sf_dir):
    from vellum.sources.shared import once

    made = once(spark, "rows-of-one-task", sf_dir, lambda: spark.range(60_000).coalesce(1))
    assert made.count() == 60_000 and len(made.inputFiles()) > 1
