"""Settings of documents: what the layers state is shuffled once, the presets' rows never, and the rows are those of `merge`."""

from pyspark.sql import functions as F

from vellum.operators import settings


def test_rows_are_those_of_merge_and_presets_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "ieee_journal"), (2, "mdpi"), (3, "wiley"), (3, "mdpi"), (4, "none"), (5, None)], "doc_id bigint, preset string")
    a = [(1, "font", "x"), (2, "font.size", "9"), (2, "font.size", "8"), (6, "a.b", "1"), (6, "a", "2"), (3, "headings.levels[0].bold", None), (3, "headings", "no"), (4, "p", "q"), (1, None, "z")]
    b = [(1, "font.family", "y"), (2, "font", "z"), (3, "headings.levels[1].case", "upper"), (6, "a.b.c", "3"), (5, "x[0].y", "1"), (2, "title.case.more", "t")]
    layers = [spark.createDataFrame(x, "doc_id bigint, path string, value string") for x in (a, b)]
    rows = docs.join(settings.preset_rows(spark), "preset").select("doc_id", F.lit(0).alias("layer"), "path", "value")
    for n, layer in enumerate(layers, 1):
        rows = rows.unionByName(layer.select("doc_id", F.lit(n).alias("layer"), "path", "value"))
    as_rows = lambda df: sorted(map(tuple, df.select("doc_id", "path", "value", "layer").collect()))
    made = settings.for_documents(docs, layers)
    assert as_rows(made) == as_rows(settings.merge(rows, ["doc_id"]))
    plan = settings.as_struct(made, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 3, plan


def test_no_preset_has_a_value_where_another_has_a_group(spark):
    rows = settings.preset_rows(spark)
    groups = rows.select(F.explode(F.array_compact(settings.parents(F.col("path")))).alias("path"))
    assert rows.where("value IS NOT NULL").join(groups, "path", "left_semi").count() == 0
