"""Layered settings as rows: (key columns, layer, path, value), merged by one aggregate.

A path names a setting in nested groups, `headings.levels[1].bold`; values are text. The last layer that states a path wins
(null states nothing, so a layer cannot take a setting back), heading levels are merged place by place as any group is,
and a layer that puts a plain value where an earlier one has a group, or a group where it has a value, replaces it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import formats
from vellum.operators.specs import FIELDS, PRESETS


def flat(tree: object, path: str = "") -> list[tuple[str, str | None]]:
    """Nested settings as (path, value); lists other than of groups are one value."""
    if isinstance(tree, dict):
        return [row for k, v in tree.items() for row in flat(v, f"{path}.{k}" if path else k)]
    if isinstance(tree, list) and tree and all(isinstance(v, dict) for v in tree):
        return [row for i, v in enumerate(tree) for row in flat(v, f"{path}[{i}]")]
    if isinstance(tree, list):
        return [(path, "|".join(map(str, tree)))]
    return [(path, str(tree).lower() if isinstance(tree, bool) else None if tree is None else str(tree))]


def preset_rows(spark: SparkSession) -> DataFrame:
    """preset, path, value of every preset, whole."""
    return spark.createDataFrame([(p, *row) for p in PRESETS for row in flat(formats.preset(p))], "preset string, path string, value string")


def parents(path: Column) -> Column:
    """The groups above a path, outermost first: a.b[1].c lies in a, a.b and a.b[1]."""
    marked = F.split(F.regexp_replace(F.regexp_replace(path, r"\[", "\u0001["), r"\.", "\u0001."), "\u0001")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(marked) - 1, F.lit(1))), lambda n: F.when(n < F.size(marked), F.array_join(F.slice(marked, 1, n), "")))


def merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, value, layer of the settings in force. Of two values of a layer for one path, the larger counts."""
    last = rows.where("value IS NOT NULL AND path IS NOT NULL").groupBy(*keys, "path").agg(F.max(F.struct("layer", "value")).alias("x"))
    last = last.select(*keys, "path", "x.layer", "x.value")
    # a plain value at a path of the groups above: the later of both layers stands, the group if one layer states both
    above = last.select(*keys, "path", "layer", F.explode(F.array_compact(parents(F.col("path")))).alias("group"))
    plain = last.select(*keys, F.col("path").alias("group"), F.col("layer").alias("plain"))
    both = above.join(plain, [*keys, "group"])
    gone = both.select(*keys, F.when(F.col("layer") < F.col("plain"), F.col("path")).otherwise(F.col("group")).alias("path"))
    return last.join(gone.distinct(), [*keys, "path"], "left_anti")


def as_struct(settings: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the fields of specs.FIELDS that have a place in the settings, typed, and all settings as a map."""
    whole = settings.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("settings"))
    return whole.select(*keys, "settings", *[F.element_at("settings", F.lit(p)).cast(FIELDS[f]).alias(f) for f, p in formats.PATHS.items()])


def levels(settings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (from 1) and what each heading level states."""
    spot = F.regexp_extract("path", r"^headings\.levels\[(\d+)\]\.(\w+)$", 1)
    name = F.regexp_extract("path", r"^headings\.levels\[(\d+)\]\.(\w+)$", 2)
    own = settings.where(spot != "").select(*keys, (spot.cast("int") + 1).alias("n"), name.alias("name"), "value")
    pick = lambda field, kind: F.max(F.when(F.col("name") == field, F.col("value"))).cast(kind).alias(field)
    return own.groupBy(*keys, "n").agg(pick("size", "double"), pick("bold", "boolean"), pick("italic", "boolean"), pick("case", "string"), pick("align", "string"))


def for_documents(documents: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """doc_id, path, value, layer: the preset of each document (doc_id, preset) under the layers (doc_id, path, value), weakest
    first, by the rules of `merge`. What the layers state comes together by document, in one shuffle; the preset's rows are put under it
    afterwards, so that they are never shuffled. No preset has a plain value where another has a group."""
    rows = documents.select("doc_id", "preset", F.lit(0).alias("layer"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("value"))
    for n, layer in enumerate(layers, 1):
        rows = rows.unionByName(layer.select("doc_id", F.lit(None).cast("string").alias("preset"), F.lit(n).alias("layer"), "path", "value").where("path IS NOT NULL AND value IS NOT NULL"))
    # a fixed number: partitions that are small here would be put together, and each document's rows grow a hundredfold below
    many = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = rows.repartition(many, "doc_id").groupBy("doc_id", "path").agg(F.collect_set("preset").alias("presets"), F.max(F.struct("layer", "value")).alias("x"))
    row = F.when(F.col("path").isNotNull(), F.struct("path", "x.layer", "x.value"))
    own = last.groupBy("doc_id").agg(F.flatten(F.collect_list("presets")).alias("presets"), F.collect_list(row).alias("own"))
    within = lambda a, b: a.startswith(F.concat(b, F.lit("."))) | a.startswith(F.concat(b, F.lit("[")))
    told = F.col("doc_id").isNotNull()  # equal ids only are one document
    beats = lambda o: lambda q: told & (within(o["path"], q["path"]) & (q["layer"] > o["layer"]) | within(q["path"], o["path"]) & (q["layer"] >= o["layer"]))
    kept = own.select("doc_id", F.explode(F.filter("own", lambda o: ~F.exists("own", beats(o)))).alias("o")).select("doc_id", "o.path", "o.value", "o.layer")
    line = F.array_append(F.array_compact(parents(F.col("path"))), F.col("path"))
    known = preset_rows(documents.sparkSession).where("value IS NOT NULL").withColumn("line", line)
    of = own.select("doc_id", F.explode("presets").alias("preset"), F.transform("own", lambda o: o["path"]).alias("paths"), F.when(told, F.flatten(F.transform("own", lambda o: F.array_compact(parents(o["path"]))))).alias("groups"))
    under = of.join(F.broadcast(known), "preset")  # fifteen presets of some hundred rows
    hidden = F.when(told, F.arrays_overlap("line", "paths") | F.array_contains("groups", F.col("path"))).otherwise(F.array_contains("paths", F.col("path")))
    base = under.where(~hidden).groupBy("doc_id", "path").agg(F.max("value").alias("value")).withColumn("layer", F.lit(0))
    return kept.unionByName(base)
