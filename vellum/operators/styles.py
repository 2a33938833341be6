"""What paragraphs inherit over chains of styles, by pointer doubling.

A table of styles (doc_id, style, based_on and a column for each attribute, null where the style itself is silent) becomes
one of resolved styles: the value of the nearest style of the chain that states one, the style itself first, within the
first `depth` styles. Each round joins every style with the one its pointer shows, so r rounds reach 2^r styles; a chain
that comes back to itself or shows a style that isn't there just ends in silence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many styles of a chain count for each attribute.
DEPTHS = {"numbered": 10, "caps": 10, "hidden": 9}


def resolve(styles: DataFrame, depths: dict[str, int] = DEPTHS) -> DataFrame:
    """doc_id, style and each attribute of `depths` as inherited. Of rows with one name the smallest (based_on, attributes) counts."""
    names = list(depths)
    own = styles.where("style IS NOT NULL").groupBy("doc_id", "style").agg(F.min(F.struct("based_on", *names)).alias("s"))
    now = own.select("doc_id", "style", F.col("s.based_on").alias("next"), F.lit(1).alias("hops"), *[F.when(F.col(f"s.{n}").isNotNull(), F.struct(F.lit(0).alias("at"), F.col(f"s.{n}").alias("value"))).alias(n) for n in names])
    for _ in range((max(depths.values()) - 1).bit_length()):
        far = now.select("doc_id", F.col("style").alias("next"), F.col("next").alias("_next"), F.col("hops").alias("_hops"), *[F.col(n).alias(f"_{n}") for n in names])
        both = now.join(far, ["doc_id", "next"], "left")
        later = {n: F.when(F.col(f"_{n}").isNotNull(), F.struct((F.col(f"_{n}.at") + F.col("hops")).alias("at"), F.col(f"_{n}.value").alias("value"))) for n in names}
        now = both.select("doc_id", "style", F.col("_next").alias("next"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), *[F.coalesce(F.col(n), later[n]).alias(n) for n in names])
    return now.select("doc_id", "style", *[F.when(F.col(f"{n}.at") < most, F.col(f"{n}.value")).alias(n) for n, most in depths.items()])


def inherited(paragraphs: DataFrame, styles: DataFrame, depths: dict[str, int] = DEPTHS) -> DataFrame:
    """paragraphs (doc_id, pos, style, and attributes of their own, null where silent) with each attribute as the paragraph
    states it, else as its style does, else false."""
    known = resolve(styles, depths).select("doc_id", "style", *[F.col(n).alias(f"_{n}") for n in depths])
    rest = [c for c in paragraphs.columns if c not in depths]
    return paragraphs.join(known, ["doc_id", "style"], "left").select(*rest, *[F.coalesce(n, f"_{n}", F.lit(False)).alias(n) for n in depths])
