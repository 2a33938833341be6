"""Target-distribution importance resampling: documents drawn in proportion to how much likelier the target makes their n-grams.

1. A Spark task hands its rows to DuckDB a batch at a time. SQL lower-cases A-Z, unnests the words, makes the runs of 1 to
   n words by a window, and sums them by bucket: zlib's crc32, registered as a function over Arrow columns, of each
   distinct run. The bucket counts of each document are spilled to Parquet in the shared folder, so no text is read twice.
2. Spark merges the counts of all documents and of the target by bucket: a gain for each, the floored logarithm of the
   two smoothed shares. The table of gains has as many rows as there are buckets, a parameter, whatever the corpus.
3. Spark scores the spilled documents: the floored mean gain of a document's runs plus Gumbel noise from its id, so that the
   highest scores are a draw without replacement. The lowest score drawn comes from a count of rows by score (scores are
   whole numbers in a range of some 10^5, however many the rows); only rows from there on are sorted, in ranges of
   (score, id, row), so equal scores or ids never meet in one task, and numbered by range.

Nulls: a null text has no words, so weight 0. A null id is drawn with the noise of an empty id and comes last among equal
scores. Rows of equal id are documents of their own with one noise; those of equal score and id are ranked by n_features.
Empty texts and repeated rows are scored like any others. Texts are taken whole; the words of one batch, or of one longer
document, must fit in a worker. An empty table gives no rows; with an empty target every gain still has a value. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, removed, text_column, written

#: ASCII letters and digits, after lower-casing, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPILLED = "row bigint, doc_id bigint, n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"


def crc32(features: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x) for x in features.cast(pa.binary()).to_pylist()], pa.uint32())


def counting_sql(longest: int, buckets: int) -> str:
    """Of rows (row, doc_id, text): the words, the features, and the ascending buckets with their counts."""
    runs = [f"SELECT row, {' || chr(32) || '.join(['word', *[f'lead(word, {j}) OVER w' for j in range(1, n)]])} AS feature FROM words WINDOW w AS (PARTITION BY row ORDER BY place)" for n in range(1, longest + 1)]
    runs[0] = "SELECT row, word AS feature FROM words"
    return rf"""
    WITH split AS (SELECT row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM batch),
    words AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM split),
    features AS (SELECT row, feature, count(*) AS n FROM ({' UNION ALL '.join(runs)}) WHERE feature IS NOT NULL GROUP BY ALL),
    hashed AS (SELECT feature, CAST(crc32(feature) % {buckets} AS INTEGER) AS bucket FROM (SELECT DISTINCT feature FROM features)),
    summed AS (SELECT row, bucket, CAST(sum(n) AS BIGINT) AS n FROM features JOIN hashed USING (feature) GROUP BY ALL),
    lists AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM summed GROUP BY row)
    SELECT b.row, b.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, coalesce(l.n_features, 0) AS n_features, coalesce(l.buckets, []) AS buckets, coalesce(l.counts, []) AS counts
    FROM batch b JOIN split s USING (row) LEFT JOIN lists l USING (row)
    """


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """SPILLED's columns of rows (doc_id, text); `row` numbers them."""
    sql = counting_sql(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = duckdb.connect(config={"threads": 1})
        db.create_function("crc32", crc32, ["VARCHAR"], "UINTEGER", type="arrow")
        for b in batches:
            db.register("batch", pa.Table.from_batches([b]))
            yield from db.execute(sql).to_arrow_table().to_batches()
            db.unregister("batch")

    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_column().alias("text")).mapInArrow(run, SPILLED)


def merged(spilled: DataFrame, name: str) -> DataFrame:
    """bucket and the sum of its counts over all rows."""
    one = spilled.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return one.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """By bucket, floor(1000 * ln) of how much likelier the target makes it; one smoothing count for each bucket."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(merged(source, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    d = lambda c, more: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("double") + F.lit(float(more))
    ratio = d("t", 1) * d(total["s"] or 0, buckets) / (d("s", 1) * d(total["t"] or 0, buckets))
    found = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))
    return [r["gain"] for r in found.orderBy("bucket").collect()]


def constant(values: list[int]) -> Column:
    """A whole array as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def floored(total: Column, n: Column) -> Column:
    """total / n, floored, in whole numbers."""
    return F.call_function("div", total - F.pmod(total, n), n)


def score(spilled: DataFrame, by_bucket: list[int], seed: int) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score."""
    table = constant(by_bucket)
    total = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("bigint"), lambda sum_, x: sum_ + F.element_at(table, x["buckets"] + 1) * x["counts"])
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    weighed = spilled.select("row", "doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, floored(total, F.col("n_features"))).otherwise(F.lit(0)).cast("bigint").alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank`, from 1, by falling score, then id (null last) and n_features. Ranges are sorted apart and numbered by
    the counts of the ranges before, one number a range."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    ranges = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()  # the range's number in the upper bits, the row's place in the lower 33
    placed = ranges.withColumns({"range": F.shiftright(place, 33), "place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = {r["range"]: r["count"] for r in placed.groupBy("range").count().collect()}
    before = [0]
    for i in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(i, 0))
    return placed.withColumn("rank", F.element_at(constant(before), (F.col("range") + 1).cast("int")) + F.col("place") + 1).drop("range", "place")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and, if it is drawn, rank; target has a column text."""
    spark = docs.sparkSession
    spilled, folder = written(bucket_counts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), longest, buckets), "buckets")
    wanted, other = written(bucket_counts(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), longest, buckets), "target")
    scored = cut(score(spilled, gains(spilled, wanted, buckets), seed))
    removed(spark, folder)
    removed(spark, other)
    able = F.col("n_words") >= least_words
    by_score = {r["score"]: r["count"] for r in scored.where(able).groupBy("score").count().collect()}
    drawn = percent * sum(by_score.values()) // 100
    lowest, above = None, 0
    for value in sorted(by_score, reverse=True):
        if above >= drawn:
            break
        lowest, above = value, above + by_score[value]
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if lowest is None:
        return scored.select(*columns, none)
    high = able & (F.col("score") >= lowest)
    of_high = ranked(scored.where(high)).select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return of_high.unionByName(scored.where(~high).select(*columns, none))
