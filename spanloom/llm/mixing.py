"""Mixing sources to target weights.

Every document gets a hash key; each source is ordered by key, running word totals are formed by key
range (a total per range, then a running total of the ranges), and the order is cut where the source's
budget ends.  A budget above a source's size takes whole epochs first, then the cut.

Defined cases: null texts have size 0; a null source is a source of its own and ranks last; a null
doc_id is keyed as the empty string, and rows of one id apart by their texts; repeated rows each count; an
empty table gives an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.runtime import cut, maybe_broadcast, table

NAME = "op1_source_mixing"

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Rows aimed at in one range of keys of one source.
RANGE_ROWS = 5_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_rows, source_size, target: the level at which capped shares use up the total.

    A source's share is weight times level, at most ``epochs`` times its size.  Ordered by the level at
    which they reach their cap, the first source that stays below its cap fixes the level of the rest.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    # One row per source from here on.
    name = F.col("source").asc_nulls_last()
    weighed = by_source.withColumn("rank", F.row_number().over(Window.orderBy(name)) - 1)
    weighed = weighed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    level = (share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("at", level).withColumn("fits", F.when(F.col("at") <= F.col("full_at"), F.struct("full_at", "rank", "at")))
    leveled = leveled.withColumn("level", F.min("fits").over(Window.partitionBy())["at"])
    return leveled.select("source", "source_rows", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes: doc_id, source, size, body (and more).  Adds source_size, target and taken.  body: any string that
    tells rows with the same or no id apart, so that they do not share one key."""
    goals = cut(targets(sizes, weights, share, epochs))
    n_sources = goals.count()
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("body")).cast("binary"))
    goals = goals.withColumnRenamed("source", "goal_source")
    rows = sizes.withColumn("mix_key", key).join(maybe_broadcast(goals, n_sources), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("source_rows") / RANGE_ROWS) / F.log(F.lit(16.0)))).cast("int")
    rows = rows.withColumn("mix_range", F.substr("mix_key", F.lit(1), digits))
    inside = Window.partitionBy("source", "mix_range").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before_in_range", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranges = rows.groupBy(F.col("source").alias("r_source"), F.col("mix_range").alias("r_range")).agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("r_source").orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("r_source", "r_range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("before_range"))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("mix_range") == F.col("r_range"))).drop("r_source", "r_range")
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - whole * F.col("source_size") - F.col("before_range") - F.col("before_in_range")
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), left))
    return rows.withColumn("taken", taken.cast("long")).drop("mix_key", "mix_range", "body", "source_rows", "before_in_range", "before_range")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The whole mix of a documents table."""
    body = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    return mix(cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), body.alias("body"))), **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes; a row for every document, null and empty texts with size 0."""
    return mix_documents(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS mix_key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM s
), f AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM f
), g AS (
  SELECT source, source_size, least(cap, weight * (SELECT lv FROM l WHERE lv <= full_at ORDER BY full_at, rk LIMIT 1)) AS target FROM l
), p AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mix_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), q AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, budget - whole * source_size - ahead)))::BIGINT AS taken
FROM q
"""
