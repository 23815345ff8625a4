"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash. A source whose target is q whole passes and a rest R
takes every document q times and once more the documents whose hash lies below the
source's threshold. Thresholds are found without sorting: words are summed by (source,
hash bucket), the bucket where the running sum crosses R is found, and only that bucket
is divided again, down to single hashes. A larger R only ever adds documents, so mixes
are nested.

Targets: source weights repeat 5, 2, 1 in code point order (null last) and share the
corpus size; a source stops at three times its size and the excess goes to the others by
weight until none is above (the level at which this settles is found directly from the
sources ordered by size over weight).

Defined cases: null or blank text has size 0 and takes 0; rows that agree in id and text
share a hash and so are taken or left together; an empty table gives no rows; a source
without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stillwater.llm.common import WORD, source_key, written

SEED = 7
WEIGHTS = (5, 2, 1)
PASSES = 3
BITS = 15
LEVELS = 4


def sized(docs: DataFrame, seed: int = SEED, *keep: F.Column) -> DataFrame:
    """doc_id, source, key, size in words and the 60-bit hash h, with the columns to keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(text.cast("binary"))))
    return docs.select("doc_id", "source", source_key("source").alias("key"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long").alias("h"), *keep)


def targets(rows: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """key, source_size, target: one row per source, the only table that is ordered as a whole."""
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    nth = (F.row_number().over(W.orderBy("key")) - 1) % len(weights) + 1
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), nth).cast("long")).withColumn(
        "cap", F.col("source_size") * passes)
    # Sources that stop first come first; a row's level assumes that all before it stop.
    before = W.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("wleft", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # That level rises while sources stop and falls after the last one that does.
    s = s.withColumn("level", F.max(F.col("left") / F.col("wleft")).over(everything))
    return s.select("key", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """key, threshold: documents with a hash below it are taken once more.

    ``goals`` has key and ``rest``, the words still to be taken. Whole buckets are passed
    while they fit; single hashes while half of them fits, so the sum ends within half a
    document of the rest.
    """
    live = goals.select("key", "rest", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("have"))
    for i in range(LEVELS):
        width = 2 ** (BITS * (LEVELS - 1 - i))
        bucket = F.col("h") - F.col("base")
        inside = rows.select("key", "size", "h").join(live.select("key", "base"), "key").where(
            (bucket >= 0) & (bucket < 2**BITS * width))
        hist = inside.groupBy("key", F.expr(f"(h - base) div {width}").alias("bucket")).agg(F.sum("size").alias("n"))
        run = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
        fits = F.col("have") + F.col("before") + F.col("n") * (0.5 if width == 1 else 1.0) <= F.col("rest")
        # The first bucket that does not fit is divided next; if all fit, so does the rest of the range.
        found = live.join(hist, "key", "left").groupBy("key", "rest", "base", "have").agg(
            F.min(F.when(~fits, F.struct("bucket", "before"))).alias("x"),
            F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("all"))
        live = written(found.select(
            "key", "rest", (F.col("base") + F.coalesce("x.bucket", F.lit(2**BITS)) * width).alias("base"),
            (F.col("have") + F.coalesce("x.before", "all")).alias("have")))
    return live.select("key", F.col("base").alias("threshold"))


def plan(rows: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """key, source_size, target, whole passes and hash threshold, one row per source."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = targets(rows, weights, passes).withColumn("whole", whole.cast("long"))
    goals = written(goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    return written(goals.join(thresholds(rows, goals), "key"))


def times() -> F.Column:
    """How often a row of ``sized`` joined to its source's plan is taken."""
    return F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row."""
    rows = written(sized(docs, seed))
    return rows.join(plan(rows, weights, passes), "key").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; rows without words are taken by no pass."""
    sources = plan(written(sized(docs, seed)), weights, passes)
    rows = sized(docs, seed, F.struct(*docs.columns).alias("doc")).where("size > 0").join(sources, "key")
    return rows.withColumn("nth", F.explode(F.sequence(F.lit(0), times()))).where("nth > 0").select("doc.*")


# The same mix by sorting: sums in hash order, and the shares recomputed until none is above.
SQL = rf"""
WITH RECURSIVE
  d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
      substr(md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15) AS h
    FROM documents),
  s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
      CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM d GROUP BY source),
  lv AS (
    SELECT 0 AS k, (SELECT sum(source_size) / sum(w)::DOUBLE FROM s) AS level, 0::BIGINT AS stopped
    UNION ALL
    SELECT k + 1, ((SELECT sum(source_size) FROM s) - x.caps) / x.wleft::DOUBLE, x.n
    FROM lv, LATERAL (
      SELECT coalesce(sum(3 * source_size) FILTER (3 * source_size < level * w), 0) AS caps,
        sum(w) FILTER (3 * source_size >= level * w) AS wleft,
        count(*) FILTER (3 * source_size < level * w) AS n FROM s) x
    WHERE x.n > stopped),
  t AS (
    SELECT source, source_size, least((3 * source_size)::DOUBLE,
      (SELECT level FROM lv ORDER BY k DESC LIMIT 1) * w) AS target FROM s),
  q AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
  r AS (
    SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
      sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
      sum(size) OVER (PARTITION BY d.source, h) AS own
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE WHEN upto - own * 0.5 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
