"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded hash inside their source, a row's fractional rank is
its rank over the source's size, and the rows sorted by fractional rank are cut into
shards of equal counts. Every stretch of that order holds the sources in proportion,
so every shard matches the mixture up to a row or so per source.

No source is sorted by one task: ranks come from counts per (source, hash prefix)
and the order inside one prefix; places in the final order come from counts per
stretch of the fractional rank, which is uniform whatever the skew.

Defined cases: null text has size 1 and the checksum of the empty text; a null source
is a source of its own, after all others; null and repeated ids are ordered by the
text's checksum and size, and rows equal in all of these are interchangeable; an empty
table gives no rows. Columns other than ``doc_id, text, source`` are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stillwater.llm.common import buckets, source_key, written

SEED = 20240613
ROWS_PER_BUCKET = 4096


def _places(rows: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """``rows`` plus their rank in the group, from bucket counts and the order inside a bucket.

    A group has 65,536 buckets at most, so the running count is a small window.
    """
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*group, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy(*group, bucket).orderBy(*order)
    ranked = rows.withColumn("inside", F.row_number().over(inside)).join(counts, [*group, bucket])
    return ranked.withColumn(out, F.col("before") + F.col("inside")).drop("before", "inside")


def fractional_ranks(rows: DataFrame, per_bucket: int = ROWS_PER_BUCKET, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, crc, size, key, ...) plus ``h`` and ``frac``, the rank in the source over its size."""
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("n_source")))
    most = sizes.agg(F.max("n_source")).first()[0] or 0
    digits = min(4, max(1, -(-(buckets(most, per_bucket).bit_length() - 1) // 4)))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("crc").cast("string")))
    keyed = rows.withColumn("h", h).withColumn("prefix", F.substring("h", 1, digits))
    ranked = _places(keyed, ["key"], "prefix", ["h", "doc_id", "crc", "size"], "r").drop("prefix")
    return ranked.join(sizes, "key").withColumn("frac", (F.col("r") - 0.5) / F.col("n_source")).drop("r", "n_source")


def assign(docs: DataFrame, shards: int = 8, per_bucket: int = ROWS_PER_BUCKET, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, source, shard and slot of every row; shard counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select("doc_id", "source", source_key("source").alias("key"),
                               (F.octet_length(text) + 1).cast("long").alias("size"),
                               F.crc32(text.cast("binary")).alias("crc")))
    total = rows.count()
    stretches = buckets(total, per_bucket)
    stretch = F.least(F.floor(F.col("frac") * stretches), F.lit(stretches - 1)).cast("long")
    ranked = written(fractional_ranks(rows, per_bucket, seed).withColumn("stretch", stretch))
    placed = _places(ranked, [], "stretch", ["frac", "key", "h", "doc_id", "crc", "size"], "place")
    shard = F.expr(f"int((place - 1) * {shards} div {max(total, 1)})")
    first = F.expr(f"(bigint(shard) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "source", "shard",
        (F.col("place") - 1 - first).alias("slot"))


def mixture(placed: DataFrame) -> DataFrame:
    """Rows and bytes by shard and source, to audit how near the shards come to the mixture."""
    return placed.groupBy("shard", "source").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


# The checksum of a text of up to 2^26 bytes by the bytewise table method.
_CRC = """
  crc_table AS (
    SELECT list(c ORDER BY b) AS t FROM (
      SELECT b, list_reduce([b::BIGINT] || [0,0,0,0,0,0,0,0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
      FROM range(256) r(b))),
"""

SQL = f"""
WITH {_CRC}
  rows_ AS (
    SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
      xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(coalesce(text, ''))),
        lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM documents, crc_table),
  hashed AS (
    SELECT *, md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, crc::VARCHAR)) AS h FROM rows_),
  ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 0.5::DOUBLE)
      / count(*) OVER (PARTITION BY source) AS frac FROM hashed),
  placed AS (
    SELECT *, row_number() OVER (ORDER BY frac, source NULLS LAST, h, doc_id) - 1 AS place,
      count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, ((place * 8) // total)::INTEGER AS shard,
  (place - ((place * 8) // total * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
