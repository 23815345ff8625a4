"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words: the words at its 1s are hashed, those at
its 0s are ignored, so a replaced word at a 0 does not disturb it. Seeds of documents and
of benchmark items are joined by hash; every hit fixes how item and document line up, and
the words around it are compared place by place.

A document leaks an item if some stretch of 13 item words (the whole item if shorter)
lines up with at least 11 equal words. The first mask has four 1s in five places, so two
replaced words spoil at most 8 of the 9 seeds of a stretch: no leak of that kind is
missed. Shorter items of L words may have (L - 5) // 4 replaced words for the same
reason; items of fewer than five words are no passages and are not looked for.

Words are runs of letters and digits of the lower-cased text. Defined cases: null or
empty texts have no words and leak nothing; repeated rows count once; null ids are kept
as ids; an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stillwater.llm.common import written

MASKS = ("11011", "101101")
STRETCH = 13
SHORTEST = 5
#: Seeds of the benchmark are sent to all tasks up to this count (about 40 bytes each), joined by shuffle beyond.
BROADCAST_SEEDS = 500_000


def words(text) -> F.Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def allowed(length: int) -> int:
    """Replaced words in a stretch that the seeds are sure to survive."""
    return (length - SHORTEST) // 4


def _seeds(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """A row for every mask and place of ``words``, long rows included."""
    def at(mask):
        chosen = [j for j, bit in enumerate(mask) if bit == "1"]
        hashed = lambda i: F.xxhash64(F.lit(mask), *[F.get("words", i + F.lit(j)) for j in chosen])
        return F.when(F.size("words") >= len(mask),
                      F.transform(F.sequence(F.lit(0), F.size("words") - len(mask)), hashed))

    each = [df.select(*keys, F.posexplode(at(mask)).alias(position, "h")) for mask in MASKS]
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, stretch, matched (most equal words in a stretch), n_equal (in the whole
    item), first_word (of the document, where the item's first word lies; may be negative)."""
    best = F.max(F.struct("matched", "n_equal", (-F.col("first_word")).alias("back"), "stretch"))
    return _matches(docs, benchmark).groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.stretch", "b.matched", "b.n_equal", (-F.col("b.back")).alias("first_word"))


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every verified place of an item: doc_id, th (hash of the text), item_id, first_word, stretch, matched, n_equal."""
    d = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    items = written(benchmark.select("item_id", words("text").alias("words")).where(F.size("words") >= SHORTEST).distinct())
    item_seeds = written(_seeds(items, ["item_id"], "at"))
    few = item_seeds.count() <= BROADCAST_SEEDS
    doc_seeds = _seeds(d.select("doc_id", "th", words("text").alias("words")), ["doc_id", "th"], "pos")
    hits = doc_seeds.join(F.broadcast(item_seeds) if few else item_seeds, "h")
    hits = written(hits.select("doc_id", "th", "item_id", (F.col("pos") - F.col("at")).alias("first_word")).distinct())
    x = hits.select(F.col("doc_id").alias("did"), "th", F.col("item_id").alias("iid"), "first_word")
    pairs = d.join(x, F.col("doc_id").eqNullSafe(F.col("did")) & (d["th"] == x["th"])).select(
        "doc_id", d["th"], "iid", "first_word", words("text").alias("dw"))
    pairs = pairs.join(items, F.col("iid").eqNullSafe(F.col("item_id")))
    same = F.transform("words", lambda w, j: F.coalesce(
        (F.get("dw", F.col("first_word") + j) == w) & (F.col("first_word") + j >= 0), F.lit(False)).cast("int"))
    pairs = pairs.select("doc_id", "th", "item_id", "first_word", same.alias("same"),
                         F.least(F.size("words"), F.lit(STRETCH)).alias("stretch"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    runs = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("stretch") + 1),
                       lambda i: total(F.slice("same", i, F.col("stretch"))))
    pairs = pairs.select("doc_id", "th", "item_id", "first_word", "stretch", F.array_max(runs).alias("matched"),
                         total("same").alias("n_equal"))
    return pairs.where(F.expr(f"matched >= stretch - (stretch - {SHORTEST}) div 4"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item; rows that share an id, a null one too, are told apart by their texts."""
    found = _matches(docs, benchmark).select(F.col("doc_id").alias("leak_id__"), F.col("th").alias("leak_th__"))
    found = written(found.distinct())
    same = docs["doc_id"].eqNullSafe(found["leak_id__"]) & (F.xxhash64(docs["text"]) == found["leak_th__"])
    return docs.join(found, same, "left_anti")


def _sql() -> str:
    seeds = " UNION ALL ".join(
        f"SELECT id, p, '{m}' AS m, list_value({', '.join(f'words[p + {j + 1}]' for j, b in enumerate(m) if b == '1')})::VARCHAR AS seed "
        f"FROM (SELECT id, words, unnest(range(len(words) - {len(m) - 1})) AS p FROM {{0}} WHERE len(words) >= {len(m)})"
        for m in MASKS)
    return rf"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM documents),
  i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM benchmark),
  ds AS ({seeds.format('d')}), si AS ({seeds.format('i')}),
  hits AS (SELECT DISTINCT ds.id AS doc_id, si.id AS item_id, ds.p - si.p AS first_word
           FROM ds JOIN si USING (m, seed)),
  places AS (
    SELECT h.*, j, len(i.words) AS n, least(len(i.words), {STRETCH}) AS stretch,
      CASE WHEN first_word + j >= 1 AND d.words[first_word + j] = i.words[j] THEN 1 ELSE 0 END AS same
    FROM hits h JOIN d ON d.id = doc_id JOIN i ON i.id = item_id, unnest(range(1, len(i.words) + 1)) u(j)
    WHERE len(i.words) >= {SHORTEST}),
  run AS (
    SELECT *, sum(same) OVER w - coalesce(sum(same) OVER w2, 0) AS near, sum(same) OVER a AS n_equal
    FROM places
    WINDOW a AS (PARTITION BY doc_id, item_id, first_word),
      w AS (PARTITION BY doc_id, item_id, first_word ORDER BY j),
      w2 AS (PARTITION BY doc_id, item_id, first_word ORDER BY j RANGE BETWEEN UNBOUNDED PRECEDING AND {STRETCH} PRECEDING)),
  best AS (
    SELECT doc_id, item_id, first_word, stretch, n_equal, max(near) AS matched FROM run GROUP BY ALL)
SELECT doc_id, item_id, stretch::INTEGER AS stretch, matched::INTEGER AS matched, n_equal::INTEGER AS n_equal,
  first_word::INTEGER AS first_word
FROM best WHERE matched >= stretch - (stretch - {SHORTEST}) // 4
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, n_equal DESC, first_word) = 1
"""


SQL = _sql()
