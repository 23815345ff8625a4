"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.llm import conversations, decontamination, html_text, mixing, neighbours, pivots, quality, ranked, repeats, secrets, sharding, simhash, toxicity
from stillwater.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query()
def op1_neighbours(spark, sf_dir):
    """Link count and component of every embedding."""
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(sharding.SQL)
def op2_sharding(spark, sf_dir):
    """Every document's shard and slot under the law ``rows``."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query(secrets.SQL)
def op3_secrets(spark, sf_dir):
    """Spans of every document: pattern matches, and random strings by the two Markov models."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.concat(base, "markov")).alias("spans"))


#: Labels are learned from documents with another remainder; these are held out.
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


@query()
def op4_quality(spark, sf_dir):
    """Score, expected grade, probability of the best grade and selection of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(f"not ({HELD_OUT})"))
    return quality.score(docs, model).withColumn("kept", quality.kept())


@query()
def op5_repeats(spark, sf_dir):
    """What is left of every document without strings of 200 bytes that start elsewhere too."""
    return repeats.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op6_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from those that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(f"not ({HELD_OUT})"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.ALARM).cast("int").alias("predicted"))


@query()
def op7_html_text(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query(mixing.SQL)
def op8_mixing(spark, sf_dir):
    """How many words the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(decontamination.SQL)
def op9_decontamination(spark, sf_dir):
    """Documents that hold a passage of a benchmark item, with the item."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_simhash(spark, sf_dir):
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query(ranked.SQL)
def op11_ranked(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(pivots.SQL)
def op12_pivots(spark, sf_dir):
    """The five vectors of highest integer inner product with every fiftieth vector."""
    return pivots.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(conversations.SQL)
def op13_conversations(spark, sf_dir):
    """Faults, cheapest repair and repaired text of every damaged conversation."""
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.digested(rows, conversations.plans(rows))
