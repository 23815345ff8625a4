"""Ranked search for the best documents of every item by bit-sliced Bloom signatures.

Scores: see ``Items``; all in 64-bit integers but for the logarithm of a term's weight.

Signatures: a document enters (term, level) for every level of ``LEVELS`` that the term's count
reaches into a Bloom filter of ``HASHES`` functions, as wide as its number of entries asks for.
Documents of a width lie side by side in blocks, and row r of a block is the bitmap of the
documents with bit r set. The AND of a term's rows is a bitmap that overestimates where it
occurs so often. A document's contribution grows with the count, so the weighted sum of
those bitmaps, level by level, each with the step from the previous level's highest count to
its own, is an upper bound on its score.

Search: one scan of the texts writes the blocks and counts what the weights need; the
``PROBES`` documents of the highest bounds are scored exactly and the k-th of them is a
score that results reach; every document whose bound reaches it is scored from its whole
text. Nothing else is left out, so the result is exact.

Items are taken in blocks of about ``ITEM_BYTES`` of text; terms, weights and limits of one
block are what all tasks get. Terms are known by 64 bits of hash.

Defined cases: null, empty and term-less texts score nothing; rows of one item_id are one item
with all their terms; a null item_id is one too; repeated document rows rank one after another;
a null doc_id comes last among ties; an empty table on either side gives no rows; further
columns are ignored. A very long text makes a wide signature in a block of few documents.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from stillwater.llm.common import written
from stillwater.llm.textwords import _LOWER, Stretches, by_bytes, mixed

LEVELS = (1, 2, 3, 4, 6, 10, 18)
HASHES = 3
BITS_PER_ENTRY = 12
NARROWEST = 256
BLOCK_DOCS = 1024
BLOCK_BITS = 1 << 23
PROBES = 16
ITEM_BYTES = 1 << 21
REFS = 4096
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Counts:
    """Terms of a batch of texts: (doc, hash, tf) sorted by doc, and the terms of every text."""

    def __init__(self, texts: list[bytes | None]):
        data = np.frombuffer(b" ".join([b"", *[t or b"" for t in texts], b""]), np.uint8)
        inside = _TERM[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begins = 1 + np.concatenate([[0], np.cumsum([(len(t) if t else 0) + 1 for t in texts])])
        doc = np.searchsorted(begins, edge[0::2], side="right") - 1
        h = Stretches(_LOWER[data]).of(edge[0::2], edge[1::2])
        self.n = np.bincount(doc, minlength=len(texts))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[:len(doc)])
        self.doc, self.hash, self.tf = doc[new], h[new], np.diff(np.append(new, len(doc)))
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))


def rows_of(hashes: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    """(entries, HASHES) hash values; a block of some width takes them modulo its width."""
    base = hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64)
    return np.stack([mixed(base ^ np.uint64(j * 0xD6E8FEB86659FD93 % 2**64)) for j in range(1, HASHES + 1)], axis=-1)


class Builder:
    """Collects documents by width and gives a block as soon as it is full."""

    def __init__(self):
        self.open = defaultdict(list)

    @staticmethod
    def docs(width: int) -> int:
        return max(8, min(BLOCK_DOCS, BLOCK_BITS // width))

    def add(self, doc_id, key, n: int, hashes: np.ndarray, tf: np.ndarray):
        entries = [rows_of(hashes[tf >= low], i) for i, low in enumerate(LEVELS)]
        entries = np.concatenate(entries).ravel()
        width = NARROWEST
        while width * HASHES < BITS_PER_ENTRY * len(entries):
            width *= 2
        waiting = self.open[width]
        waiting.append((doc_id, key, n, (entries & np.uint64(width - 1)).astype(np.int32)))
        if len(waiting) == self.docs(width):
            yield self.block(width)

    def block(self, width: int) -> dict:
        docs = self.open.pop(width)
        bits = np.zeros((width, -(-len(docs) // 8) * 8), bool)
        for i, (_, _, _, rows) in enumerate(docs):
            bits[rows, i] = True
        return {"width": width, "ids": [d[0] for d in docs], "keys": [d[1] for d in docs], "sizes": [d[2] for d in docs],
                "bits": np.packbits(bits, axis=1).tobytes()}

    def rest(self):
        for width in list(self.open):
            yield self.block(width)


class Items:
    """Items of one block: their terms, and after the count of the corpus their weights.

    A term in df of the N documents that hold any term weighs floor(1000 ln((2N + 2) / (2 df + 1))).
    A document of n terms has m = 10 + 90 n N div L, L being the terms of all documents. A term that
    occurs tf times in it adds its weight times 10^9 tf div (1000 tf + 8 m).
    """

    def __init__(self, rows: list):
        terms = defaultdict(set)
        for r in rows:
            terms[r["item_id"]].update(Counts([r["text"] and bytes(r["text"])]).hash.tolist())
        self.ids = [i for i in terms if terms[i]]
        lists = [np.sort(np.array(list(terms[i]), np.uint64)) for i in self.ids]
        self.hashes = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.hashes, t) for t in lists]

    def weigh(self, df: np.ndarray, top: np.ndarray, n: int, total: int) -> None:
        self.n, self.total, self.top = n, total, top
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are terms of items, their numbers)."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        return hit, at[hit]

    def part(self, tf, sizes):
        """What a term of weight 1 adds."""
        m = 10 + 90 * sizes * self.n // self.total
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def slices(self):
        """(first, last) of runs of items with about ``REFS`` terms."""
        first, refs = 0, 0
        for i, t in enumerate(self.terms):
            refs += len(t)
            if refs >= REFS or i + 1 == len(self.terms):
                yield first, i + 1
                first, refs = i + 1, 0

    def bounds(self, width: int, sizes: np.ndarray, bits: bytes) -> np.ndarray:
        """(items, documents) upper bounds of the scores in a block."""
        rows = np.frombuffer(bits, np.uint8).reshape(width, -1)
        out = np.zeros((len(self.ids), len(sizes)), np.int64)
        highest = [high - 1 for high in LEVELS[1:]] + [max(int(self.top.max(initial=1)), LEVELS[-1])]
        before, there = np.int64(0), None
        for level, high in enumerate(highest):
            at = (rows_of(self.hashes, level) & np.uint64(width - 1)).astype(np.int64)
            now = rows[at[:, 0]]
            for j in range(1, HASHES):
                now &= rows[at[:, j]]
            now[self.top < LEVELS[level]] = 0
            there = now if there is None else now & there
            used = there.any(axis=1)
            if not used.any():
                break
            part = self.part(np.int64(high), sizes)
            for first, last in self.slices():
                terms = np.concatenate(self.terms[first:last])
                item = np.repeat(np.arange(first, last), [len(t) for t in self.terms[first:last]])[used[terms]]
                terms = terms[used[terms]]
                if len(terms):
                    heavy = np.unpackbits(there[terms], axis=1, count=len(sizes)) * self.weight[terms][:, None]
                    starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
                    out[item[starts]] += np.add.reduceat(heavy, starts, axis=0) * (part - before)
            before = part
        return out


_INDEX = ("width int, ids array<long>, keys array<long>, sizes array<long>, bits binary, "
          "term int, df long, top long, n long, total long")
_FIELDS = pa.schema([("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                     ("bits", pa.binary()), ("term", pa.int32()), *[(c, pa.int64()) for c in ("df", "top", "n", "total")]])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def _counted(batches):
    """(batch, first, Counts) over runs of texts of about a megabyte."""
    for b in batches:
        texts = [t.as_py() for t in b["text"].cast(pa.binary())]
        for first, last in by_bytes(texts):
            yield b, first, Counts(texts[first:last])


def scanned(docs: DataFrame, items: Items, build: bool = True) -> DataFrame:
    """Blocks of signatures, and per task the counts of the items' terms and of all terms."""
    def task(batches):
        builder, n, total = Builder(), 0, 0
        df, top = np.zeros(len(items.hashes), np.int64), np.zeros(len(items.hashes), np.int64)
        for b, first, c in _counted(batches):
            n, total = n + int((c.n > 0).sum()), total + int(c.n.sum())
            hit, term = items.find(c.hash)
            df += np.bincount(term, minlength=len(df))
            np.maximum.at(top, term, c.tf[hit])
            for i in range(len(c.n) if build else 0):
                if c.n[i]:
                    s = slice(c.first[i], c.first[i + 1])
                    for block in builder.add(b["doc_id"][first + i].as_py(), b["key"][first + i].as_py(), int(c.n[i]), c.hash[s], c.tf[s]):
                        yield pa.RecordBatch.from_pylist([block], _FIELDS)
        for block in builder.rest():
            yield pa.RecordBatch.from_pylist([block], _FIELDS)
        found = [{"term": int(t), "df": int(df[t]), "top": int(top[t])} for t in np.flatnonzero(df)]
        yield pa.RecordBatch.from_pylist([{"n": n, "total": total}, *found], _FIELDS)

    return written(keyed(docs).mapInArrow(task, _INDEX))


def weighed(items: Items, scan: DataFrame) -> bool:
    """Weights from a scan's counts; False if no document holds a term."""
    n, total = scan.agg(F.sum("n"), F.sum("total")).first()
    if not n:
        return False
    df, top = np.zeros(len(items.hashes), np.int64), np.zeros(len(items.hashes), np.int64)
    for r in scan.where("term is not null").groupBy("term").agg(F.sum("df"), F.max("top")).collect():
        df[r[0]], top[r[0]] = r[1], r[2]
    items.weigh(df, top, n, total)
    return True


def probes(blocks: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, doc_id, key) of the documents with the highest bounds."""
    most = max(k, PROBES)

    def task(batches):
        best = np.zeros((len(items.ids), 0), np.int64)
        names = np.zeros((len(items.ids), 0, 2), object)
        for r in (r for b in batches for r in b.to_pylist()):
            bound = items.bounds(r["width"], np.array(r["sizes"], np.int64), r["bits"])
            mine = np.empty((len(r["ids"]), 2), object)
            mine[:, 0], mine[:, 1] = r["ids"], r["keys"]
            keep = np.argsort(-bound, axis=1, kind="stable")[:, :most]
            best = np.concatenate([best, np.take_along_axis(bound, keep, 1)], axis=1)
            names = np.concatenate([names, mine[keep]], axis=1)
            keep = np.argsort(-best, axis=1, kind="stable")[:, :most]
            best, names = np.take_along_axis(best, keep, 1), np.take_along_axis(names, keep[:, :, None], 1)
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array([names[i, p, 0] for i, p in zip(item, place)], pa.int64()),
             pa.array([names[i, p, 1] for i, p in zip(item, place)], pa.int64()), pa.array(best[item, place])], ["item", "doc_id", "key", "bound"])

    found = blocks.mapInArrow(task, "item int, doc_id long, key long, bound long")
    by = W.partitionBy("item").orderBy(F.col("bound").desc(), "doc_id", "key")
    return found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).select("item", "doc_id", "key")


def reaching(blocks: DataFrame, items: Items, goal: np.ndarray) -> DataFrame:
    """(item, doc_id, key) of every document whose bound reaches the item's goal."""
    def task(batches):
        for r in (r for b in batches for r in b.to_pylist()):
            item, doc = np.nonzero(items.bounds(r["width"], np.array(r["sizes"], np.int64), r["bits"]) >= goal[:, None])
            ids, keys = pa.array(r["ids"], pa.int64()), pa.array(r["keys"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids.take(pa.array(doc)), keys.take(pa.array(doc))],
                                             ["item", "doc_id", "key"])

    return blocks.mapInArrow(task, "item int, doc_id long, key long")


def scored(docs: DataFrame, pairs: DataFrame, items: Items, goal: np.ndarray) -> DataFrame:
    """(item, doc_id, score) of the pairs that reach the goal, from whole texts."""
    asked = pairs.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set("item").alias("items"))
    rows = keyed(docs).join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))

    def task(batches):
        tf = np.zeros(len(items.hashes), np.int64)
        for b, first, c in _counted(batches):
            out = []
            hit, term = items.find(c.hash)
            at = np.searchsorted(c.doc[hit], np.arange(len(c.n) + 1))
            for i, n in enumerate(c.n):
                mine = slice(at[i], at[i + 1])
                tf[term[mine]] = c.tf[hit[mine]]
                for j in b["items"][first + i].as_py():
                    t = items.terms[j]
                    score = int((items.weight[t] * items.part(tf[t], int(n))).sum())
                    if score >= goal[j]:
                        out.append((j, b["doc_id"][first + i].as_py(), score))
                tf[term[mine]] = 0
            yield pa.RecordBatch.from_arrays([pa.array([o[p] for o in out], t) for p, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
                                             ["item", "doc_id", "score"])

    return rows.select("doc_id", "text", "items").mapInArrow(task, "item int, doc_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for every item."""
    spark = docs.sparkSession
    texts = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts, index, out = max(1, -(-size // ITEM_BYTES)), None, None
    for part in range(parts):
        items = Items(texts.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect())
        if not items.ids:
            continue
        scan = scanned(docs, items, build=index is None)
        if index is None:
            index = scan.where("width is not null").select("width", "ids", "keys", "sizes", "bits")
        if not weighed(items, scan):
            break
        goal = np.ones(len(items.ids), np.int64)
        first = top(scored(docs, written(probes(index, items, k)), items, goal), k)
        for r in first.where(F.col("rank") == k).select("item", "score").collect():
            goal[r["item"]] = r["score"]
        best = top(scored(docs, written(reaching(index, items, goal)), items, goal), k)
        names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.union(best)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')" % (_UPPER, _UPPER.lower())

SQL = f"""
WITH
  docs AS (SELECT doc_id, row_number() OVER () AS place, {_SPLIT} AS terms FROM documents),
  corpus AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS total FROM docs WHERE len(terms) > 0),
  asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark)),
  tfs AS (
    SELECT place, doc_id, term, len(terms) AS n, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
  weights AS (
    SELECT term, floor(1000 * ln((2 * corpus.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, corpus GROUP BY term, corpus.n),
  scores AS (
    SELECT item_id, place, doc_id,
      sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * tfs.n * corpus.n) // corpus.total))))::BIGINT AS score
    FROM asked JOIN tfs ON asked.term = tfs.term JOIN weights ON weights.term = tfs.term, corpus GROUP BY ALL),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
