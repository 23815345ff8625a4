"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints within 2 bits, found by the vantage-point tree of ``simhash``, are the first
candidates; an exact comparison follows. No Hamming radius covers a similarity for certain, so what
they leave is found by the shingles themselves. Two sets with similarity t share a member among the first n - ceil(t n) + 1
of either, in any order that all sets use, and what follows the first shared one must be
long enough in both. The order is by frequency in a sample of documents and then by hash, so
that a common line is hardly ever what two texts meet by. Equal sets are one row.

Texts that meet at a shingle are, with those candidates, first compared with the next one in size and with the next
one in an order of that shingle's own. Only pairs whose ends those links leave in different
groups are listed in full. Pairs pass a bound on the difference of the sets (counts of their
hashes in 256 cells) and then an exact comparison of the shingles themselves.

Defined cases: a text of fewer than five words is one shingle; null, empty and blank texts
are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from stillwater.llm import simhash
from stillwater.llm.common import components, discard, written

WORDS = 5
PERCENT = 80
SEED = 42
CELLS = 256
#: Documents whose shingles tell the frequent ones, those in SEEN of them or more.
SAMPLE = 4_000
SEEN = 3


def shingles(text: bytes | None, words: int = WORDS) -> set[bytes]:
    """The distinct runs of ``words`` words; of a shorter text all its words."""
    found = (text or b"").lower().split()
    if not found:
        return set()
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    size = min(words, len(found))
    return {line[a:b] for a, b in zip(starts[:len(found) - size + 1].tolist(), (ends[size - 1:] - 1).tolist())}


def hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the shingles."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles(text, words)], np.uint64))


def similar(a: set, b: set, percent: int = PERCENT) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def frequent(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles of several sampled documents, and of how many."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    drawn = docs.select("text").where(part < int(1_000_000 * min(1.0, sample / max(docs.count(), 1)))).distinct()

    def made(batches):
        for b in batches:
            for t in b["text"].cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(t.as_py(), words).view(np.int64))], ["h"])

    counted = drawn.mapInArrow(made, "h long").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= SEEN)
    got = counted.toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["c"].to_numpy(np.int64)[order]


def marks(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], *keep: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The kept columns, key ``fp``, size, cells and first shingles of the set of every row, and its SimHash."""
    def one(text):
        h = hashes(text, words)
        if not len(h):
            return 0, 0, bytes(CELLS), h, 0
        often = np.zeros(len(h), np.int64)
        if len(common[0]):
            at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
            often = np.where(common[0][at] == h, common[1][at], 0)
        first = h[np.argsort(often, kind="stable")][:len(h) * (100 - percent) // 100 + 1]
        cells = np.minimum(np.bincount((h >> np.uint64(56)).astype(int), minlength=CELLS), 255).astype(np.uint8)
        return xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h), cells.tobytes(), first, simhash.fingerprint(text)

    def made(batches):
        for b in batches:
            got = [one(t.as_py()) for t in b["text"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*[b[c] for c in keep], pa.array(np.array([g[0] for g in got], np.uint64).view(np.int64)),
                 pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary()),
                 pa.array([g[3].view(np.int64) for g in got], pa.list_(pa.int64())), pa.array([g[4] for g in got], pa.int64())],
                [*keep, "fp", "n", "cells", "first", "sim"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(
        made, ", ".join([*fields, "fp long, n long, cells binary, first array<long>, sim long"]))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar, written."""
    def possible(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("ca", "cb"))
            least = np.abs(x - y).sum(1, dtype=np.int64)
            n = b["na"].to_numpy() + b["nb"].to_numpy()
            yield b.select(["a", "b"]).filter(pa.array((100 + percent) * least <= (100 - percent) * n))

    def compared(batches):
        for b in batches:
            x, y = b["ta"].cast(pa.binary()), b["tb"].cast(pa.binary())
            held, of, keep = None, None, []
            for i in range(b.num_rows):
                if b["b"][i] != of:
                    held, of = shingles(y[i].as_py(), words), b["b"][i]
                keep.append(similar(shingles(x[i].as_py(), words), held, percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: sets.select(F.col("fp").alias(s), F.col("n").alias(f"n{s}"), F.col("cells").alias(f"c{s}"))
    text = lambda s: texts.select(F.col("fp").alias(s), F.col("text").alias(f"t{s}"))
    left = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    left = written(left.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(possible, "a long, b long"))
    ends = left.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    used = sets.join(ends, "fp", "left_semi").select("fp", "row.doc_id", "row.th__")
    same = lambda c: docs[c].eqNullSafe(used[c])
    texts = written(docs.join(used, same("doc_id") & same("th__")).select("fp", "text").dropDuplicates(["fp"]))
    left = left.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb")
    found = written(left.mapInArrow(compared, "a long, b long"))
    discard(texts)
    return found


def hashed_alike(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose SimHash fingerprints the vantage-point tree links, equal ones included."""
    named = written(sets.groupBy("sim").agg(F.min("fp").alias("least")))
    same = sets.join(named, "sim").where("fp != least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    end = lambda s: named.select(F.col("sim").alias(s), F.col("least").alias(f"k{s}"))
    near = simhash.links(named.select(F.col("sim").alias("fp"))).join(end("a"), "a").join(end("b"), "b")
    return written(same.union(near.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))))


def links(docs: DataFrame, marked: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of keys that connect all pairs of similar sets; the table ``marked`` is used up."""
    wide = written(marked.where("n > 0").groupBy("fp").agg(
        F.min(F.struct("doc_id", "th__")).alias("row"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("first").alias("first"), F.first("sim").alias("sim")))
    discard(marked)
    alike = hashed_alike(wide.select("fp", "sim"))
    met = wide.select("fp", "n", F.posexplode("first").alias("at", "h"))
    run = W.partitionBy("h").orderBy("n", "fp")
    met = met.select("h", "fp", "n", (F.col("n") - F.col("at")).alias("rest"), F.lag(F.struct("fp", "n")).over(run).alias("p"), F.lead("fp").over(run).alias("next"))
    near_size = lambda p: F.least(p, "n") * 100 >= F.greatest(p, "n") * percent
    mixed = W.partitionBy("h").orderBy(F.xxhash64("h", "fp"), "fp")
    met = met.where("p is not null or next is not null").withColumn("q", F.lag(F.struct("fp", "n")).over(mixed))
    met = written(met.select("h", "fp", "n", "rest", F.array_compact(F.array(
        F.when(near_size("p.n"), F.col("p.fp")), F.when(near_size("q.n"), F.col("q.fp")))).alias("beside")))
    sets = written(wide.drop("first", "sim").join(met.select("fp").distinct(), "fp", "left_semi"))
    discard(wide)
    beside = met.select("fp", F.explode("beside").alias("other")).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    near = verified(alike.union(beside), sets, docs, words, percent)
    parts = components(near)
    met = met.join(parts, F.col("fp") == F.col("node"), "left").select("h", "fp", "n", "rest", F.coalesce("component", "fp").alias("part"))
    spread = met.groupBy("h").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("h")
    met = written(met.join(spread, "h", "left_semi"))
    a, b = met.alias("a"), met.alias("b")
    other = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.part") != F.col("b.part"))
                   & (F.struct("a.n", "a.fp") < F.struct("b.n", "b.fp")) & (F.col("a.n") * 100 >= F.col("b.n") * percent)
                   & (F.least("a.rest", "b.rest") * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent))
    far = verified(other.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")), sets, docs, words, percent)
    return near.union(far)


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group: the smallest id's; of rows with that id, one."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th__"))
    wide = written(marks(keyed, frequent(keyed, words=words), "doc_id", "th__", words=words, percent=percent))
    marked = written(wide.select("doc_id", "th__", "fp"))
    found = simhash.groups(marked, lambda _: links(keyed, wide, words, percent))
    return simhash.first_rows(docs, marked, found)
