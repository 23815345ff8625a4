"""SimHash near-duplicates by a vantage-point tree over the fingerprints.

Tasks compute a 64-bit fingerprint per document from its 3-word shingles. Distinct
fingerprints, with the smallest id of each, are what is searched: copies are one row.
A tree of vantage points splits them by Hamming distance: near (distance <= radius) or
far. A fingerprint lives in one leaf. Two fingerprints within 2 bits have distances to a
vantage point that differ by 2 at most, so only a far one at radius + 1 or + 2 can have a
partner on the near side: it is sent there too, and below that point prunes by the same
bound. Every leaf with its visitors is one shard; inside, the tree goes on until blocks
are small and are compared in full. Shards give links of a spanning forest, not pairs.

The top of the tree is built on a sample of ``SAMPLE`` fingerprints and has ``LEAVES``
leaves at most; every fingerprint is placed and compared, whatever the sample.

Defined cases: null, empty and blank texts have fingerprint zero and link to each other
like any other; a null id is no component id unless its group has no other; repeated
rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stillwater.llm.common import components, written

SHINGLE = 3
SEED = 42
BITS = 2
SAMPLE = 20_000
LEAVES = 1024
LEAF_ROWS = 4096
BLOCK = 1024
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of one text; bit set if set in over half of the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    size = min(SHINGLE, len(words))
    first, last = starts[:len(words) - size + 1].tolist(), (ends[size - 1:] - 1).tolist()
    set_bits, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(first), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``fp`` of every row."""
    def made(batches):
        for b in batches:
            texts = b["text"].cast(pa.binary())
            fp = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], fp], [*keep, "fp"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(made, ", ".join([*fields, "fp long"]))


def distance(a, b):
    return np.bitwise_count(a ^ b)


def _split(values: np.ndarray, rng) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that send the fewest visitors across, of a few tried."""
    best = None
    for v in rng.choice(values, min(8, len(values)), replace=False):
        n = np.bincount(distance(values, v), minlength=68)
        near = np.cumsum(n)
        for r in range(64):
            if 0.25 * len(values) <= near[r] <= 0.75 * len(values):
                cost = (n[r + 1:r + BITS + 1].sum() / len(values), abs(near[r] / len(values) - 0.5))
                if best is None or cost < best[0]:
                    best = (cost, v, r)
    return best and best[1:]


def build(sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, leaves: int = LEAVES, seed: int = 1) -> list:
    """Nodes (vantage, radius, near, far); a child below zero is leaf number -child - 1."""
    rng, nodes, n_leaves = np.random.default_rng(seed), [], 0
    want = max(leaf_rows * len(sample) / max(rows, 1), len(sample) / leaves, 2)

    def grow(values):
        nonlocal n_leaves
        cut = _split(values, rng) if len(values) > want else None
        if cut is None:
            n_leaves += 1
            return -n_leaves
        here = len(nodes)
        nodes.append(None)
        d = distance(values, cut[0])
        nodes[here] = (cut[0], cut[1], grow(values[d <= cut[1]]), grow(values[d > cut[1]]))
        return here

    root = grow(sample)
    return nodes if root == 0 else []


def route(nodes: list, fps: np.ndarray) -> list[tuple[int, np.ndarray, bool]]:
    """(leaf, places in fps, whether they live there) for every leaf reached."""
    out, todo = [], [(0 if nodes else -1, np.arange(len(fps)), True)]
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if node < 0:
            out.append((-node - 1, rows, home))
            continue
        vantage, radius, near, far = nodes[node]
        d = distance(fps[rows], vantage)
        if home:
            todo += [(near, rows[d <= radius], True), (far, rows[d > radius], True),
                     (near, rows[(d > radius) & (d <= radius + BITS)], False)]
        else:
            todo += [(near, rows[d <= radius + BITS], False), (far, rows[d > radius - BITS], False)]
    return out


def linked(fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within reach of which one lives here."""
    root = np.arange(len(fps))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b, rng = [], [], np.random.default_rng(1)
    # Blocks of rows with whether a row lives in the block or is a visitor.
    stack = [(np.arange(len(fps)), home)]
    while stack:
        rows, lives = stack.pop()
        inside = rows[lives]
        if len(inside) > BLOCK:
            cut = _split(fps[rng.choice(inside, min(len(inside), 512), replace=False)], rng)
            if cut is not None:
                d = distance(fps[rows], cut[0]).astype(int)
                near = d <= cut[1] + BITS
                far = np.where(lives, d > cut[1], d > cut[1] - BITS)
                stack.append((rows[near], (lives & (d <= cut[1]))[near]))
                stack.append((rows[far], (lives & (d > cut[1]))[far]))
                continue
        for at in range(0, len(rows), BLOCK):
            for to in range(0, len(inside), BLOCK):
                x, y = np.nonzero(distance(fps[rows[at:at + BLOCK], None], fps[None, inside[to:to + BLOCK]]) <= BITS)
                x, y = rows[at:at + BLOCK][x], inside[to:to + BLOCK][y]
                other = x != y
                for i, j in zip(x[other].tolist(), y[other].tolist()):
                    p, q = find(i), find(j)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        a.append(i)
                        b.append(j)
    return np.array(a, int), np.array(b, int)


def links(fps: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, leaves: int = LEAVES) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within 2 bits that connect all such pairs."""
    n = fps.count()
    part = F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1_000_000))
    drawn = fps.select("fp").where(part < int(1_000_000 * min(1.0, sample / max(n, 1)))).toPandas()["fp"]
    nodes = build(np.sort(drawn.to_numpy(np.int64)).view(np.uint64), n, leaf_rows, leaves)

    def placed(batches):
        for b in batches:
            values = b["fp"].to_numpy(zero_copy_only=False).astype(np.int64)
            for leaf, rows, home in route(nodes, values.view(np.uint64)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), leaf)), pa.array(values[rows]), pa.array(np.full(len(rows), home))],
                    ["leaf", "fp", "home"])

    def shard(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["fp"])
        values = g["fp"].to_numpy(np.int64)
        a, b = linked(values.view(np.uint64), g["home"].to_numpy(bool))
        return pd.DataFrame({"a": values[a], "b": values[b]})

    return fps.select("fp").mapInArrow(placed, "leaf long, fp long, home boolean").groupBy("leaf").applyInPandas(
        shard, "a long, b long")


def groups(marked: DataFrame, near=links) -> DataFrame:
    """fp, component_id, from a written table with doc_id and fp; ``near`` gives the links of fps."""
    smallest = written(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    parts = components(near(smallest))
    named = smallest.join(parts, F.col("fp") == F.col("node"), "left").withColumn(
        "part", F.coalesce("component", "fp"))
    ids = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return named.select("fp", "part").join(ids, "part").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    marked = written(fingerprints(docs, "doc_id"))
    return marked.join(groups(marked), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: the smallest id's; of rows with that id, one."""
    marked = written(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("th__")), "doc_id", "th__"))
    return first_rows(docs, marked, groups(marked))


def first_rows(docs: DataFrame, marked: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for the groups ``found``; ``marked`` has doc_id, th__ and fp."""
    found = found.withColumnRenamed("component_id", "cid__")
    best = marked.join(found, "fp").where(F.col("doc_id").eqNullSafe(F.col("cid__"))).groupBy(
        F.coalesce(F.col("cid__").cast("string"), F.concat(F.lit("fp"), F.col("fp"))).alias("group")).agg(
        F.min(F.struct("doc_id", "th__")).alias("b"))
    best = written(best.select(F.coalesce(F.col("b.doc_id").cast("string"), F.lit("")).alias("kid__"),
                               F.col("b.th__").alias("kth__")).distinct())
    key, th = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")
    rows = docs.withColumns({"kid__": key, "kth__": th}).join(best, ["kid__", "kth__"], "left_semi")
    return rows.dropDuplicates(["kid__", "kth__"]).select(*docs.columns)
