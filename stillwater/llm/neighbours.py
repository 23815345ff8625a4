"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors become one node with a count. Nodes go to overlapping shards, those of the
``OVERLAP`` nearest of the centroids of a sample. Every shard builds a graph by batched
insertion: a greedy search from the medoid and the nearest of the batch give candidates, robust pruning keeps those
that no kept one covers, and reverse edges are pruned alike. Adjacency lists of a node
are united over its shards. Then every node is searched in all its shards: greedily from
the medoid to its surroundings, and on from every node in range over the united lists
while new ones turn up. Links are verified in double precision, counted in the first
shard that both ends share, and never listed as pairs.

A group that holds a sizeable share of all rows would fill a shard. Leaders of such groups
show in the sample; all nodes within half the link angle of a leader are linked to each
other for certain and form a ball. Balls are counted as a whole; links between a ball and
nodes around it (up to one and a half link angles from the leader) are compared in parts
of ``PART`` members, which are shared out over the tasks.

``audit`` measures recall on the vectors whose id is divisible by 20 against all rows.

Vectors of different lengths have no cosine and never link. A length with more nodes than
a shard is searched by itself; of the others each is one shard, and all go in one pass.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components
link with nothing and are their own component; repeated rows are vectors of their own;
rows without an id count as vectors for others, a group of such rows alone has no
component id; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stillwater.llm.common import components, written

LINK = 0.95
OVERLAP = 3
SAMPLE = 8192
SHARD_ROWS = 1500
SHARDS = 1024
BALL_SAMPLE = 64  # points of the sample that make a ball
PART = 4096
DEGREE, BEAM, ALPHA, MATES = 16, 24, 1.2, 4


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def centroids(sample: np.ndarray, k: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def leaders(sample: np.ndarray, link: float = LINK, least: int = BALL_SAMPLE) -> np.ndarray:
    """Points of the sample with ``least`` others within half the link angle, each taken once."""
    near, free, out = np.cos(np.arccos(link) / 2 - 1e-7), np.ones(len(sample), bool), []
    for i in range(len(sample)):
        if free[i]:
            ball = free & (sample @ sample[i] >= near)
            if ball.sum() >= least:
                out.append(i)
                free &= ~ball
    return sample[out]


def search(x: np.ndarray, nbr: np.ndarray, medoid: int, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The ``beam`` nearest nodes met by a greedy search for every query, all in step; -1 where fewer."""
    n = len(q)
    ids, dist, seen = np.full((n, beam), -1), np.full((n, beam), np.inf, np.float32), np.ones((n, beam), bool)
    ids[:, 0], dist[:, 0], seen[:, 0] = medoid, 1 - q @ x[medoid], False
    live = np.arange(n)
    while len(live):
        at = np.argmin(seen[live], axis=1)
        open_ = ~seen[live, at]
        live, at = live[open_], at[open_]
        if not len(live):
            break
        seen[live, at] = True
        new = nbr[ids[live, at]]
        ok = (new >= 0) & ~(new[:, :, None] == ids[live][:, None, :]).any(axis=2)
        d = np.where(ok, 1 - np.einsum("qrd,qd->qr", x[new], q[live]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        take = lambda a, b: np.take_along_axis(np.concatenate([a[live], b], axis=1), best, axis=1)
        ids[live], seen[live], dist[live] = take(ids, np.where(ok, new, -1)), take(seen, ~ok), np.take_along_axis(all_d, best, axis=1)
    return ids


def prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: the nearest candidate stays and covers those alpha times nearer to it than to the point."""
    cand = np.sort(cand, axis=1)
    ok = (cand >= 0) & (cand != points[:, None])
    ok[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    d = np.where(ok, 1 - np.einsum("pcd,pd->pc", x[cand], x[points]), np.inf)
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(min(degree, cand.shape[1])):
        at = np.argmin(d, axis=1)
        some = np.isfinite(d[rows, at])
        if not some.any():
            break
        chosen = np.where(some, cand[rows, at], -1)
        out[:, k] = chosen
        between = 1 - np.einsum("pcd,pd->pc", x[cand], x[chosen])
        covered = (alpha * alpha * between <= d) & some[:, None]
        d[covered] = np.inf
        d[rows, at] = np.inf
    return out


def build(x: np.ndarray, seed: int = 1) -> tuple[np.ndarray, int]:
    """Adjacency (node, DEGREE), -1 where free, and the medoid."""
    m, rng = len(x), np.random.default_rng(seed)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    order = np.concatenate([[medoid], rng.permutation(np.delete(np.arange(m), medoid))]).astype(int)
    nbr, done = np.full((m, DEGREE), -1), 1
    while done < m:
        batch = order[done:done + max(1, min(done // 4, 256))]
        cand = np.tile(order[:done], (len(batch), 1)) if done <= BEAM else search(x, nbr, medoid, x[batch])
        if len(batch) > 1:  # nodes that are put in together would not find each other
            alike = x[batch] @ x[batch].T
            np.fill_diagonal(alike, -np.inf)
            mates = np.argsort(-alike, axis=1, kind="stable")[:, :min(MATES, len(batch) - 1)]
            cand = np.concatenate([cand, batch[mates]], axis=1)
        nbr[batch] = prune(x, batch, cand)
        # Reverse edges: the old list of every target with up to DEGREE new ones, pruned again.
        source, target = np.repeat(batch, DEGREE), nbr[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        to, first = np.unique(target, return_index=True)
        nth = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        added = np.full((len(to), DEGREE), -1)
        fits = nth < DEGREE
        added[np.searchsorted(to, target[fits]), nth[fits]] = source[fits]
        nbr[to] = prune(x, to, np.concatenate([nbr[to], added], axis=1))
        done += len(batch)
    return nbr, medoid


def in_range(x: np.ndarray, nbr: list[np.ndarray], medoid: int, exact: np.ndarray, link: float = LINK):
    """(query, node) pairs found in range, for every node as a query; yielded in blocks of queries."""
    flat, size = np.concatenate([*nbr, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(v) for v in nbr])
    begin = np.cumsum(size) - size
    padded = np.full((len(x), max(int(size.max(initial=1)), 1)), -1)
    for i, v in enumerate(nbr):
        padded[i, :len(v)] = v
    m = len(x)
    for lo in range(0, m, 512):
        q = np.arange(lo, min(lo + 512, m))
        met = search(x, padded, medoid, x[q])
        pair = np.unique(np.concatenate([(q[:, None] * m + met)[met >= 0], q * m + q]))
        known, tried = np.zeros(0, np.int64), pair
        while len(pair):
            a, b = pair // m, pair % m
            hit = np.concatenate([
                pair[i:i + 65536][np.einsum("nd,nd->n", exact[a[i:i + 65536]], exact[b[i:i + 65536]]) >= link]
                for i in range(0, len(pair), 65536)])
            known = np.union1d(known, hit)
            a, b = hit // m, hit % m
            step = np.repeat(a, size[b]) * m + flat[np.repeat(begin[b], size[b]) + np.arange(size[b].sum()) - np.repeat(
                np.cumsum(size[b]) - size[b], size[b])]
            pair = np.setdiff1d(step, tried)
            tried = np.union1d(tried, pair)
        a, b = known // m, known % m
        yield a[a != b], b[a != b]


def _root(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, by label propagation with shortcuts."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def nodes(vectors: DataFrame) -> DataFrame:
    """node, embedding, n (rows that have it), id (their smallest vec_id) of every vector that can link."""
    good = vectors.select("vec_id", "embedding").where(
        "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf')) "
        "and exists(embedding, x -> x <> 0)")
    out = good.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("id"))
    return written(out.withColumn("node", F.xxhash64("embedding")))


def links(found: DataFrame, link: float = LINK, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(node, others): rows of other nodes linked; (a, b): edges that connect all linked nodes."""
    length = F.size("embedding")
    sizes = found.groupBy(length.alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "d")
    large = [r["d"] for r in sizes.where(F.col("m") > SHARD_ROWS).collect()] or [r["d"] for r in sizes.take(1)]
    got = [_links_of_length(found.where(length == d), link, sample) for d in large]
    rest = found.where(~length.isin(large)) if large else found
    if not got or sizes.count() > len(large):
        searched = _searched(rest.select("node", "n", "embedding", F.array(length).alias("shards"), length.alias("shard")), link)
        got.append((searched.groupBy("node").agg(F.sum("others").alias("others")),
                    searched.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    counts, edges = zip(*got)
    return reduce(DataFrame.unionByName, counts), reduce(DataFrame.unionByName, edges)


def _links_of_length(found: DataFrame, link: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """``links`` of vectors of one length."""
    n = found.count()
    part = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1_000_000))
    drawn = found.where(part < int(1_000_000 * min(1.0, sample / max(n, 1)))).orderBy("node").select("embedding").toPandas()
    s = unit(_matrix(drawn["embedding"])) if len(drawn) else np.zeros((0, 1))
    heads = leaders(s, link) if len(s) else s
    k = min(max(1, n // SHARD_ROWS), SHARDS, max(len(s), 1))
    centre = centroids(s, k) if len(s) else np.zeros((1, 1))
    angle = np.arccos(link)
    near, around = np.cos(angle / 2 - 1e-7), np.cos(min(1.5 * angle + 1e-7, np.pi))

    def place(batches):
        for b in batches:
            x = unit(_matrix(b["embedding"].to_pylist()))
            top = np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :OVERLAP]
            to_head = x @ heads.T if len(heads) else np.full((len(x), 1), -1.0)
            ball = np.where(to_head.max(axis=1) >= near, to_head.argmax(axis=1), -1)
            shell = [np.flatnonzero((to_head[i] >= around) & (np.arange(to_head.shape[1]) != ball[i])).tolist() if len(heads) else []
                     for i in range(len(x))]
            yield pa.RecordBatch.from_arrays(
                [b["node"], b["n"], b["embedding"], pa.array(top.tolist(), pa.list_(pa.int32())), pa.array(ball.astype(np.int32)),
                 pa.array(shell, pa.list_(pa.int32()))], ["node", "n", "embedding", "shards", "ball", "shell"])

    kind = found.schema["embedding"].dataType.simpleString()
    fields = f"node long, n long, embedding {kind}, shards array<int>, ball int, shell array<int>"
    placed = written(found.select("node", "n", "embedding").mapInArrow(place, fields))
    searched = _searched(placed.where("ball < 0").select("node", "n", "embedding", "shards", F.explode("shards").alias("shard")), link)
    counts = searched.select("node", "others")
    edges = searched.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not len(heads):
        return counts.groupBy("node").agg(F.sum("others").alias("others")), edges

    # One row per ball; its members are linked to each other.
    members = placed.where("ball >= 0")
    balls = written(members.groupBy("ball").agg(F.sum("n").alias("rows"), F.count("*").alias("m"), F.min("node").alias("b")))
    inside = members.join(F.broadcast(balls), "ball")
    counts = counts.union(inside.select("node", F.col("rows") - F.col("n")))
    edges = edges.union(inside.select(F.col("node").alias("a"), "b"))
    shells = placed.select("node", "n", "embedding", F.explode("shell").alias("ball"), (F.col("ball") < 0).alias("free"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / PART)).cast("int")
    shells = shells.join(F.broadcast(balls), "ball").select(
        "ball", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", "n", "embedding", "b",
        F.lit(False).alias("member"), "free")
    near_shell = shells.select("ball").distinct()
    core = inside.join(F.broadcast(near_shell), "ball", "left_semi").select(
        "ball", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "n", "embedding", "b",
        F.lit(True).alias("member"), F.lit(False).alias("free"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        x, n, member = unit(_matrix(g["embedding"])), g["n"].to_numpy(), g["member"].to_numpy(bool)
        others, touched = np.zeros(len(g), np.int64), np.zeros(len(g), bool)
        inner, outer = np.flatnonzero(member), np.flatnonzero(~member)
        for i in range(0, len(inner), 1024):
            for j in range(0, len(outer), 1024):
                a, b = inner[i:i + 1024], outer[j:j + 1024]
                hit = x[a] @ x[b].T >= link
                others[a] += hit @ n[b]
                others[b] += hit.T @ n[a]
                touched[b] |= hit.any(axis=0)
        # Members of another ball are counted there.
        some = member | g["free"].to_numpy(bool)
        return pd.DataFrame({"node": g["node"], "others": np.where(some, others, 0),
                             "b": g["b"].astype("Int64").where(pd.Series(touched, g.index))})

    crossed = written(core.union(shells).groupBy("ball", "part").applyInPandas(compare, "node long, others long, b long"))
    counts = counts.union(crossed.select("node", "others"))
    edges = edges.union(crossed.where("b is not null").select(F.col("node").alias("a"), "b"))
    return counts.groupBy("node").agg(F.sum("others").alias("others")), edges


def _searched(apart: DataFrame, link: float) -> DataFrame:
    """node, others, root of every shard: graphs grown, united and searched."""

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        ids = g["node"].to_numpy()
        nbr, _ = build(unit(_matrix(g["embedding"])).astype(np.float32))
        return pd.DataFrame({"node": ids, "nbr": [ids[v[v >= 0]] for v in nbr]})

    lists = apart.groupBy("shard").applyInPandas(grow, "node long, nbr array<long>").groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list("nbr"))).alias("nbr"))

    def look(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        ids, exact = g["node"].to_numpy(), unit(_matrix(g["embedding"]))
        x, n, mine = exact.astype(np.float32), g["n"].to_numpy(), key[0]
        nbr = []
        for v in g["nbr"]:
            at = np.searchsorted(ids, v)
            at = np.minimum(at, len(ids) - 1)
            nbr.append(at[ids[at] == v])
        shards = np.sort(np.array(g["shards"].tolist()), axis=1)
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        others, a_all, b_all = np.zeros(len(ids), np.int64), [], []
        for a, b in in_range(x, nbr, medoid, exact, link):
            shared = (shards[a][:, :, None] == shards[b][:, None, :]).any(axis=2)
            first = shards[a][np.arange(len(a)), shared.argmax(axis=1)] == mine
            np.add.at(others, a[first], n[b[first]])
            forest = _root(len(ids), a, b)
            a_all.append(np.flatnonzero(forest != np.arange(len(ids))))
            b_all.append(forest[a_all[-1]])
        a, b = (np.concatenate([np.zeros(0, int), *v]) for v in (a_all, b_all))
        root = _root(len(ids), a, b)
        return pd.DataFrame({"node": ids, "others": others, "root": ids[root]})

    return written(apart.join(lists, "node").groupBy("shard").applyInPandas(look, "node long, others long, root long"))


def near_duplicates(vectors: DataFrame, link: float = LINK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    found = nodes(vectors)
    counts, edges = links(found, link, sample)
    parts = components(edges)
    named = found.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    known = named.join(ids, "component").join(counts, "node", "left").select(
        F.col("embedding").alias("e"), "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    rows = vectors.select("vec_id", "embedding")
    return rows.join(written(known), F.col("embedding") == F.col("e"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit(vectors: DataFrame, result: DataFrame, link: float = LINK, every: int = 20) -> DataFrame:
    """found, links: link counts of the vectors whose id is divisible by ``every``, against all rows in blocks."""
    found = nodes(vectors)
    query = written(vectors.where(F.col("vec_id") % every == 0).join(found.select("embedding", "node"), "embedding").select(
        "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, found.count() // 20_000))).alias("block")))
    blocks = query.select("block", F.size("embedding").alias("length")).distinct()
    rows = found.join(F.broadcast(blocks), F.size("embedding") == F.col("length")).select("block", "n", "embedding", F.lit(None).cast("long").alias("vec_id"))

    def block(g: pd.DataFrame) -> pd.DataFrame:
        q, r = g[g["vec_id"].notna()], g[g["vec_id"].isna()]
        a, b, n = unit(_matrix(q["embedding"])), unit(_matrix(r["embedding"])), r["n"].to_numpy()
        hits = [((a[i:i + 256] @ b.T) >= link) @ n for i in range(0, len(a), 256)]
        return pd.DataFrame({"vec_id": q["vec_id"].astype("int64"), "links": np.concatenate([np.zeros(0), *hits]).astype(np.int64) - 1})

    both = rows.union(query.select("block", F.lit(0).cast("long"), "embedding", "vec_id"))
    true = both.groupBy("block", F.size("embedding")).applyInPandas(block, "vec_id long, links long")
    return true.join(result.select("vec_id", "n_links"), "vec_id").agg(
        F.sum(F.least("n_links", "links")).alias("found"), F.sum("links").alias("links"))
