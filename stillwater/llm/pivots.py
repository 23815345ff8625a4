"""Exact top-k search by inner product with a pivot table.

Components x become the integers floor(256 x); a score is their inner product. With M^2 the
largest squared norm of all candidates, a candidate v gets one more component sqrt(M^2 - v.v)
and a query q gets 0 there: their squared Euclidean distance is then q.q + M^2 - 2 q.v, so
the nearest candidates are those of the highest score. Distances d of all candidates to
``PIVOTS`` pivots are computed once and written. By the triangle inequality
max over p of |d(q, p) - d(v, p)| is the greatest lower bound on d(q, v) that the table
gives, hence an upper bound on the score.

Equal vectors are one class with its k + 1 smallest ids, which is all a list of k can show of
it. Classes lie in cells by nearest pivot and distance to it; the ranges of a cell's
distances bound all of it. Queries first visit the cells of the best bounds until those hold
``FIRST_ROWS`` classes, which gives each a score it must beat, and then every other cell whose bound
reaches that score. Within a part of a cell candidates are evaluated in the order of their bounds
until the next bound is below the k-th best score. Bounds get a margin far above rounding;
scores are exact integers, ties are never cut.

What is sent to all tasks is bounded: the pivots and the ranges of at most ``PIVOTS`` x
``RINGS`` cells. Cells are dealt in parts of about ``PART_ROWS`` classes and queries in blocks of
about ``BLOCK_ROWS``, so no task holds a whole cell or the whole query set.

Defined cases: vectors that are null or hold null or non-finite components take no part; a
shorter vector counts as filled up with zeros (an empty one scores 0 with all); a row that
repeats id and vector is a further candidate, but one query; a null id is no query and comes
last among ties; scores beyond 64 bits are cut to the nearest bound; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stillwater.llm.common import written

SCALE = 256
PIVOTS = 32
SAMPLE = 2048
RINGS = 64
PART_ROWS = 4096
BLOCK_ROWS = 4096
FIRST_ROWS = 256
CHUNK = 64
#: Share of q.q + M^2 by which bounds on scores are widened; rounding is below 1e-12 of it.
MARGIN = 1e-9
_LONG = 2**63 - 1


def integers(vectors: DataFrame, vec: str) -> DataFrame:
    """(id, v) of the rows that take part; v without zeros at its end."""
    x = F.col(vec).cast("array<double>")
    fit = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    rows = vectors.where(fit).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))
    used = F.array_max(F.transform("v", lambda c, i: F.when(c != 0, i + 1).otherwise(0)))
    return rows.select("id", F.slice("v", F.lit(1), F.coalesce(used, F.lit(0))).alias("v"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): distinct vectors and their k + 1 smallest ids."""
    first = W.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    least = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    return least.groupBy("v").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("ids"))


def filled(lists, dim: int) -> np.ndarray:
    """One row of ``dim`` integers per list, zeros behind."""
    out = np.zeros((len(lists), dim), np.int64)
    for i, v in enumerate(lists):
        out[i, :min(len(v), dim)] = v[:dim]
    return out


class Geometry:
    """The pivots and the distances to them of candidates (one more component) and of queries (0 there)."""

    def __init__(self, sample: list, dim: int, square: float):
        self.dim, self.square = dim, square
        self.pivots = np.zeros((0, dim + 1))
        points = self.lifted(filled(sample, dim))
        if len(points):
            chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
            while len(chosen) < PIVOTS and far.max() > 0:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
            self.pivots = points[chosen]

    def lifted(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))])

    def table(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        x = np.column_stack([v.astype(float), np.zeros(len(v))]) if query else self.lifted(v)
        return np.column_stack([np.linalg.norm(x - p, axis=1) for p in self.pivots])

    def best(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Upper bounds on the scores with q of what is at least so far from it."""
        whole = float((q.astype(float) ** 2).sum()) + self.square
        return (whole - least * least) / 2 + MARGIN * whole + 0.5


class Part:
    """Candidates that one task evaluates: vectors, distances to the pivots, one row per pivot, and ids."""

    def __init__(self, v: np.ndarray, table: np.ndarray, ids: list):
        self.v, self.table, self.ids = v, np.ascontiguousarray(table.T), ids
        self.counts = np.fromiter((len(i) for i in ids), np.int64, len(ids))
        self.place = {x.tobytes(): i for i, x in enumerate(v)}
        self.largest = float(np.abs(v.astype(float)).max(initial=0))

    def products(self, some: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products; in whole numbers of any size where 64 bits may not do, then cut."""
        if self.largest * float(np.abs(q.astype(float)).max(initial=0)) * max(len(q), 1) < 2.0**62:
            return self.v[some] @ q
        return np.array([min(max(s, -_LONG - 1), _LONG) for s in self.v[some].astype(object) @ q.astype(object)], np.int64)

    def bounds(self, q: dict, geometry: Geometry) -> tuple[np.ndarray, np.ndarray]:
        """(places, bounds) of the candidates whose bounds reach the goal; pivots by turns leave ever fewer."""
        some, least = np.arange(len(self.v)), np.zeros(len(self.v))
        for first in range(0, len(self.table), PIVOTS // 4):
            for p in range(first, min(first + PIVOTS // 4, len(self.table))):
                least = np.maximum(least, np.abs(self.table[p][some] - q["d"][p]))
            if q["goal"] is not None:
                stay = geometry.best(q["v"], least) >= q["goal"]
                some, least = some[stay], least[stay]
        return some, geometry.best(q["v"], least)


def kth(scores: np.ndarray, counts: np.ndarray, k: int) -> int | None:
    """The k-th highest score when each counts so often; None if there are fewer."""
    order = np.argsort(-scores, kind="stable")
    at = np.searchsorted(np.cumsum(counts[order]), k)
    return int(scores[order[at]]) if at < len(order) else None


def visit(q: dict, k: int, part: Part, geometry: Geometry) -> list[tuple]:
    """(score, id) of the k best of one part for one query, evaluated in the order of bounds."""
    own = part.place.get(q["v"].tobytes(), -1)
    mine, counts = list(part.ids[own]) if own >= 0 else [], part.counts
    if q["id"] in mine:
        mine.remove(q["id"])
        counts = counts.copy()
        counts[own] -= 1
    some, bound = part.bounds(q, geometry)
    order = np.argsort(-bound, kind="stable")
    some, bound, goal = some[order], bound[order], q["goal"]
    at, size, scores = 0, CHUNK, np.zeros(0, np.int64)
    while at < len(some) and (goal is None or bound[at] >= goal):
        scores = np.concatenate([scores, part.products(some[at:at + size], q["v"])])
        at, size = at + size, size * 2
        now = kth(scores, counts[some[:at]], k)
        goal = now if goal is None or now is not None and now > goal else goal
    seen = some[:at]
    if goal is not None:
        seen, scores = seen[scores >= goal], scores[scores >= goal]
    found = [(int(s), i) for c, s in zip(seen, scores) for i in (mine if c == own else part.ids[c])]
    return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]


class Cells:
    """Ranges of the distances to every pivot in each cell, and the parts it is dealt in."""

    def __init__(self, rows: list, pivots: int):
        self.key = [(r["near"], r["ring"]) for r in rows]
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.parts = -(-self.n // PART_ROWS)
        self.low = np.array([[r[f"low{i}"] for i in range(pivots)] for r in rows])
        self.high = np.array([[r[f"high{i}"] for i in range(pivots)] for r in rows])

    def bounds(self, q: np.ndarray, d: np.ndarray, geometry: Geometry) -> np.ndarray:
        return geometry.best(q, np.maximum(np.maximum(self.low - d, d - self.high), 0).max(1))

    def first(self, bounds: np.ndarray, seed: int) -> dict[int, int]:
        """cell -> part that a query visits first."""
        out, rows = {}, 0
        for c in np.argsort(-bounds, kind="stable"):
            out[int(c)] = seed % int(self.parts[c])
            rows += self.n[c] // self.parts[c]
            if rows >= FIRST_ROWS:
                break
        return out


def search(vectors: DataFrame, wanted: Column, k: int = 5, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every wanted row."""
    spark = vectors.sparkSession
    rows = integers(vectors, vec)
    base = written(classes(rows, k))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, dim, square = base.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    sample = [r["v"] for r in base.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()]
    geometry = Geometry(sample, dim or 0, square or 0.0)
    m = len(geometry.pivots)
    rings = max(1, min(RINGS, -(-n // (PIVOTS * PART_ROWS))))

    def measured(batches):
        for b in batches:
            d = geometry.table(filled(b["v"].to_pylist(), geometry.dim))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [b["v"], b["ids"], pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array(list(d), pa.list_(pa.float64()))],
                ["v", "ids", "near", "far", "d"])

    table = written(base.mapInArrow(measured, "v array<long>, ids array<long>, near int, far double, d array<double>"))
    widest = table.agg(F.max("far")).first()[0] or 1.0
    table = table.withColumn("ring", F.least(F.floor(F.col("far") / widest * rings), F.lit(rings - 1)).cast("int"))
    ranges = [f(F.col("d")[i]).alias(f"{name}{i}") for i in range(m) for f, name in ((F.min, "low"), (F.max, "high"))]
    cells = Cells(table.groupBy("near", "ring").agg(F.count("*").alias("n"), *ranges).orderBy("near", "ring").collect(), m)
    places = spark.createDataFrame([(*key, i, int(p)) for i, (key, p) in enumerate(zip(cells.key, cells.parts))],
                                   "near int, ring int, cell int, parts int")
    table = table.join(F.broadcast(places), ["near", "ring"]).select(
        "v", "ids", "d", "cell", F.expr("int(pmod(xxhash64(v), parts))").alias("part"))

    named = vectors.where(wanted).select("vec_id", vec)
    tag = F.md5(F.concat_ws(",", F.col("v").cast("array<string>")))
    queries = written(integers(named, vec).select("id", "v", tag.alias("tag")).where("id is not null").distinct())
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def routed(asked: DataFrame, again: bool) -> DataFrame:
        def task(batches):
            for b in batches:
                out = []
                for r in b.to_pylist():
                    q = filled([r["v"]], geometry.dim)
                    d = geometry.table(q, query=True)[0]
                    bounds = cells.bounds(q[0], d, geometry)
                    first = cells.first(bounds, int(r["tag"][:8], 16))
                    if again:
                        goal = r["goal"]
                        to = [(c, p) for c in range(len(bounds)) if goal is None or bounds[c] >= goal
                              for p in range(int(cells.parts[c])) if first.get(c) != p]
                    else:
                        to = list(first.items())
                    out.append({"id": r["id"], "tag": r["tag"], "v": r["v"], "d": list(d), "goal": r["goal"],
                                "to": [{"cell": c, "part": p} for c, p in to]})
                yield pa.RecordBatch.from_pylist(out, schema)

        schema = pa.schema([("id", pa.int64()), ("tag", pa.string()), ("v", pa.list_(pa.int64())), ("d", pa.list_(pa.float64())), ("goal", pa.int64()),
                            ("to", pa.list_(pa.struct([("cell", pa.int32()), ("part", pa.int32())])))])
        sent = asked.mapInArrow(task, "id long, tag string, v array<long>, d array<double>, goal long, to array<struct<cell:int,part:int>>")
        return sent.select("id", "tag", "v", "d", "goal", F.inline("to"), F.expr(f"int(pmod(crc32(tag), {blocks}))").alias("block"))

    def visited(asked: DataFrame) -> DataFrame:
        def group(keys, candidates: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(candidates) and len(some):
                v, d = filled(list(candidates["v"]), geometry.dim), np.vstack(list(candidates["d"]))
                ids = [[None if i is None or i != i else int(i) for i in x] for x in candidates["ids"]]
                part, asked_v = Part(v, d, ids), filled(list(some["v"]), geometry.dim)
                for i, (id_, tag_, qd, goal) in enumerate(zip(some["id"], some["tag"], some["d"], some["goal"])):
                    q = {"id": int(id_), "v": asked_v[i], "d": np.asarray(qd), "goal": None if pd.isna(goal) else int(goal)}
                    out += [(int(id_), tag_, s, f) for s, f in visit(q, k, part, geometry)]
            return pd.DataFrame(out, columns=["id", "tag", "score", "vec_id"]).astype({"id": "int64", "score": "int64", "vec_id": "Int64"})

        keys = ["cell", "part", "block"]
        asked = asked.withColumn("goal", F.col("goal").cast("string"))  # pandas would turn it into a float
        there = table.join(asked.select(*keys).distinct().toDF(*keys), ["cell", "part"])
        return there.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(group, "id long, tag string, score long, vec_id long")

    place = W.partitionBy("id", "tag").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    before = written(best(visited(written(routed(queries.withColumn("goal", F.lit(None).cast("long")), False)))))
    goals = before.where(F.col("rank") == k).select("id", "tag", F.col("score").alias("goal"))
    after = visited(written(routed(queries.join(goals, ["id", "tag"], "left"), True)))
    return best(before.drop("rank").unionByName(after)).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


SQL = """
WITH
  rows_ AS (
    SELECT vec_id, [floor(256 * c::DOUBLE)::BIGINT for c in embedding] AS v, row_number() OVER () AS place FROM embeddings
    WHERE embedding IS NOT NULL AND len([1 for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
  scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([q.v[i] * c.v[i] for i in range(1, least(len(q.v), len(c.v)) + 1)]), 0)::BIGINT AS score
    FROM rows_ q JOIN rows_ c ON q.place <> c.place WHERE q.vec_id % 50 = 0),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
