"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - s) with ordered thresholds t_1 < t_2 < ... and one score s
for all of them, the mean weight of a document's hashed features: words, word shapes
(runs of letter case, digits and punctuation), and whether a word repeats the one before.
From it come the expected grade and the probability of the best grade, which selection uses.

Fitting takes a hash share of the labelled rows worth ``TRAIN_DOCS`` documents, as sparse
counts made by the tasks; every document is scored whole. The mean is drawn towards zero
by ``SHRINK`` features, so very short texts lean on the thresholds alone.

Defined cases: null and empty texts have score 0, the thresholds decide; ids may be null
or repeated; null grades are no labels; without labels all grades are null and all
documents are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stillwater.llm.textwords import Words, by_bytes

TRAIN_DOCS = 6000
DIMENSIONS = 2**16
SHRINK = 4.0
EPOCHS = 12
KEEP_AT = 0.5


def _shapes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[48:58], table[65:91], table[97:123], table[128:] = ord("0"), ord("A"), ord("a"), ord("a")
    return table


SHAPE = _shapes()


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a batch, text after text, and each text's first place (one more at the end)."""
    w = Words(texts)
    dims = np.uint64(DIMENSIONS)
    plain = w.hashes()
    shape = SHAPE[w.raw]
    # Shape by its three last and two first symbols, and whether the word is long.
    last = lambda k: np.where(w.end - k >= w.start, shape[np.maximum(w.end - k, 0)], 0).astype(np.uint64)
    first = lambda k: np.where(w.start + k < w.end, shape[np.minimum(w.start + k, len(shape) - 1)], 0).astype(np.uint64)
    form = np.zeros(len(plain), np.uint64)
    for part in (last(1), last(2), last(3), first(0), first(1), (w.end - w.start > 24).astype(np.uint64)):
        form = form * np.uint64(257) + part
    again = np.zeros(len(plain), bool)
    again[1:] = (plain[1:] == plain[:-1]) & (w.doc[1:] == w.doc[:-1])
    form = (form * np.uint64(2) + again) * np.uint64(0x9E3779B97F4A7C15)
    numbers = np.empty(2 * len(plain), np.int64)
    numbers[0::2] = (plain % (dims // np.uint64(2))).astype(np.int64)
    numbers[1::2] = ((form >> np.uint64(40)) % (dims // np.uint64(2)) + dims // np.uint64(2)).astype(np.int64)
    return numbers, 2 * w.first


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, idx, val = _bytes(b["text"]), [], []
        for lo, hi in by_bytes(texts):
            numbers, first = features(texts[lo:hi])
            for i in range(hi - lo):
                u, n = np.unique(numbers[first[i]:first[i + 1]], return_counts=True)
                idx.append(u.astype(np.int32))
                val.append((n / (n.sum() + SHRINK)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [b["grade"], pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["grade", "idx", "val"])


def _scores(texts: list[bytes | None], w: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for lo, hi in by_bytes(texts):
        numbers, first = features(texts[lo:hi])
        run = np.concatenate([[0.0], np.cumsum(w[numbers], dtype=np.float64)])
        out.append((run[first[1:]] - run[first[:-1]]) / (np.diff(first) + SHRINK))
    return np.concatenate(out)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", train_docs: int = TRAIN_DOCS,
        epochs: int = EPOCHS, seed: int = 3) -> dict | None:
    """weights, thresholds and grades from a bounded sample of labelled rows; None without any."""
    graded = labels.select(F.col("doc_id").alias("id__"), F.col(grade).cast("long").alias("grade")).where(
        "grade is not null and id__ is not null")
    n = graded.count()
    if not n:
        return None
    part = F.pmod(F.xxhash64(F.col("id__").cast("string")), F.lit(1_000_000))
    drawn = graded.where(part < int(1_000_000 * min(1.0, train_docs / n)))
    # The sample has a proven bound, so its ids go to the documents.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id__")).select("grade", "text")
    got = rows.mapInArrow(_counts, "grade long, idx array<int>, val array<float>").toArrow()
    if not got.num_rows:
        return None
    y = got["grade"].to_numpy()
    grades = np.unique(y)
    rank = np.searchsorted(grades, y)
    idx, val = ([np.asarray(v, t) for v in got[c].to_pylist()] for c, t in (("idx", np.int64), ("val", np.float32)))
    order = np.lexsort(([v.sum() for v in idx], rank))  # rows come in any order from the tasks
    w = np.zeros(DIMENSIONS)
    # Thresholds start at the observed shares: t_k = logit P(grade <= k).
    share = np.clip([(rank <= k).mean() for k in range(len(grades) - 1)], 0.01, 0.99)
    t = np.log(share / (1 - share))
    rng, g2, gt2 = np.random.default_rng(seed), np.full(DIMENSIONS, 1e-8), np.full(len(t), 1e-8)
    for _ in range(epochs):
        rng.shuffle(order)
        for part in np.array_split(order, max(1, len(order) // 32)):
            i, v = np.concatenate([idx[r] for r in part] or [[]]).astype(np.int64), np.concatenate([val[r] for r in part])
            row = np.repeat(np.arange(len(part)), [len(idx[r]) for r in part])
            s = np.bincount(row, w[i] * v, len(part))
            # Bounds of the observed grade: sigmoid(hi - s) - sigmoid(lo - s).
            edge = np.concatenate([[-30.0], t, [30.0]])
            lo, hi = sigmoid(edge[rank[part]] - s), sigmoid(edge[rank[part] + 1] - s)
            p = np.maximum(hi - lo, 1e-9)
            dlo, dhi = lo * (1 - lo) / p, hi * (1 - hi) / p
            ds = dhi - dlo
            grad = np.bincount(i, ds[row] * v, DIMENSIONS)
            gt = np.bincount(rank[part], dlo, len(t) + 2)[1:len(t) + 1] - np.bincount(rank[part], dhi, len(t) + 1)[:len(t)]
            used = grad != 0
            g2[used] += grad[used] ** 2
            w[used] -= 0.5 * grad[used] / np.sqrt(g2[used])
            gt2 += gt ** 2
            t = np.sort(t - 0.05 * gt / np.sqrt(gt2))
    return {"weights": w.astype(np.float32), "thresholds": t, "grades": grades.astype(float)}


def score(docs: DataFrame, model: dict | None, *keep: str) -> DataFrame:
    """doc_id, score, expected (grade), p_best (probability of the best grade), and columns to keep."""
    keep = tuple(c for c in keep if c != "doc_id")
    out = docs.select("doc_id", *([] if "text" in keep else ["text"]), *keep)
    if model is None:
        return out.select("doc_id", *[F.lit(None).cast("double").alias(c) for c in ("score", "expected", "p_best")], *keep)
    w, t, grades = model["weights"], model["thresholds"], model["grades"]

    def scored(batches):
        for b in batches:
            s = _scores(_bytes(b["text"]), w)
            below = sigmoid(t[None, :] - s[:, None])
            p = np.diff(np.column_stack([np.zeros(len(s)), below, np.ones(len(s))]), axis=1)
            columns = [b["doc_id"], pa.array(s), pa.array(p @ grades), pa.array(p[:, -1]), *[b[c] for c in keep]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "expected", "p_best", *keep])

    fields = [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "score double", "expected double", "p_best double"]
    fields += [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return out.mapInArrow(scored, ", ".join(fields))


def kept(p_best: str = "p_best", at: float = KEEP_AT) -> F.Column:
    """Selection by tail probability; documents without a model are kept."""
    return F.coalesce(F.col(p_best) >= at, F.lit(True))
