"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors: an embedding of its hash (one for all words that few
training documents hold), and the mean embedding of its character trigrams. Two gated recurrent layers read a window of words, one from each
side; attention pools their states and a linear layer gives the window's logit. A
document's score is the calibrated soft maximum (log of summed exponentials) of the
logits of all its overlapping windows, so whole texts of any length are read; it is also
what training fits, so that the network finds out which windows make a document toxic.

The network is written in numpy and trained on a bounded sample: windows of
``TRAIN_DOCS`` labelled documents of at most ``TRAIN_WORDS`` words. A quarter of the
sample is left out of the training and calibrates the score. Scoring reads every word of
every document, in blocks of ``BLOCK`` windows.

Defined cases: null, empty and blank texts are a window without words; ids may be null or
repeated; null labels are no labels; without both classes every score is 0; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stillwater.llm.textwords import Words, by_bytes, mixed, ranges

WINDOW, STRIDE = 48, 36
WORD_ROWS, CHAR_ROWS = 2**14, 2**12
WORD_SIZE = CHAR_SIZE = STATE = 8
TRAIN_DOCS, TRAIN_WORDS = 5000, 1500
STEPS, BATCH, RATE, DECAY = 800, 32, 0.015, 0.01
KNOWN_DOCS = 8
BLOCK = 8192
ALARM = 0.7


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Inputs:
    """Distinct words of a batch of texts and the windows over them."""

    def __init__(self, texts: list[bytes | None]):
        w = Words(texts)
        for _ in range(4):  # punctuation around a word, up to four symbols on a side
            w.start = w.start + (_MARK[w.low[w.start]] & (w.end - w.start > 1))
            w.end = w.end - (_MARK[w.low[w.end - 1]] & (w.end - w.start > 1))
        h = w.hashes()
        _, where, self.of = np.unique(h, return_index=True, return_inverse=True)
        self.word = (h[where] >> np.uint64(50)).astype(np.int64)
        self.text = w.doc
        self.length = (w.end - w.start)[where]
        at = ranges(w.start[where], self.length)
        low = w.low.astype(np.uint64)
        tri = (low[at - 1] << np.uint64(16)) | (low[at] << np.uint64(8)) | low[at + 1]
        self.char = (mixed(tri * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        n = np.diff(w.first)
        count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        self.doc = np.repeat(np.arange(len(texts)), count)
        nth = ranges(np.zeros(len(texts), np.int64), count)
        self.start = w.first[:-1][self.doc] + nth * STRIDE
        self.size = np.minimum(WINDOW, w.first[1:][self.doc] - self.start)

    def vectors(self, model: dict) -> np.ndarray:
        """Input vector of every distinct word."""
        if not len(self.word):
            return np.zeros((1, WORD_SIZE + CHAR_SIZE), np.float32)
        begin = np.cumsum(self.length) - self.length
        chars = np.add.reduceat(model["char"][self.char], begin, axis=0) / self.length[:, None].astype(np.float32)
        return np.concatenate([model["word"][self.word * model["known"][self.word]], chars], axis=1)


def _init(rng) -> dict:
    g = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(np.float32)
    m = {"word": g(WORD_ROWS, WORD_SIZE), "char": g(CHAR_ROWS, CHAR_SIZE)}
    for side in "fb":
        m |= {f"W{side}": g(WORD_SIZE + CHAR_SIZE, 3 * STATE, scale=0.3), f"U{side}": g(STATE, 3 * STATE, scale=0.3),
              f"c{side}": np.zeros(3 * STATE, np.float32)}
    return m | {"att": g(2 * STATE), "out": g(2 * STATE, scale=0.3), "bias": np.zeros(1, np.float32)}


def forward(model: dict, x: np.ndarray, words: np.ndarray, size: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Logits of windows, longest first; words (window, place) number rows of x, size is how many count."""
    n, steps = words.shape
    h_all = np.zeros((steps, n, 2 * STATE), np.float32)
    live = [int(np.searchsorted(-size, -t)) for t in range(steps)]  # windows longer than t
    for k, side in enumerate("fb"):
        gates_in, u = x @ model[f"W{side}"] + model[f"c{side}"], model[f"U{side}"]
        h, rows = np.zeros((n, STATE), np.float32), np.arange(n)
        for t in range(steps):
            m = live[t]
            if not m:
                break
            place = np.full(m, t) if side == "f" else size[:m] - 1 - t
            a, old = gates_in[words[rows[:m], place]], h[:m]
            zr = sigmoid(a[:, :2 * STATE] + old @ u[:, :2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            c = np.tanh(a[:, 2 * STATE:] + (r * old) @ u[:, 2 * STATE:])
            new = old + z * (c - old)
            if tape is not None:
                tape[side, t] = (m, place, old.copy(), z, r, c)
            h[:m] = new
            h_all[place, rows[:m], k * STATE:(k + 1) * STATE] = new
    score = h_all @ model["att"]
    score[np.arange(steps)[:, None] >= size[None, :]] = -1e9
    e = np.exp(score - score.max(0))
    p = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", p, h_all)
    pooled[size == 0] = 0
    if tape is not None:
        tape |= {"h": h_all, "p": p, "pooled": pooled}
    return pooled @ model["out"] + model["bias"][0]


def backward(model: dict, x: np.ndarray, words: np.ndarray, size: np.ndarray, tape: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters after the inputs, and of x."""
    h, p, pooled = tape["h"], tape["p"], tape["pooled"]
    n, steps = words.shape
    grad = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * model["out"]
    dp = np.einsum("nh,tnh->tn", dpooled, h)
    ds = p * (dp - (p * dp).sum(0))
    grad["att"] = np.einsum("tn,tnh->h", ds, h)
    dh_all = p[:, :, None] * dpooled[None] + ds[:, :, None] * model["att"]
    dx = np.zeros_like(x)
    rows = np.arange(n)
    for k, side in enumerate("fb"):
        u, dgates = model[f"U{side}"], np.zeros((len(x), 3 * STATE), np.float32)
        du, dh = np.zeros_like(u), np.zeros((n, STATE), np.float32)
        for t in range(steps - 1, -1, -1):
            if (side, t) not in tape:
                continue
            m, place, old, z, r, c = tape[side, t]
            d = dh[:m] + dh_all[place, rows[:m], k * STATE:(k + 1) * STATE]
            dc = d * z * (1 - c * c)
            dro = dc @ u[:, 2 * STATE:].T
            dz, dr = d * (c - old) * z * (1 - z), dro * old * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            du[:, :2 * STATE] += old.T @ dzr
            du[:, 2 * STATE:] += (r * old).T @ dc
            dh[:m] = d * (1 - z) + dro * r + dzr @ u[:, :2 * STATE].T
            np.add.at(dgates, words[rows[:m], place], np.concatenate([dzr, dc], axis=1))
        grad |= {f"W{side}": x.T @ dgates, f"U{side}": du, f"c{side}": dgates.sum(0)}
        dx += dgates @ model[f"W{side}"].T
    return grad, dx


def _blocks(inputs: Inputs, order: np.ndarray, block: int):
    """(windows, their words, their sizes) in the given order, each block longest first."""
    for at in range(0, len(order), block):
        part = order[at:at + block]
        part = part[np.argsort(-inputs.size[part], kind="stable")]
        size = inputs.size[part]
        place = np.arange(max(int(size[0]) if len(size) else 0, 1))
        words = np.zeros((len(part), len(place)), np.int64)
        inside = place[None, :] < size[:, None]
        words[inside] = inputs.of[(inputs.start[part][:, None] + place)[inside]]
        yield part, words, size


def window_logits(model: dict, inputs: Inputs) -> np.ndarray:
    x, out = inputs.vectors(model), np.zeros(len(inputs.doc))
    order = np.argsort(-inputs.size, kind="stable")
    for part, words, size in _blocks(inputs, order, BLOCK):
        out[part] = forward(model, x, words, size)
    return out


def soft_maximum(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    first = np.searchsorted(doc, np.arange(n))
    top = np.maximum.reduceat(z, first)
    return top + np.log(np.add.reduceat(np.exp(z - top[doc]), first))


def logits(model: dict, texts: list[bytes | None]) -> np.ndarray:
    """The soft maximum of the window logits of every text."""
    if not texts:
        return np.zeros(0)
    inputs = Inputs(texts)
    return soft_maximum(window_logits(model, inputs), inputs.doc, len(texts))


def _calibrated(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, drawn towards (1, 0); steps that do not help are halved."""
    def loss(v):
        x = v[0] * s + v[1]
        return np.logaddexp(0, np.where(y == 1, -x, x)).sum() + 0.5 * ((v[0] - 1) ** 2 + v[1] ** 2 / 100)

    v = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(np.clip(v[0] * s + v[1], -30, 30))
        g = np.array([((p - y) * s).sum() + v[0] - 1, (p - y).sum() + v[1] / 100])
        c = p * (1 - p)
        step = np.linalg.solve([[(c * s * s).sum() + 1, (c * s).sum()], [(c * s).sum(), c.sum() + 0.01]], g)
        while loss(v - step) > loss(v) and np.abs(step).max() > 1e-9:
            step = step / 2
        v = v - step
    return float(v[0]), float(v[1])


def learn(texts: list[bytes], toxic: np.ndarray, steps: int = STEPS, seed: int = 5) -> dict:
    """A trained network with the slope and offset that calibrate its largest logit."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 4 == 3
    model = _init(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    fit = [t for t, out in zip(texts, held) if not out]
    inputs, y = Inputs(fit), toxic[~held].astype(np.float32)
    pairs = np.unique(inputs.word[inputs.of] * len(fit) + inputs.text)  # every word once per document
    model["known"] = np.bincount(pairs // len(fit), minlength=WORD_ROWS) >= KNOWN_DOCS
    rows = inputs.word * model["known"][inputs.word]
    model["bias"][0] = -3
    step, begin = 0, np.cumsum(inputs.length) - inputs.length
    window = np.searchsorted(inputs.doc, np.arange(len(fit) + 1))
    while step < steps:
        order = rng.permutation(len(fit))
        for docs in np.array_split(order, max(1, len(fit) // BATCH))[:steps - step]:
            docs = np.sort(docs)
            some = ranges(window[docs], window[docs + 1] - window[docs])
            (part, words, size), = _blocks(inputs, some, len(some))
            used, local = np.unique(words, return_inverse=True)
            local = local.reshape(words.shape)
            lengths = inputs.length[used]
            chars = inputs.char[ranges(begin[used], lengths)]
            share = 1 / lengths[:, None].astype(np.float32)
            x = np.concatenate([model["word"][rows[used]],
                                np.add.reduceat(model["char"][chars], np.cumsum(lengths) - lengths, axis=0) * share], axis=1)
            tape: dict = {}
            z = forward(model, x, local, size, tape)
            of = np.searchsorted(docs, inputs.doc[part])
            back = np.argsort(of, kind="stable")
            whole = soft_maximum(z[back], of[back], len(docs))
            d = (sigmoid(whole) - y[docs]) / len(docs)
            grad, dx = backward(model, x, local, size, tape, (d[of] * np.exp(z - whole[of])).astype(np.float32))
            grad["word"], grad["char"] = np.zeros_like(model["word"]), np.zeros_like(model["char"])
            np.add.at(grad["word"], rows[used], dx[:, :WORD_SIZE])
            np.add.at(grad["char"], chars, np.repeat(dx[:, WORD_SIZE:] * share, lengths, axis=0))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model[k] -= rate * ((first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + DECAY * model[k])
    # Logistic calibration of a document's largest logit on documents the network has not seen.
    s, y = logits(model, [t for t, out in zip(texts, held) if out]), toxic[held].astype(float)
    a, b = _calibrated(s, y)
    return model | {"slope": a, "offset": b}


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, steps: int = STEPS) -> dict | None:
    """A network from a bounded sample: half of it toxic documents if there are as many."""
    known = labels.select(F.col("doc_id").alias("id__"), F.col("toxic").cast("int").alias("y")).where(
        "y in (0, 1) and id__ is not null")
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    part = F.pmod(F.xxhash64(F.col("id__").cast("string")), F.lit(1_000_000))
    share = lambda y: int(1_000_000 * min(1.0, train_docs / 2 / n[y]))
    drawn = known.where(part < F.when(F.col("y") == 1, share(1)).otherwise(share(0)))
    # The sample has a proven bound, so its ids go to the documents.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id__"))
    short = F.size(F.split("text", r"[\x20\x09-\x0D]+")) <= TRAIN_WORDS
    got = rows.where(short).select("doc_id", "y", "text").toPandas().sort_values(["doc_id", "y", "text"])
    if got["y"].nunique() < 2:
        return None
    # In a fixed random order, so that the part for calibration is a random one.
    got = got.iloc[np.random.default_rng(11).permutation(len(got))]
    return learn([t.encode() for t in got["text"]], got["y"].to_numpy(), steps)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def scored(batches):
        for b in batches:
            texts = b["text"].cast(pa.binary()).to_pylist()
            s = np.concatenate([np.zeros(0), *(logits(model, texts[lo:hi]) for lo, hi in by_bytes(texts))])
            p = sigmoid(np.clip(model["slope"] * s + model["offset"], -30, 30))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")
