"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from stillwater.llm import decontamination, mixing, quality, sharding

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def fingerprint(text):
    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        p, q = find(i), find(j)
        root[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def simhash_groups(texts):
    f = [fingerprint(t) for t in texts]
    return f, groups(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2])


def shingles(text, size=5):
    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_groups(texts, percent=80):
    s = [shingles(t) for t in texts]
    same = lambda a, b: not a and not b or 100 * len(a & b) >= percent * len(a | b)
    return groups(len(s), [(i, j) for i in range(len(s)) for j in range(i) if same(s[i], s[j])])


def repeats(texts, length=200):
    """(bytes, removed, runs, kept) of every text."""
    t = [(x or "").encode() for x in texts]
    seen = Counter(b[i:i + length] for b in t for i in range(len(b) - length + 1))
    out = []
    for b in t:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def leaking(texts, items):
    """Numbers of the texts that leak an item, by comparing all places with each other."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    number = defaultdict(lambda: len(number))
    items = [np.array([number[x] for x in split(t)], int) for t in items]
    out = set()
    for k, t in enumerate(texts):
        w = np.array([number[x] for x in split(t)], int)
        for it in items:
            if len(it) < decontamination.SHORTEST or not len(w):
                continue
            length = min(decontamination.STRETCH, len(it))
            padded = np.concatenate([np.full(len(it), -1), w, np.full(len(it), -1)])
            same = np.lib.stride_tricks.sliding_window_view(padded, len(it)) == it
            run = np.lib.stride_tricks.sliding_window_view(same, length, axis=1).sum(axis=2)
            if run.max() >= length - decontamination.allowed(length):
                out.add(k)
    return out


def mix(rows):
    """rows: (doc_id, source, text); how often each is taken."""
    size = [len(SPACE.findall(t or "")) for _, _, t in rows]
    total = Counter()
    for (_, s, _), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    free, left = set(order), sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * total[s] < level * weight[s]}
        if not full:
            break
        free -= full
        left -= sum(3 * total[s] for s in full)
    target = {s: min(3.0 * total[s], level * weight[s]) if s in free else 3.0 * total[s] for s in order}
    h = [int(md5(mixing.SEED, d, hashlib.md5((t or "").encode()).hexdigest())[:15], 16) for d, _, t in rows]
    times = [0] * len(rows)
    for s in order:
        mine = sorted((i for i in range(len(rows)) if rows[i][1] == s), key=lambda i: h[i])
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, run = target[s] - whole * total[s], 0
        for i in mine:
            times[i] = whole + (run + size[i] / 2 <= rest)
            run += size[i]
    return size, times


def shard(rows, shards=8):
    """rows: (doc_id, source, text); (shard, slot) by two sorts."""
    crc = [zlib.crc32((t or "").encode()) for _, _, t in rows]
    h = [md5(sharding.SEED, d, c) for (d, _, _), c in zip(rows, crc)]
    by = defaultdict(list)
    for i, (_, s, _) in enumerate(rows):
        by[s].append(i)
    frac = {}
    for mine in by.values():
        for k, i in enumerate(sorted(mine, key=lambda i: (h[i], rows[i][0]))):
            frac[i] = (k + 0.5) / len(mine)
    order = sorted(frac, key=lambda i: (frac[i], rows[i][1] is None, rows[i][1] or "", h[i], rows[i][0]))
    out, used = {}, Counter()
    for place, i in enumerate(order):
        k = place * shards // len(order)
        out[i] = (k, used[k])
        used[k] += 1
    return out


def p_best(text, model):
    """Probability of the best grade by the definition, one text at a time."""
    numbers, _ = quality.features([(text or "").encode()])
    s = sum(float(model["weights"][i]) for i in numbers) / (len(numbers) + quality.SHRINK)
    return 1 - 1 / (1 + math.exp(s - model["thresholds"][-1]))
