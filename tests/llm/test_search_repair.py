"""Ranked search, exact top-k search and conversation repair against plain versions; edge cases."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stillwater.llm import conversations, pivots, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranking(docs, items, k=10):
    def split(t):
        return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    held = [(d, Counter(split(t))) for d, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    asked, out = {}, set()
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    for i, terms in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in terms}
        scores = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total if total else 0
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out |= {(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_ranked_search(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ß", "x9"]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(63)], k=rng.randrange(1, 90)))) for i in range(150)]
    docs += [(500, docs[3][1]), (500, docs[3][1]), (None, docs[4][1]), (600, None), (601, " .;"), (602, ""), (603, " ".join(words) * 300), (604, "w1 " * 4000)]
    items = [(1, "w1, w5; W9 w50"), (2, "Ünder ß und"), (3, None), (4, "nothing-of-this"), (5, ""), (None, "w7 x9"), (6, "w2"), (6, "w2 w61"), (7, docs[9][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item long")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank long")
    got = {tuple(r) for r in ranked.search(d, q).collect()}
    assert got == plain_ranking(docs, items) and {g[0] for g in got} == {None, 1, 2, 6, 7}
    monkeypatch.setattr(ranked, "ITEM_BYTES", 40)
    assert {tuple(r) for r in ranked.search(d, q).collect()} == got
    assert ranked.search(d.limit(0), q).count() == ranked.search(d, q.limit(0)).count() == 0


def test_signature_bounds_hold(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([str(i) for i in range(300)], k=rng.randrange(1, 400))).encode() for _ in range(300)]
    items = ranked.Items([{"item_id": i, "text": " ".join(map(str, rng.sample(range(320), 20))).encode()} for i in range(12)])
    c = ranked.Counts(texts)
    hit, term = items.find(c.hash)
    import numpy as np
    top = np.zeros(len(items.hashes), np.int64)
    np.maximum.at(top, term, c.tf[hit])
    items.weigh(np.bincount(term, minlength=len(top)), top, len(texts), int(c.n.sum()))
    builder, seen, slack = ranked.Builder(), 0, []
    blocks = [b for i in range(len(texts)) for b in builder.add(i, i, int(c.n[i]), c.hash[c.first[i]:c.first[i + 1]], c.tf[c.first[i]:c.first[i + 1]])]
    for b in [*blocks, *builder.rest()]:
        bound = items.bounds(b["width"], np.array(b["sizes"], np.int64), b["bits"])
        for col, doc in enumerate(b["ids"]):
            seen += 1
            tf = dict(zip(c.hash[c.first[doc]:c.first[doc + 1]].tolist(), c.tf[c.first[doc]:c.first[doc + 1]].tolist()))
            for j, t in enumerate(items.terms):
                count = np.array([tf.get(int(h), 0) for h in items.hashes[t]], np.int64)
                exact = int((items.weight[t] * items.part(count, int(c.n[doc]))).sum())
                assert exact <= bound[j, col]
                slack.append((exact + 1) / (bound[j, col] + 1))
    assert seen == len(texts) and np.mean(slack) > 0.8


def plain_nearest(rows, k, step):
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, done = set(), set()
    for a, (i, v) in enumerate(fit):
        short = tuple(v[:max((p + 1 for p, x in enumerate(v) if x), default=0)])
        if i is None or i % step or (i, short) in done:
            continue
        done.add((i, short))
        best = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(fit) if a != b)
        out |= {(i, r, j, -s) for r, (s, _, _, j) in enumerate(best[:k], 1)}
    return out


def test_exact_top_k(spark, monkeypatch):
    rng = random.Random(5)
    base = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in base[i % 40]]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1]), (None, rows[10][1]), (400, None), (401, [None] * 12), (410, [float("nan")] * 12),
             (420, [float("inf")] * 12), (430, []), (440, [0.0] * 12), (450, [1.0, 2.0]), (460, [5e3] * 12), (470, rows[3][1] + [1.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, v string")
    want = plain_nearest(rows, 5, 10)
    got = [tuple(r) for r in pivots.search(df, F.col("vec_id") % 10 == 0).collect()]
    assert set(got) == want and len(got) == len(want)
    for name, value in (("PART_ROWS", 20), ("BLOCK_ROWS", 7), ("FIRST_ROWS", 8), ("CHUNK", 4), ("PIVOTS", 4)):
        monkeypatch.setattr(pivots, name, value)
    assert {tuple(r) for r in pivots.search(df, F.col("vec_id") % 10 == 0).collect()} == want
    assert pivots.search(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert {tuple(r) for r in pivots.search(few, F.col("vec_id") % 10 == 0).collect()} == plain_nearest(rows[:3], 5, 10)


def test_bounds_eliminate_most_candidates():
    import numpy as np
    rng = np.random.default_rng(1)
    v = np.floor(256 * (rng.normal(0, 0.3, (20, 8))[rng.integers(0, 20, 2000)] + rng.normal(0, 0.01, (2000, 8)))).astype(np.int64)
    g = pivots.Geometry(v[:500].tolist(), 8, float((v.astype(float) ** 2).sum(1).max()))
    part = pivots.Part(v, g.table(v), [[i] for i in range(len(v))])
    q = {"id": 0, "v": v[0], "d": g.table(v[:1], query=True)[0], "goal": None}
    exact = np.sort(np.delete(v @ v[0], 0))[::-1][:5]
    assert [s for s, _ in pivots.visit(q, 5, part, g)] == exact.tolist()
    assert len(part.bounds(q | {"goal": int(exact[-1])}, g)[0]) < len(v) / 4


def huge_products():
    return [[2**40, 2**40, -3], [2**62, 2**62, 5]]


def test_large_components_stay_exact():
    import numpy as np
    v = np.array(huge_products(), np.int64)
    part = pivots.Part(v, np.zeros((2, 1)), [[0], [1]])
    q = np.array([2**20, -2**20, 7], np.int64)
    assert part.products(np.arange(2), q).tolist() == [-21, 35]
    assert part.products(np.arange(2), v[1]).tolist() == [2**63 - 1, 2**63 - 1]


def cheapest(rows):
    """(cost, audit) by least (cost, audit) over rows and states, one edit at a time; rows: (initial, gone, cut)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(rows) and state in conversations.ENDS:
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        for c in "ua":
            if c in conversations.STATES[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", at, conversations.STATES[state][c]))
        if at < len(rows):
            initial, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if not gone:
                for c, to in conversations.STATES[state].items():
                    if c == initial:
                        heapq.heappush(heap, (cost + cut, audit + "K", at + 1, to))
                    if c in "ua":
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, to))


def plain_repair(rows):
    out, by = {}, {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, live in by.items():
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged, count = set(), [], Counter()
        for _, role, text in live:
            end = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            judged.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        turns = {t for t, *_ in live if t is not None}
        cost, audit = cheapest(judged)
        lines = list(conversations.lines(audit, [(r, t) for _, r, t in live]))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


@pytest.fixture
def many_pieces(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_conversations(spark, many_pieces):
    rng = random.Random(11)
    texts = ["a.", "b!", "c", "", " \n", None, "e?  ", "long one. cut", "d. \t"]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys"]), rng.choice(texts) if rng.random() < 0.6 else f"say {t}.")
            for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, "user", "x.") for t in (None, 3, 3, 9)] + [(100, None, "assistant", "y.")] * 3 + [(101, 0, "user", None)]
    rows += [(200, t, ("user", "assistant")[(t // 3) % 2], f"turn {t}." if t % 5 else "again.") for t in range(400)]
    rows += [(300, 5, "user", "same.")] * 40
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, times int")
    damaged = conversations.damaged(df)
    got = {r[0]: tuple(r)[1:] for r in conversations.digested(damaged, conversations.plans(damaged)).collect()}
    assert got == plain_repair(rows)
    whole = conversations.repaired(damaged, conversations.plans(damaged)).where("conv_id = 200").orderBy("place").collect()
    text = "\n".join(f"{r['role']}:{r['text']}" for r in whole)
    assert hashlib.sha256(text.encode()).hexdigest() == got[200][-1] and len(whole) > 200
    assert conversations.plans(conversations.prepared(df.limit(0))).count() == 0


def test_any_split_gives_the_same_cell():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 8))]
        chart = {(i, i + 1): conversations.leaf(*r) for i, r in enumerate(rows)}
        for length in range(2, len(rows) + 1):
            for i in range(len(rows) - length + 1):
                cells = [conversations.combined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
                assert all(c == cells[0] for c in cells)
                chart[i, i + length] = cells[0]
        best = min(c for e in conversations.ENDS if (c := chart[0, len(rows)][e]))
        assert best == cheapest([(i, g, int(c and not g)) for i, g, c in rows])
