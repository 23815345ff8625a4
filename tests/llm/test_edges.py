"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import time

import pytest
import numpy as np
from pyspark.sql import types as T

from stillwater.llm import (decontamination, html_text, mixing, neighbours, quality, repeats, secrets, sharding, simhash,
                            stages, toxicity)

KIND = "doc_id long, text string, lang string, source string, n_chars int, size long, h long, key string, fp long, th long, crc int"
LONG = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta", "token"]) for _ in range(40_000))
TEXTS = [(1, "one two three four five six"), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (None, "no id here at all"),
         (7, "same text twice"), (7, "same text twice"), (8, "same text twice"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 4 == 3 else f"s{k % 2}", 0, 1, 2, "k", 3, 4, 5) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def ids(df, c="doc_id"):
    return sorted((r[c] for r in df.select(c).collect()), key=lambda x: (x is None, x))


ALL = sorted((i for i, _ in TEXTS), key=lambda x: (x is None, x))


def test_sharding(docs, nothing):
    got = sharding.assign(docs, 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1)]
    assert {r["size"] for r in got if r["doc_id"] in (2, 3)} == {1} and {r["text_crc32"] for r in got if r["doc_id"] in (2, 3)} == {0}
    assert ids(sharding.assign(docs)) == ALL and sharding.assign(nothing).count() == 0


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert {r["taken"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).columns == docs.columns
    assert mixing.mixed(docs).columns == docs.columns


def test_secrets(spark, docs, nothing):
    got = secrets.scan(docs).collect()
    assert len(got) == len(TEXTS) and not any(r["hex"] or r["access"] for r in got)
    assert secrets.scan(nothing).count() == 0
    rare = spark.createDataFrame(
        [(1, 'é API_KEY = "abcdef12" and token=abc; PassWD:x'), (2, "AKIA" + "Z9" * 8 + " " + "0a" * 12), (3, "x" * 30)], "doc_id long, text string")
    r = {x["doc_id"]: x for x in secrets.scan(rare).collect()}
    assert [(s["start"], s["end"], s["value"]) for s in r[1]["assign"]] == [(2, 21, "abcdef12")]
    assert [(s["start"], s["end"]) for s in r[2]["access"]] == [(0, 20)] and [(s["start"], s["end"]) for s in r[2]["hex"]] == [(21, 45)]


def test_markov_models_tell_random_strings_from_names(spark):
    rng = random.Random(4)
    syllables = "con ver ta tion al is ment re de form er ing port act".split()
    name = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    noise = lambda k: "".join(rng.choice(secrets.ALPHABET) for _ in range(k))
    train = spark.createDataFrame([(i, f"{name(6)} {name(7)} token={noise(40)} {name(8)}") for i in range(150)], "doc_id long, text string")
    ratios = secrets.train(train)
    test = [(i, f"{name(9)} and {noise(32)} end") for i in range(40)]
    got = secrets.scan(spark.createDataFrame(test, "doc_id long, text string"), ratios).collect()
    right = sum([s["value"] for s in r["markov"]] == [test[r["doc_id"]][1].split()[2]] for r in got)
    assert right >= 38


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 2), (5, 0), (7, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert list(model["grades"]) == [0, 1, 2] and model["thresholds"][0] <= model["thresholds"][1]
    got = quality.score(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["expected"] <= 2 and 0 <= r["p_best"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (2, 3, 4)} == {0.0}
    none = quality.score(docs, quality.fit(docs, labels.limit(0)))
    assert none.where(quality.kept()).count() == len(TEXTS) and quality.score(nothing, model).count() == 0


def test_repeats(docs, nothing):
    got = {r["doc_id"]: r for r in repeats.remove(docs).collect()}
    assert got[2]["n_bytes"] == 0 and got[1]["n_removed"] == 0 and got[5]["n_bytes"] == len(LONG)
    assert repeats.remove(docs).count() == len(TEXTS) and repeats.remove(nothing).count() == 0


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (7, 0), (5, 0), (3, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    model = toxicity.fit(docs, labels, steps=5)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1 and toxicity.score(nothing, model).count() == 0


def test_html(spark):
    pages = [(1, "u", None, "x"), (None, None, "", "x"), (3, "u", "<p>unclosed <b>bold", "x"), (3, "u", "<script>never closed", "x"),
             (4, "u", "<article><p>A&amp;B &lt;i&gt;\n\t c</p><div class='ad'>buy</div><p>d</article>" + "<p>x" * 5000, "x")]
    kind = "page_id long, url string, html string, text string"
    got = html_text.extract(spark.createDataFrame(pages, kind)).collect()
    assert [r["text"] for r in got if r["page_id"] == 4] == ["A&B <i> c\n\nd"] and len(got) == 5
    assert sorted(r["n_chars"] for r in got) == [0, 0, 0, 12, 13]  # a page without a surge gives its heaviest run
    assert html_text.extract(spark.createDataFrame([], kind)).count() == 0
    deep = lambda n: "<div>" + "<span>" * n + "<a href=x>" + "<b>" * n + "link text " * 9 + "</b>" * n + "</a>" + "</span>" * n + "</div>"
    assert [w for _, w, _, _ in html_text.lines(deep(1))] == [w for _, w, _, _ in html_text.lines(deep(12))] == [0]
    begun = time.time()
    assert html_text.main_text("<div>" * 60_000 + "x" * 100) == "x" * 100 and time.time() - begun < 20


def test_decontamination(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "same text twice"), (3, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()] == [(1, 1)]
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.leaks(nothing, bench).count() == 0
    assert decontamination.clean(docs, bench).count() == len(TEXTS) - 1 and decontamination.clean(docs, bench).columns == docs.columns
    leak = "one two three four five six"
    more = spark.createDataFrame([(1, leak), (1, "clean words only here"), (None, leak), (None, "other clean words here"), (2, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in decontamination.clean(more, bench).collect()} == {
        (1, "clean words only here"), (None, "other clean words here"), (2, None)}


def test_repeats_at_the_edge_of_a_buffer(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    first, second = letters(2**19 - 10), letters(2**20)
    third = letters(50) + second[2**19 - 300:2**19 - 100] + letters(50)
    tail = letters(30) + second[2**19 + 10:2**19 + 190 + 20] + letters(10)
    for order in ((first, second, third, tail), (second, first, tail, third)):
        df = spark.createDataFrame(list(enumerate(order)), "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: r["n_removed"] for r in repeats.remove(df).collect()}
        assert [got[order.index(t)] for t in (first, second, third, tail)] == [0, 400, 200, 200]


def test_simhash(docs, nothing):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"]}
    assert got[2] == got[3] == got[4] == 2 and got[7] == got[8] == 7 and got[1] == 1
    kept = simhash.representatives(docs)
    assert ids(kept) == [1, 2, 5, 7, None] and kept.columns == docs.columns
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.representatives(nothing).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.01, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]),
            (7, [inf, 1.0, 0.0]), (8, [1.0, None, 0.0]), (9, [0.0, 1.0, 0.0]), (10, []), (11, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]),
            (12, [0.0, -1.0, 0.0]), (1, [1.0, 0.0, 0.0])]
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    got = [tuple(r) for r in neighbours.near_duplicates(spark.createDataFrame(rows, kind)).collect()]
    assert {g for g in got if g[0] in (1, 2, 3)} == {(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False)}
    assert {g for g in got if g[0] and g[0] > 3} == {(i, 0, i, True) for i in range(4, 13)} and len(got) == len(rows)
    assert neighbours.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_neighbours_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    made = [(d, rng.standard_normal((m, d))) for d, m in ((3, 40), (8, 30), (2, 12), (5, 1))]
    rows = [v.tolist() for _, x in made for v in np.concatenate([x, x[:7] * 2, x[:5] + 0.01])]
    got = neighbours.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>"))
    unit = [np.array(v) / np.linalg.norm(v) for v in rows]
    linked = [[len(a) == len(b) and a @ b >= neighbours.LINK for b in unit] for a in unit]
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {i: sum(v) - 1 for i, v in enumerate(linked)}
    alone = neighbours.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), *[(i, [1.0, float(i), 0.0]) for i in range(3, 6)]],
                                                             "vec_id long, embedding array<double>"))
    assert {r["vec_id"]: r["n_links"] for r in alone.collect() if r["vec_id"] < 3} == {1: 1, 2: 1}


def test_stages_take_clashing_columns_and_return_those_of_documents(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in (stages.select, stages.dedupe, stages.decontaminate, stages.mix):
        assert stage(spark, docs, str(tmp_path)).columns == stages.COLUMNS
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert stages.shard(spark, docs, str(tmp_path)).count() == len(TEXTS)
