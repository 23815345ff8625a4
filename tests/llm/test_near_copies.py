"""Near copies by five-word shingles and a Jaccard similarity of 0.8 against all pairs."""

import random

from stillwater.llm import near_copies, stages
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = brute.SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def same(a, b):
    return not a and not b or 100 * len(a & b) >= 80 * len(a | b)


def test_stage_equals_jaccard_of_all_pairs(spark):
    rng = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    for t in [t for t in texts if 100 < len(t.split()) < 800][:40]:
        w = t.split()
        for _ in range(3):  # around the limit: each changed word takes up to five shingles
            c = w[:]
            for k in range(rng.randrange(1, len(w) // 30 + 2)):
                c[rng.randrange(len(c))] = f"changed{k}"
            texts.append(" ".join(c[rng.randrange(5):]))
    base = [f"w{k}" for k in range(60)]
    texts += [" ".join([*base, *[f"x{k}" for k in range(j)]]) for j in range(0, 60, 2)]  # a chain
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d", "a b c d e", None, "", " \n", "A b c D"]
    sets = [shingles(t) for t in texts]
    root = brute.groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if same(sets[i], sets[j])])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    got = {r["doc_id"] for r in stages.dedupe(spark, docs, SF).collect()}
    assert got == set(root)
    by_bits = brute.simhash_groups(texts)[1]
    assert len(got) < len(set(by_bits)) - 20


def test_common_passage_and_null_ids(spark):
    rng = random.Random(4)
    line = " ".join(f"licence{k}" for k in range(30))
    texts = [" ".join([line, *[f"v{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 200))]]) for _ in range(300)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "one two three four five six", "en", "s", 1), (None, line, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    sets = [shingles(r[1]) for r in rows]
    root = brute.groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if same(sets[i], sets[j])])
    got = stages.dedupe(spark, docs, SF).collect()
    assert len(got) == len(set(root)) and sum(r["doc_id"] is None for r in got) == sum(rows[i][0] is None for i in set(root))
    assert stages.dedupe(spark, docs.limit(0), SF).count() == 0


def test_first_candidates_are_the_simhash_groups(spark):
    """The stage's first candidates connect what the fingerprints within 2 bits connect."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    texts += [" ".join([*t.split(), "tail"]) for t in texts if len(t.split()) > 400] + [t.upper() for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = near_copies.marks(docs, near_copies.frequent(docs), "doc_id").toPandas()
    pairs = near_copies.hashed_alike(spark.createDataFrame(marked.drop_duplicates("fp")[["fp", "sim"]])).collect()
    ids = {r.fp: r.doc_id for r in marked.itertuples()}
    edges = [(ids[p.a], ids[p.b]) for p in pairs] + [(r.doc_id, ids[r.fp]) for r in marked.itertuples()]
    assert len(ids) < len(texts) and pairs
    assert brute.groups(len(texts), edges) == brute.simhash_groups(texts)[1]


def test_stages_send_texts_in_small_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    docs = spark.createDataFrame([(i, "", "en", "s", 1) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars int")
    long = spark.range(0, 200, 1, 1).selectExpr("repeat('word and more ', 10000) as text")
    for stage in (stages.select, stages.dedupe):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, SF)
        assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 6e6
