"""Secret scan: fixed patterns, and random-looking strings by character Markov models.

Two models of which character follows which are counted from labelled samples: values
that the patterns found are random strings, other long tokens are ordinary identifiers.
A token of ``MIN_TOKEN`` characters or more that no pattern touches is a secret if the
log-likelihood ratio of the two models, per character pair, is above ``THRESHOLD``.

Training reads the documents whose hash falls into a share of the corpus that is worth
``TRAIN_DOCS`` documents; every document is scanned. Without samples both models are
uniform and nothing is added. The ratios are a table of fixed size, 67 x 67 numbers.

Places are code points, end exclusive. They come from the lengths of the matches and of
the pieces between them. Defined cases: a null or empty text has no spans; ids may be null
or repeated (one row out per row in); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

# The patterns of the contract; the letters of a keyword in either case.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

MIN_TOKEN = 20
MIN_SAMPLE = 8
TRAIN_DOCS = 20_000
THRESHOLD = 0.5
SMOOTHING = 0.5
BACKOFF = 5.0  # pairs' worth of the plain character frequencies in every row
KINDS = ("assign", "access", "hex", "markov")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
HINTS = ("passw", "secret", "token", "api")


def _token(least: int) -> str:
    return "[A-Za-z0-9+/_=-]{%d,}" % least


def _spans(text, pattern: str, kind: str, group: int = 0, least: int = 0) -> F.Column:
    """Array of (start, kind number, end, value) of the matches of a pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.zip_with(F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))),
                       values, lambda s, v: F.struct(s["b"].alias("b"), s["m"].alias("m"), v.alias("v")))
    number = F.lit(KINDS.index(kind))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    placed = F.aggregate(
        F.filter(sizes, lambda s: s["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["b"] + s["m"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["b"]).alias("start"), number.alias("kind"),
                (acc["at"] + s["b"] + s["m"]).alias("end"), s["v"].alias("value")))).alias("out")),
        lambda acc: acc["out"])
    kept = F.filter(placed, lambda x: F.length(x["value"]) >= least) if least else placed
    return F.when(F.size(found) > 0, kept).otherwise(empty)


def _either(text, hints) -> F.Column:
    return F.expr(" or ".join(f"contains({text}, '{h}')" for h in hints))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with arrays assign, access and hex."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return docs.withColumns({
        "assign": F.when(_either("lower(text)", HINTS), _spans(F.col("text"), ASSIGN, "assign", 2, 6)).otherwise(empty),
        "access": F.when(_either("text", ("AKIA",)), _spans(F.col("text"), ACCESS, "access")).otherwise(empty),
        "hex": _spans(F.col("text"), HEX, "hex"),
    })


def _outside(spans: str, x) -> F.Column:
    return ~F.exists(spans, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratio of every pair of characters of the alphabet, row by row."""
    share = min(1.0, train_docs / max(docs.count(), 1))
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    sample = docs.where(F.coalesce(part, F.lit(0)) < int(share * 16**8))
    sample = base_spans(sample.select(F.coalesce("text", F.lit("")).alias("text"))).withColumn(
        "base", F.concat("assign", "access", "hex")).withColumn("tokens", _spans(F.col("text"), _token(MIN_SAMPLE), "markov"))
    values = sample.select(F.lit(1).alias("random"), F.explode(F.transform("base", lambda x: x["value"])).alias("v"))
    names = sample.select(F.lit(0).alias("random"), F.explode(F.transform(
        F.filter("tokens", lambda x: _outside("base", x)), lambda x: x["value"])).alias("v"))
    both = values.union(names).where("length(v) > 1")
    pairs = both.select("random", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.substring("v", i, F.lit(2)))).alias("pair"))
    # At most 2 x 67 x 67 rows, whatever the corpus.
    a, size = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    counts = [[[0] * size for _ in range(size)] for _ in range(2)]
    known = pairs.groupBy("random", "pair").count().where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    for row in known.collect():
        counts[row["random"]][a[row["pair"][0]]][a[row["pair"][1]]] = row["count"]

    def logs(c):
        total = sum(map(sum, c))
        plain = [(sum(line[y] for line in c) + smoothing) / (total + smoothing * size) for y in range(size)]
        return [[math.log((n + BACKOFF * p) / (sum(line) + BACKOFF)) for n, p in zip(line, plain)] for line in c]

    logs = [logs(c) for c in counts]
    return [r - o for rl, ol in zip(logs[1], logs[0]) for r, o in zip(rl, ol)]


def score(token, ratios: list[float]) -> F.Column:
    """Mean log-likelihood ratio of the character pairs of a token of the alphabet."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
        lambda s, i: s + F.element_at(table, (place(i) - 1) * len(ALPHABET) + place(i + 1)),
        lambda s: s / (F.length(token) - 1))


def scan(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, assign, access, hex, markov: arrays of (start, kind, end, value)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ratios = train(d) if ratios is None else ratios
    found = base_spans(d).withColumn("tokens", _spans(F.col("text"), _token(MIN_TOKEN), "markov"))
    found = found.withColumn("base", F.concat("assign", "access", "hex"))
    return found.select("doc_id", "assign", "access", "hex", F.filter(
        "tokens", lambda x: _outside("base", x) & (score(x["value"], ratios) > threshold)).alias("markov"))


def listed(spans: F.Column) -> F.Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def _sql() -> str:
    def kind(name, pattern, group=0, least=0):
        quoted = pattern.replace("'", "''")
        return f"""
  {name}_parts AS (
    SELECT rid, unnest(string_split_regex(text, '{quoted}')[:-2]) AS b, unnest(regexp_extract_all(text, '{quoted}')) AS m,
      unnest(regexp_extract_all(text, '{quoted}', {group})) AS v, generate_subscripts(regexp_extract_all(text, '{quoted}'), 1) AS k
    FROM d WHERE regexp_matches(text, '{quoted}')),
  {name}_all AS (
    SELECT rid, {KINDS.index(name) if name in KINDS else 3} AS kind, v,
      sum(length(b) + length(m)) OVER (PARTITION BY rid ORDER BY k) AS e, length(m) AS l FROM {name}_parts),
  {name}_ AS (SELECT rid, kind, v, (e - l)::BIGINT AS s, e::BIGINT AS e FROM {name}_all WHERE length(v) >= {least}),"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{kind('assign', ASSIGN, 2, 6)}{kind('access', ACCESS)}{kind('hex', HEX)}{kind('tokens', _token(MIN_TOKEN))}{kind('samples', _token(MIN_SAMPLE))}
  base AS (FROM assign_ UNION ALL FROM access_ UNION ALL FROM hex_),
  drawn AS (
    SELECT rid FROM d WHERE coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT, 0)
      < floor(least(1.0::DOUBLE, {TRAIN_DOCS} / (SELECT greatest(count(*), 1) FROM d)::DOUBLE) * 4294967296)),
  labelled AS (
    SELECT 1 AS random, v FROM base JOIN drawn USING (rid)
    UNION ALL
    SELECT 0, v FROM samples_ t JOIN drawn USING (rid)
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = t.rid AND b.s < t.e AND b.e > t.s)),
  pairs AS (
    SELECT random, substr(v, i, 1) AS x, substr(v, i + 1, 1) AS y FROM labelled, unnest(range(1, length(v))) u(i)),
  alphabet AS (SELECT unnest(string_split('{ALPHABET}', '')) AS c),
  counts AS (
    SELECT x.c AS x, y.c AS y, r.random, count(p.random) AS n
    FROM alphabet x CROSS JOIN alphabet y CROSS JOIN (VALUES (0), (1)) r(random)
    LEFT JOIN pairs p ON p.x = x.c AND p.y = y.c AND p.random = r.random GROUP BY ALL),
  plain AS (
    SELECT y, random, (n + {SMOOTHING}) / (sum(n) OVER (PARTITION BY random) + {SMOOTHING * len(ALPHABET)}) AS p
    FROM (SELECT y, random, sum(n) AS n FROM counts GROUP BY y, random)),
  logs AS (
    SELECT x, y, random, ln((n + {BACKOFF} * p) / (sum(n) OVER (PARTITION BY x, random) + {BACKOFF})) AS l
    FROM counts JOIN plain USING (y, random)),
  ratios AS (SELECT x, y, sum(CASE WHEN random = 1 THEN l ELSE -l END) AS r FROM logs GROUP BY ALL),
  scored AS (
    SELECT t.rid, t.kind, t.s, t.e, avg(r) AS score
    FROM tokens_ t, unnest(range(1, length(t.v))) u(i)
    JOIN ratios ON x = substr(t.v, i, 1) AND y = substr(t.v, i + 1, 1)
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = t.rid AND b.s < t.e AND b.e > t.s) GROUP BY ALL),
  spans AS (
    SELECT rid, kind, s, e FROM base UNION ALL SELECT rid, kind, s, e FROM scored WHERE score > {THRESHOLD}),
  named AS (SELECT *, list_value('assign', 'access', 'hex', 'markov')[kind + 1] || ':' || s || ':' || e AS t FROM spans)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
  count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(t, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN named USING (rid) GROUP BY rid, doc_id
"""


SQL = _sql()
