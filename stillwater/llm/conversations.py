"""Conversations repaired at least cost by a weighted interval parse of their roles.

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials. A row is kept (0),
given the role user or assistant (2) or deleted (3; blank rows and repeats must be); an
empty user or assistant row may be inserted anywhere (2), and a truncated row that stays
adds 1. The grammar is in Chomsky normal form with one symbol [p, q] per pair of states of
that language, [p, q] -> [p, r] [r, q]; a cell holds the least (cost, audit) of a span of
rows for every symbol. Insertion closure: the cells of a single row are multiplied by those
of the empty span on both sides. Since the symbols are closed under insertion, every split of
a span gives the same cell, so that one split is read and spans of 1, 2, 4, ... rows are
combined bottom-up. Equal costs of a span never have audits of which one begins another
(the longer would insert more), hence least audits add up to a least audit.

Spark deals light rows (no text, a digest of it) by ranges of (conversation, turn), so that
a conversation with many rows is parsed by many tasks; the cells of its pieces are combined
in order. The texts meet the audit in a second pass that streams through them.

Defined cases: nulls are one space; rows of a turn stand in the order of role and then of the
text's digest; an empty table gives no rows; a role without a legal initial, the empty one
too, can not be kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stillwater.llm.common import written
from stillwater.llm.sharding import _CRC as CRC

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: state -> initial -> state of (s?(ua)+)?; 0 is the start, 0 and 3 may end.
STATES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
BLANKS = " \t\n\x0b\f\r"
PLAN = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
_N = len(STATES)
LEGAL = ("su", "ua", "au")


def combined(x: list, y: list) -> list:
    """The cells of a span from those of its two parts; a cell is (cost, audit) or None."""
    out = []
    for p in range(_N):
        for q in range(_N):
            best = None
            for r in range(_N):
                a, b = x[p * _N + r], y[r * _N + q]
                if a is not None and b is not None:
                    cost = a[0] + b[0]
                    if best is None or cost < best[0] or cost == best[0] and a[1] + b[1] < best[1]:
                        best = (cost, a[1] + b[1])
            out.append(best)
    return out


def _least(*cells):
    return min((c for c in cells if c is not None), default=None)


def empty_span() -> list:
    """Cells of no rows: what insertions alone can do."""
    nothing = [(0, "") if p == q else None for p in range(_N) for q in range(_N)]
    once = [_least(nothing[p * _N + q], (INSERT, "I") if q in [STATES[p].get(c) for c in "ua"] else None)
            for p in range(_N) for q in range(_N)]
    while (more := combined(once, once)) != once:
        once = more
    return once


_EMPTY, _leaves = empty_span(), {}


def leaf(initial: str, must_go: bool, truncated: bool) -> list:
    """Cells of one row."""
    key = (initial, must_go, truncated)
    if key not in _leaves:
        cells = []
        for p in range(_N):
            for q in range(_N):
                stays = not must_go
                cells.append(_least(
                    (KEEP + TRUNCATED * truncated, "K") if stays and STATES[p].get(initial) == q else None,
                    (REROLE + TRUNCATED * truncated, "R") if stays and q in [STATES[p].get(c) for c in "ua"] else None,
                    (DELETE, "D") if p == q else None))
        _leaves[key] = combined(combined(_EMPTY, cells), _EMPTY)
    return _leaves[key]


class Chart:
    """Cells of a growing run of rows, as spans whose lengths are falling powers of two."""

    def __init__(self):
        self.spans: list[tuple[int, list]] = []

    def add(self, cells: list, length: int = 1) -> None:
        while self.spans and self.spans[-1][0] <= length:
            n, before = self.spans.pop()
            cells, length = combined(before, cells), n + length
        self.spans.append((length, cells))

    def add_times(self, cells: list, times: int) -> None:
        """The same row ``times`` times, by doubling."""
        whole, n = None, times
        while n:
            if n & 1:
                whole = cells if whole is None else combined(cells, whole)
            n >>= 1
            cells = combined(cells, cells) if n else cells
        if whole is not None:
            self.add(whole, times)

    def cells(self) -> list:
        out = _EMPTY
        for _, cells in reversed(self.spans):
            out = combined(cells, out)
        return out


def faults(rows: DataFrame) -> DataFrame:
    """Light rows: what the parse needs of each row of (conv_id, turn, role, text, times)."""
    end = F.rtrim("text", F.lit(BLANKS))
    light = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("key"), (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), "times")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    light = written(light.groupBy("conv_id", "role", "key", "turn").agg(
        F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.sum("times").alias("times")))
    seen = light.where("times > 0").groupBy("conv_id", "role", "key").agg(F.min(place).alias("first"))
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first")
    met = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    return light.join(seen, met, "left").select(
        "conv_id", "turn", "role", "key", "blank", "cut", "times", (place > F.col("first")).alias("again"))


_PIECE = pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("n", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
                    *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")],
                    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


class _Piece:
    """What is known of a run of rows of one conversation."""

    def __init__(self, conv_id, seg):
        self.conv_id, self.seg, self.n, self.head, self.tail = conv_id, seg, 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.chart = Chart()

    def _follow(self, head: str, tail: str, n: int) -> None:
        if self.n:
            self.illegal += self.tail + head not in LEGAL
        else:
            self.head = head
        self.tail, self.n = tail, self.n + n

    def _turn(self, low, high, turns) -> None:
        if low is not None:
            self.turns += turns - (self.high is not None and self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def row(self, turn, role, blank, cut, again, times) -> None:
        if not times:
            return
        initial = role[:1]
        self._follow(initial, initial, times)
        self.illegal += times - 1  # no initial may follow itself
        self._turn(turn, turn, 1)
        extra = times if again else times - 1
        if blank:
            self.blank += times
        else:
            self.duplicate += extra
            self.truncated += cut and not again
        if not (blank or again):
            self.chart.add(leaf(initial, False, cut))
        else:
            extra = times
        if extra:
            self.chart.add_times(leaf(initial, True, False), extra)

    def piece(self, r: dict) -> None:
        if not r["n"]:
            return
        self._follow(r["head"], r["tail"], r["n"])
        for c in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + r[c])
        self._turn(r["low"], r["high"], r["turns"])
        self.chart.add([None if a is None else (c, a) for c, a in zip(r["costs"], r["audits"])], r["n"])

    def record(self) -> dict:
        cells = self.chart.cells()
        return {**{c: getattr(self, c) for c in _PIECE.names[:12]},
                "costs": [c and c[0] for c in cells], "audits": [c and c[1] for c in cells]}

    def plan(self) -> dict:
        cost, audit = min(c for c in (self.chart.cells()[e] for e in ENDS) if c is not None)
        return {"conv_id": self.conv_id, "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
                **{c: getattr(self, c) for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}


def _runs(add, done, schema):
    """A task: records of one conversation follow each other; ``done`` of each run is sent on."""
    def task(batches):
        piece, out = None, []
        for b in batches:
            for r in b.to_pylist():
                if piece is None or piece.conv_id != r["conv_id"]:
                    if piece is not None:
                        out.append(done(piece))
                    piece = _Piece(r["conv_id"], r["seg"])
                add(piece, r)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if piece is not None:
            out.append(done(piece))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return task


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost and audit; ``rows`` as ``prepared`` gives them."""
    order = ["conv_id", "turn", "role", "key"]
    light = written(faults(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    light = light.withColumn("seg", F.spark_partition_id())

    def add(p, r):
        p.row(r["turn"], r["role"], r["blank"], r["cut"], r["again"], r["times"])

    piece = ("conv_id long, seg int, n long, head string, tail string, blank long, duplicate long, truncated long, "
             "illegal long, low long, high long, turns long, costs array<long>, audits array<string>")
    pieces = light.mapInArrow(_runs(add, _Piece.record, _PIECE), piece)
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string())])
    return pieces.mapInArrow(_runs(lambda p, r: p.piece(r), _Piece.plan, schema), "conv_id long, " + PLAN)


def lines(audit: str, rows):
    """(role, text) of every repaired row, given the rows' (role, text) in order."""
    rows, place = iter(rows), 0
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = ("user", "assistant")[place % 2]
        if not (edit == "K" and role[:1] == "s"):
            place += 1
        yield role, text


def _meeting(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's plan followed by its rows in order, in one partition."""
    names = [f.split()[0] for f in PLAN.split(", ")]
    texts = rows.where("times > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("key"), "text", "times",
        *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in PLAN.split(", ")])
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.lit(None).cast("binary").alias("key"), F.lit("").alias("text"), F.lit(1).alias("times"), *names)
    both = heads.union(texts).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", "turn", "role", "key").drop("turn", "key")


def _conversations(batches):
    """(plan, iterator over repaired lines) of one conversation after another; nothing is gathered."""
    records = (r for b in batches for r in b.to_pylist())
    plan = next(records, None)
    while plan is not None:
        following = []

        def rows():
            for r in records:
                if r["kind"] == 0:
                    following.append(r)
                    return
                for _ in range(r["times"]):
                    yield r["role"], r["text"]

        mine = rows()
        yield plan, lines(plan["audit"], mine)
        for _ in mine:
            pass
        plan = following[0] if following else None


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def task(batches):
        out, size = [], 0
        for plan, parts in _conversations(batches):
            for place, (role, text) in enumerate(parts):
                out.append({"conv_id": plan["conv_id"], "place": place, "role": role, "text": text})
                size += len(text) + 100
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _meeting(rows, found).mapInArrow(task, "conv_id long, place long, role string, text string")


def digested(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The plans with the SHA-256 of the repaired ``role:text`` lines, fed line by line."""
    names = ["conv_id", *[f.split()[0] for f in PLAN.split(", ")], "repaired_sha256"]
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in names])

    def task(batches):
        out = []
        for plan, parts in _conversations(batches):
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(parts):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            out.append({c: plan.get(c) for c in names[:-1]} | {"repaired_sha256": digest.hexdigest()})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _meeting(rows, found).mapInArrow(task, f"conv_id long, {PLAN}, repaired_sha256 string")


def prepared(rows: DataFrame, times: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text and how often the row stands there (0: only its conversation counts)."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled,
                       (F.lit(1) if times is None else times).cast("int").alias("times"))


def damaged(rows: DataFrame) -> DataFrame:
    """``prepared`` rows with a fifth of them damaged by the checksum of ``conv_id:turn``."""
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return prepared(rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role").cast("string")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times")), F.col("times"))


def _step(edit: str, cost: str) -> str:
    """SQL: a cell (nine digits of cost, then the audit) with one more edit."""
    return f"lpad((left({{0}}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({{0}}, 10) || '{edit}'"


def _closure(cells: list[str]) -> list[str]:
    """SQL: the cells of the four states after any insertions."""
    one, two = _step("I", str(INSERT)), _step("II", str(2 * INSERT))
    c0, c1, c2, c3 = cells
    return [c0, c1, "least(" + ", ".join([c2, *[one.format(c) for c in (c0, c1, c3)]]) + ")",
            "least(" + ", ".join([c3, one.format(c2), *[two.format(c) for c in (c0, c1)]]) + ")"]


def _after_row() -> list[str]:
    """SQL: the cells after one row without the insertions behind it."""
    out = []
    for q in range(_N):
        ways = [_step("D", str(DELETE)).format(f"c{q}")]
        for p in range(_N):
            for initial, to in STATES[p].items():
                if to == q:
                    ways.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_step('K', 'cut').format(f'c{p}')} END")
                    if initial in "ua":
                        ways.append(f"CASE WHEN NOT gone THEN {_step('R', f'{REROLE} + cut').format(f'c{p}')} END")
        out.append(f"least({', '.join(ways)})")
    return out


_START = ", ".join(f"{sql} AS c{q}" for q, sql in enumerate(_closure([f"'{0:09d}'", *["NULL::VARCHAR"] * 3])))
_ROW = ", ".join(f"{sql} AS c{q}" for q, sql in enumerate(_after_row()))
_NEXT = ", ".join(f"{sql} AS c{q}" for q, sql in enumerate(_closure([f"c{q}" for q in range(_N)])))

# One row after another, four cells a conversation; keys are texts so that nulls meet.
SQL = f"""
WITH RECURSIVE {CRC}
  rows_ AS (
    SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(named)),
        lambda i: ('0x' || substr(hex(encode(named)), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named FROM conversations), crc_table),
  live AS (
    SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM rows_, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
  placed AS (
    SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended,
      row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM live),
  judged AS (
    SELECT *, ended = '' AS blank, ended <> '' AND row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 AS again,
      initial || lead(initial) OVER (PARTITION BY k ORDER BY pos) NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
  ready AS (
    SELECT *, blank OR again AS gone, (NOT blank AND NOT again AND right(ended, 1) NOT IN ('.', '!', '?'))::BIGINT AS cut FROM judged),
  counted AS (
    SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT) AS blank,
      sum(again::BIGINT) AS duplicate, sum(cut) AS truncated, sum(coalesce(illegal, false)::BIGINT) AS illegal, count(*) AS n
    FROM ready GROUP BY k),
  walk AS (
    SELECT k, 0::BIGINT AS step, {_START} FROM (SELECT DISTINCT k FROM rows_)
    UNION ALL
    SELECT k, step, {_NEXT} FROM (SELECT walk.k AS k, step + 1 AS step, {_ROW} FROM walk JOIN ready ON walk.k = ready.k AND pos = step + 1)),
  parsed AS (
    SELECT walk.k, least(c0, c3) AS best FROM walk LEFT JOIN counted ON walk.k = counted.k WHERE step = coalesce(n, 0)),
  edits AS (
    SELECT k, i, substr(best, 9 + i, 1) AS edit FROM parsed, unnest(range(1, strlen(best) - 8)) AS u(i)),
  matched AS (
    SELECT *, sum((edit <> 'I')::BIGINT) OVER (PARTITION BY k ORDER BY i) AS pos FROM edits),
  named AS (
    SELECT m.k, i, edit, r.role, CASE WHEN edit = 'I' THEN '' ELSE r.text END AS text, edit = 'K' AND initial = 's' AS opens
    FROM matched m LEFT JOIN ready r ON m.k = r.k AND m.pos = r.pos WHERE edit <> 'D'),
  lined AS (
    SELECT k, i, CASE WHEN edit = 'K' THEN role
      WHEN sum((NOT coalesce(opens, false))::BIGINT) OVER (PARTITION BY k ORDER BY i) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line
    FROM named),
  joined AS (SELECT k, string_agg(line, chr(10) ORDER BY i) AS whole FROM lined GROUP BY k)
SELECT DISTINCT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, left(best, 9)::BIGINT AS cost,
  substr(best, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM rows_ JOIN parsed USING (k) LEFT JOIN counted USING (k) LEFT JOIN joined USING (k)
"""
