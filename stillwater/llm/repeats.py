"""Repeated byte strings, removed by a column-wise collection transform.

A byte goes if some string of ``LENGTH`` bytes that covers it starts anywhere else too.
Texts are cut so that equal strings meet: the anchor of a 200-byte string is the 48-byte
piece in it with the smallest hash, leftmost on a tie, which depends on the string alone.
Strings of a text with the same anchor start in a row and make one fragment, so every
start is in exactly one fragment and equal strings have equal anchors at equal distance.

Fragments with an anchor that occurs once are done. Equal fragments become one row with a
count. The others are the documents of a collection per bucket of anchors, lined up at
the anchor. The transform of the collection is built column by column from the right: a
round reads the next column from a file, inserts its symbol in front of every document's
suffix, re-orders the suffixes by (symbol, order so far), which is the Burrows-Wheeler
order of the lined-up suffixes, and updates common prefixes as one plus the smallest on
the way between two suffixes with equal symbols. Two neighbours with a common prefix of
200 bytes are a repeat that starts in this column. Only suffixes in the same column can
be equal this far, so the order is kept per column; a round is linear in the bucket.

An anchor with more than ``HOT`` different fragments (the edges of a passage that a large
share of all texts has) is not put into one bucket: the strings of its fragments are
counted one by one by a 128-bit hash, spread over all tasks.

Defined cases: null is the empty text; texts of under 200 bytes lose nothing; rows that
agree in id and text are repeats of each other and are cut alike; ids may be null; an
empty table gives no rows. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stillwater.llm.common import written
from stillwater.llm.textwords import Stretches, mixed, ranges

LENGTH = 200
ANCHOR = 48
REACH = LENGTH - ANCHOR + 1  # places of the anchor in a string
HOT = 20_000
BUCKET_BYTES = 6_000_000
CHUNK = 1 << 19
_LOW = np.uint64((1 << 21) - 1)  # a place in a buffer, which may be CHUNK + LENGTH - 2 bytes longer than CHUNK


def fragments(data: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Of texts data[begin:end]: text, first start, number of starts, anchor's distance, hashes of anchor and fragment."""
    n = len(data)
    if n < LENGTH:
        return [np.zeros(0, np.int64)] * 6
    h = Stretches(data)
    at = np.arange(n - ANCHOR + 1)
    piece = h.of(at, at + ANCHOR)
    # The place rides in the low bits, so the smallest value names the leftmost smallest hash.
    key = (piece & ~_LOW) | at.astype(np.uint64)
    block = np.full(-(-len(key) // REACH) * REACH, np.uint64(2**64 - 1))
    block[:len(key)] = key
    block = block.reshape(-1, REACH)
    fore = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.maximum(end - begin - LENGTH + 1, 0)
    s = ranges(begin, starts)
    text = np.repeat(np.arange(len(begin)), starts)
    anchor = (np.minimum(back[s], fore[s + REACH - 1]) & _LOW).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(s)))
    s, text, anchor = s[first], text[first], anchor[first]
    whole = h.of(s, s + many - 1 + LENGTH) ^ mixed((many * 512 + anchor - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, s - begin[text], many, anchor - s, piece[anchor].view(np.int64), whole.view(np.int64)


def _chunks(texts: list[bytes]):
    """(buffer, row, offset in the row, begin, end) of about CHUNK bytes; long texts in overlapping parts."""
    parts, size = [], 0
    for row, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), CHUNK):
            parts.append((row, at, t[at:at + CHUNK + LENGTH - 1]))
            size += len(parts[-1][2])
            if size >= CHUNK:
                yield parts
                parts, size = [], 0
    if parts:
        yield parts


def _cut(batches):
    names = ["doc_id", "th", "s0", "many", "off", "a", "f"]
    for b in batches:
        texts = [t or b"" for t in b["text"].cast(pa.binary()).to_pylist()]
        for parts in _chunks(texts):
            size = np.array([len(p[2]) for p in parts])
            begin = np.cumsum(size) - size
            text, s0, many, off, a, f = fragments(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), begin, begin + size)
            row, at = np.array([p[0] for p in parts])[text], np.array([p[1] for p in parts])[text]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(rows), b["th"].take(rows), pa.array((s0 + at).astype(np.int32)),
                 pa.array(many.astype(np.int16)), pa.array(off.astype(np.int16)), pa.array(a), pa.array(f)], names)


def repeats(texts: list[bytes], off: np.ndarray, many: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """[first, last, first, last, ...] of the repeated starts of each fragment of a bucket."""
    m = len(texts)
    size = np.array([len(t) for t in texts])
    columns = REACH + LENGTH + REACH
    with tempfile.TemporaryFile() as file:
        table = np.memmap(file, np.uint16, "w+", shape=(columns, m))
        buffer, begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
        for j in range(columns):
            place = j - REACH + off
            inside = np.flatnonzero((place >= 0) & (place < size))
            table[j, inside] = buffer[begin[inside] + place[inside]].astype(np.uint16) + 1
        order, prefix = np.arange(m), np.zeros(m + 1, np.int16)
        found = np.zeros((REACH + 1, m), bool)
        for j in range(columns - 1, -1, -1):
            symbol = np.asarray(table[j])[order]
            rank = np.argsort(symbol, kind="stable")
            symbol = symbol[rank]
            new = np.zeros(m + 1, np.int16)  # new[i]: common prefix of suffixes i - 1 and i; zero at both ends
            edges = np.flatnonzero(np.diff(symbol)) + 1
            for lo, hi in zip([0, *edges], [*edges, m]):
                if symbol[lo] and hi - lo > 1:
                    new[lo + 1:hi] = np.minimum.reduceat(prefix, rank[lo:hi] + 1)[:-1] + 1
            order, prefix = order[rank], np.minimum(new, LENGTH)
            if j <= REACH:
                found[j, order] = (prefix[:-1] >= LENGTH) | (prefix[1:] >= LENGTH)
        del table
    out = []
    for i in range(m):
        if counts[i] > 1:
            out.append([0, int(many[i]) - 1])
            continue
        row = np.concatenate([[False], found[REACH - off[i]:REACH - off[i] + many[i], i], [False]])
        edge = np.flatnonzero(row[1:] != row[:-1])
        edge[1::2] -= 1
        out.append(edge.tolist())
    return out



def _texts(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``classes`` (a, f, n, where) with the fragment's bytes, read from one document that has it."""
    wanted = classes.select(F.col("at.th").alias("th"), F.col("at.doc_id").alias("did"), F.struct(
        "a", "f", "n", F.col("at.s0").alias("s0"), F.col("at.many").alias("many"), F.col("at.off").alias("off")).alias("w"))
    wanted = wanted.groupBy("th", "did").agg(F.collect_list("w").alias("w"))
    rows = docs.join(wanted, (docs["th"] == wanted["th"]) & docs["doc_id"].eqNullSafe(wanted["did"])).select("text", "w")

    def read(batches):
        names = ["a", "f", "n", "many", "off", "text"]
        for b in batches:
            for text, wanted in zip(b["text"].cast(pa.binary()), b["w"]):
                t, w = text.as_py(), wanted.as_py()
                yield pa.RecordBatch.from_pylist(
                    [{k: x[k] for k in names[:-1]} | {"text": t[x["s0"]:x["s0"] + x["many"] - 1 + LENGTH]} for x in w],
                    pa.schema([("a", pa.int64()), ("f", pa.int64()), ("n", pa.int64()), ("many", pa.int16()),
                               ("off", pa.int16()), ("text", pa.binary())]))

    # Repeated rows would read a fragment twice.
    return rows.mapInArrow(read, "a long, f long, n long, many short, off short, text binary").dropDuplicates(["a", "f"])


def _bucket(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["a", "f"])
    runs = repeats(g["text"].tolist(), g["off"].to_numpy(np.int64), g["many"].to_numpy(np.int64), g["n"].to_numpy())
    return pd.DataFrame({"a": g["a"].to_numpy(), "f": g["f"].to_numpy(), "runs": runs})


def _strings(batches):
    """Every 200-byte string of the fragments as two hashes."""
    for b in batches:
        for a, f, n, many, text in zip(*(b[c].to_pylist() for c in ("a", "f", "n", "many", "text"))):
            data, at = np.frombuffer(text, np.uint8), np.arange(many)
            h, g = Stretches(data), Stretches(data[::-1])
            one, two = h.of(at, at + LENGTH), g.of(len(data) - at - LENGTH, len(data) - at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(many, a)),
                 pa.array(np.full(many, f)), pa.array(np.full(many, n)), pa.array(at.astype(np.int32))],
                ["one", "two", "a", "f", "n", "at"])


def _hot(rows: DataFrame) -> DataFrame:
    strings = written(rows.mapInArrow(_strings, "one long, two long, a long, f long, n long, at int"))
    many = strings.groupBy("one", "two").agg(F.sum("n").alias("all")).where("all > 1")
    starts = strings.join(many, ["one", "two"]).groupBy("a", "f").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    first = F.filter("starts", lambda x: ~F.array_contains("starts", x - 1))
    last = F.filter("starts", lambda x: ~F.array_contains("starts", x + 1))
    return starts.select("a", "f", F.flatten(F.zip_with(first, last, lambda x, y: F.array(x, y))).alias("runs"))


def spans(docs: DataFrame, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, th, hits (s0, runs) of every document with a repeat; ``docs`` has doc_id, th, text."""
    everything = written(docs.mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, "
                                               "s0 int, many short, off short, a long, f long"))
    # Written first, so that the join has plain shuffles on both sides and can split a hot anchor.
    again = written(everything.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    found = written(everything.join(again, "a"))
    classes = found.groupBy("a", "f").agg(F.count("*").alias("n"), F.min(F.struct("th", "doc_id", "s0", "many", "off")).alias("at"))
    classes = written(classes)
    variants = written(classes.groupBy("a").agg(F.count("*").alias("variants")))
    classes = classes.join(variants, "a")
    alone = classes.where("variants = 1 and n > 1").select(
        "a", "f", F.array(F.lit(0), F.col("at.many").cast("int") - 1).alias("runs"))
    rows = written(_texts(classes.where("variants > 1").select("a", "f", "n", "at"), docs).join(variants, "a"))
    total = rows.where(F.col("variants") <= hot).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    into = max(1, total // bucket_bytes)
    cold = rows.where(F.col("variants") <= hot).withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(into))).groupBy(
        "bucket").applyInPandas(_bucket, "a long, f long, runs array<int>")
    verdict = alone.union(cold).union(_hot(rows.where(F.col("variants") > hot))).where(F.size("runs") > 0)
    hits = found.join(written(verdict), ["a", "f"])
    return hits.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s0", "runs")).alias("hits"))


def merged(hits: list[dict] | None) -> list[list[int]]:
    """Removed stretches of a text, in order, from the repeated starts."""
    found = sorted([h["s0"] + a, h["s0"] + b + LENGTH] for h in hits or [] for a, b in zip(h["runs"][0::2], h["runs"][1::2]))
    out: list[list[int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove(docs: DataFrame, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = written(spans(d, hot, bucket_bytes)).withColumnRenamed("doc_id", "did").withColumnRenamed("th", "sh")
    rows = d.join(found, (F.col("th") == F.col("sh")) & F.col("doc_id").eqNullSafe(F.col("did")), "left")

    def cut(batches):
        names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for b in batches:
            out = {k: [] for k in names[1:]}
            for text, hits in zip(b["text"].cast(pa.binary()), b["hits"]):
                t, gone = text.as_py(), merged(hits.as_py())
                edges = [0, *(x for span in gone for x in span), len(t)]
                kept = b"".join(t[a:z] for a, z in zip(edges[0::2], edges[1::2]))
                for k, v in zip(names[1:], (kept, len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())):
                    out[k].append(v)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(out[k], t) for k, t in zip(names[1:], kinds)]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "hits").mapInArrow(
        cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
