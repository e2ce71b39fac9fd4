"""Removal of repeated substrings by bucket-pointer refinement.

The suffixes that can start a repeat are put into q-gram buckets, and the buckets are refined by the bucket numbers of
later offsets until they tell strings of the full length apart.

1. Initial buckets. A window is a start of a 50-byte string; its anchor is the least hashed 20-gram in it, which
   depends on the window's bytes alone. Consecutive windows of one anchor form a node with a bucket (the anchor's
   20-gram) and a context (all bytes that its windows cover). A bucket that one document holds alone can't hold a
   repeat and is dropped; a node whose whole context also stands in a smaller document is settled, all its windows
   repeat. What is left are the nodes at the edges of repeats.
2. Refinement. The suffixes at all offsets of a bucket's contexts are sorted by their first 8 bytes, which gives each
   its bucket number; then by the pair of their own number and that 8 bytes on, which gives numbers of 16 bytes; with
   these, in the same way, of 32; and the windows by those of 32 bytes at offsets 0 and 18, which together are all 50.
   Numbers are ranks of bytes, so no repeat rests on a hash. Windows of one number repeat but for the smallest document.
3. The repeating windows of a document are joined to its text, and the covered bytes removed.

Copies inside a batch are settled before the shuffle, so that a passage that stands everywhere costs a row for each
batch, not for each document. Sorted rows are streamed. A bucket of more than ``MOST`` nodes, as that of a frequent
line between differing neighbours, is not refined in one task: its windows are grouped by their 50 bytes, with the
smallest document of each pre-aggregated. Whole contexts are compared by two hashes of 64 bits each.

Defined results: null and empty texts have no bytes; texts under 50 bytes keep all; equal documents are removed but
for the smallest doc_id; a repeat inside one document stays unless a smaller document has it; rows that repeat a
doc_id are judged row by row, and none of them takes bytes from another; rows without a doc_id keep all bytes and take
none from others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import Rolling, cut, drop_cut, table, text_bytes

LENGTH, GRAM, CHUNK, MOST = 50, 20, 1 << 18, 8192
SIDE = LENGTH - GRAM + 1
#: Lengths of the refined buckets below LENGTH; each is twice the one before.
LENGTHS = (8, 16, 32)
#: place holds the start, whether settled, and the number of windows; tag tells rows of one doc_id apart.
NODES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("place", pa.int64()), ("check", pa.int64())])
NODES_SQL = "key long, doc_id long, tag int, place long, check long"
RUNS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()), ("windows", pa.int64()), ("settled", pa.bool_())])
RUNS_SQL = "key long, doc_id long, tag int, start long, windows long, settled boolean"
CONTEXTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()), ("context", pa.binary())])
CONTEXTS_SQL = "key long, doc_id long, tag int, start long, context binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()), ("windows", pa.int64())])
FOUND_SQL = "doc_id long, tag int, start long, windows long"
WINDOWS_BITS = 20
START_AT = WINDOWS_BITS + 1
SETTLED, WINDOWS = np.int64(1 << WINDOWS_BITS), np.int64((1 << WINDOWS_BITS) - 1)


def chunks(data: bytes, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that together hold each window once, so that memory stays bounded for any length."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole) - LENGTH + 1, size):
        yield at, whole[at : at + size + LENGTH - 1]


def anchors(data: bytes, size: int, r: Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """Start, number of windows, bucket and context of the nodes of a text."""
    mask = np.uint64((1 << (2 * size).bit_length()) - 1)
    for at, part in chunks(data, size):
        prefix = r.prefix(part)
        grams = len(part) - GRAM + 1
        bucket = r.hashes(prefix, slice(0, grams), slice(GRAM, None))
        low = (bucket & ~mask) | np.arange(grams, dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: -(SIDE - 16)], low[SIDE - 16 :]) & mask
        first = np.concatenate([[0], np.flatnonzero(np.diff(low)) + 1])
        windows = np.append(first[1:], len(low)) - first
        context = r.hashes(prefix, first, first + windows - 1 + LENGTH)
        yield at + first, windows, bucket[low[first].astype(np.int64)], context ^ windows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def settle_inside(parts: list[tuple]) -> pa.RecordBatch:
    """Nodes ``(doc_id, tag, start, windows, key, check)`` of a batch; those that a smaller document of the batch settles are joined to runs."""
    sizes = [len(p[2]) for p in parts]
    doc, tag = np.repeat(np.array([p[0] for p in parts], np.int64), sizes), np.repeat(np.array([p[1] for p in parts], np.int32), sizes)
    start, windows, key, check = (np.concatenate([p[i] for p in parts]) for i in range(2, 6))
    by_doc = np.argsort(doc, kind="stable")
    order = by_doc[np.argsort(check[by_doc], kind="stable")]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(check[order]) != 0]))
    first = np.repeat(order[begins], np.diff(np.append(begins, len(order))))
    settled = np.zeros(len(doc), bool)
    settled[order] = (doc[order] > doc[first]) & (key[order] == key[first])
    left = ~settled
    out = [(key[left].view(np.int64), doc[left], tag[left], start[left] << START_AT | windows[left], check[left].view(np.int64))]
    doc, tag, start, windows = doc[settled], tag[settled], start[settled], windows[settled]
    if len(doc):
        order = np.lexsort((start, tag, doc))
        doc, tag, start, windows = doc[order], tag[order], start[order], windows[order]
        far = start >> (WINDOWS_BITS - 1)  # a run's windows must fit their bits
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + windows[:-1]) | (far[1:] != far[:-1])]))
        last = np.append(new[1:] - 1, len(doc) - 1)
        doc, tag, length, start = doc[new], tag[new], start[last] + windows[last] - start[new], start[new]
        spread = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64)).view(np.int64)
        out.append((spread, doc, tag, start << START_AT | SETTLED | length, np.zeros(len(doc), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(5)], schema=NODES)


def initial(size: int) -> Callable:
    """A mapInArrow function from texts to the rows of their nodes."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rolling(size + LENGTH)
        for batch in it:
            parts, held = [], 0
            for doc_id, tag, data in zip(batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), text_bytes(batch["text"]), strict=True):
                for part in anchors(data, size, r):
                    parts.append((doc_id, tag, *part))
                    held += len(part[0])
                    if held >= 2_000_000:
                        yield settle_inside(parts)
                        parts, held = [], 0
            if parts:
                yield settle_inside(parts)

    return apply


def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled nodes, and the others of buckets that hold several documents, from rows sorted by (key, check, doc_id) with all of a key in one partition.

    Kept between batches are the last row's class and its smallest document, and the unsettled nodes of the last bucket
    as long as they are of one document.
    """
    last, opened, held = (None, None, None), None, [np.zeros(0, f.type.to_pandas_dtype()) for f in list(RUNS)[:5]]
    for batch in it:
        if not batch.num_rows:
            continue
        key, doc, tag, place, check = (batch[f.name].to_numpy(zero_copy_only=False) for f in NODES)
        new = np.concatenate([[(key[0], check[0]) != last[:2]], (np.diff(key) != 0) | (np.diff(check) != 0)])
        low = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if not new[0]:
            low[: np.argmax(np.append(new, True))] = last[2]
        settled = (place & SETTLED > 0) | (doc > low)
        last = key[-1], check[-1], low[-1]
        rows = [key, doc, tag, place >> START_AT, place & WINDOWS]
        done, left = [c[settled] for c in rows], [np.concatenate([h, c[~settled]]) for h, c in zip(held, rows, strict=True)]
        if len(left[0]):
            begins = np.flatnonzero(np.concatenate([[True], np.diff(left[0]) != 0]))
            several = np.minimum.reduceat(left[1], begins) < np.maximum.reduceat(left[1], begins)
            several[0] |= left[0][0] == opened
            keep = np.repeat(several, np.diff(np.append(begins, len(left[0]))))
            opened = left[0][-1] if several[-1] else None
            held = [c[len(c) if several[-1] else begins[-1] :] for c in left]
            left = [c[keep] for c in left]
        columns = [np.concatenate(pair) for pair in zip(done, left, strict=True)]
        columns.append(np.arange(len(columns[0])) < len(done[0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUNS, strict=True)], schema=RUNS)


def contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the nodes ``(doc_id, tag, text, nodes[])``."""
    for batch in it:
        out, held = [], 0
        for doc_id, tag, data, nodes in zip(batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), text_bytes(batch["text"]), batch["nodes"], strict=True):
            for key, start, windows in zip(*(nodes.values.field(i).to_pylist() for i in range(3)), strict=True):
                out.append((key, doc_id, tag, start, data[start : start + windows + LENGTH - 1]))
            held += len(nodes)
            if held >= 200_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(CONTEXTS)], schema=CONTEXTS)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(CONTEXTS)], schema=CONTEXTS)


def numbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bucket numbers: ranks of the pairs of two numbers."""
    return np.unique(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64), return_inverse=True)[1]


def windows_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset in all bytes of the contexts, and bucket number of each window of whole buckets."""
    column = rows["context"]
    end = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[end[0] : end[-1]]
    begin, size = end[:-1] - end[0], np.diff(end) - LENGTH + 1
    row = np.repeat(np.arange(len(column)), size)
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    number = np.unique(np.lib.stride_tricks.sliding_window_view(data, LENGTHS[0]).copy().view(np.uint64)[:, 0], return_inverse=True)[1]
    for length in LENGTHS[:-1]:  # suffixes across two contexts get numbers too, which no window asks for
        number = numbered(number[:-length], number[length:])
    return row, at, numbered(number[at], number[at + LENGTH - LENGTHS[-1]])


def refine(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs ``(doc_id, tag, start, windows)`` of the windows that a smaller document has too, from contexts sorted by key, all of a key in one partition."""

    def repeats(rows: pa.RecordBatch) -> pa.RecordBatch:
        row, at, number = windows_of(rows)
        doc = rows["doc_id"].to_numpy()
        low = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, number, doc[row])
        mine = np.flatnonzero(doc[row] > low[number])
        row, at = row[mine], at[mine]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(at) != 1)])) if len(mine) else mine
        length = np.diff(np.append(new, len(mine)))
        first = np.concatenate([[0], np.cumsum(pa.compute.binary_length(rows["context"]).to_numpy())])[row[new]]
        picked = rows.take(pa.array(row[new]))
        return pa.RecordBatch.from_arrays([picked["doc_id"], picked["tag"], pa.array(picked["start"].to_numpy() + at[new] - first), pa.array(length)], schema=FOUND)

    waiting, many = [], 0
    for batch in it:
        key = batch["key"].to_numpy()
        if not len(key):
            continue
        if many >= MOST:  # whole buckets, but for those of the last key
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            old = rows["key"].to_numpy()
            split = int(np.searchsorted(old, old[-1]))
            if key[0] != old[-1]:
                split = len(old)
            if split:
                yield repeats(rows.slice(0, split))
            waiting = [rows.slice(split)] if split < len(old) else []
            many = len(old) - split
        waiting.append(batch)
        many += len(key)
    if waiting:
        yield repeats(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])


def repeating_windows(docs: DataFrame, size: int = CHUNK, most: int = MOST) -> DataFrame:
    """``(doc_id, tag, start, windows)``: runs of windows that a document with a smaller doc_id also has."""
    texts = tagged(docs).filter("doc_id is not null")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = cut(texts.mapInArrow(initial(size), NODES_SQL).repartition(n, "key").sortWithinPartitions("key", "check", "doc_id").mapInArrow(settle, RUNS_SQL))
    nodes = level.filter("not settled").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("key", "start", "windows")).alias("nodes"))
    edges = cut(texts.join(nodes, ["doc_id", "tag"]).select("doc_id", "tag", "text", "nodes").mapInArrow(contexts, CONTEXTS_SQL))
    large = cut(edges.groupBy("key").count().filter(F.col("count") > most).select("key"))
    inside = cut(edges.join(large, "key", "left_anti").select(*CONTEXTS.names).repartition(n, "key").sortWithinPartitions("key").mapInArrow(refine, FOUND_SQL))
    # a large bucket's windows by their bytes
    place = F.explode(F.sequence(F.lit(0), F.octet_length("context") - LENGTH)).alias("i")
    spread = edges.join(large, "key", "left_semi").select("doc_id", "tag", "start", "context", place)
    spread = spread.select("doc_id", "tag", (F.col("start") + F.col("i")).alias("start"), F.substring("context", F.col("i") + 1, F.lit(LENGTH)).alias("window"))
    lowest = spread.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    between = spread.join(lowest.hint("merge"), "window").filter("doc_id > low").select("doc_id", "tag", "start", F.lit(1).cast("long").alias("windows"))
    found = cut(level.filter("settled").select("doc_id", "tag", "start", "windows").union(inside).union(between))
    for used in (level, edges, large, inside):
        drop_cut(used)
    return found


def tagged(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, text)``; the tag is a hash of the text, which tells rows of one doc_id apart."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.select("doc_id", F.hash("text").alias("tag"), "text")


def cover(start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows cover."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate((start + windows + LENGTH - 1)[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[new], stop[np.append(new[1:] - 1, len(stop) - 1)] if len(start) else start


def removal(docs: DataFrame, size: int = CHUNK, most: int = MOST) -> DataFrame:
    """``(doc_id, kept binary, n_bytes, n_removed, spans)`` of every row; spans are [start, stop) byte ranges.

    Texts are walked in pieces of ``size`` bytes; buckets of more than ``most`` nodes are spread. Neither changes results.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def cut_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [[], [], [], []]
            for data, starts, sizes in zip(text_bytes(batch["text"]), batch["starts"], batch["sizes"], strict=True):
                if not starts.is_valid or not len(starts):
                    row = (data, len(data), 0, [])
                else:
                    begin, end = cover(np.array(starts.values), np.array(sizes.values))
                    keep = np.ones(len(data), bool)
                    for a, b in zip(begin, end, strict=True):
                        keep[a:b] = False
                    row = (np.frombuffer(data, np.uint8)[keep].tobytes(), len(data), int((~keep).sum()), np.stack([begin, end], 1).tolist())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    windows = repeating_windows(docs, size, most).groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("sizes"))
    found = tagged(docs).join(windows, ["doc_id", "tag"], "left").select("doc_id", "text", "starts", "sizes")
    return found.mapInArrow(cut_out, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<array<long>>")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
pieces AS (SELECT doc_id, low, substr(h, 2 * low + 1, 1098) AS piece FROM (SELECT doc_id, h, unnest(range(0, n - 49, 500)) AS low FROM d)),
w AS (SELECT doc_id, low + i AS i, substr(piece, 2 * i + 1, 100) AS s FROM (SELECT doc_id, low, piece, unnest(range(0, least(length(piece) // 2 - 49, 500))) AS i FROM pieces)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY 1),
c AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s WHERE w.doc_id > f.low),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM c),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, n, n FROM d),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS after FROM e),
q AS (SELECT p.doc_id, sum(b - a) AS n_removed, count(*) FILTER (b > a) AS n_spans, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a, b) AS kept FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN q ON d.doc_id = q.doc_id
"""
