"""Periodic runs of words: Main-Lorentz divide and conquer with Z-functions.

A text's words are interned to numbers. A stretch is halved; runs across its middle are found by two Z-functions: for
each period, how far the words behind the middle agree with those one period on, and how far those before it agree
with those one period back. Where both together reach a period, there is a repetition. One that goes on beyond the
stretch crosses the middle of a larger stretch and is found there; the others are maximal. Of the periods found for an
interval the smallest counts; the others are its multiples.

Each run of at least L words has L/2 words in a row that stand again one period on. So stretches in which no L/2 words
in a row (told by a hash) occur twice are passed over, which no run can be in.

Documents are independent: nothing is shuffled, and a task holds one batch of texts. A text of n words takes time
n log n.

Defined results: a null text is empty; a text without words has no run, and its collapsed text is empty; runs may overlap;
rows without a doc_id and repeated rows are judged like any others; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import mix, table, text_bytes

#: Parameter of the query: words of the shortest run.
LEAST_WORDS = 12
#: A batch of results goes out at about so many bytes of text.
BATCH_BYTES = 8_000_000


def z_function(s: np.ndarray) -> np.ndarray:
    """How long the stretch from each place on agrees with the beginning; only places with the first letter need a look."""
    z = np.zeros(len(s), np.int64)
    letters, known, left, right, n = s.tolist(), {}, 0, 0, len(s)
    for i in np.flatnonzero(s[1:] == s[0]).tolist():
        i += 1
        k = min(known.get(i - left, 0), right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and letters[k] == letters[i + k]:
                k += 1
            left, right = i, i + k
        known[i] = k
    if known:
        z[list(known)] = list(known.values())
    z[0] = n
    return z


def crossing(words: np.ndarray, low: int, middle: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and periods of the repetitions in [low, high) that hold words on both sides of the middle."""
    u, v, gap = words[low:middle], words[middle:high], np.array([-1], words.dtype)
    a, b = len(u), len(v)
    ahead = z_function(np.concatenate((v, gap, u, v)))
    back = z_function(np.concatenate((u[::-1], gap, v[::-1], u[::-1])))
    for most, behind, on, shift in ((b, np.append(ahead[1:b], 0), back[a + 1 : a + 1 + b][::-1], True), (a, ahead[b + 1 : b + 1 + a][::-1], np.append(back[1:a], 0), False)):
        period = np.arange(1, most + 1)
        hit = (behind + on >= period) & (behind + on > 0)
        p = period[hit]
        yield middle - on[hit] - (0 if shift else p), middle + behind[hit] + (p if shift else 0), p


def again(words: np.ndarray, gram: int) -> np.ndarray | None:
    """For each place, the next one at which the same ``gram`` words stand; None if there is none at all."""
    n = len(words) - gram + 1
    if n < 2:
        return None
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = mix(h + words[k : k + n].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return None
    after = np.full(len(words), len(words), np.int64)
    after[order[:-1][same]] = order[1:][same]
    return after


def find_runs(words: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of at least ``least`` words and two periods, by start and period."""
    n, gram = len(words), (least + 1) // 2
    if n < least or (after := again(words, gram)) is None:
        return []
    found: dict[tuple[int, int], int] = {}
    waiting = [(0, n)]
    while waiting:
        low, high = waiting.pop()
        if high - low < least or after[low : high - gram].min() > high - gram:
            continue
        middle = (low + high) // 2
        waiting += [(low, middle), (middle, high)]
        for start, stop, period in crossing(words, low, middle, high):
            long = stop - start >= least
            for s, e, p in zip(start[long].tolist(), stop[long].tolist(), period[long].tolist(), strict=True):
                if (s == low > 0 and words[s - 1] == words[s - 1 + p]) or (e == high < n and words[e] == words[e - p]):
                    continue  # goes on: a larger stretch has it whole
                found[s, e] = min(p, found.get((s, e), p))
    return sorted((s, e - s, p) for (s, e), p in found.items())


def interned(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, from 0."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without what runs repeat: of each run the first period stays, unless another run drops it."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``(doc_id, runs array<struct<start, length, period>>, collapsed)`` of every row. ``prepare`` may change the words first."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, held = [], 0
            for number, text in zip(batch["doc_id"], text_bytes(batch["text"]), strict=True):
                number, words = number.as_py(), text.split()
                if prepare:
                    words = prepare(number, words)
                runs = find_runs(interned(words), least)
                rows.append({"doc_id": number, "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": collapsed(words, runs).decode()})
                held += len(text)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    sql = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, sql)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: those of some documents, told by their number, are made periodic from a place on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % period] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(table(spark, sf_dir, "documents"), prepare=repeated_tail)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = rows.withColumns({"best": best, "listed": listed})
    length = -F.col("best.less")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
