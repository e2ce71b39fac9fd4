"""Benchmark decontamination by greedy string tiling.

Words of a text are hashed; runs of MIN_TILE words are seeds (an item of fewer words is one seed). A document keeps
the runs of words whose seeds are in a bitmap of the items' seeds, sized by their number: what it lets through by
chance costs time and no result. Documents and items that share a seed are candidates. An item isn't looked up by the
seeds that most documents have, as far as the words under these seeds are too few for enough coverage; so an item that
shares a template with others meets the documents with the template only where the template alone covers it.

For each candidate pair, the longest run of words that stands unmarked in both is found by Karp-Rabin hashes of runs,
with a binary search over the length; all matches of this length that touch no marked word are marked, and the hashes
are run again over what is unmarked, until no match of MIN_TILE words is left. The share of an item's words under tiles
is its coverage, whatever their order in the document.

Neither texts nor pairs of copies are shuffled, only kept runs of words. There is one way for item tables of any size.

Defined results: null or empty texts and items match nothing; items of fewer words than a tile match where all their
words stand in sequence; equal items, items that share an id and items without one each get their row; documents that
share a doc_id or have none are each judged by their own text; ties of length go to the smallest positions; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import ASCII_WORDS, Rolling, cut, mix, same_text, table, text_bytes

MIN_TILE, MIN_COVERAGE = 5, 0.6
#: Bits of the bitmap are numbered by so many bits at least and at most (2 and 32 MB), and there are 32 to a seed between.
BITMAP_BITS, MOST_BITMAP_BITS = 24, 28
SPAN = 1 << 16
LONG = SPAN // 2
BASE = 0x9E3779B97F4A7C15
FOUND = pa.schema([("text_hash", pa.string()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64())])
FOUND_SQL = "text_hash string, doc_id long, item_id long, coverage double, tiles long"


def word_hasher() -> Callable[[bytes], np.ndarray]:
    """A function that gives a 64-bit hash of each word of a text; its length alone tells which kind of hash, not its place."""
    rolling, space = Rolling(SPAN + 1), np.array([c == 32 for c in range(256)])

    def hashes(data: bytes) -> np.ndarray:
        data = data.translate(ASCII_WORDS)
        out, at = [], 0
        while at < len(data):
            stop = min(at + SPAN, len(data))
            if stop < len(data) and (gap := data.rfind(b" ", at, stop)) > at:
                stop = gap
            elif stop < len(data):  # a word that doesn't fit the span, so a LONG one
                stop = n if (n := data.find(b" ", stop)) >= 0 else len(data)
                out.append(np.array([xxhash.xxh64_intdigest(w) for w in data[at:stop].split()], np.uint64))
                at = stop
                continue
            part = np.frombuffer(data, np.uint8, stop - at, at)
            inside = np.zeros(len(part) + 2, np.int8)
            inside[1:-1] = ~space[part]
            step = np.diff(inside)
            first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            values = rolling.hashes(rolling.prefix(part), first, last)
            for i in np.flatnonzero(last - first >= LONG):
                values[i] = xxhash.xxh64_intdigest(data[at + first[i] : at + last[i]])
            out.append(values)
            at = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    return hashes


class Runs:
    """Karp-Rabin hashes of the runs of a sequence of word hashes, for any length."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            self.inverse = np.cumprod(np.full(len(words) + 1, pow(BASE, -1, 2**64), np.uint64))
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(np.full(len(words), BASE, np.uint64)))])

    def of(self, n: int) -> np.ndarray:
        """Hashes of the runs of n words, by where they start."""
        if not 0 < n < len(self.prefix):
            return np.zeros(0, np.uint64)
        return mix((self.prefix[n:] - self.prefix[:-n]) * self.inverse[:-n] + np.uint64(n))


def unmarked(marked: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of n words of which none is marked."""
    before = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(before[n:] == before[:-n]) if n <= len(marked) else np.zeros(0, np.int64)


def tiling(item: np.ndarray, text: np.ndarray, at_least: int = MIN_TILE, gaps: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (item position, text position, words) by greedy string tiling; ``gaps`` marks words of the text that no tile may hold."""
    at_least = min(at_least, len(item))
    if not at_least or len(text) < at_least:
        return []
    marked_item, marked_text = np.zeros(len(item), bool), np.zeros(len(text), bool) if gaps is None else gaps.copy()
    of_item, of_text = Runs(item), Runs(text)

    def shared(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of unmarked runs of n words of the item that stand unmarked in the text, and those of the text."""
        mine, theirs = unmarked(marked_item, n), unmarked(marked_text, n)
        a, b = of_item.of(n)[mine], of_text.of(n)[theirs]
        return mine[np.isin(a, b)], theirs[np.isin(b, a)]

    tiles, most = [], len(item)
    while len(shared(at_least)[0]):
        low, high = at_least, most  # what is shared at a length is shared at all smaller ones
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(shared(n)[0]) else (low, n - 1)
        starts, places = shared(low)
        by_hash: dict[int, list[int]] = defaultdict(list)
        for t, value in zip(places[::-1].tolist(), of_text.of(low)[places[::-1]].tolist(), strict=True):
            by_hash[value].append(t)
        new = 0
        for p, value in zip(starts.tolist(), of_item.of(low)[starts].tolist(), strict=True):
            if marked_item[p : p + low].any():
                continue
            waiting = by_hash[value]
            while waiting and marked_text[waiting[-1] : waiting[-1] + low].any():
                waiting.pop()
            if waiting and np.array_equal(item[p : p + low], text[waiting[-1] : waiting[-1] + low]):
                t = waiting.pop()
                marked_item[p : p + low] = marked_text[t : t + low] = True
                tiles.append((p, t, low))
                new += 1
        most = low if new else low - 1
        if most < at_least:
            break
    return tiles


def item_seeds(items: DataFrame) -> DataFrame:
    """``(no, place, seed, length, words)`` of items ``(no, text)``: the seed at each place, its length and that of the item."""
    schema = pa.schema([("no", pa.int64()), ("place", pa.int64()), ("seed", pa.int64()), ("length", pa.int32()), ("words", pa.int64())])

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hasher()
        for batch in it:
            for no, data in zip(batch["no"].to_pylist(), text_bytes(batch["text"]), strict=True):
                words = hashes(data)
                n = min(MIN_TILE, len(words))
                values = Runs(words).of(n).view(np.int64)
                full = lambda x: np.full(len(values), x)
                columns = full(no), np.arange(len(values)), values, full(n), full(len(words))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return items.select("no", "text").mapInArrow(apply, "no long, place long, seed long, length int, words long")


def looked_up(often: np.ndarray, places: np.ndarray, length: int, words: int, min_coverage: float) -> np.ndarray:
    """Which of an item's places are looked up, given how many documents have the seed of each.

    The most frequent are left out while the words under all that are left out are too few for ``min_coverage``. Tiles
    cover words under shared seeds only, so a document that shares none but these seeds can't cover enough.
    """
    covered, under, asked = np.zeros(words, bool), 0, np.ones(len(places), bool)
    for i in np.lexsort((places, -often)).tolist():
        part = covered[places[i] : places[i] + length]
        more = under + len(part) - int(part.sum())
        if more / max(1, words) < min_coverage:
            part[:] = True
            under, asked[i] = more, False
    return asked & (often > 0)


def candidates(kept: DataFrame, seeds: DataFrame, min_coverage: float) -> DataFrame:
    """``(row, no)``: the texts ``kept`` and the items of ``seeds`` that share a seed by which the item is looked up.

    A group is one item's places, so no larger than its text.
    """
    shared = kept.select("row", F.explode("seeds").alias("seed"))
    often = shared.groupBy("seed").agg(F.count("*").alias("often"))
    place = F.struct(F.coalesce("often", F.lit(0)).cast("long").alias("often"), "place", "seed")
    grouped = seeds.join(often, "seed", "left").groupBy("no", "length", "words").agg(F.collect_list(place).alias("places"))
    schema = pa.schema([("no", pa.int64()), ("seed", pa.int64())])

    def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for no, length, words, of_item in zip(*(batch[c].to_pylist() for c in ("no", "length", "words")), batch["places"], strict=True):
                counts, places, values = (of_item.values.field(c).to_numpy() for c in ("often", "place", "seed"))
                found = np.unique(values[looked_up(counts, places, length, words, min_coverage)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), no), pa.int64()), pa.array(found, pa.int64())], schema=schema)

    index = grouped.mapInArrow(choose, "no long, seed long")
    return shared.join(index, "seed").select("row", "no").distinct()


def bitmap_bits(seeds: int) -> int:
    """How many bits number the bits of a bitmap of so many seeds."""
    return min(MOST_BITMAP_BITS, max(BITMAP_BITS, (32 * seeds).bit_length()))


def bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """The set of the seeds' last bits as a bitmap of 2**bits bits; at most 2**(bits - 6) rows come to the driver."""
    low = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    words = seeds.groupBy(F.shiftright(low, 6).cast("int").alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(seed & 63L as int)))").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
    return out


def kept_runs(texts: DataFrame, known: np.ndarray, lengths: list[int], bits: int) -> DataFrame:
    """``(row, text_hash, doc_id, words, gaps, seeds)`` of the texts ``(row, doc_id, text)`` in which a seed is in the bitmap.

    ``words`` are the word hashes of the runs that hold such seeds, with a gap between two runs.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)  # 2**bits bits
    schema = pa.schema([("row", pa.int64()), ("text_hash", pa.string()), ("doc_id", pa.int64()), ("words", pa.binary()), ("gaps", pa.binary()), ("seeds", pa.list_(pa.int64()))])

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes, mask = shared.value, word_hasher(), np.uint64((1 << bits) - 1)
        for batch in it:
            out = []
            for row, doc_id, data in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), text_bytes(batch["text"]), strict=True):
                words, found = hashes(data), []
                cover, runs = np.zeros(len(words) + 1, np.int64), Runs(words)
                for n in lengths:
                    values = runs.of(n)
                    low = values & mask
                    hit = np.flatnonzero(known[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                    found.append(values[hit])
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + n, -1)
                inside = np.cumsum(cover)[:-1] > 0
                if inside.any():
                    keep = inside | np.concatenate([[False], inside[:-1]])  # a run and the word behind it
                    seeds = np.unique(np.concatenate(found)).view(np.int64)
                    out.append((row, hashlib.md5(data).hexdigest(), doc_id, words[keep].tobytes(), (~inside[keep]).tobytes(), seeds))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return texts.mapInArrow(apply, "row long, text_hash string, doc_id long, words binary, gaps binary, seeds array<long>")


def contamination(docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE, bits: int | None = None) -> DataFrame:
    """``(text_hash, doc_id, item_id, coverage, tiles)`` of the pairs whose coverage is at least ``min_coverage``.

    Each row of both tables counts for itself, whatever its id. ``bits`` number the bits of the bitmap; by the seeds if None.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = cut(items.select(F.monotonically_increasing_id().alias("no"), F.col("item_id").cast("long"), F.col("text").cast("string")))
    seeds = cut(item_seeds(items))
    lengths = sorted(r["length"] for r in seeds.select("length").distinct().collect())  # MIN_TILE of them at most
    bits = bits or bitmap_bits(seeds.count())
    kept = cut(kept_runs(texts, bitmap(seeds, bits), lengths, bits))
    pairs = candidates(kept, seeds, min_coverage)
    both = pairs.join(kept.drop("seeds"), "row").join(items.withColumnRenamed("text", "item"), "no").select("text_hash", "doc_id", "words", "gaps", "item_id", "item")

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hasher()
        for batch in it:
            out = []
            for at in range(len(batch)):
                words, gaps = (np.frombuffer(batch[c][at].as_py(), kind) for c, kind in (("words", np.uint64), ("gaps", bool)))
                item = hashes((batch["item"][at].as_py() or "").encode())
                tiles = tiling(item, words, gaps=gaps)
                covered = sum(n for _, _, n in tiles) / max(1, len(item))
                if tiles and covered >= min_coverage:
                    out.append((batch["text_hash"][at].as_py(), batch["doc_id"][at].as_py(), batch["item_id"][at].as_py(), covered, len(tiles)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    return both.mapInArrow(judge, FOUND_SQL)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that cover no item; all columns stay."""
    return same_text(docs, contamination(docs, items), "left_anti")
