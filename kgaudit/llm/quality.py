"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of target text (a sample of documents labelled good), one of
the raw corpus (all documents). A document's mean log ratio of its n-grams under both, with PRIOR n-grams without
evidence added, so that few words decide little, is its evidence. The cut is where the evidence best parts the labelled
documents that are held out, and the scale that makes the evidence beyond the cut the log odds of being good is fitted
to the same documents: this is the log weight. As many documents are taken as have even odds or better; those of the
largest sum of weight and Gumbel noise are selected, which is a sample without replacement in proportion to the odds.

n-grams are words, pairs of words and pairs of word shapes (case, length, punctuation, whether the word repeats the
one before).

At most ``max_labelled`` labels are used, those of the least hashes: a bounded sample to fit on. The raw model, the
weights and the selection cover all documents.

Defined results: null, empty and blank texts have a null weight and are not selected; labels that are null or that
contradict each other for a doc_id don't count; with no label of either kind, every document with words is selected;
equal scores at the cut are all selected; rows are judged each by its text, whatever its doc_id, and rows that repeat
all alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import Rolling, cut, mix, same_text, table, text_bytes, text_hash

BUCKET_BITS, PRIOR, MAX_LABELLED, LOSS, SEED, SPAN = 16, 16, 20_000, 0.01, 11, 1 << 16


def featurizer() -> Callable[[bytes], Iterator[np.ndarray]]:
    """A function that gives the buckets of the n-grams of a text, in pieces of bounded size."""
    code = np.arange(256)
    rolling, space, upper = Rolling(SPAN + 1, 3), (code == 32) | (code >= 9) & (code <= 13), (code >= 65) & (code <= 90)
    lower = np.where(upper, code + 32, code).astype(np.uint8)
    mark = (code > 32) & (code < 127) & ~((code >= 48) & (code <= 57) | upper | (code >= 97) & (code <= 122))

    def features(data: bytes) -> Iterator[np.ndarray]:
        whole = np.frombuffer(data, np.uint8)
        at = 0
        while at < len(whole):
            stop = min(at + SPAN, len(whole))
            if stop < len(whole) and len(gaps := np.flatnonzero(space[whole[at:stop]])):
                stop = at + int(gaps[-1]) + 1
            part = whole[at:stop]
            at = stop
            inside = np.zeros(len(part) + 2, np.int8)
            inside[1:-1] = ~space[part]
            step = np.diff(inside)
            first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            if not len(first):
                continue
            word = rolling.hashes(rolling.prefix(lower[part]), first, last)
            big, odd = (np.concatenate([[0], np.cumsum(x[part])]) for x in (upper, mark))
            length = np.minimum(np.log2(last - first + 1), 7).astype(np.int64)
            shape = (np.minimum(big[last] - big[first], 3) * 64 + np.minimum(odd[last] - odd[first], 3) * 16 + length * 2 + upper[part[first]]).astype(np.uint64)
            pair = mix(word[:-1] * np.uint64(3) + word[1:] + np.uint64(5))
            shapes = mix((shape[:-1] * np.uint64(1021) + shape[1:]) * np.uint64(2) + (word[1:] == word[:-1]) + np.uint64(1 << 40))
            yield (np.concatenate([word, pair, shapes]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    return features


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """``(doc_id, text, role)``: role 1 and 0 fit and test a good document, 2 tests a bad one, else null."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    known = known.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    known = known.orderBy(F.xxhash64(F.lit(SEED), "label_id"), "label_id").limit(max_labelled)
    role = F.when(F.col("low") == 0, 2).otherwise(F.pmod(F.xxhash64(F.lit(SEED + 1), "label_id"), F.lit(2)).cast("int"))
    known = F.broadcast(known.select("label_id", role.alias("role")))  # max_labelled rows of two numbers at most
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(known, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "text", "role")


def models(texts: DataFrame) -> np.ndarray:
    """Log ratio of target to raw frequency of each bucket."""
    n = 1 << BUCKET_BITS
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, features = np.zeros(n, np.int64), np.zeros(n, np.int64), featurizer()
        for batch in it:
            for data, role in zip(text_bytes(batch["text"]), batch["role"].to_pylist(), strict=True):
                for part in features(data):
                    seen = np.bincount(part, minlength=n) if len(part) > n // 8 else None
                    for into in (raw, target) if role == 1 else (raw,):
                        if seen is None:
                            np.add.at(into, part, 1)
                        else:
                            into += seen
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], schema=schema)

    counted = texts.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(n), np.zeros(n)
    for row in counted.collect():  # 2**BUCKET_BITS rows at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(n)
    base = (raw + 1) / (raw + 1).sum()
    return np.log((target + 1000 * base) / (target.sum() + 1000)) - np.log(base)


def weights(texts: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``(doc_id, text_hash, role, draw, evidence)``; draw is a hash by which the noise is drawn."""
    shared = texts.sparkSession.sparkContext.broadcast(ratio)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.string()), ("role", pa.int32()), ("draw", pa.int64()), ("evidence", pa.float64())])

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, features = shared.value, featurizer()
        for batch in it:
            out = []
            for data in text_bytes(batch["text"]):
                total = n = 0
                for part in features(data):
                    total += ratio[part].sum()
                    n += len(part)
                out.append(total / (n + PRIOR) if n else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], batch["role"], batch["draw"], pa.array(out, pa.float64())], schema=schema)

    drawn = texts.withColumns({"draw": F.xxhash64(F.lit(SEED), "doc_id", "text"), "text_hash": text_hash()})
    return drawn.mapInArrow(weigh, "doc_id long, text_hash string, role int, draw long, evidence double")


def log_odds(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Cut and scale: ``scale * (evidence - cut)`` are the log odds of being good. Without either kind the cut is below everything."""
    if not len(good) or not len(bad):
        return -np.inf, 0.0
    cut_at = best_cut(good, bad)
    x = np.concatenate([good, bad]) - cut_at
    goal = np.repeat([(len(good) + 1) / (len(good) + 2), 1 / (len(bad) + 2)], [len(good), len(bad)])  # never quite sure
    weight = np.repeat([0.5 / len(good), 0.5 / len(bad)], [len(good), len(bad)])
    low, high = 0.0, 100 / max(np.abs(x).max(), 1e-9)
    for _ in range(60):  # the loss is convex: where its slope is zero
        scale = (low + high) / 2
        slope = (weight * x * (1 / (1 + np.exp(-np.clip(scale * x, -500, 500))) - goal)).sum()
        low, high = (scale, high) if slope < 0 else (low, scale)
    return cut_at, (low + high) / 2


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The evidence that parts good from bad documents.

    Of all cuts that lose at most ``LOSS`` more than the best one, that in the middle of the widest gap, so that
    documents a little unlike the labelled ones fall on the right side.
    """
    good, bad = np.sort(good), np.sort(bad)
    every = np.unique(np.concatenate([good, bad]))
    at = np.concatenate([[every[0] - 1], (every[1:] + every[:-1]) / 2, [every[-1] + 1]])
    lost = np.searchsorted(good, at) / len(good) + 1 - np.searchsorted(bad, at) / len(bad)
    gap = np.concatenate([[0], np.diff(every), [0]])
    return float(at[np.argmax(np.where(lost <= lost.min() + LOSS, gap, -1))])


def kth_largest(scored: DataFrame, k: int) -> float:
    """The k-th largest ``score``, by counting in ever finer bins; no sort of all rows."""
    low, high, above = *scored.agg(F.min("score"), F.max("score")).first(), 0
    while low < high:
        width = (high - low) / 4096
        if low + width <= low or high - width >= high:
            break
        inside = scored.filter(F.col("score").between(low, high))
        bins = inside.groupBy(F.least(F.floor((F.col("score") - low) / width), F.lit(4095)).alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for row in sorted(bins.collect(), reverse=True):  # 4096 rows at most
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low


def quality_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, text_hash, log_weight, score, selected)`` of every document."""
    texts = labelled(docs, labels, max_labelled)
    weighed = cut(weights(texts, models(texts)))
    tested = weighed.filter("role in (0, 2) and evidence is not null").select("role", "evidence").collect()  # of the bounded sample
    at, scale = log_odds(*(np.array([r["evidence"] for r in tested if r["role"] == x]) for x in (0, 2)))
    odds = F.lit(scale) * (F.col("evidence") - F.lit(at)) if np.isfinite(at) else F.when(F.col("evidence").isNotNull(), 0.0)
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    scored = weighed.select("doc_id", "text_hash", odds.alias("log_weight"), (odds - F.log(-F.log(u))).alias("score"))
    k = scored.filter("log_weight >= 0").count()
    bound = kth_largest(scored.filter("score is not null"), k) if k else float("inf")
    return scored.withColumn("selected", F.coalesce(F.col("score") >= F.lit(bound), F.lit(False)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected documents; all columns stay."""
    return same_text(docs, quality_sample(docs, labels).filter("selected"), "left_semi")
