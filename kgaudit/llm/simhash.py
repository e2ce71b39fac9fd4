"""SimHash near-duplicates by multi-index hashing.

A fingerprint falls into two segments of 32 bits. Fingerprints that differ in three bits or fewer differ in at most
one bit of one segment, so each distinct fingerprint probes the tables of both segments with the Hamming ball of
radius one (33 keys), and what the tables return is verified over all 64 bits. Equal fingerprints are one class from
the start: copies cost no pairs.

A segment value that more than ``MOST`` distinct fingerprints share is looked up further: their other segment falls
into two halves of 16 bits, of which one differs in at most one bit, so it is probed in the same way. The 48 bits that
then agree leave at most 65,536 distinct fingerprints to a key.

Defined results: null or empty texts have fingerprint zero, which links like any other; texts of fewer words than a
shingle count as one shingle; ties of a bit (exactly half) give 0; repeated documents share a class; rows without a
doc_id are in their class and link others, and component_id is null where none of a component has a doc_id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import ASCII_LOWER, batches, components, cut, numbered, table, text_bytes

SHINGLE_WORDS, SEED, BITS, MOST = 3, 42, 3, 1000


def fingerprint(data: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer."""
    words = data.translate(ASCII_LOWER).split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(shingle_words)), strict=False) if len(words) >= shingle_words else iter([words])
    ones, total = np.zeros(64, np.int64), 0
    while part := [digest(join(run), SEED) for run in islice(runs, 65_536)]:
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """``(doc_id, fp)`` of every document, or its ``keys`` (columns of longs) and ``fp``."""
    keys = keys or ("doc_id",)
    schema = pa.schema([(key, pa.int64()) for key in (*keys, "fp")])
    rows = lambda b: {key: b[key] for key in keys} | {"fp": [fingerprint(t) for t in text_bytes(b["text"])]}
    texts = docs.select(*(F.col(key).cast("long").alias(key) for key in keys), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(batches(schema, rows), ", ".join(f"{key} long" for key in (*keys, "fp")))


def ball(bits: int) -> Column:
    """The values to flip bits with for all keys of Hamming distance one or less."""
    return F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(bits)))


def halves(value: Column, bits: int) -> Column:
    """Both halves of a value of 2 * bits bits, the upper one with a mark that tells it from the lower."""
    low = value.bitwiseAND(F.lit((1 << bits) - 1))
    return F.array(low, F.shiftrightunsigned(value, bits).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(1 << bits)))


def near_pairs(prints: DataFrame, most: int = MOST) -> DataFrame:
    """``(a, b)``: the fingerprints among the distinct ``(fp)`` that differ in at most BITS bits.

    Keys are many times what the size of the table tells, so they are not to be broadcast.
    """
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    parts = halves(F.col("fp"), 32)
    keyed = prints.select("fp", F.posexplode(parts).alias("half", "key"), F.element_at(parts, 2).alias("high"), F.element_at(parts, 1).alias("low"))
    keyed = keyed.select("fp", "key", F.when(F.col("half") == 0, F.col("high").bitwiseAND(F.lit((1 << 32) - 1))).otherwise(F.col("low")).alias("other"))
    probes = keyed.select(F.col("fp").alias("a"), F.explode(ball(32)).alias("flip"), "key", "other").select("a", "other", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    shared = cut(keyed.groupBy("key").count().filter(F.col("count") > most).select("key"))
    entries = keyed.withColumnRenamed("fp", "b")
    if shared.isEmpty():
        return probes.join(entries.select("b", "key").hint("merge"), "key").filter((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    few = probes.join(entries.join(shared, "key", "left_anti").select("b", "key").hint("merge"), "key").filter((F.col("a") < F.col("b")) & close).select("a", "b")
    deeper = probes.join(shared, "key", "left_semi").select("a", "key", F.explode(halves(F.col("other"), 16)).alias("part"))
    deeper = deeper.select("a", "key", "part", F.explode(ball(16)).alias("flip")).select("a", "key", F.col("part").bitwiseXOR(F.col("flip")).alias("part"))
    below = entries.join(shared, "key", "left_semi").select("b", "key", F.explode(halves(F.col("other"), 16)).alias("part"))
    many = deeper.join(below.hint("merge"), ["key", "part"]).filter((F.col("a") < F.col("b")) & close).select("a", "b")
    return few.union(many).distinct()


def print_roots(prints: DataFrame, most: int = MOST) -> DataFrame:
    """``(fp, root)`` of the distinct fingerprints of ``prints``: a fingerprint that names the component."""
    classes = cut(prints.select("fp").distinct())
    roots = components(near_pairs(classes, most))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id reachable over links of at most BITS differing bits."""
    prints = cut(fingerprints(docs))
    roots = cut(print_roots(prints, most))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = cut(roots.join(least, "root").select("fp", "component_id"))
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The first row of each near-duplicate group, by doc_id, rows without one behind the others; all columns stay."""
    rows, row = numbered(docs)
    prints = cut(fingerprints(rows.select(F.col("doc_id").alias("_id"), F.col(row).alias("_number"), "text"), "_id", "_number"))
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_number"))
    copies = prints.groupBy("fp").agg(first.alias("_first"))  # one row for all copies of a fingerprint, summed up in tasks
    kept = copies.join(print_roots(prints), "fp").groupBy("root").agg(F.min("_first")["_number"].alias("_kept"))
    return rows.join(kept.select("_kept"), F.col(row) == F.col("_kept"), "left_semi").drop(row)
