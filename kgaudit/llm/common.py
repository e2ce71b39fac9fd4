"""Shared pieces: table access, lineage cutting, rolling hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of A-Z mapped to a-z; all others stay.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, and ASCII other than letters and digits mapped to a space.
ASCII_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new temporary one where it is unset and all runs on one machine, as in tests."""
    if not (found := spark.conf.get("spark.checkpoint.dir", "")):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This cuts the lineage; the copy outlives any executor. The write's shuffle files are removed when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it as long as it is taken."""
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, written with a number for each row in a column of a new name, and that name."""
    name = fresh("_row", df.columns)
    return cut(df.withColumn(name, F.monotonically_increasing_id())), name


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def same_text(docs: DataFrame, kept: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that have (``left_semi``) or lack (``left_anti``) a row of ``kept(doc_id, text_hash)``, as ``text_hash`` gives it: a doc_id, or none, with a text."""
    mark = kept.select(F.col("doc_id").alias("_judged_id"), F.col("text_hash").alias("_judged_hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_judged_id")) & (text_hash() == F.col("_judged_hash"))
    return docs.join(mark, same, how)


def text_hash() -> Column:
    """128 bits of a text; null has its own value."""
    return F.coalesce(F.md5("text"), F.lit(""))


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that no plan reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def batches(schema: pa.Schema, rows: Callable[[pa.RecordBatch], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that turns a batch into columns."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return apply


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    binary = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    for value in binary:
        yield value.as_py() or b""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes of byte ranges, modulo 2**64, from prefix sums; ranges of up to ``span`` bytes a chunk."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, span: int, seed: int = 1):
        with np.errstate(over="ignore"):
            self.letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
            self.power = np.cumprod(np.full(span + 1, self.BASE, np.uint64))
            self.inverse = np.cumprod(np.full(span + 1, pow(self.BASE, -1, 2**64), np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.power[: len(data)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        """Of the ranges [start, stop), independent of where they stand."""
        return mix((prefix[stop] - prefix[start]) * self.inverse[: len(prefix)][start])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(node, root)``, root being the component's smallest node.

    Alternating large-star and small-star steps. Minima are pre-aggregated, so a hub doesn't meet in one task; the
    minima are written first, so that both join sides are plain exchanges, which adaptive execution can split.
    Nodes without edges are not returned. Rounds end when a round changes nothing.
    """

    def star(links: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
        both = links.union(links.select("b", "a")) if large else links
        least = cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        joined = both.filter("b > a") if large else both
        moved = joined.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return (moved if large else moved.union(least)).filter("a > b").distinct(), least

    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
        state, old = now, links
        stepped, low1 = star(links, large=True)
        middle = cut(stepped)
        stepped, low2 = star(middle, large=False)
        links = cut(stepped)
        for used in (old, low1, middle, low2):
            drop_cut(used)
