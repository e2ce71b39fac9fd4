"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

A source's documents, in an order permuted by hash, form one stream of words, which may be read twice. The words that
the source owes the mix are the head of that stream, cut into blocks. A binary tree splits the block quotas of all
sources among the output shards: at every node, the left half gets its exact number of blocks, drawn without
replacement from the node's blocks (a multivariate hypergeometric draw, by inversion, source after source). A shard
then takes the next blocks of each source's permuted stream, so that blocks are disjoint, and orders them by hash.

The order within a source is a prefix sum in two levels, buckets of hashes and rows in a bucket; a source that holds a
third of all rows is spread over all buckets. Only ids and sizes are shuffled, not texts. A node of the tree holds a
number for each source, and targets are ordered over all sources, so sources are to be far fewer than documents.

Defined results: null and empty texts have size 0 and are never taken; a null source is one source, last in order;
repeated rows take their own places in the stream; equal hashes are ordered by doc_id and size; sources that are full
at the same rate are ordered by name; extra columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgaudit.llm.common import cut, drop_cut, fresh, numbered, table

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK_WORDS, SHARD_BLOCKS, SEED, BUCKET_DIGITS, LEVELS = 1024, 4096, 7, 3, 6
WORD, WORD_AND_GAP, GAP_BEHIND = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r"[\x20\x09-\x0D]+$"


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``(doc_id, source, size, id)``: sizes in words, and a number of the row where a column holds one."""
    number = F.col(row) if row else F.lit(None).cast("long")
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), number.alias("id"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)``: shares by weight, none above ``most`` times its source's size.

    Sources are ordered by the rate at which they are full. Those before the first that isn't full at the common rate
    of the rest keep their cap; the rest share what is left by weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_rate = W.orderBy("rate", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    source = source.withColumn("cap", most * F.col("source_size")).withColumn("rate", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(by_rate.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(by_rate.rowsBetween(0, W.unboundedFollowing))
    source = source.withColumns({"common": (share * F.sum("source_size").over(everything) - before) / behind, "place": F.row_number().over(by_rate)})
    level = F.min(F.when(F.col("common") <= F.col("rate"), F.struct("place", "common"))).over(everything)["common"]
    return source.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), "cap")).alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a plain Column would be computed wherever it stands."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(marked: Column, pool: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` of ``pool`` blocks are among ``marked``: the inverse of the distribution at ``u``.

    Weights relative to the most likely value are added up outwards from it, as far as they can matter.
    """

    def bounds(s: Column) -> Column:
        m, n, d = s["m"], s["n"], s["d"]
        low, high = F.greatest(F.lit(0.0), d - (n - m)), F.least(m, d)
        mode = F.floor((d + 1) * (m + 1) / (n + 2)).cast("double")
        reach = F.ceil(12 * F.sqrt(d * m * (n - m) * (n - d) / F.greatest(n * n * (n - 1), F.lit(1.0))) + 12).cast("double")
        return F.struct(m.alias("m"), n.alias("n"), d.alias("d"), s["u"].alias("u"), F.least(F.greatest(mode, low), high).alias("mode"), low.alias("low"), high.alias("high"), reach.alias("reach"))

    def walk(s: Column, rising: bool, goal: Column) -> Column:
        """Sum of the weights on one side of the mode, and the first value at which ``goal`` is reached."""
        m, n, d = s["m"], s["n"], s["d"]
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"))
        steps = F.sequence(F.lit(0), F.least(s["high"] - s["mode"] if rising else s["mode"] - s["low"], s["reach"]).cast("int"))

        def add(t: Column, i: Column) -> Column:
            k = s["mode"] + i if rising else s["mode"] - i
            ratio = (m - k) * (d - k) / ((k + 1) * (n - m - d + k + 1)) if rising else k * (n - m - d + k) / ((m - k + 1) * (d - k + 1))
            total = t["sum"] + t["w"] if rising else t["sum"] + F.when(i > 0, t["w"]).otherwise(0.0)
            return let(total, lambda x: F.struct((t["w"] * ratio).alias("w"), x.alias("sum"), F.when((t["at"] < 0) & (x >= goal), k).otherwise(t["at"]).alias("at")))

        return F.aggregate(steps, start, add)

    def invert(s: Column) -> Column:
        never = F.lit(float("inf"))
        sums = F.struct(walk(s, True, never)["sum"].alias("over"), walk(s, False, never)["sum"].alias("under"))

        def reached(t: Column) -> Column:
            goal = F.struct((s["u"] * (t["over"] + t["under"])).alias("above"), (s["u"] * (t["over"] + t["under"]) - t["over"]).alias("below"))
            return let(goal, lambda g: F.when(g["below"] <= 0, walk(s, True, g["above"])["at"]).otherwise(walk(s, False, g["below"])["at"]))

        return let(let(sums, reached), lambda k: F.when(k >= 0, k).otherwise(s["mode"]).cast("long"))

    given = F.struct(*(x.cast("double").alias(n) for x, n in ((marked, "m"), (pool, "n"), (draws, "d"), (u, "u"))))
    return let(let(given, bounds), invert)


def split(nodes: DataFrame) -> DataFrame:
    """Both children of each node ``(path, quotas array<struct<source_no, blocks>>, total)`` of the tree."""
    start = F.struct((F.col("total") - F.floor(F.col("total") / 2)).alias("draws"), F.col("total").alias("pool"), F.expr("cast(array() as array<long>)").alias("left"))

    def draw(s: Column, q: Column) -> Column:
        some = hypergeometric(q["blocks"], s["pool"], s["draws"], uniform(F.lit(SEED), F.col("path"), q["source_no"]))
        got = F.when((s["draws"] > 0) & (q["blocks"] > 0), some).otherwise(F.lit(0).cast("long"))
        return let(got, lambda x: F.struct((s["draws"] - x).alias("draws"), (s["pool"] - q["blocks"]).alias("pool"), F.array_append(s["left"], x).alias("left")))

    drawn = nodes.withColumn("left", F.aggregate("quotas", start, draw)["left"])
    child = lambda side: F.zip_with(
        "quotas", "left", lambda q, x: F.struct(q["source_no"].alias("source_no"), (x if side == 0 else q["blocks"] - x).alias("blocks"))
    )
    both = F.explode(F.array(*(F.struct((F.col("path") * 2 + side).alias("path"), child(side).alias("quotas")) for side in (0, 1))))
    children = drawn.select(both.alias("c")).select("c.path", "c.quotas")
    return children.withColumn("total", F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q["blocks"]))


def shard_blocks(source: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``(source, block, shard)`` for every block that the mix takes, from ``(source, source_size, target)``."""
    owed = source.withColumn("blocks", F.ceil(F.round("target") / block_words).cast("long"))
    numbers = owed.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    root = numbers.agg(F.sort_array(F.collect_list(F.struct("source_no", "blocks"))).alias("quotas"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("total"))
    total = root.first()["total"]
    depth = max(0, (total - 1).bit_length() - (shard_blocks - 1).bit_length())
    nodes = root.select(F.lit(1).cast("long").alias("path"), "quotas", "total")  # children of p are 2p and 2p + 1, so that no two nodes share their draws
    for level in range(depth):
        if level and level % LEVELS == 0:  # one task a node from here on
            nodes = cut(nodes.repartition("path"))
        nodes = split(nodes)
    leaf = nodes.select((F.col("path") - (1 << depth)).alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.source_no", "q.blocks")
    until = F.sum("blocks").over(W.partitionBy("source_no").orderBy("shard"))
    ranges = leaf.withColumn("stop", until).filter("blocks > 0").join(numbers.select("source_no", "source"), "source_no")
    return ranges.select("source", F.explode(F.sequence(F.col("stop") - F.col("blocks"), F.col("stop") - 1)).alias("block"), "shard")


def streams(sized: DataFrame) -> DataFrame:
    """Adds ``at``, the place of a document's first word in its source's permuted stream, and ``bucket, row``, which name the document."""
    hashed = sized.withColumn("hash", F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    hashed = hashed.withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS)).withColumn("hash", F.unhex("hash"))
    bucket = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_source = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bucket = bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)).alias("base"))
    in_bucket = W.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size", "id")
    placed = hashed.withColumn("row", F.row_number().over(in_bucket))
    placed = placed.withColumn("within", F.sum("size").over(in_bucket.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    return placed.join(bucket, same).select("doc_id", "source", "size", "id", "bucket", "row", (F.col("base") + F.col("within")).alias("at"))


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks_: int = SHARD_BLOCKS, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, source, size, id, source_size, target, bucket, row)`` and the pieces of them that the mix takes.

    Pieces are ``(source, bucket, row, doc_id, size, id, shard, block, first, words)``: ``words`` words from word ``first``.
    """
    sized = cut(sizes(docs, row))
    source = cut(targets(sized))
    placed = cut(streams(sized).join(source.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t"))).drop("t"))
    drop_cut(sized)
    epoch = F.explode(F.array(F.lit(0), F.lit(1)))
    passes = placed.filter("size > 0").withColumn("epoch", epoch).withColumn("start", F.col("at") + F.col("epoch") * F.col("source_size"))
    owed = F.round("target").cast("long")
    passes = passes.withColumn("stop", F.least(F.col("start") + F.col("size"), owed)).filter("stop > start")
    spread = passes.withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (stop - 1) div {block_words})")))
    blocks = shard_blocks(source, block_words, shard_blocks_).select(F.col("source").alias("t"), F.col("block").alias("k"), "shard")
    joined = spread.join(blocks.hint("merge"), F.col("source").eqNullSafe(F.col("t")) & (F.col("block") == F.col("k")))  # blocks grow with the input
    first, last = F.greatest("start", F.col("block") * block_words), F.least("stop", (F.col("block") + 1) * block_words)
    pieces = joined.select("source", "bucket", "row", "doc_id", "size", "id", "shard", "block", (first - F.col("start")).alias("first"), (last - first).alias("words"))
    return placed, pieces


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the shards that the tree deals it to: how many and the first (none: 0 and null)."""
    return taken_words(table(spark, sf_dir, "documents"))


def taken_words(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks_: int = SHARD_BLOCKS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, n_shards, first_shard)`` of each document."""
    placed, pieces = mixture(docs, block_words, shard_blocks_)
    dealt = F.sum("words").alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("n_shards"), F.min("shard").alias("first_shard")
    taken = pieces.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("row").alias("r")).agg(*dealt)
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("row") == F.col("r"))
    joined = placed.join(taken.hint("merge"), same, "left")
    return joined.select("doc_id", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("taken", "n_shards")), "first_shard")


def mix_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op5_mix_sources`` that SQL can express; the tree's draws are not among them."""
    return op5_mix_sources(spark, sf_dir).drop("n_shards", "first_shard")


BASE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, {MOST}::DOUBLE * source_size AS cap, {MOST}::DOUBLE * source_size / weight AS rate FROM w),
o AS (SELECT *, row_number() OVER by_rate AS place, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (by_rate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (by_rate ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS common FROM r WINDOW by_rate AS (ORDER BY rate, source NULLS LAST)),
l AS (SELECT arg_min(common, place) AS level FROM o WHERE common <= rate),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM o, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS owed,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, greatest(least(start + size, owed) - start, 0) + greatest(least(start + size + source_size, owed) - start - source_size, 0) AS taken FROM p
"""


def mixed_corpus(docs: DataFrame) -> DataFrame:
    """The pieces with their text, dealt to shards and shuffled in each: the columns of ``docs``, a shard and a shuffle key.

    A whole document keeps its text; a part of one is the text from its first word to its last. Rows are numbered
    first, so that each has the pieces that were cut from it, also without a doc_id or with one that repeats. The two
    columns are ``shard`` and ``shuffle_key``; where ``docs`` has one of that name, an underscore is put behind it.
    """
    rows, row = numbered(docs)
    _, pieces = mixture(rows, row=row)
    key = F.xxhash64(F.lit(SEED + 1), "doc_id", "block", "first")
    grouped = pieces.groupBy("id", "size").agg(F.collect_list(F.struct("shard", key.alias("shuffle_key"), "first", "words")).alias("pieces"))
    whole = rows.select(F.struct(*docs.columns).alias("d"), F.col(row).alias("number"))
    words = F.regexp_extract_all("d.text", F.lit(WORD_AND_GAP), F.lit(0))

    def cut_out(w: Column) -> Column:
        part = lambda p: F.regexp_replace(F.array_join(F.slice(w, p["first"].cast("int") + 1, p["words"].cast("int")), ""), GAP_BEHIND, "")
        return F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), p["shuffle_key"].alias("shuffle_key"), F.when(p["words"] == F.col("size"), F.col("d.text")).otherwise(part(p)).alias("text")))

    parts = whole.join(grouped, F.col("number") == F.col("id")).withColumn("cut", let(words, cut_out))  # a text is split once
    others = [c for c in docs.columns if c != "text"]
    parts = parts.select(*(F.col(f"d.`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.explode("cut").alias("p"))
    kept = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {"text": F.col("p.text")}
    if "n_chars" in kept:
        kept["n_chars"] = F.length("p.text").cast(docs.schema["n_chars"].dataType)
    shard, order = (fresh(c, docs.columns) for c in ("shard", "shuffle_key"))
    parts = parts.select(*(kept[c].alias(c) for c in docs.columns), F.col("p.shard").alias(shard), F.col("p.shuffle_key").alias(order))
    return parts.repartition(shard).sortWithinPartitions(shard, order)

