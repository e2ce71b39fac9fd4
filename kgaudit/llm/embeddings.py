"""Embedding near-duplicates by NN-descent.

Equal vectors form one class. The neighbour graph of the classes starts from blocks of random hyperplane codes, in
which all pairs are compared, and is refined: each class joins its neighbours and those that have it as neighbour,
their pairs are compared, and a pair that betters a list enters it. Rounds end when few lists change.

A list whose last neighbour is still over the threshold is saturated. Saturated lists are enlarged, four times as long
each time, and refined again, until they end below the threshold or hold ``MOST_NEIGHBOURS``. Edges of the lists, in
both directions, are the links. Classes whose lists stay saturated at that length, as those of a large group of near
copies, are compared with each other exactly, in blocks that return link counts and edges that span the links found,
not pairs; so links between two such groups are found before components are taken, and a large group costs no rows.

Recall is audited by exact comparison of a sample of classes with all classes, in blocks. It is the mean over classes
of the share of their links that was found, and of sets of classes with about as many links, the worst one counts.
Below ``LEAST_RECALL``, the graph is refined again from twice as many hyperplane codes; after three tries, all classes
are compared with all. The recall that the audit found comes with the result.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing and are kept;
vectors of different lengths aren't linked; equal ones are linked; rows without a vec_id link with nothing; rows that
repeat a vec_id count as vectors of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgaudit.llm.common import components, cut, drop_cut, table

THRESHOLD, NEIGHBOURS, MOST_NEIGHBOURS, CODES, TRIES, FEW, BLOCK, BRIDGES, EXACT, AUDIT, LEAST_RECALL, SEED = 0.9, 10, 160, 6, 3, 0.001, 512, 8, 4096, 1000, 0.97, 17
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])
EDGES_SQL = "a long, b long, cosine double"


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of vectors that are stored as the bytes of doubles.

    Rows are first scaled by a power of two to components of about 1, which is exact, so that no square overflows or vanishes.
    """
    m = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True, initial=0.0))[1])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def comparable() -> Column:
    """Whether the row ``(vec_id, v)`` can link: an id, and finite components that aren't all zero."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return F.coalesce(finite & F.col("vec_id").isNotNull(), F.lit(False))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(vec_id, id)`` and classes ``(id, low, dim, n, vec binary)`` of the vectors that can link; low is the smallest vec_id."""
    values = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [np.array(v.values, np.float64) + 0.0 for v in batch["v"]]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([len(v) for v in rows], pa.int32()), pa.array([v.tobytes() for v in rows], pa.binary())], schema=schema)

    packed = cut(values.filter(comparable()).mapInArrow(pack, "vec_id long, dim int, vec binary"))
    grouped = packed.groupBy("vec", "dim").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classed = cut(grouped.withColumn("id", F.monotonically_increasing_id()))
    members = packed.select("vec_id", "vec").join(classed.select("vec", "id"), "vec").select("vec_id", "id")
    return members, classed


def best_of_group(ids: np.ndarray, unit: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a group, its up to k nearest others that are better than its worst so far."""
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    k = min(k, len(ids) - 1)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
    value = np.take_along_axis(cosine, near, axis=1)
    row, column = np.nonzero(value > worst[:, None])
    return ids[row], ids[near[row, column]], value[row, column]


def coded(vec: DataFrame, first: int, codes: int, bits: int) -> DataFrame:
    """Classes with a block ``(code_no, dim, code, chunk)`` for each of some hyperplane codes.

    Large blocks are cut into chunks, in each code anew; about ``BRIDGES`` rows of such a block are in all its chunks.
    """
    schema = pa.schema([("id", pa.int64()), ("vec", pa.binary()), ("dim", pa.int32()), ("code_no", pa.int32()), ("code", pa.int64())])

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in it:
            for dim in np.unique(batch["dim"]):
                mine = batch.filter(pa.compute.equal(batch["dim"], int(dim)))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, int(dim)]).standard_normal((first + codes, bits, int(dim)))
                unit = matrix(mine["vec"])
                for no in range(first, first + codes):
                    sign = (unit @ planes[dim][no].T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(mine), np.int64)
                    yield pa.RecordBatch.from_arrays([mine["id"], mine["vec"], mine["dim"], pa.array(np.full(len(mine), no, np.int32)), pa.array(sign.astype(np.int64))], schema=schema)

    rows = vec.select("id", "dim", "vec").mapInArrow(code, "id long, vec binary, dim int, code_no int, code long")
    sizes = cut(rows.groupBy("code_no", "dim", "code").count())
    chunks = F.ceil(F.col("count") / BLOCK).cast("long")
    bridge = F.pmod(F.xxhash64("code_no", "id"), F.col("count")) < BRIDGES
    mine = F.pmod(F.xxhash64("id", "code_no"), chunks)
    chunk = F.explode(F.when(bridge, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(mine)))
    return rows.join(sizes, ["code_no", "dim", "code"]).withColumn("chunk", chunk)


def from_blocks(blocks: DataFrame, k: int) -> DataFrame:
    """Edges of the k nearest within each block."""

    def compare(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        found = best_of_group(ids, matrix(group["vec"].combine_chunks()), np.full(len(ids), -2.0), k) if len(ids) > 1 else ([], [], [])
        return pa.table([pa.array(c, f.type) for c, f in zip(found, EDGES, strict=True)], schema=EDGES)

    return blocks.groupBy("code_no", "dim", "code", "chunk").applyInArrow(compare, EDGES_SQL)


def nearest(edges: DataFrame) -> DataFrame:
    """The lists ``(a, b, cosine, old, k)`` of the k nearest of all edges; a class's k is the largest of its edges'. An edge is old if it was in a list before."""
    once = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.max("old").alias("old"), F.max("k").alias("k"))
    mine = W.partitionBy("a")
    ranked = once.withColumns({"rank": F.row_number().over(mine.orderBy(F.col("cosine").desc(), "b")), "k": F.max("k").over(mine)})
    return ranked.filter("rank <= k").drop("rank")


def descended(graph: DataFrame, vec: DataFrame) -> DataFrame:
    """Edges ``(a, b, cosine, old, k)`` that better a list, found among the neighbours of each class and those that have it as neighbour.

    A list that was enlarged takes only links.
    """
    reverse = F.row_number().over(W.partitionBy("b").orderBy(F.xxhash64("a", "b")))
    lists = graph.groupBy(F.col("a").alias("w")).agg(F.max("k").alias("k"), F.when(F.count("*") >= F.max("k"), F.min("cosine")).when(F.max("k") > NEIGHBOURS, float(np.nextafter(THRESHOLD, 0))).otherwise(-2.0).alias("worst"))
    backward = graph.withColumn("r", reverse).join(lists.select(F.col("w").alias("b"), F.col("k").alias("most")), "b").filter("r <= most")
    around = graph.select(F.col("a").alias("centre"), F.col("b").alias("id")).union(backward.select(F.col("b").alias("centre"), F.col("a").alias("id")))
    around = around.union(graph.select("a", "a")).distinct()
    ready = vec.select("id", "dim", "vec").join(lists, F.col("id") == F.col("w")).drop("w")
    n = int(vec.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = around.join(ready, "id").select("centre", "id", "dim", "vec", "k", "worst").repartition(n, "centre").sortWithinPartitions("dim", "centre", "id")
    schema = pa.schema([*EDGES, ("old", pa.int32()), ("k", pa.int32())])

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in it:
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0] if batch.num_rows else held
            if whole is None:
                continue
            centre = whole["centre"].to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(centre)) + 1])
            held = whole.slice(int(bounds[-1]))
            yield from compared(whole.slice(0, int(bounds[-1])), bounds)
        if held is not None:
            yield from compared(held, np.array([0, held.num_rows]))

    def compared(rows: pa.RecordBatch, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of the groups between bounds; the neighbours of a centre are of its length, those of the next may be of another."""
        if not rows.num_rows:
            return
        ids, worst, k, dim = (rows[c].to_numpy() for c in ("id", "worst", "k", "dim"))
        found = []
        edges = np.concatenate([[0], np.flatnonzero(np.diff(dim)) + 1, [len(dim)]])
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            unit = matrix(rows["vec"].slice(int(low), int(high - low)))
            inside = bounds[(bounds >= low) & (bounds <= high)]
            for a, b in zip(inside[:-1], inside[1:], strict=True):
                if b - a > 1:
                    a_, b_, value = best_of_group(np.arange(a, b), unit[a - low : b - low], worst[a:b], int(k[a:b].max()))
                    found.append((ids[a_], ids[b_], value, k[a_]))
        if found:
            one, other, cosine, limit = (np.concatenate([f[i] for f in found]) for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other), pa.array(cosine), pa.array(np.zeros(len(one), np.int32)), pa.array(limit.astype(np.int32))], schema=schema)

    return rows.mapInArrow(groups, EDGES_SQL + ", old int, k int")


def settled(graph: DataFrame, vec: DataFrame) -> DataFrame:
    """The graph, refined until few lists change."""
    while True:
        places = graph.groupBy("a").agg(F.max("k").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        graph = replaced(graph, nearest(graph.withColumn("old", F.lit(1)).union(descended(graph, vec))))
        if graph.filter("old = 0").count() <= FEW * places:
            return graph


def full(graph: DataFrame) -> DataFrame:
    """``(id)``: the classes whose lists are full of neighbours at the threshold."""
    lists = graph.groupBy(F.col("a").alias("id")).agg(F.count_if(F.col("cosine") >= THRESHOLD).alias("links"), F.max("k").alias("k"))
    return lists.filter("links >= k").select("id")


def enlarged(graph: DataFrame, vec: DataFrame, most: int) -> DataFrame:
    """The graph with saturated lists enlarged, up to ``most`` neighbours."""
    longest = NEIGHBOURS
    while longest < most:
        saturated = cut(full(graph))
        if saturated.isEmpty():
            break
        longest = min(most, longest * 4)
        marked = graph.join(saturated.withColumnRenamed("id", "s"), F.col("a") == F.col("s"), "left")
        graph = replaced(graph, marked.withColumn("k", F.when(F.col("s").isNotNull(), F.lit(longest)).otherwise(F.col("k")).cast("int")).drop("s"))
        graph = settled(graph, vec)
    return graph


def linked(graph: DataFrame, vec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b)`` that connect what is linked, and ``(id, links)``: the vectors of other classes that each class is linked with."""
    dense = cut(full(graph))
    spanning, counts = exact(cut(vec.join(dense, "id", "left_semi")))
    near = graph.filter(F.col("cosine") >= THRESHOLD).select("a", "b")
    both = near.union(near.select("b", "a")).distinct()
    flag = lambda name: dense.select(F.col("id").alias(name), F.lit(True).alias(f"{name}_dense"))
    listed = both.join(flag("a"), "a", "left").join(flag("b"), "b", "left").filter("a_dense is null or b_dense is null")  # else counted exactly
    listed = listed.join(vec.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    return near.union(spanning), listed.union(counts).groupBy("id").agg(F.sum("links").alias("links"))


def spanned(ids: np.ndarray, label: np.ndarray, other: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Edges that connect what ``near`` links: ``ids`` with labels, which are lowered in place, and others.

    A label is an id that is already connected with its row; one edge is made for each change of a label.
    """
    mine, theirs = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, most, edges = near[np.ix_(mine, theirs)], np.iinfo(np.int64).max, []
    column = other[theirs]
    while len(mine):
        low = np.minimum(column, np.where(near, label[mine][:, None], most).min(axis=0))
        new = np.minimum(label[mine], np.where(near, low, most).min(axis=1))
        edges += [np.stack([column, low], axis=1)[column != low], np.stack([label[mine], new], axis=1)[label[mine] != new]]
        if (low == column).all() and (new == label[mine]).all():
            break
        column, label[mine] = low, new
    return np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)


def exact(vec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b)`` that span all links between classes, and ``(id, links)``, by comparison of all with all.

    ``EXACT`` classes at a time go to every task, which meets them with its rows; no vectors are shuffled.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    spark = vec.sparkSession
    parts = -(-vec.count() // EXACT)
    edges, counts = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "id long, links long")
    for no in range(parts):
        rows = vec.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == no).select("id", "dim", "vec").toLocalIterator()
        queries = spark.sparkContext.broadcast([(r["id"], r["dim"], bytes(r["vec"])) for r in rows])

        def compare(it: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            asked = {}
            for dim in {q[1] for q in queries.value}:
                ids = np.array([q[0] for q in queries.value if q[1] == dim], np.int64)
                asked[dim] = ids, matrix(pa.array([q[2] for q in queries.value if q[1] == dim])), ids.copy(), np.zeros(len(ids), np.int64)
            for batch in it:
                for at in range(0, len(batch), BLOCK):
                    part = batch.slice(at, BLOCK)
                    for dim in np.unique(part["dim"]):
                        mine = part.filter(pa.compute.equal(part["dim"], int(dim)))
                        if int(dim) in asked:
                            ids, unit, label, links = asked[int(dim)]
                            other = mine["id"].to_numpy()
                            near = unit @ matrix(mine["vec"]).T >= THRESHOLD
                            near &= ids[:, None] != other
                            links += near @ mine["n"].to_numpy()
                            pairs = spanned(ids, label, other, near)
                            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], schema=schema)
            for ids, _, _, links in asked.values():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(links)], schema=schema)

        found = cut(vec.select("id", "dim", "n", "vec").mapInArrow(compare, "a long, b long, links long"))
        edges = edges.union(found.filter("b is not null").select("a", "b"))
        counts = counts.union(found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links")))
        queries.unpersist()
    return edges.distinct(), counts.filter("links > 0")


def audited(vec: DataFrame, found: DataFrame) -> float:
    """Mean share of a class's links that was found, over a bounded sample of classes.

    Classes are taken together by the power of two of their number of links; it is the least of these means.
    """
    spark = vec.sparkSession
    sample = vec.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(AUDIT).select("id", "dim", "vec").collect()
    queries = spark.sparkContext.broadcast([(r["id"], r["dim"], bytes(r["vec"])) for r in sample])
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in it:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                for dim in np.unique(part["dim"]):
                    mine = part.filter(pa.compute.equal(part["dim"], int(dim)))
                    asked = [q for q in queries.value if q[1] == dim]
                    if asked:
                        near = matrix(pa.array([q[2] for q in asked])) @ matrix(mine["vec"]).T >= THRESHOLD
                        near &= np.array([q[0] for q in asked])[:, None] != mine["id"].to_numpy()
                        for q, links in zip(asked, near @ mine["n"].to_numpy(), strict=True):
                            total[q[0]] = total.get(q[0], 0) + int(links)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], schema=schema)

    true = vec.select("id", "dim", "n", "vec").mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("true"))
    share = F.coalesce("links", F.lit(0)) / F.col("true")
    means = true.filter(F.col("true") > 0).join(found, "id", "left").groupBy(F.floor(F.log2(F.col("true")))).agg(F.avg(share).alias("share"))
    return means.agg(F.coalesce(F.min("share"), F.lit(1.0))).first()[0]


def replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``new``, written; frees what it was made of."""
    new = cut(new)
    if old is not None:
        drop_cut(old)
    return new


def near_links(vectors: DataFrame, k: int = NEIGHBOURS, codes: int = CODES, most: int = MOST_NEIGHBOURS) -> tuple[DataFrame, float]:
    """``(vec_id, n_links, component_id)`` of every row, and the audited recall."""
    members, vec = classes(vectors)
    bits = max(0, round(np.log2(max(1, vec.count()) / (BLOCK / 2))))
    graph, first = None, 0
    for _ in range(TRIES):
        for at in range(first, first + codes, CODES):  # a few codes at a time
            found = from_blocks(coded(vec, at, min(CODES, first + codes - at), bits), k).withColumns({"old": F.lit(0), "k": F.lit(k)})
            graph = replaced(graph, nearest(found if graph is None else graph.union(found)))
        first, codes = first + codes, codes * 2
        graph = enlarged(settled(graph, vec), vec, most)
        links, counts = linked(graph, vec)
        counts = cut(counts)
        recall = audited(vec, counts)
        if recall >= LEAST_RECALL:
            break
    else:
        links, counts = exact(vec)
        counts, recall = cut(counts), 1.0
    roots = cut(components(links))
    lowest = roots.join(vec.select(F.col("id").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("component"))
    named = roots.join(lowest, "root").select(F.col("node").alias("id"), "component")
    per_class = vec.select("id", "n", "low").join(counts, "id", "left").join(named, "id", "left")
    per_class = cut(per_class.select(F.col("id").alias("class"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component_id")))
    found = members.join(per_class, F.col("id") == F.col("class")).select("vec_id", "n_links", "component_id")
    values = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    alone = values.filter(~comparable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone), recall


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recall = near_links(table(spark, sf_dir, "embeddings"))
    return found.withColumns({"kept": F.col("vec_id") == F.col("component_id"), "audited_recall": F.lit(recall)})
