"""Embeddings of nodes from link prediction: a mean-neighbour encoder with two layers (ML12).

A node's row holds its own features beside the mean of a sample of its neighbours, and the same of each neighbour in
the sample: all that two layers need. Neighbours are sampled by rank of a hash, the same in every run; tasks leave the
smallest ones of each node before these meet, so no task sorts all of a hub's. Pairs that are linked, and as many drawn
pairs that aren't, carry the rows of both ends, which only these have. An epoch is one pass over the pairs: every task
sums the gradient of its own pairs, Spark adds the sums, the driver takes a step. Embeddings of all nodes are made layer
by layer: the first layer once for each node, then its mean over each sample.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgaudit.operators import graph, learning, training
from kgaudit.session import written

#: Neighbours that are sampled of a node.
FANOUT = 8


def degree_features(edges: DataFrame, embedding: DataFrame | training.Vectors | None = None) -> DataFrame:
    """``(node, x array<double>)``: logarithms of in-, out- and whole degree, and the node's vector ``(node, vec)`` where it has one.

    Vectors are to be of one length; a node without one has zeros. A function of names makes those of all nodes in the tasks.
    """
    degree = graph.degrees(edges.filter("subject <> object"))
    if callable(embedding):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = np.log1p(np.stack([batch[c].to_numpy() for c in ("in_degree", "out_degree", "degree")], axis=1))
                    yield pa.RecordBatch.from_pydict({"node": batch["node"], "x": listed(np.concatenate([own, embedding(batch["node"].to_pylist())], axis=1))})

        return degree.mapInArrow(run, "node string, x array<double>")
    own = F.array(*(F.log1p(F.col(c).cast("double")) for c in ("in_degree", "out_degree", "degree")))
    if embedding is None:
        return degree.select("node", own.alias("x"))
    size = embedding.agg(F.max(F.size("vec")).alias("n")).first()["n"] or 0
    vector = F.coalesce(F.col("vec").cast("array<double>"), F.array_repeat(F.lit(0.0), size))
    return degree.join(embedding.select("node", "vec"), "node", "left").select("node", F.concat(own, vector).alias("x"))


def listed(rows: np.ndarray) -> pa.Array:
    """A matrix as lists, one a row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="int32") * rows.shape[1]), pa.array(np.ascontiguousarray(rows, dtype=float).ravel()))


def wide(lists: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def width(rows: DataFrame, c: str) -> int:
    found = rows.select(F.size(c).alias("n")).first()
    return found["n"] if found else 0


def standardised(features: DataFrame) -> DataFrame:
    """``(node, x)`` with every feature moved to mean 0 and scaled to deviation 1; a constant one becomes 0."""
    size = width(features, "x")
    if not size:
        return features
    each = features.agg(*(f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(size) for f in (F.avg, F.stddev_pop))).first()
    bounds = [(each[f"avg{i}"], each[f"stddev_pop{i}"]) for i in range(size)]
    return features.select("node", F.array(*((F.col("x")[i] - m) * (1 / s if s > 1e-12 else 0.0) for i, (m, s) in enumerate(bounds))).alias("x"))


def sampled_neighbours(links: DataFrame, fanout: int = FANOUT, seed: int = 0) -> DataFrame:
    """``(node, next)``: at most ``fanout`` of each node's neighbours, those with the smallest hashes."""
    drawn = graph.steps_of(links).withColumn("_h", F.xxhash64(F.lit(seed), "node", "next"))
    place = F.dense_rank().over(W.partitionBy("node").orderBy("_h", "next"))  # equal steps have one place
    return drawn.withColumn("_r", place).filter(F.col("_r") <= fanout).select("node", "next").distinct()


def sample_means(steps: DataFrame, vectors: DataFrame, c: str) -> DataFrame:
    """``(node, mean)`` of the vectors ``(node, c)`` of each node's sample."""
    size = width(vectors, c)
    moved = steps.join(vectors.select(F.col("node").alias("next"), c), "next")
    if not size:  # there are no nodes
        return moved.select("node", F.col(c).alias("mean"))
    means = moved.groupBy("node").agg(*(F.avg(F.col(c)[i]).alias(f"m{i}") for i in range(size)))
    return means.select("node", F.array(*(f"m{i}" for i in range(size))).alias("mean"))


def own_rows(steps: DataFrame, features: DataFrame) -> DataFrame:
    """``(node, own)``: a node's features beside its sample's mean, which is zeros for a node without neighbours."""
    joined = features.join(sample_means(steps, features, "x"), "node", "left")
    return joined.select("node", F.concat("x", F.coalesce("mean", F.transform("x", lambda v: F.lit(0.0)))).alias("own"))


def near_rows(own: DataFrame, steps: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, own, near)`` of some nodes, or of all: their inputs and those of their samples."""
    moved = steps.join(own.select(F.col("node").alias("next"), F.col("own").alias("there")), "next")
    near = moved.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("next", "there"))), lambda s: s["there"]).alias("near"))
    some = own if nodes is None else own.join(nodes, "node", "left_semi")
    return some.join(near, "node", "left").withColumn("near", F.coalesce("near", F.array().cast("array<array<double>>")))


def node_rows(links: DataFrame, features: DataFrame, fanout: int = FANOUT, seed: int = 0) -> DataFrame:
    """``(node, own array<double>, near array<array<double>>)``: a node's features beside its sample's mean, and those of the sample.

    A node without neighbours has a mean of zeros and an empty sample.
    """
    steps = written(sampled_neighbours(links, fanout, seed))
    return near_rows(written(own_rows(steps, written(features))), steps)


def end_rows(pairs: DataFrame, own: DataFrame, steps: DataFrame, few: bool) -> DataFrame:
    """The rows of nodes that pairs ``(a, b)`` end at. Where these are ``few``, their names go to all tasks, and neither the other nodes nor their steps are shuffled."""
    sent = F.broadcast if few else lambda df: df
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    near = written(steps.join(sent(ends), "node", "left_semi"))
    names = ends.union(near.select("next")).distinct()
    return near_rows(written(own.join(sent(names), "node", "left_semi")), near, ends)


def linked_pairs(edges: DataFrame) -> DataFrame:
    """``(a, b)`` of each two nodes that an edge joins, in either direction, once and with a before b."""
    return edges.filter("subject <> object").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()


def unlinked_pairs(linked: DataFrame, nodes: DataFrame, seed: int = 0, buckets: int = 256) -> DataFrame:
    """About one pair ``(a, b)`` of two drawn nodes for each linked one, without linked pairs and pairs of one node.

    Nodes are numbered in buckets of their hash; a draw is a bucket, by its size, and a number in it, both from a hash
    of the linked pair. So nothing is numbered over all nodes, and every run draws the same.
    """
    numbered = nodes.select("node").distinct().withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(buckets)))
    numbered = written(numbered.withColumn("no", F.row_number().over(W.partitionBy("bucket").orderBy("node")) - 1))
    sizes = [(r["bucket"], r["n"]) for r in numbered.groupBy("bucket").agg(F.count("*").alias("n")).orderBy("bucket").collect()]  # at most ``buckets`` rows
    total, ends = sum(n for _, n in sizes), np.cumsum([n for _, n in sizes]).tolist()
    if total < 2:
        return linked.limit(0)
    whole = F.array(*(F.struct(F.lit(int(b)).cast("long").alias("bucket"), F.lit(int(e - n)).cast("long").alias("first"), F.lit(int(e)).cast("long").alias("stop")) for (b, n), e in zip(sizes, ends, strict=True)))
    drawn = linked.select("a", "b")
    for side in ("x", "y"):
        at = F.pmod(F.xxhash64(F.lit(seed), F.lit(side), "a", "b"), F.lit(total))
        drawn = drawn.withColumn(f"at_{side}", at)
    for side in ("x", "y"):
        place = F.filter(whole, lambda s: (F.col(f"at_{side}") >= s["first"]) & (F.col(f"at_{side}") < s["stop"]))[0]  # noqa: B023
        drawn = drawn.withColumn("s", place).select(*drawn.columns, F.col("s.bucket").alias("bucket"), (F.col(f"at_{side}") - F.col("s.first")).alias("no"))
        drawn = drawn.join(numbered.withColumnRenamed("node", side), ["bucket", "no"]).drop("bucket", "no")
    return drawn.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(linked, ["a", "b"], "left_anti")


@dataclasses.dataclass(frozen=True)
class Encoder:
    """Weights of both layers: each sees a node beside the mean of its sample."""

    one: np.ndarray
    bias_1: np.ndarray
    two: np.ndarray
    bias_2: np.ndarray

    @classmethod
    def seeded(cls, size: int, hidden: int = 16, out: int = 16, seed: int = 0) -> Encoder:
        """For nodes of ``size`` features."""
        rng = np.random.default_rng(seed)
        w = lambda m, n: rng.standard_normal((m, n)) / np.sqrt(m)
        return cls(w(2 * size, hidden), np.zeros(hidden), 0.5 * w(2 * hidden, out), np.zeros(out))


@dataclasses.dataclass(frozen=True)
class Nodes:
    """Rows of nodes: their own inputs, those of all samples one below another, and whose sample each of these is in."""

    own: np.ndarray
    near: np.ndarray
    whose: np.ndarray

    @classmethod
    def of(cls, own: list, near: list) -> Nodes:
        size = len(own[0]) if own else 0
        counts = [len(n) for n in near]
        return cls(np.array(own, dtype=float).reshape(len(own), size), np.array([x for n in near for x in n], dtype=float).reshape(sum(counts), size), np.repeat(np.arange(len(own)), counts))


def encode(nodes: Nodes, w: Encoder) -> tuple[np.ndarray, tuple]:
    """Embeddings of nodes, and what the gradient needs.

    The second layer is linear: cut off at 0, no product of embeddings would speak against a link.
    """
    mine, there = nodes.own @ w.one + w.bias_1, nodes.near @ w.one + w.bias_1
    count = np.maximum(np.bincount(nodes.whose, minlength=len(nodes.own)), 1)[:, None]
    mean = np.zeros((len(nodes.own), w.one.shape[1]))
    np.add.at(mean, nodes.whose, np.maximum(there, 0))
    wide = np.concatenate([np.maximum(mine, 0), mean / count], axis=1)
    z = wide @ w.two + w.bias_2
    return z, (mine, there, count, wide)


def pulled(nodes: Nodes, w: Encoder, kept: tuple, by_out: np.ndarray) -> np.ndarray:
    """The derivative by every weight, from that by the embeddings."""
    mine, there, count, wide = kept
    by_wide = by_out @ w.two.T
    k = w.one.shape[1]
    by_mine = by_wide[:, :k] * (mine > 0)
    by_there = (by_wide[:, k:] / count)[nodes.whose] * (there > 0)
    parts = (nodes.own.T @ by_mine + nodes.near.T @ by_there, by_mine.sum(axis=0) + by_there.sum(axis=0), wide.T @ by_out, by_out.sum(axis=0))
    return np.concatenate([p.ravel() for p in parts])


def link_gradient(a: Nodes, b: Nodes, y: np.ndarray, w: Encoder) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of links by the product of both ends' embeddings, and its derivative by every weight."""
    (u, kept_a), (v, kept_b) = encode(a, w), encode(b, w)
    logit = (u * v).sum(axis=1)
    by_logit = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y)[:, None]
    return float((np.logaddexp(0, logit) - logit * y).sum()), pulled(a, w, kept_a, by_logit * v) + pulled(b, w, kept_b, by_logit * u)


def pair_table(linked: DataFrame, unlinked: DataFrame, rows: DataFrame) -> DataFrame:
    """``(a, b, y, own_a, near_a, own_b, near_b)`` of both kinds of pairs."""
    out = linked.select("a", "b", F.lit(1).alias("y")).union(unlinked.select("a", "b", F.lit(0)))
    for side in ("a", "b"):
        out = out.join(rows.select(F.col("node").alias(side), F.col("own").alias(f"own_{side}"), F.col("near").alias(f"near_{side}")), side)
    return out


def _ends(batch: pa.RecordBatch) -> tuple[Nodes, Nodes]:
    return tuple(Nodes.of(batch[f"own_{s}"].to_pylist(), batch[f"near_{s}"].to_pylist()) for s in ("a", "b"))


def summed_gradient(pairs: DataFrame, w: Encoder) -> np.ndarray:
    """The gradient over all pairs, followed by the loss and the number of pairs."""
    size = sum(getattr(w, f.name).size for f in dataclasses.fields(w)) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                loss, found = link_gradient(*_ends(batch), np.array(batch["y"].to_pylist(), dtype=float), w)
                total += np.append(found, [loss, batch.num_rows])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = pairs.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # one row a weight
        out[r["i"]] = r["v"]
    return out


def link_scores(pairs: DataFrame, w: Encoder) -> DataFrame:
    """``(a, b, y, score)``: the probability of a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _ends(batch)
                logit = (encode(a, w)[0] * encode(b, w)[0]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["y"], pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], ["a", "b", "y", "score"])

    return pairs.mapInArrow(run, "a string, b string, y int, score double")


def embedded(rows: DataFrame, w: Encoder) -> DataFrame:
    """``(node, embedding array<double>)`` of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = encode(Nodes.of(batch["own"].to_pylist(), batch["near"].to_pylist()), w)[0]
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found.tolist(), pa.list_(pa.float64()))], ["node", "embedding"])

    return rows.mapInArrow(run, "node string, embedding array<double>")


def embeddings(own: DataFrame, steps: DataFrame, w: Encoder) -> DataFrame:
    """``(node, embedding array<double>)`` as ``embedded`` gives it, of all nodes at once, without the inputs of their samples."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["node"], listed(np.maximum(wide(batch["own"]) @ w.one + w.bias_1, 0))], ["node", "h"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = np.concatenate([wide(batch["h"]), wide(batch["mean"])], axis=1) @ w.two + w.bias_2
                yield pa.RecordBatch.from_arrays([batch["node"], listed(z)], ["node", "embedding"])

    hidden = written(own.select("node", "own").mapInArrow(first, "node string, h array<double>"))
    nothing = F.array(*(F.lit(0.0) for _ in w.bias_1))
    both = hidden.join(sample_means(steps, hidden, "h"), "node", "left").select("node", "h", F.coalesce("mean", nothing).alias("mean"))
    return both.mapInArrow(second, "node string, embedding array<double>")


@dataclasses.dataclass(frozen=True)
class Pretrained:
    encoder: Encoder
    own: DataFrame
    steps: DataFrame
    losses: list[float]
    auroc: float | None

    @property
    def rows(self) -> DataFrame:
        """The rows of all nodes."""
        return near_rows(self.own, self.steps)

    @property
    def embeddings(self) -> DataFrame:
        """``(node, embedding array<double>)`` of all nodes."""
        return embeddings(self.own, self.steps, self.encoder)


#: Pairs whose ends' names may go to all tasks.
FEW = 20_000


def pretrain(edges: DataFrame, features: DataFrame, epochs: int = 10, rate: float = 0.02, hidden: int = 16, fanout: int = FANOUT, most_pairs: int | None = None, held_percent: int = 20, seed: int = 13) -> Pretrained:
    """An encoder trained to tell linked pairs from drawn ones, and its area under the ROC curve on held-out pairs.

    Held-out links, chosen by hash, are in no node's sample, so the encoder can't read them off its input. ``most_pairs``
    bounds the pairs that the encoder is fitted on, chosen by hash; rows and embeddings are of all nodes. Without links the
    weights stay as they are.
    """
    linked = written(linked_pairs(edges))
    held = learning.sampled(held_percent, F.concat_ws("|", "a", "b"), seed=seed)
    seen = linked.filter(~held).select(F.col("a").alias("subject"), F.col("b").alias("object"))
    steps = written(sampled_neighbours(seen, fanout, seed))
    own = written(own_rows(steps, standardised(written(features))))
    start = Encoder.seeded((width(own, "own") or 2) // 2, hidden, hidden, seed)
    n = linked.count()
    chosen = linked if most_pairs is None or n <= most_pairs else written(linked.filter(F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(1 << 20)) < F.lit(most_pairs / n * (1 << 20))))
    drawn = written(unlinked_pairs(chosen, own, seed).join(linked, ["a", "b"], "left_anti"))
    rows = end_rows(chosen.select("a", "b").union(drawn), own, steps, min(n, n if most_pairs is None else most_pairs) <= FEW)
    pairs = written(pair_table(chosen, drawn, rows).withColumn("held", held))
    fit, check = pairs.filter("not held"), pairs.filter("held")
    shapes = [getattr(start, f.name) for f in dataclasses.fields(start)]
    now, losses = np.concatenate([a.ravel() for a in shapes]), []
    adam = training.Adam(now.size, rate)

    def shaped(values: np.ndarray) -> Encoder:
        parts = np.split(values, np.cumsum([a.size for a in shapes])[:-1])
        return Encoder(*(p.reshape(a.shape) for p, a in zip(parts, shapes, strict=True)))

    for _ in range(epochs):
        found = summed_gradient(fit, shaped(now))
        if not found[-1]:
            break
        losses.append(float(found[-2] / found[-1]))
        now = adam.moved(now, found[:-2] / found[-1])
    area = learning.auroc_auprc(link_scores(check, shaped(now))).first()["auroc"]
    return Pretrained(shaped(now), own, steps, losses, area)
