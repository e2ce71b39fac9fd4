"""Labels, metrics, prototypes, calibration and edge scoring (ML1-ML8, ML10, ML13, ML14, ML17-ML21, A12-A17, W2, W6, W8, J15)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ERROR_TYPES = ("type_violation", "retracted_support", "ontology_mismatch", "weak_evidence")


def edge_reasons(c: dict[str, Column]) -> Column:
    """The first reason for which an edge is suspicious, else null (ML13).

    ``c`` has booleans ``violation``, ``retracted``, ``mismatch`` and numbers ``sources``, ``confidence``.
    """
    weak = (c["sources"] <= 1) & (c["confidence"] < 0.5)
    return F.when(c["violation"], "type_violation").when(c["retracted"], "retracted_support").when(c["mismatch"], "ontology_mismatch").when(weak, "weak_evidence")


def edge_label(reason: Column, c: dict[str, Column]) -> Column:
    """1 for suspicious edges, 0 for clean ones (several sources, confident), null for the rest (ML13)."""
    clean = (c["sources"] >= 2) & (c["confidence"] >= 0.9)
    return F.when(reason.isNotNull(), 1).when(clean, 0)


def reason_counts(edges: DataFrame) -> DataFrame:
    """Edges by first reason."""
    return edges.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def error_type_of(c: dict[str, Column]) -> Column:
    """Error type by rule features, in order of precedence (ML18)."""
    return F.when(c["type"] < 0, "type_violation").when(c["retraction"] < 0, "retracted_support").when(c["ontology"] < 0, "ontology_mismatch").when(c["weak"] < 0, "weak_evidence")


def top_edges(edges: DataFrame, predicted: DataFrame | None, claim: list[str], edge: list[str], most: int = 10) -> DataFrame:
    """The most suspicious edges of each claim by ``suspicion``, equal ones by their keys, with ``error_type`` where one is predicted.

    Without ``predicted`` the edges have their ``error_type`` themselves.
    """
    rank = F.row_number().over(W.partitionBy(*claim).orderBy(F.col("suspicion").desc(), *edge))
    best = edges.withColumn("rank", rank).filter(F.col("rank") <= most)
    return best if predicted is None else best.join(predicted.select(*claim, *edge, "error_type"), [*claim, *edge], "left")


def sampled(percent: int, *key: Column, seed: int = 0) -> Column:
    """A draw by hash: true for so many of a hundred keys, the same in every run (ML14)."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(100)) < percent


def perturbed(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Edges with some directions flipped, sources ablated and support marked retracted; ``perturbation`` says which (ML14)."""
    key = (F.col("subject"), F.col("predicate"), F.col("object"))
    kind = F.when(sampled(20, *key, seed=seed), "direction_flip").when(sampled(15, *key, seed=seed + 1), "evidence_ablation").when(sampled(15, *key, seed=seed + 2), "retracted_override")
    flip = F.col("perturbation") == "direction_flip"
    turned = {"subject": F.when(flip, F.col("_o")).otherwise(F.col("_s")), "object": F.when(flip, F.col("_s")).otherwise(F.col("_o"))}
    n = F.when(F.col("perturbation") == "evidence_ablation", F.lit(0).cast("long")).otherwise(F.col("n_sources").cast("long"))
    retracted = F.when(F.col("perturbation") == "retracted_override", F.lit(1.0)).otherwise(F.col("retracted_support_ratio"))
    out = edges.withColumn("perturbation", kind).withColumnsRenamed({"subject": "_s", "object": "_o"})
    return out.withColumns(turned | {"n_sources": n, "retracted_support_ratio": retracted, "is_perturbed_edge": F.col("perturbation").isNotNull().cast("double")}).drop("_s", "_o")


def centroids(examples: DataFrame, last: int = 50) -> DataFrame:
    """Mean of the last vectors ``(label, ord, vec)`` of each label."""
    recent = examples.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(F.col("ord").desc()))).filter(F.col("_r") <= last)
    means = recent.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def nearest_prototype(rows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Label of the prototype of largest cosine; of equal ones the smallest label (ML17).

    Up to ``MAX_PROTOTYPES`` prototypes, one row a label, go to every task as a single row, and a row is compared with
    them in place; more are dealt in blocks of so many, and the best of the blocks counts.
    """
    ready = prototypes.select("label", F.col("centroid").cast("array<double>").alias("centroid"))
    n = ready.count()
    blocks = ready.withColumn("_block", F.pmod(F.xxhash64("label"), F.lit(max(1, -(-n // MAX_PROTOTYPES)))))
    packed = blocks.groupBy("_block").agg(F.collect_list(F.struct("label", "centroid")).alias("_all"))
    vector = F.transform("vec", lambda v: v.cast("double"))
    best = F.array_max(F.transform("_all", lambda s: F.struct(cosine(vector, s["centroid"]).alias("cosine"), (-s["label"]).alias("l"), s["label"].alias("label"))))
    if n <= MAX_PROTOTYPES:
        return rows.crossJoin(F.broadcast(packed)).select("row_id", best.alias("b")).select("row_id", F.col("b.label").alias("predicted"), F.col("b.cosine").alias("cosine"))
    found = rows.crossJoin(packed).select("row_id", best.alias("b")).groupBy("row_id").agg(F.max("b").alias("b"))
    return found.select("row_id", F.col("b.label").alias("predicted"), F.col("b.cosine").alias("cosine"))


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``(bin, n, accuracy, confidence)`` of predictions ``p`` and labels ``y``."""
    no = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(no.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("accuracy"), F.avg("p").alias("confidence"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected and largest calibration error."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return calibration_bins(scored, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def hits_at(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of the groups with a positive that have one among their k best (A15, W6). Rows are ``(group_id, ord, score, y)``."""
    rank = F.row_number().over(W.partitionBy("group_id").orderBy(F.col("score").desc(), "ord"))
    best = ranked.withColumn("_r", rank).filter("y = 1").groupBy("group_id").agg(F.min("_r").alias("_best"))
    return best.agg(F.count("*").alias("groups"), *(F.avg((F.col("_best") <= k).cast("double")).alias(f"hits_at_{k}") for k in ks))


def score_steps(scored: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score, with those above it.

    Scores are aggregated before the running sums, which are taken in two levels: within ranges of scores, and over
    the ranges' totals.
    """
    each = scored.groupBy("score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    each = each.withColumn("_range", F.floor(F.col("score") * 256))
    inside = W.partitionBy("_range").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranges = each.groupBy("_range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    above = W.orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    base = ranges.select("_range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"))
    out = each.join(base, "_range")
    plus = lambda c, b: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(b)
    return out.select("score", "pos", "neg", plus("pos", "bp").alias("pos_above"), plus("neg", "bn").alias("neg_above"))


def auroc_auprc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision of ``(score, y)``."""
    steps = score_steps(scored)
    precision = (F.col("pos_above") + F.col("pos")) / (F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg"))
    won = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
    return steps.agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auroc"), F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("auprc"))


def positive_weight(labelled: DataFrame) -> DataFrame:
    """Negatives for each positive."""
    return labelled.agg((F.count_if(F.col("y") == 0) / F.greatest(F.count_if(F.col("y") == 1), F.lit(1))).alias("pos_weight"))


def fit_platt(scored: DataFrame, p: str = "p", y: str = "y") -> tuple[float, float]:
    """Slope and intercept of a logistic calibration of logits with an L2 prior (ML20)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    bounded = F.greatest(F.least(F.col(p), F.lit(1 - 1e-7)), F.lit(1e-7))
    ready = scored.select(array_to_vector(F.array(F.log(bounded / (1 - bounded)))).alias("features"), F.col(y).cast("double").alias("label"))
    n = max(1, ready.count())
    model = LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=100).fit(ready)
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(p: Column, slope: float, intercept: float) -> Column:
    bounded = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    return 1 / (1 + F.exp(-(slope * F.log(bounded / (1 - bounded)) + intercept)))


def fit_isotonic(scored: DataFrame, p: str = "p", y: str = "y") -> tuple[list[float], list[float]]:
    """Knots of an isotonic calibration (ML19)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    ready = scored.select(array_to_vector(F.array(F.col(p))).alias("features"), F.col(y).cast("double").alias("label"))
    model = IsotonicRegression().fit(ready)
    return [float(x) for x in model.boundaries], [float(x) for x in model.predictions]


def apply_isotonic(p: Column, x: list[float], y: list[float]) -> Column:
    """Linear interpolation between knots, constant outside (ML19, ML21).

    The knots are two constant arrays, so the expression has one size whatever their number.
    """
    xs, ys = F.array(*map(F.lit, x)), F.array(*map(F.lit, y))
    below = F.size(F.filter(xs, lambda k: k < p))  # knots are sorted: the next one is at or above p
    a, b, u, v = (F.get(c, below - i) for c, i in ((xs, 1), (xs, 0), (ys, 1), (ys, 0)))
    inside = F.when(b == p, v).otherwise(u + (v - u) * (p - a) / (b - a))
    return F.when(p.isNull(), None).when(below == 0, float(y[0])).when(below == len(x), float(y[-1])).otherwise(inside)


def fit_temperature(scored: DataFrame, logit: str = "logit", y: str = "y", rounds: int = 40) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm; a round is one aggregation (ML8)."""

    def losses(points: list[float]) -> list[float]:
        z = [F.col(logit) / float(np.exp(t)) for t in points]
        loss = [F.avg(F.greatest(x, F.lit(0.0)) - x * F.col(y) + F.log1p(F.exp(-F.abs(x)))) for x in z]
        return list(scored.agg(*(x.alias(f"l{i}") for i, x in enumerate(loss))).first())

    low, high = -3.0, 3.0
    for _ in range(max(1, rounds // 10)):
        points = np.linspace(low, high, 17).tolist()
        best = int(np.argmin(losses(points)))
        low, high = points[max(0, best - 1)], points[min(16, best + 1)]
    return float(np.exp((low + high) / 2))


#: Prototypes that a task holds at once.
MAX_PROTOTYPES = 1000
EDGE_FEATURES = ("n_sources", "n_pmids", "confidence", "evidence_age", "retracted_support_ratio", "rule_sum")


def normal_feature(name: str, value: Column) -> Column:
    """An edge feature in the scorer's range: counts as log1p, ratios within [0, 1], infinities bounded (ML2)."""
    value = F.coalesce(value.cast("double"), F.lit(0.0))
    if name.startswith("n_") or name.endswith("_count"):
        return F.log1p(F.greatest(value, F.lit(0.0)))
    if name.endswith("_ratio") or name == "confidence":
        return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))
    return F.greatest(F.least(value, F.lit(1e6)), F.lit(-1e6))


@dataclass(frozen=True)
class ScorerWeights:
    """Weights of a relational graph network with two layers and an edge scorer (ML3, ML4)."""

    self_1: np.ndarray
    relation_1: np.ndarray
    bias_1: np.ndarray
    self_2: np.ndarray
    relation_2: np.ndarray
    bias_2: np.ndarray
    relation_vector: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    #: The head that tells error types apart; without columns where there is none.
    error_hidden: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    error_bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    error_out: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def seeded(cls, node_dim: int, edge_dim: int, relations: int, hidden: int = 16, seed: int = 0, error_types: int = 0) -> ScorerWeights:
        """Random weights; with ``error_types`` there is a head for so many of them."""
        rng = np.random.default_rng(seed)
        w = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)
        wide = 2 * hidden + 8 + edge_dim
        made = cls(w(node_dim, hidden), w(relations, node_dim, hidden), np.zeros(hidden), w(hidden, hidden), w(relations, hidden, hidden), np.zeros(hidden), w(relations, 8), w(wide, hidden), np.zeros(hidden), w(hidden, 1)[:, 0])
        return replace(made, error_hidden=w(wide, hidden), error_bias=np.zeros(hidden), error_out=w(hidden, error_types)) if error_types else made


def edge_logits(x: np.ndarray, source: np.ndarray, target: np.ndarray, relation: np.ndarray, attributes: np.ndarray, w: ScorerWeights) -> np.ndarray:
    """Logit of every edge of one graph. Messages are summed along edge direction, one matrix a relation."""
    for own, by_relation, bias in ((w.self_1, w.relation_1, w.bias_1), (w.self_2, w.relation_2, w.bias_2)):
        out = x @ own + bias
        for r in np.unique(relation):
            mine = relation == r
            np.add.at(out, target[mine], x[source[mine]] @ by_relation[r])
        x = np.maximum(out, 0)
    wide = np.concatenate([x[source], x[target], w.relation_vector[relation], attributes], axis=1)
    return np.maximum(wide @ w.hidden + w.hidden_bias, 0) @ w.out


def suspicion(edges: DataFrame, node_features: DataFrame, relations: list[str], weights: ScorerWeights, features: tuple[str, ...] = EDGE_FEATURES) -> DataFrame:
    """``(pair_id, subject, predicate, object, suspicion)`` of the edges of every pair's subgraph (ML1, ML5, ML6).

    Subgraphs are capped before (see ``graph.capped``), so a group is bounded; predicates that the weights don't know
    count as the first. ``node_features`` is ``(pair_id, node, x array<double>)``.
    """
    number = F.greatest(F.array_position(F.array(*map(F.lit, relations)), F.col("predicate")) - 1, F.lit(0)).cast("int")
    ready = edges.select("pair_id", "subject", "predicate", "object", number.alias("relation"), F.array(*(normal_feature(f, F.col(f)) for f in features)).alias("attributes"))
    side = lambda c, x: node_features.select("pair_id", F.col("node").alias(c), F.col("x").alias(x))
    for c, x in (("subject", "xs"), ("object", "xo")):  # features are as many as edges: never a table for the driver to broadcast
        ready = ready.join(side(c, x).hint("merge"), ["pair_id", c])
    shared = edges.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("pair_id", ready_type(ready, "pair_id")), ("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string()), ("suspicion", pa.float64())])

    def score(group: pa.Table) -> pa.Table:
        subject, obj = group["subject"].to_pylist(), group["object"].to_pylist()
        names = sorted({*subject, *obj})
        place = {n: i for i, n in enumerate(names)}
        x = np.zeros((len(names), len(group["xs"][0].as_py())))
        for ids, column in ((subject, "xs"), (obj, "xo")):
            for n, row in zip(ids, group[column].to_pylist(), strict=True):
                x[place[n]] = row
        logit = edge_logits(x, np.array([place[n] for n in subject]), np.array([place[n] for n in obj]), group["relation"].to_numpy(), np.array(group["attributes"].to_pylist()), shared.value)
        return pa.table([group["pair_id"], group["subject"], group["predicate"], group["object"], pa.array(1 / (1 + np.exp(-logit)))], schema=schema)

    kind = ready.schema["pair_id"].dataType.simpleString()
    return ready.groupBy("pair_id").applyInArrow(score, f"pair_id {kind}, subject string, predicate string, object string, suspicion double")


def ready_type(df: DataFrame, column: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[df.schema[column].dataType.simpleString()]


def focal_loss(logit: np.ndarray, y: np.ndarray, gamma: float = 2.0, alpha: float = 0.25) -> float:
    """Mean focal loss (ML7)."""
    p = 1 / (1 + np.exp(-logit))
    right = np.where(y == 1, p, 1 - p)
    return float((np.where(y == 1, alpha, 1 - alpha) * (1 - right) ** gamma * -np.log(np.maximum(right, 1e-12))).mean())


def margin_loss(logit: np.ndarray, y: np.ndarray, margin: float = 1.0) -> float:
    """Mean shortfall of positives over negatives from the margin (ML7)."""
    gap = margin - (logit[y == 1][:, None] - logit[y == 0][None, :])
    return float(np.maximum(gap, 0).mean()) if gap.size else 0.0


def distillation_loss(logit: np.ndarray, y: np.ndarray, teacher: np.ndarray, alpha: float = 0.5, temperature: float = 2.0) -> float:
    """Mean cross-entropy with the labels and divergence from a teacher's probabilities, mixed by ``alpha`` (ML11)."""
    p, q = (np.clip(v, 1e-7, 1 - 1e-7) for v in (teacher, 1 / (1 + np.exp(-logit / temperature))))
    hard = (np.logaddexp(0, logit) - logit * y).mean()
    soft = (p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))).mean()
    return float((1 - alpha) * hard + alpha * temperature**2 * soft)


def compared(scored: DataFrame, models: tuple[str, ...], y: str = "y") -> DataFrame:
    """``(model, n, auroc, auprc)`` of models that scored the same labelled edges, one column each (ML11).

    Edges that any of them left without a score count for none, so that the models are compared on the same ones.
    """
    both = scored.filter(" and ".join(f"{c} is not null" for c in (*models, y)))
    out = None
    for m in models:
        rows = both.select(F.col(m).alias("score"), F.col(y).alias("y"))
        one = auroc_auprc(rows).select(F.lit(m).alias("model"), "auroc", "auprc").join(rows.agg(F.count("*").alias("n")))
        out = one if out is None else out.union(one)
    return out.select("model", "n", "auroc", "auprc")


def boosted_features(edges: DataFrame, relations: list[str], features: tuple[str, ...] = EDGE_FEATURES) -> DataFrame:
    """``edges`` with a vector ``features``: the edge features and a one-hot predicate; an unknown one has none."""
    from pyspark.ml.functions import array_to_vector

    hot = [(F.col("predicate") == r).cast("double") for r in relations]
    return edges.withColumn("features", array_to_vector(F.array(*(normal_feature(f, F.col(f)) for f in features), *(F.coalesce(h, F.lit(0.0)) for h in hot))))


def fit_boosted(edges: DataFrame, relations: list[str], features: tuple[str, ...] = EDGE_FEATURES, y: str = "y", rounds: int = 100, depth: int = 4, rate: float = 0.1):
    """A boosted-tree baseline over histograms of the features, positives weighted by negatives for each positive (ML10)."""
    from pyspark.ml.classification import GBTClassifier

    known = edges.filter(F.col(y).isin(0, 1))
    n = known.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n")).first()
    ready = boosted_features(known, relations, features).select("features", F.col(y).cast("double").alias("label"), F.when(F.col(y) == 1, n["n"] / max(1.0, n["p"])).otherwise(1.0).alias("w"))
    return GBTClassifier(weightCol="w", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=0).fit(ready)


def boosted_scores(model, edges: DataFrame, relations: list[str], features: tuple[str, ...] = EDGE_FEATURES, into: str = "score") -> DataFrame:
    """``edges`` with the model's probability of suspicion."""
    from pyspark.ml.functions import vector_to_array

    found = model.transform(boosted_features(edges, relations, features))
    return found.select(*edges.columns, vector_to_array("probability")[1].alias(into))


def fit_logistic(edges: DataFrame, features: tuple[str, ...] = EDGE_FEATURES, y: str = "y"):
    """A logistic baseline with balanced class weights on the edge features (ML10)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = edges.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n")).first()
    total = counts["p"] + counts["n"]
    weight = F.when(F.col(y) == 1, total / (2.0 * max(1, counts["p"]))).otherwise(total / (2.0 * max(1, counts["n"])))
    ready = edges.select(array_to_vector(F.array(*(normal_feature(f, F.col(f)) for f in features))).alias("features"), F.col(y).cast("double").alias("label"), weight.alias("w"))
    return LogisticRegression(weightCol="w", maxIter=50).fit(ready)

