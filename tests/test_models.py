"""Error types, distillation, baselines and pretraining of the models on graphs."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgaudit.operators import learning, pretraining, training

COLUMNS = "pair_id long, subject string, predicate string, object string, y int, error int, n_sources int, n_pmids int, confidence double, evidence_age double, retracted_support_ratio double, rule_sum double"


def slopes(loss, at):
    return np.array([(loss(at + d) - loss(at - d)) / 2e-6 for d in np.eye(at.size) * 1e-6])


def test_joint_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    g = training.Graph(rng.standard_normal((5, 3)), np.array([0, 1, 2, 0, 4]), np.array([1, 2, 3, 3, 0]), np.array([0, 1, 0, 1, 1]), rng.standard_normal((5, 6)), np.array([1, 0, -1, 0, 1]), np.array([2, -1, 0, -1, 1]), np.array([0.9, 0.2, 0.5, np.nan, 1.0]))
    w = learning.ScorerWeights.seeded(3, 6, 2, hidden=4, seed=3, error_types=3)
    goal = training.Loss(positive_weight=2.5, error_weight=0.7, alpha=0.4, temperature=3.0)
    found, at = training.flat(training.gradient(g, w, goal)[1]), training.flat(w)
    assert found == pytest.approx(slopes(lambda v: training.gradient(g, training.shaped(v, w), goal)[0], at), abs=1e-5)
    none = dataclasses.replace(g, error=np.full(5, -1))
    assert not training.gradient(none, w, goal)[1].error_out.any()


def test_distillation_loss_by_hand():
    rng = np.random.default_rng(2)
    g = training.Graph(rng.standard_normal((4, 3)), np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([0, 0, 0]), rng.standard_normal((3, 6)), np.array([1, 0, 1]), None, np.array([0.8, 0.3, 0.6]))
    w = learning.ScorerWeights.seeded(3, 6, 1, hidden=4, seed=5)
    logit = training.forward(g, w)[0]
    want = learning.distillation_loss(logit, g.y, g.teacher, alpha=0.3, temperature=2.0)
    assert training.gradient(g, w, training.Loss(alpha=0.3, temperature=2.0))[0] == pytest.approx(3 * want)
    p, q = 0.8, 1 / (1 + np.exp(-1.0 / 2))
    one = 0.7 * np.log1p(np.exp(-1.0)) + 0.3 * 4 * (p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q)))
    assert learning.distillation_loss(np.array([1.0]), np.array([1]), np.array([0.8]), 0.3, 2.0) == pytest.approx(one)


def typed(spark, pairs=60):
    """Suspicious edges have low confidence; those with a retracted source are of type 1, the others of type 0."""
    rows = []
    for p in range(pairs):
        for i in range(4):
            y, k = int((p * 7 + i * 3) % 5 < 2), int((p + i) % 2)
            rows.append((p, f"s{p}", "r", f"o{i}", y, k if y and i else None, 1, 1, 0.1 if y else 0.9, 0.0, float(k), 0.0))
    edges = spark.createDataFrame(rows, COLUMNS)
    nodes = edges.select("pair_id", F.explode(F.array("subject", "object")).alias("node")).distinct()
    return edges, nodes.withColumn("x", F.array(F.lit(1.0), F.lit(0.5)))


def test_error_types_are_learnt_and_told(spark):
    edges, nodes = typed(spark)
    table = training.graphs(edges, nodes, ["r"])
    start = learning.ScorerWeights.seeded(2, 6, 1, seed=1, error_types=2)
    found = training.train(table, start, epochs=40, rate=0.05, patience=0, goal=training.Loss(error_weight=1.0))
    told = training.predictions(table, found.weights, ["weak", "retracted"]).join(edges, ["pair_id", "subject", "predicate", "object"]).collect()
    assert len(told) == 240 and all(abs(sum(r["error_probabilities"].values()) - 1) < 1e-9 for r in told)
    assert all((r["error_type"] is None) == (r["suspicion"] < 0.5) for r in told)
    known = [r for r in told if r["error_type"] and r["y"] == 1]
    right = sum(r["error_type"] == ("retracted" if r["retracted_support_ratio"] else "weak") for r in known)
    assert len(known) > 60 and right / len(known) > 0.9
    without = training.predictions(table, learning.ScorerWeights.seeded(2, 6, 1), ["weak", "retracted"]).first()
    assert without["error_type"] is None and without["error_probabilities"] is None and 0 <= without["suspicion"] <= 1


def test_distilled_scorer_follows_its_teacher(spark):
    edges, nodes = typed(spark, 40)
    teacher = edges.select("pair_id", "subject", "predicate", "object", F.when(F.col("retracted_support_ratio") > 0, 0.95).otherwise(0.05).alias("score"))
    start = learning.ScorerWeights.seeded(2, 6, 1, seed=1)
    pure = training.distilled(edges, teacher, nodes, ["r"], start, alpha=1.0, epochs=60, rate=0.05, patience=0)
    table = training.graphs(edges, nodes, ["r"])
    last = training.train(table, start, epochs=60, rate=0.05, patience=0)
    assert pure.losses[-1] < 0.3 * pure.losses[0] and len(last.losses) == 60
    half = training.distilled(edges, teacher.filter("pair_id < 5"), nodes, ["r"], start, epochs=2, patience=0)
    assert len(half.losses) == 2


def test_boosted_trees_beside_the_logistic_baseline(spark):
    """Suspicious is what has either many sources or little confidence, not both: no line tells them apart."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        many, low, r = rng.random() < 0.5, rng.random() < 0.5, ("r", "q")[i % 2]
        rows.append((i, "s", r, "o", int((many != low) and (r == "r" or rng.random() < 0.5)), None, 20 if many else 1, 1, 0.2 if low else 0.8, 0.0, 0.0, float(rng.random())))
    edges = spark.createDataFrame(rows, COLUMNS)
    fit, check = edges.filter("pair_id % 4 <> 0"), edges.filter("pair_id % 4 = 0")
    trees = learning.boosted_scores(learning.fit_boosted(fit, ["r", "q"], rounds=10), check, ["r", "q"], into="trees")
    from pyspark.ml.functions import vector_to_array

    line = learning.fit_logistic(fit).transform(learning.boosted_features(trees, []).select(*trees.columns, "features")).withColumn("line", vector_to_array("probability")[1])
    got = {r["model"]: r for r in learning.compared(line, ("trees", "line")).collect()}
    assert got["trees"]["n"] == got["line"]["n"] == 300
    assert got["trees"]["auroc"] > 0.85 > 0.75 > got["line"]["auroc"] and got["trees"]["auprc"] > got["line"]["auprc"]
    some = learning.compared(line.withColumn("line", F.when(F.col("pair_id") < 600, F.col("line"))), ("trees", "line")).collect()
    assert {r["n"] for r in some} == {150}


def test_link_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(4)
    nodes = lambda counts: pretraining.Nodes.of(rng.standard_normal((len(counts), 6)).tolist(), [rng.standard_normal((n, 6)).tolist() for n in counts])
    a, b, y, w = nodes([2, 0, 3, 1]), nodes([1, 2, 0, 4]), np.array([1.0, 0.0, 1.0, 0.0]), pretraining.Encoder.seeded(3, 5, 4, seed=2)
    arrays = [getattr(w, f.name) for f in dataclasses.fields(w)]

    def shaped(v):
        return pretraining.Encoder(*(p.reshape(x.shape) for p, x in zip(np.split(v, np.cumsum([x.size for x in arrays])[:-1]), arrays, strict=True)))

    at = np.concatenate([x.ravel() for x in arrays])
    assert pretraining.link_gradient(a, b, y, w)[1] == pytest.approx(slopes(lambda v: pretraining.link_gradient(a, b, y, shaped(v))[0], at), abs=1e-5)


def two_camps(spark, size=40, seed=6):
    """Links stand mostly within two camps, which the nodes' vectors tell."""
    rng = np.random.default_rng(seed)
    names = [f"n{i}" for i in range(2 * size)]
    rows = {tuple(sorted(rng.choice(size, 2, replace=False) + size * int(rng.random() < 0.5))) for _ in range(size * 12)}
    edges = spark.createDataFrame([(names[a], "r", names[b]) for a, b in sorted(rows)], "subject string, predicate string, object string")
    vectors = [(n, [float(i < size), float(i >= size)] + rng.standard_normal(2).tolist()) for i, n in enumerate(names)]
    return edges, spark.createDataFrame(vectors, "node string, vec array<double>")


def test_samples_and_rows_of_nodes(spark):
    edges = spark.createDataFrame([("hub", "r", f"n{i}") for i in range(300)] + [("n0", "r", "n0")], "subject string, predicate string, object string")
    near = pretraining.sampled_neighbours(edges, 5)
    got = {r["node"]: r["n"] for r in near.groupBy("node").agg(F.count("*").alias("n")).collect()}
    assert got["hub"] == 5 and all(n == 1 for k, n in got.items() if k != "hub") and len(got) == 301
    assert sorted(near.collect()) == sorted(pretraining.sampled_neighbours(edges.repartition(3), 5).collect())
    features = pretraining.degree_features(edges)
    assert features.filter("node = 'hub'").first()["x"] == pytest.approx([0.0, np.log(301), np.log(301)])
    alone = features.union(spark.createDataFrame([("alone", [1.0, 2.0, 3.0])], "node string, x array<double>"))
    rows = {r["node"]: r for r in pretraining.node_rows(edges, alone, 5).collect()}
    assert rows["alone"]["own"] == [1.0, 2.0, 3.0, 0.0, 0.0, 0.0] and rows["alone"]["near"] == []
    assert len(rows["hub"]["near"]) == 5 and rows["hub"]["own"][3:] == pytest.approx([np.log(2), 0.0, np.log(2)])


def test_drawn_pairs_are_not_linked(spark):
    edges, _ = two_camps(spark)
    linked = pretraining.linked_pairs(edges)
    nodes = edges.select(F.explode(F.array("subject", "object")).alias("node"))
    drawn = pretraining.unlinked_pairs(linked, nodes, buckets=7)
    known, got = {tuple(r) for r in linked.collect()}, {tuple(r) for r in drawn.collect()}
    assert not known & got and all(a < b for a, b in got) and len(got) > 0.4 * len(known)
    assert got == {tuple(r) for r in pretraining.unlinked_pairs(linked, nodes.repartition(2), buckets=7).collect()}
    assert pretraining.unlinked_pairs(linked.limit(0), nodes.limit(0)).count() == 0


def test_pretraining_finds_the_camps(spark):
    edges, vectors = two_camps(spark)
    features = pretraining.degree_features(edges, vectors)
    found = pretraining.pretrain(edges, features, epochs=25, rate=0.02)
    assert found.losses[-1] < 0.8 * found.losses[0] and found.auroc > 0.7
    vectors = {r["node"]: r["embedding"] for r in pretraining.embedded(found.rows, found.encoder).collect()}
    assert len(vectors) == features.count() and {len(v) for v in vectors.values()} == {16}
    nothing = pretraining.pretrain(edges.limit(0), features.limit(0), epochs=2)
    assert nothing.losses == [] and nothing.auroc is None


def test_embeddings_layer_by_layer(spark):
    """Those of all nodes, made without rows of samples, are those that the rows give; only ends of pairs have rows in the training."""
    edges, vectors = two_camps(spark)
    edges = edges.union(edges.limit(30))
    found = pretraining.pretrain(edges, pretraining.degree_features(edges, vectors), epochs=2, most_pairs=40)
    want = {r["node"]: r["embedding"] for r in pretraining.embedded(found.rows, found.encoder).collect()}
    got = {r["node"]: r["embedding"] for r in found.embeddings.collect()}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in want)
    ends = pretraining.end_rows(edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).limit(3), found.own, found.steps, True)
    all_rows = {r["node"]: r for r in found.rows.collect()}
    assert 3 < ends.count() <= 6 and all(all_rows[r["node"]] == r for r in ends.collect())


def test_degree_features_with_vectors_made_in_tasks(spark):
    from kgaudit.functions import ids

    edges, _ = two_camps(spark)
    nodes = edges.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    want = {r["node"]: r["x"] for r in pretraining.degree_features(edges, nodes.select("node", ids.hash_embedding(F.col("node"), 3).alias("vec"))).collect()}
    got = {r["node"]: r["x"] for r in pretraining.degree_features(edges, ids.HashVectors(3)).collect()}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], rel=1e-14) for n in want)


def test_isotonic_knots_of_any_number(spark):
    x, y = [0.1, 0.2, 0.2, 0.6, 0.9], [0.0, 0.3, 0.3, 0.5, 1.0]
    points = [None, 0.0, 0.1, 0.15, 0.2, 0.4, 0.6, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([(p,) for p in points], "p double").select("p", learning.apply_isotonic(F.col("p"), x, y).alias("c"))
    got = {r["p"]: r["c"] for r in df.collect()}
    assert got.pop(None) is None
    assert [got[p] for p in points[1:]] == pytest.approx([float(np.interp(p, x, y)) for p in points[1:]])
    one = spark.range(3).select(learning.apply_isotonic(F.col("id").cast("double"), [1.0], [0.5]).alias("c")).collect()
    assert [r["c"] for r in one] == [0.5, 0.5, 0.5]


def test_nearest_prototype_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(30)] + [(99, [0.0] * 4)], "row_id int, vec array<double>")
    kinds = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(9)], "label int, centroid array<double>")
    want = sorted(learning.nearest_prototype(rows, kinds).collect())
    monkeypatch.setattr(learning, "MAX_PROTOTYPES", 4)
    assert sorted(learning.nearest_prototype(rows, kinds).collect()) == want and len(want) == 31
    assert next(r for r in want if r["row_id"] == 99)["predicted"] == 0
