"""Conditions, rules, gates, text, graph, ontology and learning operators on small inputs of our own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgaudit.functions import ids
from kgaudit.functions import text as tx
from kgaudit.operators import conditions, evidence, gates, graph, learning, ontology, rules, subgraph
from kgaudit.operators.rules import Rule


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# Conditions ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def facts(spark):
    schema = "facts struct<a: struct<n: int, x: double, flag: boolean, text: string, items: array<string>, none: string>>"
    return spark.createDataFrame([((((3, 1.5, True, "abc", ["u", "v"], None)),),), ((((0, None, False, "", [], None)),),)], schema)


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (("a.n", "exists"), (True, False)),
        (("a.text", "exists"), (True, False)),
        (("a.items", "exists"), (True, False)),
        (("a.none", "exists"), (False, False)),
        (("a.missing.deep", "exists"), (False, False)),
        (("a.flag", "equals", True), (True, False)),
        (("a.flag", "equals", 0), (False, True)),
        (("a.n", "equals", False), (False, True)),
        (("a.none", "equals", None), (True, True)),
        (("a.missing", "equals", None), (True, True)),
        (("a.x", "equals", False), (False, False)),
        (("a.text", "contains", "b"), (True, False)),
        (("a.items", "contains", "v"), (True, False)),
        (("a.none", "contains", "v"), (False, False)),
        (("a.x", "gt", 1), (True, False)),
        (("a.text", "gt", 1), (False, False)),
        (("a.flag", "gte", 1), (True, False)),
        (("a.n", "within_years", 3), (True, True)),
        (("a.n", "older_than_years", 2), (True, False)),
    ],
)
def test_atoms(facts, spec, want):
    schema = facts.schema["facts"].dataType
    assert tuple(r[0] for r in facts.selectExpr(conditions.atom(schema, *spec)).collect()) == want
    assert tuple(r[0] for r in facts.selectExpr(conditions.atom(schema, *spec, **({"negate": True}))).collect()) == tuple(not w for w in want)


def test_conditions_and_templates(facts):
    schema = facts.schema["facts"].dataType
    n, flag = {"fact": "a.n", "op": "gt", "value": 1}, {"fact": "a.flag", "negate": True}
    for spec, want in ((None, [True, True]), ([n], [True, False]), ({"any": [n, flag]}, [True, True]), ({"all": [n], "any": [flag]}, [False, False]), ({"any": []}, [True, True])):
        assert [r[0] for r in facts.select(conditions.condition(schema, spec)).collect()] == want
    with pytest.raises(ValueError):
        conditions.atom(schema, "a.n", "like", 1)
    shown = facts.select(conditions.template(schema, "n={a.n} x={a.x:.2f} {a.items} {a.no} {a.flag}")).collect()
    assert [r[0] for r in shown] == ["n=3 x=1.50 ['u', 'v'] ? True", "n=0 x=? [] ? False"]


# Rules -----------------------------------------------------------------------------------------------------------


def grounded(fired, attackers):
    """Labels by brute force: rounds until nothing changes."""
    label = {}
    while True:
        new = {}
        for r in fired:
            by = [a for a in attackers.get(r, ()) if a in fired]
            if any(label.get(a) == "IN" for a in by):
                new[r] = "OUT"
            elif all(label.get(a) == "OUT" for a in by):
                new[r] = "IN"
        if new == label:
            return {r: label.get(r, "UNDECIDED") for r in fired}
        label = new


def test_grounded_labels_match_brute_force(spark):
    rng = random.Random(2)
    for _ in range(6):
        names = [f"r{i}" for i in range(6)]
        made = []
        for name in names:
            attacks = tuple(rng.sample(names, rng.randint(0, 2)))
            kind = rng.choice(["defeats", "rebuts", "undercuts"])
            made.append(Rule(name, float(rng.randint(-3, 3)), [{"fact": f"f.{name}"}], "", float(rng.randint(0, 2)), **{kind: tuple(a for a in attacks if a != name)}))
        rows = [tuple(rng.random() < 0.7 for _ in names) for _ in range(12)]
        df = spark.createDataFrame([((r,),) for r in rows], "facts struct<f: struct<" + ",".join(f"{n}: boolean" for n in names) + ">>")
        attackers = rules.Attacks.of(made).by_target
        got = one(rules.evaluate(df, made), "facts", "features", "trace", "score")
        for (fact,), features, trace, score in got:
            fired = [n for n in names if fact[n]]
            want = grounded(fired, attackers)
            assert {t["rule_id"]: t["label"] for t in trace} == want
            weight = {r.id: r.weight for r in made}
            assert features == {n: weight[n] if n in fired and want[n] != "OUT" else 0.0 for n in names}
            assert score == pytest.approx(sum(features.values()))
            for t in trace:
                assert list(t["defeated_by"]) == sorted(a for a in attackers[t["rule_id"]] if want.get(a) == "IN" and t["label"] == "OUT")


def test_attacks_and_priorities():
    low, high = Rule("low", priority=1, defeats=("high",)), Rule("high", priority=2, rebuts=("low",))
    assert rules.Attacks.of([low, high]).by_target == {"low": ["high"], "high": []}
    equal = Rule("a", priority=1, rebuts=("b",)), Rule("b", priority=1)
    assert rules.Attacks.of(equal).by_target == {"a": ["b"], "b": ["a"]}
    assert rules.has_defeasible_parts([low]) and not rules.has_defeasible_parts([Rule("x")])


def test_default_rules_are_one_layer():
    by = rules.Attacks.of(rules.DEFAULT_RULES).by_target
    assert len(rules.DEFAULT_RULES) == 47 and sum(map(len, by.values())) == 27
    targets = {t for t, a in by.items() if a}
    assert len(targets) == 13 and not targets & {a for v in by.values() for a in v}


def test_rules_from_mappings():
    r = rules.rule_from({"id": "x", "weight": "no", "conditions": [{"fact": "a"}], "defeats": "y"})
    assert (r.weight, r.defeats, r.when) == (1.0, ("y",), [{"fact": "a"}])


def test_unknown_semantics(facts):
    with pytest.raises(ValueError):
        rules.evaluate(facts, [Rule("x")], semantics="preferred")


# Gates -----------------------------------------------------------------------------------------------------------

GATE_SCHEMA = """score double, facts struct<evidence: struct<retracted_count: int, concern_count: int, has_multiple_sources: boolean>, conflicts: struct<qualifier_negated: boolean, opposite_predicate_same_context: boolean>,
 extraction: struct<is_low_confidence: boolean>, type: struct<domain_valid: boolean, range_valid: boolean, is_spurious_self_referential: boolean>, ontology: struct<is_sibling_conflict: boolean>, tissue: struct<is_mismatch: boolean>,
 text_nli: struct<checked: boolean, n_support: int, n_contradict: int, m_lit: double, s_neg_total: double, claim_predicate_class: string, claim_is_hedged: boolean, paper_aggregates: array<struct<paper_type: string, s_neg: double>>>>"""


def gate_row(score=1.0, **over):
    base = {"evidence": [0, 0, True], "conflicts": [False, False], "extraction": [False], "type": [True, True, False], "ontology": [False], "tissue": [False], "text_nli": [True, 2, 0, 1.5, 0.0, "association", False, []]}
    for key, value in over.items():
        group, at = key.rsplit("_", 1)
        base[group][int(at)] = value
    return (score, tuple(tuple(v) for v in base.values()))


@pytest.mark.parametrize(
    ("row", "verdict", "gate"),
    [
        (gate_row(), "PASS", None),
        (gate_row(evidence_0=1), "FAIL", "gate:retraction"),
        (gate_row(evidence_1=1), "WARN", "gate:expression_of_concern"),
        (gate_row(evidence_2=False), "WARN", "gate:positive_evidence_required"),
        (gate_row(conflicts_0=True), "FAIL", "gate:self_negation"),
        (gate_row(conflicts_1=True), "FAIL", "gate:opposite_predicate"),
        (gate_row(extraction_0=True), "FAIL", "gate:low_confidence"),
        (gate_row(type_0=False), "FAIL", "gate:type_violation"),
        (gate_row(type_0=None), "PASS", None),
        (gate_row(type_2=True), "FAIL", "gate:spurious_self_referential"),
        (gate_row(ontology_0=True), "WARN", "gate:sibling_conflict"),
        (gate_row(tissue_0=True), "WARN", "gate:tissue_mismatch"),
        (gate_row(text_nli_2=2, text_nli_4=0.8), "FAIL", "gate:nli_strong_contradiction"),
        (gate_row(text_nli_7=[("primary_human", 0.9)]), "FAIL", "gate:nli_strong_contradiction"),
        (gate_row(text_nli_7=[("animal", 0.9)]), "PASS", None),
        (gate_row(text_nli_1=0, text_nli_2=1, text_nli_5="causal"), "FAIL", "gate:nli_no_support_with_contradiction"),
        (gate_row(text_nli_1=1, text_nli_3=0.5, text_nli_5="causal"), "WARN", "gate:nli_weak_causal_support"),
        (gate_row(text_nli_1=0, text_nli_3=0.0, text_nli_5="causal"), "PASS", None),
        (gate_row(text_nli_2=1, text_nli_3=0.1), "WARN", "gate:nli_mixed_evidence"),
        (gate_row(score=0.84, text_nli_6=True), "WARN", "gate:nli_hedged_claim"),
        (gate_row(score=0.85, text_nli_6=True), "PASS", None),
        (gate_row(score=-0.1), "WARN", None),
        (gate_row(score=-0.5, ontology_0=True), "FAIL", None),
    ],
)
def test_gates(spark, row, verdict, gate):
    got = one(gates.apply_gates(spark.createDataFrame([row], GATE_SCHEMA)), "verdict", "gate_trace")[0]
    assert got == (verdict, [gate] if gate else [])


def test_strict_ontology(spark):
    df = gates.apply_gates(spark.createDataFrame([gate_row(ontology_0=True)], GATE_SCHEMA))
    assert one(gates.strict_ontology(df), "verdict") == [("FAIL",)]


# Identifiers and text --------------------------------------------------------------------------------------------


def test_identifiers(spark):
    rows = {"12345": "PMID:12345", "pmid: 12": "PMID:12", "PMCID:77": "PMC77", "pmc9": "PMC9", "doi:10.1/X": "10.1/X", "https://doi.org/10.1/x": "10.1/x", " 10.5/y ": "10.5/y", "GO:1": "GO:1"}
    df = spark.createDataFrame([(k,) for k in rows], "i string")
    assert dict(one(df, "i", ids.normal_citation(F.col("i")))) == rows
    kinds = {"hgnc:5": "gene", "MONDO:1": "disease", "HP:1": "phenotype", "R-HSA-1": "pathway", "PMC1": "publication", "OMIM:1": "unknown"}
    df = spark.createDataFrame([(k,) for k in kinds], "i string")
    assert dict(one(df, "i", ids.category_of(F.col("i")))) == kinds
    vector = one(spark.range(1), ids.hash_embedding(F.lit("x"), 4))[0][0]
    assert len(vector) == 4 and all(0 <= x < 1 for x in vector)


def test_text(spark):
    df = spark.createDataFrame([("Inactivates it. It may, possibly, block X!  No 10.1000/a.b. PMID: 12345 pmid:12345 PMID: 12345",)], "t string")
    t = F.col("t")
    row = df.select(tx.sentences(t), tx.citations(t), tx.hedging_terms(t), tx.polarity(F.lit("inactivates")), tx.polarity(F.lit("blocks")), tx.named_predicate(t), tx.predicate_class(F.lit("leads_to")), tx.predicate_class(F.lit("biolink:related_to")), tx.is_negated(F.lit("Does not")), tx.mentions(t, F.lit("x")), tx.mentions(t, F.lit("")), tx.occurrences(F.lit("aaaa"), F.lit("aa"))).first()
    assert row[0][:2] == ["Inactivates it.", "It may, possibly, block X!"]
    assert row[1] == ["PMID: 12345", "PMID:12345", "10.1000/a.b"]
    assert row[2] == ["possibly", "may"]
    assert tuple(row)[3:] == ("positive", "negative", "activates", "causal", "association", True, True, False, 2)


def test_sections_and_labels(spark):
    section = lambda s, i, n: tx.section(F.lit(s), F.lit(i), F.lit(n))
    row = spark.range(1).select(section("We found x", 0, 9), section("x", 1, 10), section("x", 9, 10), section("x", 6, 10), section("x", 3, 10), tx.nli_label(F.lit(True), F.lit("negative"), F.lit(None)), tx.nli_label(F.lit(True), F.lit(None).cast("string"), F.lit("positive")), tx.nli_label(F.lit(False), F.lit("positive"), F.lit("positive")), tx.nli_label(F.lit(True), F.lit("positive"), F.lit("positive")), tx.between_mentions(F.lit("A strongly, raises B."), F.lit("a"), F.lit("b"))).first()
    assert tuple(row) == ("results", "introduction", "conclusion", "results", "abstract", "REFUTE", "NEI", "NEI", "SUPPORT", "strongly, raises")


# Evidence --------------------------------------------------------------------------------------------------------


def test_provenance_cascade(spark):
    claims = spark.createDataFrame([(1, [" PMID:1 ", "1", "", "GO:5", "PMID:RETRACT:9", "10.1/x", "GO:5"])], "claim_id int, citations array<string>")
    known = spark.createDataFrame([("pmid:1", "concern"), ("doi:10.1/x", "clean")], "identifier string, status string")
    notices = spark.createDataFrame([("10.1/x", "retracted"), ("PMID:1", "correction")], "identifier string, notice_status string")
    got = {r["identifier"]: (r["status"], r["kind"], r["source"]) for r in evidence.provenance(evidence.claim_citations(claims), known, notices).collect()}
    assert got == {"PMID:1": ("concern", "pmid", "cache"), "1": ("concern", "pmid", "cache"), "GO:5": ("clean", "other", "other"), "PMID:RETRACT:9": ("retracted", "pmid", "heuristic"), "10.1/x": ("retracted", "doi", "cache")}


def test_years_and_decay(spark):
    row = spark.range(1).select(evidence.year_of(F.lit("2010-05"), 2020), evidence.year_of(F.lit("1899"), 2020), evidence.year_of(F.lit("x"), 2020), evidence.first_year([F.lit("bad"), F.lit("2001")], F.lit(1999), 2020), evidence.first_year([F.lit(None).cast("string"), F.lit("")], F.lit(1999), 2020), evidence.decay(F.lit(10.0)), evidence.decay(F.lit(100.0)), evidence.decay(F.lit(-1.0))).first()
    assert tuple(row) == (2010, None, None, None, 1999, 0.5, 0.1, 1.0)


# Graph -----------------------------------------------------------------------------------------------------------


def edge_table(spark, pairs):
    return spark.createDataFrame([(a, "p", b) for a, b in pairs], "subject string, predicate string, object string")


def test_distances_clustering_degrees(spark):
    rng = random.Random(1)
    names = [f"n{i}" for i in range(14)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(26)] + [("n0", "n1"), ("n0", "n1"), ("n2", "n2")]
    edges = edge_table(spark, pairs)
    near = {n: {b for a, b in pairs if a == n and b != n} | {a for a, b in pairs if b == n and a != n} for n in names}
    dist, paths, level = {"n0": 0}, {"n0": 1}, ["n0"]
    for hop in range(1, 4):
        new = {}
        for n in level:
            for m in near[n]:
                if m not in dist:
                    new[m] = new.get(m, 0) + paths[n]
        dist |= {m: hop for m in new}
        paths |= new
        level = list(new)
    starts = spark.createDataFrame([(1, "n0")], "request_id int, node string")
    got = graph.distances(starts, graph.neighbours(edges), 3).collect()
    assert {r["node"]: (r["dist"], r["paths"]) for r in got} == {n: (dist[n], paths[n]) for n in dist}
    found = {r["node"]: r["clustering"] for r in graph.clustering(edges).collect()}
    for n in names:
        d = len(near[n])
        t = sum(b in near[a] for a in near[n] for b in near[n] if a < b)
        assert found.get(n, 0.0) == pytest.approx(2 * t / (d * (d - 1)) if d >= 2 else 0.0)
    assert all(r["clustering"] == 0 for r in graph.clustering(edges, most_degree=1).collect())
    degree = {r["node"]: (r["out_degree"], r["in_degree"], r["degree"]) for r in graph.degrees(edges).collect()}
    assert all(degree[n] == (o := sum(a == n for a, _ in pairs), i := sum(b == n for _, b in pairs), o + i) for n in degree)


def test_ego_and_shortest_edges(spark):
    edges = edge_table(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("x", "y")])
    _, found = graph.ego(spark.createDataFrame([(1, "a")], "request_id int, node string"), edges, 1)
    assert {(r["subject"], r["object"]) for r in found.collect()} == {("a", "b"), ("a", "d")}
    pairs = spark.createDataFrame([(7, "a", "c"), (8, "a", "y")], "pair_id int, subject string, object string")
    on = {(r["pair_id"], r["subject"], r["object"]) for r in graph.edges_on_shortest_paths(pairs, edges, 3).collect()}
    assert on == {(7, "a", "b"), (7, "b", "c"), (7, "a", "d"), (7, "d", "c")}
    through = {r["node"]: r["paths_on_shortest"] for r in graph.pair_distances(pairs, edges, 3).filter("pair_id = 7").collect()}
    assert through == {"a": 2, "b": 1, "d": 1, "c": 2, "e": 0}


def test_subgraph_and_queries(spark):
    edges = edge_table(spark, [("g1", "g2"), ("g1", "d1"), ("d1", "d2"), ("g2", "d1"), ("g1", "z")])
    nodes = spark.createDataFrame([("g1", "gene"), ("g2", "gene"), ("d1", "disease"), ("d2", "disease"), ("z", "other")], "id string, category string")
    pairs = spark.createDataFrame([(1, "g1", "d1")], "pair_id int, subject string, object string")
    by_letter = lambda c: F.when(c.startswith("g"), "gene").when(c.startswith("d"), "disease").otherwise("other")
    kept, inside = subgraph.pair_subgraph(pairs, nodes, edges, 1, ("gene", "disease"), ids.allowed_edge, category_of=by_letter)
    assert {r["node"] for r in kept.collect()} == {"g1", "g2", "d1", "d2"}
    assert {(r["subject"], r["object"]) for r in inside.collect()} == {("g1", "g2"), ("g1", "d1"), ("g2", "d1")}
    asked = spark.createDataFrame([(1, "g1", "g2", None), (2, "g1", "d1", "q")], "request_id int, subject string, object string, predicate string")
    assert [r["request_id"] for r in graph.query_edges(asked, edges).collect()] == [1]
    assert graph.either_way(pairs.selectExpr("pair_id", "object subject", "subject object"), edges).count() == 1


def test_support_and_attempts(spark):
    assoc = spark.createDataFrame([("a",), ("b",)], "association_id string")
    support = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3), ("a", 4)], "association_id string, pub_id int")
    pubs = spark.createDataFrame([(1, True, 0), (2, False, 2), (3, False, 0), (4, False, 0)], "pub_id int, retracted boolean, cites_retracted_count int")
    got = {r["association_id"]: (r["n_publications"], r["retracted_support_ratio"], r["citing_retracted_ratio"]) for r in graph.support_ratios(assoc, support, pubs).collect()}
    assert got == {"a": (4, 0.25, 0.25), "b": (0, None, None)}
    tries = spark.createDataFrame([("q", 1, 0), ("q", 2, 3), ("q", 3, 9), ("r", 1, 0), ("r", 2, 0)], "k string, attempt_no int, n_edges int")
    assert {tuple(r) for r in graph.first_hit(tries, "k").collect()} == {("q", 2, 3), ("r", 2, 0)}


# Ontology --------------------------------------------------------------------------------------------------------


def test_ontology(spark):
    term = lambda i, up, c="phenotype": {"id": F.lit(i), "ancestors": F.array(*map(F.lit, up)), "category": F.lit(c)}
    a, b, root = term("HP:1", ["hp:9 ", "HP:0000118"]), term("HP:2", ["HP:9", "HP:0000118"]), term("HP:3", ["HP:0000118"])
    above = term("HP:9", ["HP:0000118"])
    row = spark.range(1).select(ontology.sibling_conflict(a, b, F.lit("p")), ontology.sibling_conflict(a, root, F.lit("p")), ontology.sibling_conflict(a, above, F.lit("p")), ontology.sibling_conflict(a, root, F.lit("x:sibling_of")), ontology.tissue_mismatch(F.lit("UBERON:1"), F.array(F.lit("uberon:2"))), ontology.tissue_mismatch(F.lit("UBERON:1"), F.array(F.lit("UBERON:1")))).first()
    assert tuple(row) == (True, False, False, True, True, False)
    edges = spark.createDataFrame([("s", "biolink:has_part", "m"), ("m", "causes", "o"), ("m", "causes", "x")], "subject string, predicate string, object string")
    pairs = spark.createDataFrame([(1, "s", "o"), (2, "s", "q"), (3, "m", "o")], "pair_id int, subject string, object string")
    chains = spark.createDataFrame([("c", "has_part", "causes")], "chain_id string, first string, second string")
    got = {r["pair_id"]: (r["property_chain_support"], r["property_chain_conflict"]) for r in ontology.property_chains(pairs, edges, chains).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False)}


# Learning --------------------------------------------------------------------------------------------------------


def test_ranking_metrics(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    got = learning.auroc_auprc(spark.createDataFrame(rows, "score double, y int")).first()
    assert got["auroc"] == pytest.approx(auc)
    ap = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(n >= s for n in neg)
        ap += sum(p == s for p in pos) * tp / (tp + fp) / len(pos)
    assert got["auprc"] == pytest.approx(ap)


def test_calibration(spark):
    rng = np.random.default_rng(0)
    p = rng.random(400)
    df = spark.createDataFrame([(float(x), int(rng.random() < x * x)) for x in p], "p double, y int")
    before = learning.calibration_error(df).first()["ece"]
    x, y = learning.fit_isotonic(df)
    assert y == sorted(y)
    after = learning.calibration_error(df.withColumn("p", learning.apply_isotonic(F.col("p"), x, y))).first()["ece"]
    slope, intercept = learning.fit_platt(df)
    platt = learning.calibration_error(df.withColumn("p", learning.apply_platt(F.col("p"), slope, intercept))).first()["ece"]
    assert after < before and platt < before
    logits = df.withColumn("logit", 3 * F.log(F.col("p") / (1 - F.col("p"))))
    assert learning.fit_temperature(logits) > 1


def test_prototypes(spark):
    df = spark.createDataFrame([("a", i, [1.0, 0.0 + i]) for i in range(3)] + [("b", 0, [0.0, -1.0])], "label string, ord int, vec array<double>")
    means = {r["label"]: r["centroid"] for r in learning.centroids(df, last=2).collect()}
    assert means == {"a": [1.0, 1.5], "b": [0.0, -1.0]}


def test_edge_scorer(spark):
    weights = learning.ScorerWeights.seeded(3, 6, 2, hidden=4)
    x, attributes = np.random.default_rng(1).standard_normal((4, 3)), np.zeros((3, 6))
    source, target, relation = np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([0, 1, 0])
    got = learning.edge_logits(x, source, target, relation, attributes, weights)
    h = x
    for own, by, bias in ((weights.self_1, weights.relation_1, weights.bias_1), (weights.self_2, weights.relation_2, weights.bias_2)):
        new = h @ own + bias
        for s, t, r in zip(source, target, relation):
            new[t] = new[t] + h[s] @ by[r]
        h = np.maximum(new, 0)
    want = [np.maximum(np.concatenate([h[s], h[t], weights.relation_vector[r], a]) @ weights.hidden + weights.hidden_bias, 0) @ weights.out for s, t, r, a in zip(source, target, relation, attributes)]
    assert np.allclose(got, want)
    names = "abcd"
    edges = spark.createDataFrame([(1, names[s], f"r{r}", names[t], 1, 0, 1.0, 0.0, 0.0, 0.0) for s, t, r in zip(source.tolist(), target.tolist(), relation.tolist())], "pair_id long, subject string, predicate string, object string, n_sources int, n_pmids int, confidence double, evidence_age double, retracted_support_ratio double, rule_sum double")
    features = spark.createDataFrame([(1, names[i], x[i].tolist()) for i in range(4)], "pair_id long, node string, x array<double>")
    attributes = np.tile([np.log1p(1), 0, 1.0, 0, 0, 0], (3, 1))
    want = 1 / (1 + np.exp(-learning.edge_logits(x, source, target, relation, attributes, weights)))
    got = {r["subject"]: r["suspicion"] for r in learning.suspicion(edges, features, ["r0", "r1"], weights).collect()}
    assert [got[names[s]] for s in source] == pytest.approx(want.tolist())


def test_losses():
    logit, y = np.array([5.0, -5.0]), np.array([1, 0])
    assert learning.focal_loss(logit, y) < learning.focal_loss(-logit, y)
    assert learning.margin_loss(logit, y) == 0 and learning.margin_loss(-logit, y) == 11


def test_perturbations(spark):
    edges = spark.createDataFrame([(f"s{i}", "p", f"o{i}", 3, 0.0) for i in range(500)], "subject string, predicate string, object string, n_sources int, retracted_support_ratio double")
    rows = learning.perturbed(edges).collect()
    kinds = {k: [r for r in rows if r["perturbation"] == k] for k in ("direction_flip", "evidence_ablation", "retracted_override", None)}
    assert 60 < len(kinds["direction_flip"]) < 140 and all(r["subject"].startswith("o") for r in kinds["direction_flip"])
    assert kinds["evidence_ablation"] and all(r["n_sources"] == 0 for r in kinds["evidence_ablation"])
    assert kinds["retracted_override"] and all(r["retracted_support_ratio"] == 1 for r in kinds["retracted_override"])
    assert all(r["is_perturbed_edge"] == 0 for r in kinds[None])
    assert rows == learning.perturbed(edges).collect()
