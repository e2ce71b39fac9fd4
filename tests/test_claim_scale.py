"""The audit of whole claims reads its sources once, and axioms are held against kinds of pairs."""

from pyspark.sql import functions as F

from kgaudit.operators import claims, ontology
from kgaudit.plans import claim_queries


def test_claims_are_normalised_once(spark):
    for query in (claim_queries.claim_facts, claim_queries.claim_verdicts, claim_queries.claim_gates):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert " may raise" not in plan  # a claim's text is made for the written table alone


def test_axioms_meet_kinds_of_pairs(spark):
    kinds = [(s, o, p, e) for s in ("gene", "disease", None) for o in ("disease", "gene") for p in ("biolink:participates_in", "Participates_In", None) for e in (True, False, None)]
    rows = spark.createDataFrame([(i, "HGNC:1", "MONDO:1", *kinds[i % len(kinds)]) for i in range(3 * len(kinds))], "pair_id long, subject string, object string, subject_class string, object_class string, predicate string, has_evidence boolean")
    edges = spark.createDataFrame([("HGNC:1", "biolink:participates_in", "GO:1"), ("GO:1", "biolink:located_in", "MONDO:1"), ("HGNC:1", "other", "X:1")], "subject string, predicate string, object string")
    classes, properties, chains, restricted = ontology.Axioms().tables(spark)
    each = ontology.property_chains(ontology.restrictions(ontology.domain_range(ontology.disjoint_pairs(rows, classes), properties), restricted), edges, chains)
    out = ontology.check_all(rows, edges)
    names = [f for f in out.schema["dl"].dataType.names if f in each.columns]
    assert len(names) == 7
    told = lambda df, prefix: {r[0]: tuple(r)[1:] for r in df.select("pair_id", *(F.col(prefix + n) for n in names)).collect()}
    assert told(out, "dl.") == told(each, "") and out.count() == rows.count()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD [name" not in plan and "LogicalRDD [ord" not in plan  # axioms are constants, of which the planner knows how small they are


def test_sources_of_a_pair_travel_as_lists(spark):
    triples = spark.createDataFrame([("a", "p", "b", ["1", "2", None]), ("a", "q", "b", ["2", "3"]), ("c", "q", "d", [None]), ("c", "p", "d", None)], "subject string, predicate string, object string, sources array<string>")
    pairs = spark.createDataFrame([(1, "a", "b", "p"), (2, "a", "b", "r"), (3, "c", "d", "q"), (4, "x", "y", "p"), (5, "a", "b", None)], "pair_id long, subject string, object string, predicate string")
    found = claims.literature_facts(pairs, triples)
    assert {r["pair_id"]: (r["structured_source_count"], r["has_structured_support"]) for r in found.collect()} == {1: (2, True), 2: (3, True), 3: (0, False), 4: (0, False), 5: (3, True)}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
