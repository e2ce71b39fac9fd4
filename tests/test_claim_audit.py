"""The audit of whole claims, from JSON lines to verdicts, and the rule set in literal values."""

import json

import pytest

from kgaudit.operators import claims as cl
from kgaudit.operators import rules
from kgaudit.plans import claim_audit
from kgaudit.sources import ingest, stores

# Rules and weights.
WEIGHTS = {
    "type_domain_range_valid": 0.0, "type_domain_range_violation": 0.0, "spurious_self_referential_claim": 0.0, "ontology_closure_hpo": 0.4, "ontology_sibling_conflict": -0.6, "retraction_gate": -1.5, "expression_of_concern": -0.5,
    "self_negation_conflict": -1.3, "opposite_predicate_same_context": -1.3, "extraction_low_confidence": -1.1, "multi_source_bonus": 0.2, "multi_source_unverified_penalty": -0.3, "minimal_evidence": -0.6, "disgenet_support_bonus": 0.5,
    "disgenet_missing_support_penalty": -0.3, "structured_literature_support": 0.4, "tissue_mismatch": -0.6, "generic_predicate_penalty": -0.5, "monarch_missing_support_penalty": -0.2, "structured_literature_strong": 0.3,
    "nli_multi_source_support": 0.5, "nli_single_source_support": 0.2, "nli_strong_support_margin": 0.4, "nli_contradiction_detected": -0.6, "nli_negative_margin": -0.8, "nli_predicate_mismatch": -0.3, "nli_hedged_claim_penalty": -0.15,
    "nli_no_evidence_checked": -0.05, "tumor_suppressor_positive_predicate": -0.6, "cosmic_cancer_gene_bonus": 0.2, "dl_disjoint_pair_violation": -1.2, "dl_domain_violation": -0.8, "dl_range_violation": -0.8, "dl_property_chain_support": 0.3,
    "dl_property_chain_conflict": -0.7, "dl_universal_violation": -0.9, "dl_existential_warning": -0.2, "temporal_recent_support_bonus": 0.2, "temporal_only_old_support_penalty": -0.2, "temporal_stale_unsupported_claim": -0.5,
    "temporal_longstanding_support_bonus": 0.3, "temporal_retraction_after_publication": -0.4, "temporal_quick_retraction": -0.6, "temporal_concern_without_resolution": -0.3, "temporal_support_after_concern_mitigates": 0.15,
    "temporal_no_support_since_retraction": -0.25, "temporal_was_supported_until_retraction": 0.0,
}


def test_weights_of_the_rules():
    assert {r.id: r.weight for r in rules.DEFAULT_RULES} == WEIGHTS


def line(number, subject, predicate, obj, evidence, text="It is so.", **more):
    ends = {"subject": {"curie": subject, "label": "GENA"}, "subject_type": "gene", "object": {"curie": obj, "label": "illness"}, "object_type": "disease"}
    return json.dumps({"id": number, "claim": text, "predicate": predicate, "evidence": evidence} | ends | more)


def pubmed(*numbers):
    return [{"type": "pubmed", "pmid": n} for n in numbers]


@pytest.fixture(scope="module")
def verdicts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("claims")
    lines = [
        line("good", "HGNC:1", cl.CONDITION, "MONDO:1", pubmed("10", "11")),
        line("retracted", "HGNC:1", cl.CONDITION, "MONDO:1", pubmed("10", "66")),
        line("types", "MONDO:1", cl.CONDITION, "HGNC:1", pubmed("10", "11")),
        line("negated", "HGNC:1", cl.CONDITION, "MONDO:1", pubmed("10", "11"), text="GENA does not cause illness."),
        line("opposite", "HGNC:2", "biolink:activates", "GO:5", pubmed("10", "11")),
        line("tissue", "HGNC:1", cl.CONDITION, "MONDO:1", [*pubmed("10", "11"), {"type": "uberon", "id": "UBERON:9"}], qualifiers={"tissue": "UBERON:1"}),
        line("unread", "HGNC:1", cl.CONDITION, "", []),
        line("refuted", "HGNC:1", cl.CONDITION, "MONDO:1", [{"type": "pubmed", "pmid": "10", "status": "refutes"}, *pubmed("11")]),
        '{"id": "cut off", "cl',
    ]
    (folder / "claims.jsonl").write_text("\n".join(lines))
    frame = spark.createDataFrame
    none = frame([], "subject string, subject_label string, object string, object_label string, ord int")
    rows = [("GENB", "HGNC:2", "oncogene", "1", "b", "")]
    abstracts = [("10", None, "clinical", "Patients were many. GENA causes illness in patients."), ("11", None, "clinical", "A trial. GENA causes illness, we found.")]
    claims = claim_audit.payloads(stores.claims_from_json(spark, f"{folder}/claims.jsonl"))
    tables = claim_audit.Tables(
        index=cl.label_index(none),
        provenance=frame([("PMID:10", "clean", 2000), ("PMID:11", "clean", 2001), ("PMID:66", "retracted", 2000)], "identifier string, status string, pub_year int"),
        papers=frame(abstracts, "paper_id string, title string, journal string, abstract string"),
        cited=frame([(c, p) for c in ("good", "tissue", "negated") for p in ("10", "11")], "claim_id string, paper_id string"),
        edges=frame([("HGNC:1", cl.CONDITION, "MONDO:1"), ("GO:5", "biolink:inhibits", "HGNC:2")], "subject string, predicate string, object string"),
        associations=frame([("HGNC:1", "MONDO:1", 0.9)], "gene_id string, cui string, score double"),
        triples=frame([("HGNC:1", cl.CONDITION, "MONDO:1", ["PMID:1", "PMID:2", "PMID:3"])], "subject string, predicate string, object string, sources array<string>"),
        terms=frame([("MONDO:1", ["MONDO:9"])], "term string, ancestors array<string>"),
        census=ingest.gene_census(frame(rows, "GENE_SYMBOL string, HGNC_ID string, ROLE_IN_CANCER string, TIER string, NAME string, SYNONYMS string")),
    )
    return {r["claim_id"]: r for r in claim_audit.audit_claims(claims, tables, 2010).collect()}


def test_every_whole_line_gets_a_verdict(verdicts):
    assert set(verdicts) == {"good", "retracted", "types", "negated", "opposite", "tissue", "unread", "refuted"}


def test_a_supported_claim_passes(verdicts):
    good = verdicts["good"]
    fired = {t["rule_id"] for t in good["trace"]}
    assert good["verdict"] == "PASS" and good["gate_trace"] == []
    assert {"disgenet_support_bonus", "structured_literature_support", "structured_literature_strong", "nli_multi_source_support", "ontology_closure_hpo"} <= fired


@pytest.mark.parametrize("claim, gate, verdict", [("retracted", "gate:retraction", "FAIL"), ("types", "gate:type_violation", "FAIL"), ("negated", "gate:self_negation", "FAIL"), ("opposite", "gate:opposite_predicate", "FAIL"), ("unread", "gate:low_confidence", "FAIL"), ("refuted", "gate:self_negation", "FAIL")])
def test_gates_open_for_what_is_wrong(verdicts, claim, gate, verdict):
    assert gate in verdicts[claim]["gate_trace"] and verdicts[claim]["verdict"] == verdict


def test_another_tissue_costs_the_pass(verdicts):
    """The rule fires and lowers the score; the gate opens only for what would pass."""
    tissue = verdicts["tissue"]
    assert "tissue_mismatch" in {t["rule_id"] for t in tissue["trace"]} and tissue["score"] < verdicts["good"]["score"]
    assert tissue["verdict"] != "PASS"
