"""Normalisation of claims and the facts of curated and literature tables."""

import pytest
from pyspark.sql import functions as F

from kgaudit.operators import claims


def got(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def index(spark):
    edges = spark.createDataFrame([("HGNC:1", "BRCA9", "MONDO:1", "Ill", 1), ("HGNC:2", "brca9", "HP:1", "Sign", 2), ("HGNC:3", None, "HP:2", "", 3)], "subject string, subject_label string, object string, object_label string, ord int")
    return claims.label_index(edges)


def test_label_index_keeps_the_last(spark):
    assert got(index(spark), "key", "id", "label") == {"brca9": ("HGNC:2", "brca9"), "ill": ("MONDO:1", "Ill"), "sign": ("HP:1", "Sign")}


def test_normalised(spark):
    end = "struct<id: string, label: string, mention: string>"
    rows = [
        (1, "BRCA9 mutations raise Ill.", (None, None, "BRCA9"), (None, "ill", None), None, ["PMID:7"]),
        (2, "x PMID: 12345", None, None, "biolink:treats", ["HP:5", "HGNC:9", "MONDO:3"]),
        (3, "x", ("HGNC:1", "", ""), ("HP:1", None, None), "", ["GO:4"]),
        (4, "x", (None, None, "who"), (None, None, "CHEBI:4"), "", None),
    ]
    df = spark.createDataFrame(rows, f"claim_id int, text string, subject {end}, object {end}, predicate string, evidence array<string>")
    out = got(claims.normalised(df, index(spark)), "claim_id", "subject_id", "object_id", "predicate", "is_low_confidence", "predicate_is_fallback", "has_variant_context", "association_narrative", "citations")
    assert out[1] == ("HGNC:2", "MONDO:1", claims.CONDITION, False, False, True, "mutations raise", ["PMID:7"])
    assert out[2] == ("HGNC:9", "HP:5", "biolink:treats", False, False, False, None, ["PMID: 12345"])
    assert out[3][:4] == ("HGNC:1", "GO:4", claims.FALLBACK, False)
    assert out[4][:4] == (None, "CHEBI:4", claims.FALLBACK, True)


def test_spotted_matches_brute_force(spark):
    labels = ["ab", "b c", "xyz", "c", "Ab"]
    texts = ["zab c", "b  c", "AB c xyz", "", None, "aXYZb c"]
    df = spark.createDataFrame(list(enumerate(texts)), "claim_id int, text string")
    dictionary = spark.createDataFrame([(f"i{i}", x) for i, x in enumerate(labels)], "id string, label string")
    want = set()
    for n, t in enumerate(texts):
        hits = sorted(((t or "").lower().find(x.lower()) + 1, f"i{i}") for i, x in enumerate(labels) if x.lower() in (t or "").lower())
        want |= {(n, i, at) for at, i in hits[:2]}
    assert {tuple(r) for r in claims.spotted(df, dictionary).select("claim_id", "id", "at").collect()} == want


def test_stances_and_evidence_keys(spark):
    df = spark.createDataFrame([("refutes",), (" Supports it",), ("Backs",), ("x",)], "s string")
    assert [r[0] for r in df.select(claims.stance(F.col("s"))).collect()] == ["refute", "support", "support", "neutral"]
    df = spark.createDataFrame([({"id": "a", "pmid": " "},), ({"url": "u", "doi": "d"},)], "m map<string,string>")
    assert [r[0] for r in df.select(claims.evidence_identifier(F.col("m"))).collect()] == ["a", "d"]


def test_curated_support(spark):
    pairs = spark.createDataFrame([(1, "HGNC:1", ["UMLS:C1", "umls_C2"]), (2, "HGNC:1", ["C9"]), (3, "HGNC:2", [])], "pair_id int, gene_id string, cuis array<string>")
    known = spark.createDataFrame([("HGNC:1", "C2", 0.3), ("HGNC:1", "C9", 0.2)], "gene_id string, cui string, score double")
    assert got(claims.curated_support(pairs, known), "pair_id", "matched_cui", "disgenet_support") == {1: ("umls_C2", True), 2: (None, False), 3: (None, False)}


def test_literature_facts(spark):
    pairs = spark.createDataFrame([(1, "a", "b", "p"), (2, "a", "c", "p"), (3, "x", "y", "p")], "pair_id int, subject string, object string, predicate string")
    triples = spark.createDataFrame([("a", "p", "b", ["1", "2"]), ("a", "q", "b", ["3"]), ("a", "q", "c", ["3", "3"])], "subject string, predicate string, object string, sources array<string>")
    assert got(claims.literature_facts(pairs, triples), "pair_id", "structured_source_count", "has_structured_support") == {1: (2, True), 2: (1, True), 3: (0, False)}


def test_polarity_conflict(spark):
    pairs = spark.createDataFrame([(1, "a", "b", "increases"), (2, "a", "b", "increases"), (3, "a", "b", "increases"), (4, "a", "b", "is")], "pair_id int, subject string, object string, predicate string")
    context = spark.createDataFrame([(1, "inhibits"), (1, "x"), (2, "inhibits"), (2, "causes"), (3, "x"), (4, "inhibits")], "pair_id int, predicate string")
    out = got(claims.polarity_conflict(pairs, context), "pair_id", "context_polarity", "opposite_predicate_same_context")
    assert out == {1: ("negative", True), 2: ("mixed", False), 3: (None, False), 4: ("negative", False)}


def test_type_facts(spark):
    rows = spark.createDataFrame([("gene", "disease"), ("disease", "gene")], "s string, o string")
    c = claims.type_facts(F.col("s"), F.col("o"), F.lit(claims.CONDITION))
    assert [tuple(r) for r in rows.select(*c.values()).collect()] == [(True, True), (False, False)]


@pytest.mark.parametrize("few", [0, 64])
def test_labels_are_spotted_in_any_text(spark, monkeypatch, few):
    """Both ways find labels inside words, across white space, of one letter, and in very long words."""
    monkeypatch.setattr(claims, "FEW", few)
    texts = [(1, "A gene\tone, then BRCA1x"), (2, "x" * 1_000_000 + "tp53"), (3, None), (4, ""), (5, "𝄞é gene  one"), (6, "zz brca1 gene\tone")]
    labels = [("a", "gene\tone"), ("b", "BRCA1"), ("c", "TP53"), ("d", "𝄞"), ("e", ""), ("f", "gene  one"), ("g", "nowhere to be found")]
    found = claims.spotted(spark.createDataFrame(texts, "claim_id int, text string"), spark.createDataFrame(labels, "id string, label string"))
    got = {(r["claim_id"], r["rank"], r["id"]) for r in found.collect()}
    assert got == {(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (5, 1, "d"), (5, 2, "f"), (6, 1, "b"), (6, 2, "a")}


def test_sentences_of_a_long_paper(spark):
    """A repeated sentence has the place of its first occurrence; the work doesn't grow with the square."""
    from kgaudit.operators import nli

    text = " ".join(["Same one here."] + [f"Sentence number {i} is here." for i in range(100_000)] + ["Same one here."])
    papers = spark.createDataFrame([(1, None, None, text), (2, None, None, None), (3, None, None, "Same one here.")], "paper_id int, title string, journal string, abstract string")
    rows = nli.paper_sentences(papers).select("paper_id", "ord", "section", "sentence")
    assert rows.groupBy("paper_id").count().filter("paper_id = 1").first()["count"] == 100_002
    same = rows.filter("paper_id = 1 and sentence like 'Same%'").collect()
    assert len(same) == 2 and len({r["section"] for r in same}) == 1


def test_best_three_sentences(spark):
    from kgaudit.operators import nli

    rows = [(1, 1, i, w, p, q) for i, (w, p, q) in enumerate([(1.0, 0.8, 0.1), (0.5, 0.8, 0.1), (0.5, 0.1, 0.8), (0.25, 0.8, 0.1), (1.0, 0.0, 0.0)])] + [(1, 2, 0, 1.0, 0.1, 0.8)]
    df = spark.createDataFrame(rows, "claim_id int, paper_id int, ord int, weight double, p_support double, p_contradict double")
    for c, v in {"paper_type": "primary_human", "claim_class": "causal", "sentence_class": "association", "label": "NEI"}.items():
        df = df.withColumn(c, F.lit(v))
    got = {r["paper_id"]: r for r in nli.paper_margins(df).collect()}
    weight = got[1]["s_pos"] / (0.8 + 0.4 + 0.2)
    assert got[1]["s_neg"] == pytest.approx(weight * (0.1 + 0.05 + 0.4)) and got[2]["s_neg"] == pytest.approx(weight * 0.8)
    assert (got[1]["sentence_count"], got[1]["nei_count"], got[1]["predicate_mismatch_count"]) == (5, 5, 5)
