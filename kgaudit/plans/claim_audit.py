"""One audit of whole claims: from payload, text and citations to a verdict.

Every fact that a rule or gate reads is the result of an operator over tables: claims are normalised to typed triples, their
citations joined with provenance, their papers read sentence by sentence, and their pairs looked up in known edges, curated
associations, literature triples, the ontology and the census. Claims are normalised and written once; every look-up reads
the columns of that table that it needs. Each table is aggregated by claim or pair before it is joined with the claims, so
a claim is one row throughout and a shuffle carries keys and facts, not texts.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import text as tx
from kgaudit.functions.ids import starts_with_any
from kgaudit.operators import claims as cl
from kgaudit.operators import graph, nli, ontology
from kgaudit.plans import audit
from kgaudit.session import written


@dataclasses.dataclass(frozen=True)
class Tables:
    """What claims are audited against.

    ``index(key, id, label)``, ``provenance(identifier, status, pub_year)``, ``papers(paper_id, title, journal, abstract)``
    with ``cited(claim_id, paper_id)``, ``edges(subject, predicate, object)``, ``associations(gene_id, cui, score)``,
    ``triples(subject, predicate, object, sources)``, ``terms(term, ancestors)`` and ``census`` (see ``ingest.gene_census``).
    """

    index: DataFrame
    provenance: DataFrame
    papers: DataFrame
    cited: DataFrame
    edges: DataFrame
    associations: DataFrame
    triples: DataFrame
    terms: DataFrame
    census: DataFrame


def literature(claims: DataFrame, t: Tables, lexicon: tx.Lexicon) -> DataFrame:
    """``(claim_id, text_nli)`` of claims with a paper that has sentences (A1, A2, A4).

    Claims are ``(claim_id, subject_term, object_term, predicate, text, claimed_tissue)``. Only citations of papers that are there
    are told apart and joined with the claims, and a claim's text is judged behind that join.
    """
    asked = claims.select("claim_id", F.col("subject_term").alias("subject"), F.col("object_term").alias("object"), "predicate", "text", F.col("claimed_tissue").alias("tissue"))
    cited = t.cited.join(t.papers.select("paper_id"), "paper_id", "left_semi").select("claim_id", "paper_id").distinct()
    read = t.papers.join(cited.select("paper_id"), "paper_id", "left_semi")
    labelled = nli.sentence_labels(asked, cited, nli.paper_sentences(read, lexicon), lexicon)
    found = nli.claim_margins(nli.paper_margins(labelled))
    return found.select("claim_id", F.struct("checked", "n_support", "n_contradict", "m_lit", "s_neg_total", "claim_predicate_class", "predicate_mismatch_count").alias("_nli"))


def claim_facts(claims: DataFrame, t: Tables, as_of_year: int, lexicon: tx.Lexicon = tx.DEFAULT, own: tx.Lexicon = tx.DEFAULT) -> DataFrame:
    """``(claim_id, facts)`` of claims ``(claim_id, text, subject, object, predicate, evidence, notes, cuis, tissue, symbol)``.

    Subject and object are structs ``(id, label, mention)``, evidence a list of identifiers, notes what pieces of evidence
    say for or against the claim. ``lexicon`` reads papers and predicates, ``own`` the claim's text.
    """
    none = F.array().cast("array<string>")
    given = claims.withColumns({"evidence": F.coalesce("evidence", none), "subject_term": F.coalesce("subject.label", F.lit("")), "object_term": F.coalesce("object.label", F.lit(""))})
    rows = cl.normalised(given, t.index).withColumnsRenamed({"subject": "subject_said", "object": "object_said", "evidence": "evidence_ids"})
    whole = written(own_facts(rows.withColumns({"subject": F.col("subject_id"), "object": F.col("object_id")}), own))
    pairs = whole.select(F.col("claim_id").alias("pair_id"), "subject", "object", "predicate", F.col("subject_category").alias("subject_class"), F.col("object_category").alias("object_class"))

    cited = whole.select("claim_id", F.explode("citations").alias("identifier"))
    kept = whole.select("claim_id", "subject", "object", "predicate", "subject_category", "object_category", "symbol", *OWN)
    rows = audit.evidence_groups(kept, cited.join(t.provenance, "identifier"), as_of_year).withColumn("pair_id", F.col("claim_id"))

    context = graph.either_way(pairs.select("pair_id", "subject", "object"), t.edges).select("pair_id", "predicate")
    rows = cl.polarity_conflict(rows, context, lexicon)
    curated = cl.curated_matches(whole.select(F.col("claim_id").alias("pair_id"), F.col("subject").alias("gene_id"), "cuis"), t.associations)
    for found in (curated, cl.literature_counts(pairs, t.triples)):
        rows = rows.join(found, "pair_id", "left")
    rows = rows.join(literature(whole, t, lexicon), "claim_id", "left")
    for side in ("subject", "object"):
        placed = t.terms.select(F.col("term").alias(side), F.col("ancestors").alias(f"{side}_ancestors"))
        rows = rows.join(placed, side, "left").withColumn(f"{side}_ancestors", F.coalesce(f"{side}_ancestors", none))

    rows = cl.gene_facts(rows.withColumn("has_evidence", F.col("claim.citation_count") > 0), t.census)
    rows = rows.withColumns({"subject_class": F.col("subject_category"), "object_class": F.col("object_category")})
    rows = ontology.check_all(rows, t.edges, asked=pairs)
    return audit.with_facts(rows, groups(), ("claim", "evidence", "temporal", "gene", "dl")).select("claim_id", "facts")


#: What a claim's own columns say, and what a claim carries through the joins besides its triple.
OWN = ("type", "extraction", "tissue", "_negated", "_refuted", "_hedged")


def _named(**columns: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in columns.items()))


def own_facts(rows: DataFrame, own: tx.Lexicon) -> DataFrame:
    """Normalised claims with the facts that their own columns tell, and the columns by which other tables are looked up."""
    fits = cl.type_facts(F.col("subject_category"), F.col("object_category"), F.col("predicate"))
    same = tx.self_referential(F.col("subject"), F.col("object"), F.col("text"), F.col("subject_term"))
    rows = rows.withColumn("_tissues", F.filter("evidence_ids", lambda e: starts_with_any(F.upper(e), ("UBERON:",))))
    facts = {
        "type": _named(domain_valid=fits["domain_valid"], range_valid=fits["range_valid"], is_spurious_self_referential=same),
        "extraction": _named(is_low_confidence=F.col("is_low_confidence"), predicate_is_fallback=F.col("predicate_is_fallback")),
        "tissue": _named(is_mismatch=ontology.tissue_mismatch(F.col("tissue"), F.col("_tissues")), expected=F.col("tissue"), actual=F.col("_tissues")),
        "_negated": tx.is_negated(F.col("text"), own), "_refuted": F.coalesce(F.exists("notes", lambda e: cl.stance(e) == "refute"), F.lit(False)), "_hedged": tx.is_hedged(F.col("text"), own),
    }
    looked_up = ("claim_id", "subject", "object", "predicate", "subject_category", "object_category", "symbol", "cuis", "subject_term", "object_term", "text")
    return rows.select(*looked_up, F.col("tissue").alias("claimed_tissue"), "citations", *(facts[c].alias(c) for c in OWN))


def groups() -> dict[str, Column]:
    """The structs of facts that are expressions over the joined columns."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    term = lambda side: {"id": F.col(side), "ancestors": F.col(f"{side}_ancestors"), "category": F.col(f"{side}_category")}
    gene = F.col("subject_category") == "gene"
    support, known = F.col("matched_cui").isNotNull(), F.col("context_edges").isNotNull()
    n = lambda c: F.coalesce(f"_nli.{c}", F.lit(0))
    x = lambda c: F.coalesce(f"_nli.{c}", F.lit(0.0))
    named, sources = _named, F.coalesce("structured_source_count", F.lit(0))
    return {
        "type": F.col("type"),
        "ontology": named(subject_has_ancestors=F.size("subject_ancestors") > 0, object_has_ancestors=F.size("object_ancestors") > 0, is_sibling_conflict=ontology.sibling_conflict(term("subject"), term("object"), F.col("predicate"))),
        "conflicts": named(
            qualifier_negated=F.col("_negated"), has_refuting_evidence=F.col("_refuted"),
            opposite_predicate_same_context=yes(F.col("opposite_predicate_same_context")), claim_predicate_polarity=F.col("claim_predicate_polarity"),
        ),
        "extraction": F.col("extraction"),
        "curated_kg": named(curated_kg_match=support | known, disgenet_checked=gene & (F.col("object_category") == "disease"), disgenet_support=support, monarch_checked=F.col("object").isNotNull(), monarch_support=known),
        "literature": named(has_structured_support=sources > 0, structured_source_count=sources),
        "tissue": F.col("tissue"),
        "text_nli": named(
            checked=yes(F.col("_nli.checked")), n_support=n("n_support"), n_contradict=n("n_contradict"), m_lit=x("m_lit"), s_neg_total=x("s_neg_total"),
            claim_predicate_class=F.coalesce("_nli.claim_predicate_class", F.lit("unknown")), predicate_mismatch_count=n("predicate_mismatch_count"), claim_is_hedged=F.col("_hedged"),
        ),
    }


def audit_claims(claims: DataFrame, t: Tables, as_of_year: int, lexicon: tx.Lexicon = tx.DEFAULT, own: tx.Lexicon = tx.DEFAULT) -> DataFrame:
    """Score, trace and verdict of whole claims under all rules and gates."""
    return audit.audit(claim_facts(claims, t, as_of_year, lexicon, own))


def payloads(claims: DataFrame) -> DataFrame:
    """Claims as ``stores.claims_from_json`` reads them, in the form that ``claim_facts`` takes; broken lines drop out.

    The mention with the role of subject or object becomes that end; a disease among them is what associations are
    looked up for; the claimed tissue is a qualifier, and the subject's first word the symbol.
    """
    whole = claims.filter("broken is null")

    def end(role: str) -> Column:
        one = F.get(F.filter("entities", lambda e: e["metadata"]["role"] == role), F.lit(0))
        return F.struct(one["norm_id"].alias("id"), one["norm_label"].alias("label"), one["mention"].alias("mention"))

    out = whole.withColumns({"subject": end("subject"), "object": end("object")})
    status = F.transform(F.coalesce("structured_evidence", F.array().cast("array<struct<type: string, id: string, pmid: string, status: string>>")), lambda e: F.coalesce(e["status"], F.lit("")))
    return out.select(
        "claim_id", "text", "subject", "object", "predicate", "evidence", status.alias("notes"), F.array_compact(F.array("object.id")).alias("cuis"),
        F.col("qualifiers")["tissue"].alias("tissue"), F.substring_index("subject.label", " ", 1).alias("symbol"),
    )
