"""The audit of whole claims over the order tables, fed by operators alone, with SQL that gives the same rows.

A claim is an order: its subject a gene or phenotype by customer, its object by the order's key, its citations the parts
of its lines, its paper the document of its key. Parts are publications and known edges, suppliers terms of an ontology
and genes of a census, lines curated associations and literature triples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.functions import text as tx
from kgaudit.operators import claims as cl
from kgaudit.operators import graph
from kgaudit.plans import claim_audit, commerce, full_audit
from kgaudit.plans.catalogue import SENTENCES_SQL
from kgaudit.plans.registry import query
from kgaudit.session import table

#: Words of the documents and of the claims' predicates.
READS = tx.Lexicon(positive=("from", "with", "activate"), negative=("that", "was", "inhibit"), causal=("from", "that", "activate", "inhibit"), association=("and the",), hedges={"of": "of", "to": "to"}, negations=("this",), sections={"results": ("of the",), "conclusion": ("to the",)})
PREDICATE = f"CASE o_orderpriority WHEN '2-HIGH' THEN 'biolink:activates' WHEN '3-MEDIUM' THEN 'biolink:inhibits' WHEN '4-NOT SPECIFIED' THEN '{cl.CONDITION}' WHEN '5-LOW' THEN 'biolink:participates_in' END"


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims with all that a payload holds."""
    line = table(spark, sf_dir, "lineitem")
    against = F.expr("if(l_returnflag = 'R' and l_tax >= 0.08, true, false)")
    own = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set("l_partkey").alias("papers"), F.collect_set(F.when(F.col("l_quantity") > 45, F.col("l_linenumber"))).alias("places"), F.max(against).alias("_against"), F.max(~against).alias("_for")
    )
    named = lambda prefix, c: F.sort_array(F.transform(c, lambda x: commerce.named(prefix, x)))
    notes = F.array_compact(F.array(F.when(F.col("_against"), "Refutes it"), F.when(F.col("_for"), "supports it")))
    own = own.select("o_orderkey", named("PMID:", "papers").alias("papers"), named("UBERON:", "places").alias("places"), notes.alias("notes"))
    none = F.array().cast("array<string>")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    made = table(spark, sf_dir, "orders").join(own, "o_orderkey", "left")
    struct = lambda i, label: F.expr(f"named_struct('id', {i}, 'label', {label}, 'mention', cast(null as string))")
    subject = struct("if(o_custkey % 5 = 0, concat('HP:', o_custkey % 9), concat('HGNC:', o_custkey))", "if(o_custkey % 2 = 0, 'the', 'of')")
    obj = struct("case o_orderkey % 4 when 0 then concat('MONDO:', o_orderkey % 50) when 1 then concat('HP:', o_orderkey % 9) when 2 then concat('GO:', o_orderkey % 30) end", "'and'")
    text = F.expr("concat('order ', o_orderkey, case o_orderstatus when 'F' then ' may raise' when 'P' then ' does not raise' else ' raises' end, ' claims')")
    return made.select(
        k.alias("claim_id"), text.alias("text"), subject.alias("subject"), obj.alias("object"), F.expr(PREDICATE).alias("predicate"), F.concat(F.coalesce("papers", none), F.coalesce("places", none)).alias("evidence"),
        F.coalesce("notes", none).alias("notes"), F.array(F.concat(F.lit("UMLS:C"), k % 7)).alias("cuis"), F.when(c % 3 == 0, "UBERON:1").alias("tissue"), F.concat(F.lit("S"), c % full_audit.CENSUS_GENES).alias("symbol"),
    )


def tables(spark: SparkSession, sf_dir: str) -> claim_audit.Tables:
    """What the claims are audited against."""
    part, line, supplier, docs = (table(spark, sf_dir, n) for n in ("part", "lineitem", "supplier", "documents"))
    none = F.lit(None).cast("string")
    edges = part.select(commerce.named("HGNC:", "p_partkey").alias("subject"), F.expr("concat('biolink:', element_at(array('activates', 'inhibits', 'binds'), cast(p_partkey % 3 + 1 as int)))").alias("predicate"), commerce.named("MONDO:", "p_size").alias("object"))
    triples = graph.literature_triples(line.select(F.col("l_suppkey").alias("subject"), F.expr("if(l_returnflag = 'R', 'biolink:inhibits', 'biolink:activates')").alias("predicate"), F.col("l_linenumber").alias("object"), F.col("l_partkey").alias("pmid")))
    terms = supplier.select((F.col("s_suppkey") % 20).alias("n")).distinct()
    return claim_audit.Tables(
        index=cl.label_index(edges.select("*", none.alias("subject_label"), none.alias("object_label"), F.lit(0).alias("ord"))),
        provenance=part.select(commerce.named("PMID:", "p_partkey").alias("identifier"), F.expr("case p_size when 1 then 'retracted' when 2 then 'concern' else 'clean' end").alias("status"), F.expr("1985 + p_size % 16").alias("pub_year")),
        papers=docs.select(F.col("doc_id").alias("paper_id"), none.alias("title"), none.alias("journal"), F.col("text").alias("abstract")),
        cited=table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("paper_id")),
        edges=edges,
        associations=line.select(commerce.named("HGNC:", "l_suppkey").alias("gene_id"), F.concat(F.lit("C"), F.col("l_linenumber")).alias("cui"), (F.col("l_discount") * 10).alias("score")),
        triples=triples.select(commerce.named("HGNC:", "subject").alias("subject"), "predicate", commerce.named("HP:", "object").alias("object"), F.transform("sources", lambda x: commerce.named("PMID:", x)).alias("sources")),
        terms=terms.select(F.concat(F.lit("HP:"), F.col("n")).alias("term"), F.array(F.concat(F.lit("HP:"), 100 + F.col("n") % 3)).alias("ancestors")),
        census=full_audit.census(spark, sf_dir),
    )


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_audit.audit_claims(claim_rows(spark, sf_dir), tables(spark, sf_dir), commerce.AS_OF_YEAR, READS)


def _has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _hits(words) -> str:
    return " + ".join(f"contains(low, '{w}')::INT" for w in words)


# Words of reviews, animal and human studies.
_REVIEW = ("review", "meta-analysis", "metaanalysis", "overview", "survey of")
_ANIMAL = ("mouse", "mice", "rat", "rats", "murine", "rodent", "zebrafish", "drosophila", "c. elegans", "animal model", "in vivo", "xenograft")
_HUMAN = ("patient", "patients", "human", "clinical", "cohort", "case-control", "randomized", "trial", "gwas", "genome-wide")
_POSITIVE, _NEGATIVE = ("from", "with", "activate"), ("that", "was", "inhibit")
_CAUSAL = ("from", "that", "activate", "inhibit")
_ENDS = "CASE WHEN o_custkey % 2 = 0 THEN 'the' ELSE 'of' END"

CLAIM_SQL = f"""WITH {SENTENCES_SQL},
claim0 AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, coalesce({PREDICATE}, '') AS p0, CASE WHEN o_custkey % 5 = 0 THEN 'HP:' || o_custkey % 9 ELSE 'HGNC:' || o_custkey END AS sid,
  CASE o_orderkey % 4 WHEN 0 THEN 'MONDO:' || o_orderkey % 50 WHEN 1 THEN 'HP:' || o_orderkey % 9 WHEN 2 THEN 'GO:' || o_orderkey % 30 END AS oid, {_ENDS} AS s_term FROM orders),
claim1 AS (SELECT *, CASE WHEN sid LIKE 'HP:%' THEN 'phenotype' ELSE 'gene' END AS sc, CASE WHEN oid LIKE 'MONDO:%' THEN 'disease' WHEN oid LIKE 'HP:%' THEN 'phenotype' WHEN oid LIKE 'GO:%' THEN 'pathway' ELSE 'unknown' END AS oc FROM claim0),
claim AS (SELECT *, CASE WHEN p0 <> '' THEN p0 WHEN sc = 'gene' AND oc IN ('disease', 'phenotype') THEN '{cl.CONDITION}' ELSE '{cl.FALLBACK}' END AS p FROM claim1),
prov AS (SELECT DISTINCT l_orderkey AS claim_id, l_partkey, CASE p_size WHEN 1 THEN 'retracted' WHEN 2 THEN 'concern' ELSE 'clean' END AS status, 1985 + p_size % 16 AS y FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT claim_id, count(*) AS n, count(*) FILTER (status = 'retracted') AS nr, count(*) FILTER (status = 'concern') AS nc, min(y) AS fp, min(y) FILTER (status = 'clean') AS so, max(y) FILTER (status = 'clean') AS sn,
  min(y) FILTER (status = 'retracted') AS er, max(y) FILTER (status = 'retracted') AS lr, min(y) FILTER (status = 'concern') AS fc, max(y) FILTER (status = 'concern') AS lc FROM prov GROUP BY claim_id),
lines AS (SELECT l_orderkey AS claim_id, bool_or(l_returnflag = 'R' AND l_tax >= 0.08) AS refuted, coalesce(bool_or(l_quantity > 45 AND l_linenumber <> 1), false) AS elsewhere FROM lineitem GROUP BY 1),
known AS (SELECT k, bool_or(p_partkey % 3 = 0) AS pos, bool_or(p_partkey % 3 = 1) AS neg FROM claim JOIN part ON sid = 'HGNC:' || p_partkey AND oid = 'MONDO:' || p_size GROUP BY 1),
assoc AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_discount * 10 >= 0.3),
curated AS (SELECT DISTINCT k FROM claim JOIN assoc ON sid = 'HGNC:' || l_suppkey AND k % 7 = l_linenumber),
lit AS (SELECT k, count(DISTINCT l_partkey) FILTER ((p = 'biolink:inhibits' AND l_returnflag = 'R') OR (p = 'biolink:activates' AND l_returnflag <> 'R')) AS exact, count(DISTINCT l_partkey) AS every FROM claim JOIN lineitem ON sid = 'HGNC:' || l_suppkey AND oid = 'HP:' || l_linenumber GROUP BY 1),
term AS (SELECT DISTINCT 'HP:' || s_suppkey % 20 AS id, s_suppkey % 20 % 3 AS up FROM supplier),
kind AS (SELECT doc_id, CASE WHEN {_has('low', _REVIEW)} THEN 0.4 WHEN human > animal THEN 1.0 WHEN animal > 0 THEN 0.6 WHEN human > 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS paper FROM (SELECT doc_id, low, {_hits(_HUMAN)} AS human, {_hits(_ANIMAL)} AS animal FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents))),
said AS (SELECT k, sent.doc_id, ord, total, list_position(l, sentence) - 1 AS place, lower(sentence) AS t, regexp_matches(sentence, '(?i)\\b' || s_term || '\\b') AND regexp_matches(sentence, '(?i)\\band\\b') AS ends,
  CASE WHEN p IN ('biolink:activates', '{cl.CONDITION}') THEN 'positive' WHEN p = 'biolink:inhibits' THEN 'negative' ELSE 'positive' END AS mine, CASE WHEN p IN ('biolink:activates', 'biolink:inhibits', '{cl.CONDITION}') THEN 'causal' ELSE 'unknown' END AS cc FROM claim JOIN sent ON doc_id = k),
read AS (SELECT *, CASE WHEN contains(t, 'of the') THEN 1.0 WHEN contains(t, 'to the') THEN 1.0 WHEN place / total < 0.2 THEN 0.7 WHEN place / total > 0.5 THEN 1.0 ELSE 0.85 END::DOUBLE AS section, CASE WHEN regexp_matches(t, '\\b(of|to)\\b') THEN 0.5 ELSE 1.0 END::DOUBLE AS hedge,
  CASE WHEN {_has("translate(t, '_-', '  ')", _CAUSAL)} THEN 'causal' WHEN contains(translate(t, '_-', '  '), 'and the') THEN 'association' WHEN {_has('t', _POSITIVE + _NEGATIVE)} THEN 'causal' ELSE 'unknown' END AS class,
  CASE WHEN {_has('t', _POSITIVE)} THEN 'positive' WHEN {_has('t', _NEGATIVE)} THEN 'negative' WHEN regexp_matches(t, '\\bthis\\b') THEN 'negative' END AS pol FROM said),
rated AS (SELECT *, CASE WHEN NOT ends OR pol IS NULL THEN 'NEI' WHEN pol = mine THEN 'SUPPORT' ELSE 'REFUTE' END AS label,
  section * hedge * (CASE WHEN cc = 'causal' THEN CASE class WHEN 'causal' THEN 1.2 WHEN 'association' THEN 0.5 ELSE 0.7 END ELSE 0.8 END)::DOUBLE * (CASE WHEN c3 AND NOT contains(t, '1') THEN 0.9 ELSE 1.0 END)::DOUBLE AS weight FROM (SELECT read.*, c % 3 = 0 AS c3 FROM read JOIN claim USING (k))),
valued AS (SELECT *, weight * (CASE label WHEN 'SUPPORT' THEN 0.8 WHEN 'REFUTE' THEN 0.1 ELSE 0.0 END)::DOUBLE AS f, weight * (CASE label WHEN 'REFUTE' THEN 0.8 WHEN 'SUPPORT' THEN 0.1 ELSE 0.0 END)::DOUBLE AS g FROM rated),
best AS (SELECT k, doc_id, any_value(cc) AS cc, list_slice(list_reverse_sort(list(f)), 1, 3) AS f, list_slice(list_reverse_sort(list(g)), 1, 3) AS g, count(*) FILTER (cc = 'causal' AND class = 'association') AS mismatch FROM valued GROUP BY 1, 2),
paper AS (SELECT k, cc, mismatch, list_reduce(list_prepend(0.0::DOUBLE, list_transform(f, lambda x: paper * x)), lambda x, y: x + y) AS pos, list_reduce(list_prepend(0.0::DOUBLE, list_transform(g, lambda x: paper * x)), lambda x, y: x + y) AS neg FROM best JOIN kind USING (doc_id)),
o AS (SELECT claim.*, coalesce(n, 0) AS n, coalesce(nr, 0) AS nr, coalesce(nc, 0) AS nc, fp, so, sn, er, lr, fc, lc, coalesce(refuted, false) AS refuted, coalesce(elsewhere, false) AS elsewhere, known.k IS NOT NULL AS is_known, pos AS edge_pos, neg AS edge_neg, curated.k IS NOT NULL AS is_curated,
  CASE WHEN exact > 0 THEN exact ELSE coalesce(every, 0) END AS sources, st.up AS s_up, ot.up AS o_up FROM claim LEFT JOIN a ON a.claim_id = k LEFT JOIN lines ON lines.claim_id = k LEFT JOIN known ON known.k = claim.k LEFT JOIN curated ON curated.k = claim.k LEFT JOIN lit ON lit.k = claim.k LEFT JOIN term st ON st.id = sid LEFT JOIN term ot ON ot.id = oid),
have AS (SELECT DISTINCT s_suppkey AS s FROM supplier WHERE s_suppkey < {full_audit.CENSUS_GENES // 2}),
gene AS (SELECT o.*, coalesce(own.s, other.s) AS s, paper.k IS NOT NULL AS is_read, cc, mismatch, pos, neg FROM o LEFT JOIN have own ON sc = 'gene' AND own.s = c % {full_audit.CENSUS_GENES} LEFT JOIN have other ON sc = 'gene' AND other.s < 5 AND other.s + 30 = c % {full_audit.CENSUS_GENES} LEFT JOIN paper ON paper.k = o.k),
fact AS (SELECT *, p <> '{cl.CONDITION}' OR sc = 'gene' AS type__domain_valid, p <> '{cl.CONDITION}' OR oc IN ('disease', 'phenotype') AS type__range_valid, coalesce(sid = oid, false) AS type__is_spurious_self_referential,
  s_up IS NOT NULL AS ontology__subject_has_ancestors, o_up IS NOT NULL AS ontology__object_has_ancestors, coalesce(s_up = o_up AND sid <> oid, false) AS ontology__is_sibling_conflict,
  st = 'P' AS conflicts__qualifier_negated, refuted AS conflicts__has_refuting_evidence,
  coalesce(CASE WHEN p IN ('biolink:activates', '{cl.CONDITION}') THEN edge_neg AND NOT edge_pos WHEN p = 'biolink:inhibits' THEN edge_pos AND NOT edge_neg END, false) AS conflicts__opposite_predicate_same_context,
  CASE WHEN p IN ('biolink:activates', '{cl.CONDITION}') THEN 'positive' WHEN p = 'biolink:inhibits' THEN 'negative' END AS conflicts__claim_predicate_polarity,
  oid IS NULL AS extraction__is_low_confidence, p = '{cl.FALLBACK}' AS extraction__predicate_is_fallback,
  is_curated OR is_known AS curated_kg__curated_kg_match, sc = 'gene' AND oc = 'disease' AS curated_kg__disgenet_checked, is_curated AS curated_kg__disgenet_support, oid IS NOT NULL AS curated_kg__monarch_checked, is_known AS curated_kg__monarch_support,
  sources > 0 AS literature__has_structured_support, sources AS literature__structured_source_count, c % 3 = 0 AND elsewhere AS tissue__is_mismatch,
  is_read AS text_nli__checked, CASE WHEN is_read AND pos > 0.3 THEN 1 ELSE 0 END AS text_nli__n_support, CASE WHEN is_read AND neg > 0.3 THEN 1 ELSE 0 END AS text_nli__n_contradict,
  CASE WHEN is_read THEN least(pos, 0.8::DOUBLE) - 1.3::DOUBLE * least(neg, 0.8::DOUBLE) ELSE 0.0::DOUBLE END AS text_nli__m_lit, CASE WHEN is_read THEN least(neg, 0.8::DOUBLE) ELSE 0.0::DOUBLE END AS text_nli__s_neg_total,
  coalesce(cc, 'unknown') AS text_nli__claim_predicate_class, coalesce(mismatch, 0) AS text_nli__predicate_mismatch_count, st = 'F' AS text_nli__claim_is_hedged,
  {', '.join(f'{e} AS {n}' for n, e in (full_audit._DL | {'dl__property_chain_support': 'false', 'dl__property_chain_conflict': 'false'}).items())},
  {full_audit._COUNTED} FROM gene),
{full_audit._JUDGED}"""

FACTS = (
    "type.domain_valid", "type.range_valid", "type.is_spurious_self_referential", "ontology.subject_has_ancestors", "ontology.object_has_ancestors", "ontology.is_sibling_conflict", "conflicts.qualifier_negated", "conflicts.has_refuting_evidence",
    "conflicts.opposite_predicate_same_context", "conflicts.claim_predicate_polarity", "extraction.is_low_confidence", "extraction.predicate_is_fallback", "curated_kg.curated_kg_match", "curated_kg.disgenet_checked", "curated_kg.disgenet_support",
    "curated_kg.monarch_checked", "curated_kg.monarch_support", "literature.has_structured_support", "literature.structured_source_count", "tissue.is_mismatch", "text_nli.checked", "text_nli.n_support", "text_nli.n_contradict", "text_nli.claim_predicate_class",
    "text_nli.predicate_mismatch_count", "text_nli.claim_is_hedged", "evidence.retracted_count", "evidence.concern_count", "claim.citation_count",
)


@query(f"{CLAIM_SQL} SELECT k AS claim_id, {', '.join(p.replace('.', '__') for p in FACTS)}, CAST(floor(1e6 * text_nli__m_lit + 0.5) AS BIGINT) AS margin_millionths FROM fact")
def claim_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of whole claims."""
    found = claim_audit.claim_facts(claim_rows(spark, sf_dir), tables(spark, sf_dir), commerce.AS_OF_YEAR, READS)
    return found.select("claim_id", *(F.col(f"facts.{p}").alias(p.replace(".", "__")) for p in FACTS), F.floor(1e6 * F.col("facts.text_nli.m_lit") + 0.5).cast("long").alias("margin_millionths"))


@query(f"{CLAIM_SQL} SELECT k AS claim_id, CAST(floor(1e6 * score + 0.5) AS BIGINT) AS score_millionths, v AS verdict FROM {full_audit._LAST}")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of whole claims: score and verdict by facts that operators give."""
    return audited(spark, sf_dir).select("claim_id", F.floor(1e6 * F.col("score") + 0.5).cast("long").alias("score_millionths"), "verdict")


@query(f"{CLAIM_SQL} " + " UNION ALL ".join(f"SELECT k AS claim_id, '{g}' AS gate FROM {full_audit._LAST} WHERE t{i}" for i, (g, *_) in enumerate(full_audit._GATES)))
def claim_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates that open for whole claims."""
    return audited(spark, sf_dir).select("claim_id", F.explode_outer("gate_trace").alias("gate")).filter("gate is not null")
