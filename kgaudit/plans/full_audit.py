"""The audit with all rules and gates, over facts that are joined from lines, a census, axioms and the orders' columns.

A claim is an order. Its citations are its lines; its subject is a gene of a census made of the suppliers; its classes,
predicate and known edges are checked against the default axioms; what else a rule reads is a function of its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.operators import claims, gates, ontology, rules
from kgaudit.plans import audit, commerce
from kgaudit.plans.registry import query
from kgaudit.session import table
from kgaudit.sources import ingest

#: Facts as expressions that Spark and DuckDB both read: k is the order's key, c the customer's.
PLAIN = {
    "type.domain_valid": "k % 11 <> 0", "type.range_valid": "k % 13 <> 0", "type.is_spurious_self_referential": "k % 17 = 0",
    "ontology.subject_has_ancestors": "k % 3 = 0", "ontology.object_has_ancestors": "k % 5 = 0", "ontology.is_sibling_conflict": "k % 19 = 0",
    "conflicts.qualifier_negated": "k % 23 = 0", "conflicts.has_refuting_evidence": "k % 29 = 0", "conflicts.opposite_predicate_same_context": "k % 43 = 0",
    "conflicts.claim_predicate_polarity": "CASE WHEN k % 3 = 0 THEN 'positive' ELSE 'negative' END",
    "extraction.is_low_confidence": "k % 31 = 0", "extraction.predicate_is_fallback": "k % 37 = 0",
    "curated_kg.curated_kg_match": "c % 2 = 0", "curated_kg.disgenet_checked": "c % 3 <> 0", "curated_kg.disgenet_support": "c % 2 = 0", "curated_kg.monarch_checked": "c % 5 <> 0", "curated_kg.monarch_support": "c % 7 = 0",
    "literature.has_structured_support": "c % 4 <> 0", "literature.structured_source_count": "c % 6",
    "tissue.is_mismatch": "c % 11 = 0",
    "text_nli.checked": "k % 4 <> 1", "text_nli.n_support": "CASE WHEN k % 4 = 1 THEN 0 ELSE k % 9 % 4 END", "text_nli.n_contradict": "CASE WHEN k % 4 = 1 THEN 0 ELSE k % 7 % 3 END",
    "text_nli.m_lit": "CASE WHEN k % 4 = 1 THEN 0.0 ELSE (k % 41 - 15) * 0.125 END", "text_nli.s_neg_total": "k % 10 * 0.125",
    "text_nli.claim_predicate_class": "CASE k % 3 WHEN 0 THEN 'causal' WHEN 1 THEN 'association' ELSE 'unknown' END", "text_nli.predicate_mismatch_count": "k % 5 % 4", "text_nli.claim_is_hedged": "k % 8 = 0",
}
NAMES = ("gene", "disease", "phenotype", "pathway", "tissue")
PREDICATES = tuple(ontology.PROPERTIES)
ROLES = ("oncogene", "TSG", "oncogene, TSG", "fusion")
CENSUS_GENES, PLACES = 40, 7


def _typed(path: str, expression: str) -> Column:
    column = F.expr(expression)
    return column.cast("double") if path in ("text_nli.m_lit", "text_nli.s_neg_total") else column


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims, with classes, predicate, ends and a gene symbol."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    return table(spark, sf_dir, "orders").select(
        k.alias("claim_id"), k.alias("pair_id"), k.alias("k"), c.alias("c"), pick(NAMES, k).alias("subject_class"), pick(NAMES, F.expr("o_orderkey div 5")).alias("object_class"),
        pick(PREDICATES, k).alias("predicate"), name("g", c % 50).alias("subject"), name("t", k % PLACES).alias("object"),
        pick(NAMES, k).alias("subject_category"), name("S", c % CENSUS_GENES).alias("symbol"),
    )


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A census of the suppliers of the first half of the symbols, with a synonym each."""
    key = F.col("s_suppkey")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (key % len(ROLES) + 1).cast("int"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "supplier").filter(key < CENSUS_GENES // 2)
    synonym = F.concat(F.lit("x, s"), (key + 30).cast("string"))
    return ingest.gene_census(rows.select(F.concat(F.lit("s"), key.cast("string")).alias("GENE_SYMBOL"), none.alias("HGNC_ID"), role.alias("ROLE_IN_CANCER"), none.alias("TIER"), none.alias("NAME"), F.when(key < 5, synonym).otherwise("").alias("SYNONYMS")))


def known_edges(spark: SparkSession) -> DataFrame:
    """Genes in pathways, pathways in tissues: a chain from each gene to one tissue."""
    genes = [(f"g{i}", "biolink:participates_in", f"p{i % PLACES}") for i in range(50)]
    return spark.createDataFrame(genes + [(f"p{i}", "biolink:located_in", f"t{i}") for i in range(PLACES)], "subject string, predicate string, object string")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the struct of all facts."""
    rows = claim_rows(spark, sf_dir)
    grouped = audit.evidence_groups(rows, commerce.provenance(spark, sf_dir), commerce.AS_OF_YEAR)
    grouped = claims.gene_facts(grouped.withColumn("has_evidence", F.col("claim.citation_count") > 0), census(spark, sf_dir))
    grouped = ontology.check_all(grouped, known_edges(spark), asked=rows)
    structs = {}
    for path, expression in PLAIN.items():
        group, name = path.split(".")
        structs.setdefault(group, []).append(_typed(path, expression).alias(name))
    more = {name: F.struct(*columns) for name, columns in structs.items()}
    return audit.with_facts(grouped, more, ("claim", "evidence", "temporal", "gene", "dl")).select("claim_id", "facts")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit. Explode its arrays with ``explode_outer``: for ``explode`` Spark infers a filter and pushes it down to the facts, with all rules and gates written out in it."""
    return audit.audit(facts(spark, sf_dir))


# The same in SQL --------------------------------------------------------------------------------------------------


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _column(path: str) -> str:
    return path.replace(".", "__")


def _atom(spec: dict) -> str:
    column, op, value = _column(spec["fact"]), spec["op"], spec["value"]
    if op == "equals":
        text = column if value is True else f"NOT {column}" if value is False else f"{column} = '{value}'" if isinstance(value, str) else f"{column} = {value}"
    else:
        text = f"{column} {({'gt': '>', 'gte': '>=', 'lt': '<', 'lte': '<=', 'within_years': '<=', 'older_than_years': '>'})[op]} {value}"
    return f"coalesce({text}, false)"


def _when(spec: dict) -> str:
    return " AND ".join(["true", *map(_atom, spec.get("all", []))]) if "all" in spec else " OR ".join(map(_atom, spec["any"]))


_DISJOINT = sorted({pair for a, others in ontology.CLASSES.items() for b in others for pair in ((a, b), (b, a))})
_DL = {
    "dl__disjoint_pair_violation": " OR ".join(f"sc = '{a}' AND oc = '{b}'" for a, b in _DISJOINT),
    "dl__domain_valid": "CASE p " + " ".join(f"WHEN '{p}' THEN list_contains({_list(d)}, sc)" for p, (d, _) in ontology.PROPERTIES.items()) + " END",
    "dl__range_valid": "CASE p " + " ".join(f"WHEN '{p}' THEN list_contains({_list(r)}, oc)" for p, (_, r) in ontology.PROPERTIES.items()) + " END",
    "dl__property_chain_support": f"c % 50 % {PLACES} = k % {PLACES}", "dl__property_chain_conflict": f"c % 50 % {PLACES} <> k % {PLACES}",
    "dl__universal_violation": "sc = 'gene' AND (p = 'biolink:expressed_in' AND oc <> 'tissue' OR p = 'biolink:participates_in' AND oc <> 'pathway')",
    "dl__existential_violation": "sc = 'gene' AND n = 0",
}
_RULES, _ATTACKS = rules.DEFAULT_RULES, rules.Attacks.of(rules.DEFAULT_RULES)
_ATTACKED = [r.id for r in _RULES if _ATTACKS.by_target[r.id]]


def _rounds() -> str:
    """Grounded labels, a round a step: i_ and o_ tell who is in and out."""
    first = ", ".join(f"false AS i_{r}, false AS o_{r}" if r in _ATTACKED else f"f_{r} AS i_{r}, false AS o_{r}" for r in (x.id for x in _RULES))
    steps = [f"l0 AS (SELECT *, {first} FROM fired)"]
    for n in range(1, _ATTACKS.rounds() + 1):
        new = []
        for r in _ATTACKED:
            by = _ATTACKS.by_target[r]
            new.append(f"f_{r} AND {' AND '.join(f'(NOT f_{a} OR o_{a})' for a in by)} AS i_{r}, f_{r} AND ({' OR '.join(f'i_{a}' for a in by)}) AS o_{r}")
        steps.append(f"l{n} AS (SELECT * REPLACE ({', '.join(new)}) FROM l{n - 1})")
    return ",\n".join(steps)


_SILENT = "text_nli__n_support = 0 AND text_nli__n_contradict = 0 AND n >= 2"
_WEAK = f"text_nli__checked AND text_nli__claim_predicate_class = 'causal' AND text_nli__n_support < 2 AND text_nli__m_lit < 1.0 AND NOT ({_SILENT})"
_BARE = "text_nli__checked AND text_nli__claim_predicate_class = 'causal' AND text_nli__n_support = 0 AND text_nli__n_contradict >= 1 AND v <> 'FAIL'"
#: Gate, condition, verdict, whether only a pass is changed and traced, and whether it is traced whatever the verdict.
_GATES = (
    ("gate:retraction", "nr > 0", "FAIL", False), ("gate:expression_of_concern", "nc > 0 AND NOT nr > 0", "WARN", True),
    ("gate:positive_evidence_required", "NOT (n >= 2 OR curated_kg__curated_kg_match)", "WARN", True),
    ("gate:self_negation", "conflicts__qualifier_negated OR conflicts__has_refuting_evidence", "FAIL", False),
    ("gate:opposite_predicate", "conflicts__opposite_predicate_same_context", "FAIL", False), ("gate:low_confidence", "extraction__is_low_confidence", "FAIL", False),
    ("gate:type_violation", "NOT type__domain_valid OR NOT type__range_valid", "FAIL", False), ("gate:spurious_self_referential", "type__is_spurious_self_referential", "FAIL", False),
    ("gate:sibling_conflict", "ontology__is_sibling_conflict", "WARN", True), ("gate:tissue_mismatch", "tissue__is_mismatch", "WARN", True),
    ("gate:nli_strong_contradiction", "text_nli__checked AND text_nli__n_contradict >= 2 AND text_nli__s_neg_total >= 0.8 AND v <> 'FAIL'", "FAIL", False),
    ("gate:nli_no_support_with_contradiction", _BARE, "FAIL", False),
    ("gate:nli_weak_causal_support", f"{_WEAK} AND NOT (t11)", "WARN", True),
    ("gate:nli_mixed_evidence", "text_nli__checked AND text_nli__n_support >= 1 AND text_nli__n_contradict >= 1 AND abs(text_nli__m_lit) < 0.4", "WARN", None),
    ("gate:nli_hedged_claim", "text_nli__claim_is_hedged AND score < 0.85", "WARN", True),
)


def _gate_steps() -> str:
    steps = ["g0 AS (SELECT *, CASE WHEN score >= 0 THEN 'PASS' WHEN score >= -0.4 THEN 'WARN' ELSE 'FAIL' END AS v FROM scored)"]
    for i, (_, holds, to, only_pass) in enumerate(_GATES):
        opens = f"({holds})" if only_pass is False else f"({holds}) AND v = 'PASS'"
        traced = f"({holds})" if only_pass is None else opens
        steps.append(f"g{i + 1} AS (SELECT * REPLACE (CASE WHEN {opens} THEN '{to}' ELSE v END AS v), {traced} AS t{i} FROM g{i})")
    steps[-1] = steps[-1].replace(" AS (", " AS MATERIALIZED (", 1)
    return ",\n".join(steps)


_ROLE = "CASE WHEN s % 4 = 0 THEN 'oncogene' WHEN s % 4 = 1 THEN 'tumor_suppressor' WHEN s % 4 = 2 THEN 'both' ELSE 'fusion' END"
#: Facts that SQL derives from the counts and years of a claim's citations and from its gene.
_COUNTED = f"""n AS claim__citation_count, nr AS evidence__retracted_count, nc AS evidence__concern_count, n >= 2 AS evidence__has_multiple_sources, s IS NOT NULL AS gene__is_cancer_gene, coalesce({_ROLE} IN ('tumor_suppressor', 'both'), false) AND s IS NOT NULL AS gene__is_tumor_suppressor,
  so IS NOT NULL AS temporal__has_support, 2001 - sn AS temporal__support_newest_age_years, CAST(NULL AS DOUBLE) AS temporal__claim_age_years,
  coalesce(sn - so >= 10, false) AND lr IS NULL AND lc IS NULL AS temporal__longstanding_uncontested_support, coalesce(lr >= fp, false) AS temporal__has_retraction_after_publication,
  CASE WHEN er >= fp THEN er - fp END AS temporal__earliest_retraction_lag_years, lc IS NOT NULL AS temporal__has_concern, lr IS NOT NULL AS temporal__has_retraction,
  coalesce(sn > fc, false) AS temporal__has_support_after_concern, coalesce(sn <= lr, true) AS temporal__no_support_after_retraction, coalesce(so < er, false) AS temporal__was_supported_before_retraction"""
#: From facts to verdicts: rules, labels, weights, gates.
_JUDGED = f"""fired AS (SELECT *, {', '.join(f'{_when(r.when)} AS f_{r.id}' for r in _RULES)} FROM fact),
{_rounds()},
weighed AS MATERIALIZED (SELECT *, {', '.join(f'CASE WHEN f_{r.id} AND NOT o_{r.id} THEN {r.weight}::DOUBLE ELSE 0.0::DOUBLE END AS w_{r.id}' for r in _RULES)} FROM l{_ATTACKS.rounds()}),
scored AS (SELECT *, 0.0::DOUBLE + {' + '.join(f'w_{r.id}' for r in _RULES)} AS score FROM weighed),
{_gate_steps()}"""

AUDIT_SQL = f"""WITH prov AS (SELECT l_orderkey AS claim_id, CASE WHEN l_returnflag = 'R' AND l_quantity <= 3 THEN 'retracted' WHEN l_returnflag = 'A' AND l_quantity <= 3 THEN 'concern' ELSE 'clean' END AS status, CAST(year(l_shipdate) AS INT) AS y FROM lineitem),
a AS (SELECT claim_id, count(*) AS n, count(*) FILTER (status = 'retracted') AS nr, count(*) FILTER (status = 'concern') AS nc, min(y) AS fp,
  min(y) FILTER (status = 'clean') AS so, max(y) FILTER (status = 'clean') AS sn, min(y) FILTER (status = 'retracted') AS er, max(y) FILTER (status = 'retracted') AS lr,
  min(y) FILTER (status = 'concern') AS fc, max(y) FILTER (status = 'concern') AS lc FROM prov GROUP BY claim_id),
o AS (SELECT o_orderkey AS k, o_custkey AS c, {_list(NAMES)}[o_orderkey % 5 + 1] AS sc, {_list(NAMES)}[o_orderkey // 5 % 5 + 1] AS oc, {_list(PREDICATES)}[o_orderkey % {len(PREDICATES)} + 1] AS p,
  coalesce(n, 0) AS n, coalesce(nr, 0) AS nr, coalesce(nc, 0) AS nc, fp, so, sn, er, lr, fc, lc FROM orders LEFT JOIN a ON o_orderkey = claim_id),
have AS (SELECT DISTINCT s_suppkey AS s FROM supplier WHERE s_suppkey < {CENSUS_GENES // 2}),
gene AS (SELECT o.*, coalesce(own.s, other.s) AS s FROM o LEFT JOIN have own ON sc = 'gene' AND own.s = c % {CENSUS_GENES} LEFT JOIN have other ON sc = 'gene' AND other.s < 5 AND other.s + 30 = c % {CENSUS_GENES}),
fact AS (SELECT *, {', '.join(f'{e} AS {_column(p)}' for p, e in PLAIN.items())}, {', '.join(f'{e} AS {n}' for n, e in _DL.items())}, {_COUNTED} FROM gene),
{_JUDGED}"""
_LAST = f"g{len(_GATES)}"


@query(f"{AUDIT_SQL} SELECT k AS claim_id, CAST(floor(1e6 * score + 0.5) AS BIGINT) AS score_millionths, v AS verdict FROM {_LAST}")
def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict under all rules and gates."""
    return audited(spark, sf_dir).select("claim_id", F.floor(1e6 * F.col("score") + 0.5).cast("long").alias("score_millionths"), "verdict")


@query(f"{AUDIT_SQL} " + " UNION ALL ".join(f"SELECT k AS claim_id, '{r.id}' AS rule_id, w_{r.id} AS feature FROM weighed WHERE w_{r.id} <> 0" for r in _RULES))
def full_rule_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the whole set that count, with their weight."""
    return audited(spark, sf_dir).select("claim_id", F.explode_outer("features").alias("rule_id", "feature")).filter("feature <> 0")


@query(f"{AUDIT_SQL} " + " UNION ALL ".join(f"SELECT k AS claim_id, '{r.id}' AS rule_id, CASE WHEN i_{r.id} THEN 'IN' WHEN o_{r.id} THEN 'OUT' ELSE 'UNDECIDED' END AS label FROM weighed WHERE f_{r.id}" for r in _RULES))
def full_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounded labels of all rules that fire."""
    return audited(spark, sf_dir).select("claim_id", F.explode_outer("trace").alias("t")).filter("t is not null").select("claim_id", "t.rule_id", "t.label")


@query(f"{AUDIT_SQL} " + " UNION ALL ".join(f"SELECT k AS claim_id, '{g}' AS gate FROM {_LAST} WHERE t{i}" for i, (g, *_) in enumerate(_GATES)))
def full_gate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates 1-14: those that open for each claim."""
    return audited(spark, sf_dir).select("claim_id", F.explode_outer("gate_trace").alias("gate")).filter("gate is not null")


@query(f"{AUDIT_SQL} SELECT k AS claim_id, CASE WHEN t8 THEN 'FAIL' ELSE v END AS verdict FROM {_LAST}")
def strict_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate W: verdicts if sibling conflicts failed a claim."""
    return gates.strict_ontology(audited(spark, sf_dir)).select("claim_id", "verdict")


@query(f"{AUDIT_SQL} SELECT k AS claim_id, {', '.join(f'{e} AS {n[4:]}' for n, e in _DL.items())} FROM gene")
def axiom_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim against the default axioms."""
    return facts(spark, sf_dir).select("claim_id", *(F.col(f"facts.dl.{n[4:]}").alias(n[4:]) for n in _DL))


@query(f"{AUDIT_SQL} SELECT k AS claim_id, sc = 'gene' AS cosmic_checked, s IS NOT NULL AS is_cancer_gene, CASE WHEN s IS NULL THEN 'unknown' ELSE {_ROLE} END AS function_class, s IS NOT NULL AND s % 4 IN (1, 2) AS is_tumor_suppressor, s IS NOT NULL AND s % 4 IN (0, 2) AS is_oncogene FROM gene")
def gene_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the census says of every claim's gene."""
    found = facts(spark, sf_dir)
    return found.select("claim_id", *(F.col(f"facts.gene.{n}").alias(n) for n in ("cosmic_checked", "is_cancer_gene", "function_class", "is_tumor_suppressor", "is_oncogene")))
