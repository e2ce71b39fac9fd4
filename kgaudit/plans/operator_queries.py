"""Queries of single operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.functions import ids
from kgaudit.functions import text as tx
from kgaudit.operators import conditions, graph, learning, ontology
from kgaudit.plans import commerce
from kgaudit.plans.registry import query
from kgaudit.session import table

KINDS = ("gene", "disease", "phenotype", "pathway", "publication")
_PICK = "['gene', 'disease', 'phenotype', 'pathway', 'publication']"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {_PICK}[l_orderkey % 5 + 1] AS a, {_PICK}[l_linenumber % 5 + 1] AS b FROM lineitem), q AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y FROM p)
SELECT l_orderkey, l_linenumber, x = 'gene' AND y IN ('gene', 'phenotype', 'pathway') OR x = 'disease' AND y = 'gene' AS allowed,
CASE WHEN x = 'gene' AND y = 'gene' THEN 'G-G' WHEN x = 'disease' AND y = 'gene' THEN 'G-Dis' WHEN x = 'gene' AND y = 'phenotype' THEN 'G-Phe' WHEN x = 'gene' AND y = 'pathway' THEN 'G-Path' ELSE 'Other' END AS edge_type FROM q""")
def edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of categories, in either direction."""
    pick = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), (F.col(c) % 5 + 1).cast("int"))
    a, b = pick("l_orderkey"), pick("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ids.allowed_edge(a, b).alias("allowed"), ids.edge_type(a, b).alias("edge_type"))


ATOMS = {
    "n_gt": ("f.n", "gt", 25), "n_gte": ("f.n", "gte", 25), "n_lt": ("f.n", "lt", 25), "n_lte": ("f.n", "lte", 25), "n_within": ("f.n", "within_years", 10), "n_older": ("f.n", "older_than_years", 10), "n_before": ("f.n", "before_year", 7), "n_after": ("f.n", "after_year", 7),
    "n_equals": ("f.n", "equals", 7), "n_exists": ("f.n", "exists"), "s_equals": ("f.s", "equals", "R"), "s_contains": ("f.s", "contains", "R"), "b_exists": ("f.b", "exists"), "b_equals": ("f.b", "equals", False), "l_contains": ("f.l", "contains", "A"), "l_exists": ("f.l", "exists"), "none_exists": ("f.none.x", "exists"), "none_equals": ("f.none", "equals", None),
}


@query("""SELECT l_orderkey, l_linenumber, q > 25 AS n_gt, q >= 25 AS n_gte, q < 25 AS n_lt, q <= 25 AS n_lte, q <= 10 AS n_within, q > 10 AS n_older, q < 7 AS n_before, q > 7 AS n_after, q = 7 AS n_equals, q <> 0 AS n_exists, r = 'R' AS s_equals, r = 'R' AS s_contains,
q > 40 AS b_exists, q <= 40 AS b_equals, r = 'A' AS l_contains, r <> 'N' AS l_exists, false AS none_exists, true AS none_equals, NOT (q > 25) AS n_gt_not FROM (SELECT *, l_quantity AS q, l_returnflag AS r FROM lineitem)""")
def fact_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operator on facts of every type."""
    flag = F.col("l_returnflag")
    facts = F.struct(F.struct(F.col("l_quantity").alias("n"), flag.alias("s"), (F.col("l_quantity") > 40).alias("b"), F.filter(F.array(flag), lambda x: x != "N").alias("l")).alias("f"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", facts.alias("facts"))
    schema = rows.schema["facts"].dataType
    return rows.selectExpr("l_orderkey", "l_linenumber", *(f"{conditions.atom(schema, *spec)} AS {name}" for name, spec in ATOMS.items()), f"{conditions.atom(schema, *ATOMS['n_gt'], negate=True)} AS n_gt_not")


@query("""WITH g AS (SELECT n_regionkey AS r, list('NAT:' || n_nationkey ORDER BY 'NAT:' || n_nationkey) AS terms FROM nation GROUP BY 1) SELECT 'REG:' || r AS ancestor, array_to_string(terms, ',') AS terms FROM g WHERE len(terms) > 1""")
def sibling_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region, as groups."""
    nation = table(spark, sf_dir, "nation").select(commerce.named("NAT:", "n_nationkey").alias("term"), commerce.named("REG:", "n_regionkey").alias("ancestor"))
    return ontology.sibling_map(nation, ["REG:none"]).select("ancestor", F.concat_ws(",", "terms").alias("terms"))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS mine FROM lineitem GROUP BY 1), p AS (SELECT l_partkey, list(DISTINCT l_suppkey) AS theirs FROM lineitem GROUP BY 1)
SELECT DISTINCT l.l_orderkey, l.l_partkey, len(list_intersect(mine, theirs)) > 0 AS shares_source FROM lineitem l JOIN s ON s.l_orderkey = l.l_orderkey JOIN p ON p.l_partkey = l.l_partkey + 1""")
def shared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sources of a claim and of the next part's edges meet."""
    line = table(spark, sf_dir, "lineitem")
    mine = line.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("mine"))
    theirs = line.groupBy((F.col("l_partkey") - 1).alias("l_partkey")).agg(F.collect_set("l_suppkey").alias("theirs"))
    pairs = line.select("l_orderkey", "l_partkey").distinct()
    return pairs.join(mine, "l_orderkey").join(theirs, "l_partkey").select("l_orderkey", "l_partkey", graph.shares_source(F.col("mine"), F.col("theirs")).alias("shares_source"))


@query("""WITH e AS (SELECT o_custkey AS claim_id, o_orderkey AS edge, o_totalprice AS suspicion, o_orderpriority AS error_type FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY suspicion DESC, edge) AS r FROM e)
SELECT claim_id, edge, CAST(r AS INT) AS rank, error_type FROM k WHERE r <= 10""")
def suspicious_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most suspicious edges of a claim, with the error type that is predicted for them."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("edge"), F.col("o_totalprice").alias("suspicion"))
    told = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("claim_id"), F.col("o_orderkey").alias("edge"), F.col("o_orderpriority").alias("error_type"))
    return learning.top_edges(edges, told, ["claim_id"], ["edge"]).select("claim_id", "edge", "rank", "error_type")


@query("SELECT CAST(row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_orderpriority) AS INT) AS place, o_orderpriority AS label FROM orders GROUP BY o_orderpriority")
def ranked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by falling score, equal ones by name."""
    scores = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.sum("o_totalprice").alias("score"))
    return graph.ranked(scores, "score", "label").select("place", "label")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax >= 0.06 THEN 'type_violation' WHEN l_discount >= 0.08 THEN 'retracted_support' WHEN l_quantity > 40 THEN 'ontology_mismatch' WHEN l_quantity < 5 THEN 'weak_evidence' END AS error_type FROM lineitem""")
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML18: error types by rule features."""
    sign = lambda holds: F.when(F.expr(holds), -1.0).otherwise(0.0)
    c = {"type": sign("l_tax >= 0.06"), "retraction": sign("l_discount >= 0.08"), "ontology": sign("l_quantity > 40"), "weak": sign("l_quantity < 5")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", learning.error_type_of(c).alias("error_type"))


@query("SELECT CAST(floor(1e6 * count(*) FILTER (quality = 0) / greatest(count(*) FILTER (quality = 1), 1) + 0.5) AS BIGINT) AS weight_millionths FROM labels")
def positive_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    found = learning.positive_weight(table(spark, sf_dir, "labels").select(F.col("quality").alias("y")))
    return found.select(F.floor(F.col("pos_weight") * 1e6 + 0.5).cast("long").alias("weight_millionths"))


@query("""SELECT o_orderkey, o_orderkey % 4 = 0 AS between, o_orderkey % 3 = 0 AS self_referential FROM orders""")
def claim_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase between two mentions, and claims of one thing that the text names once."""
    text = F.expr("if(o_orderkey % 4 = 0, concat('S', o_orderkey, ' raises the risk of T', o_orderkey), concat('T', o_orderkey, ' and S', o_orderkey))")
    subject, obj = F.expr("concat('S', o_orderkey)"), F.expr("concat('T', o_orderkey)")
    same = F.expr("if(o_orderkey % 3 = 0, 'x', 'y')")
    return table(spark, sf_dir, "orders").select("o_orderkey", (tx.between_mentions(text, subject, obj) == "raises the risk of").alias("between"), tx.self_referential(F.lit("x"), same, text, subject).alias("self_referential"))
