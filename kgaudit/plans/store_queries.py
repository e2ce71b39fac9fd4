"""Queries of pair subgraphs and of stores, with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgaudit.functions import ids
from kgaudit.operators import subgraph
from kgaudit.plans import audit, commerce
from kgaudit.plans.registry import query
from kgaudit.session import shared_folder, table
from kgaudit.sources import stores

# Pair subgraphs --------------------------------------------------------------------------------------------------


def line_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each line and order: equal edges have amounts of their own, and an order ``ord``."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    no = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    edge = lambda df, s, p, o, amount, at: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), amount.alias("amount"), at.alias("ord"))
    ordered, part, supplier = commerce.named("ORD:", "l_orderkey"), commerce.named("PART:", "l_partkey"), commerce.named("SUPP:", "l_suppkey")
    out = edge(line, ordered, "contains", part, F.col("l_quantity"), no).union(edge(line, part, "supplied_by", supplier, F.col("l_quantity"), no))
    out = out.union(edge(order, commerce.named("CUST:", "o_custkey"), "placed", commerce.named("ORD:", "o_orderkey"), F.col("o_totalprice"), F.col("o_orderkey") * 8))
    customer = table(spark, sf_dir, "customer")
    return out.union(edge(customer, commerce.named("CUST:", "c_custkey"), "located_in", commerce.named("NAT:", "c_nationkey"), F.col("c_acctbal"), F.lit(0).cast("long")))


KINDS = ("customer", "order", "part", "supplier")
JOINED = (("customer", "order"), ("order", "part"), ("part", "supplier"))


def order_subgraphs(spark: SparkSession, sf_dir: str, with_edges: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Around each order and its customer, with the suppliers of its large returned lines as evidence."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"), commerce.named("ORD:", "o_orderkey").alias("subject"), commerce.named("CUST:", "o_custkey").alias("object"))
    returned = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_returnflag = 'R'")
    evidence = returned.select(F.col("l_orderkey").alias("pair_id"), F.explode(F.array(commerce.named("SUPP:", "l_suppkey"), F.lit("PMID:1"))).alias("node"))
    nodes = spark.createDataFrame([], "id string, category string").limit(0)  # Spark knows that it is empty
    category = lambda c: ids.category_of(c, commerce.CATEGORIES)
    return subgraph.pair_subgraph(pairs, nodes, line_graph(spark, sf_dir), 1, KINDS, lambda a, b: ids.allowed_edge(a, b, JOINED), evidence, category, lambda c: c.startswith("SUPP:"), with_edges)


PAIRS_SQL = """m AS (SELECT 'ORD:' || l_orderkey AS subject, 'contains' AS predicate, 'PART:' || l_partkey AS object, l_quantity AS amount, l_orderkey * 8 + l_linenumber AS ord FROM lineitem
  UNION ALL SELECT 'PART:' || l_partkey, 'supplied_by', 'SUPP:' || l_suppkey, l_quantity, l_orderkey * 8 + l_linenumber FROM lineitem
  UNION ALL SELECT 'CUST:' || o_custkey, 'placed', 'ORD:' || o_orderkey, o_totalprice, o_orderkey * 8 FROM orders),
centre AS (SELECT o_orderkey AS pair_id, 'ORD:' || o_orderkey AS node FROM orders UNION SELECT o_orderkey, 'CUST:' || o_custkey FROM orders
  UNION SELECT l_orderkey, 'SUPP:' || l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders)),
touched AS (SELECT pair_id, m.* FROM centre JOIN m ON m.subject = node UNION SELECT pair_id, m.* FROM centre JOIN m ON m.object = node)"""


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, subject, predicate, object ORDER BY ord, amount) AS r FROM touched)
SELECT pair_id, subject, predicate, object, amount, ord FROM k WHERE r = 1""")
def pair_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of subgraphs with evidence centres; of equal edges the first, with its own amount."""
    return order_subgraphs(spark, sf_dir)[1].select("pair_id", "subject", "predicate", "object", "amount", "ord")


@query(f"""WITH {PAIRS_SQL}, n AS (SELECT pair_id, node FROM centre UNION SELECT pair_id, subject FROM touched UNION SELECT pair_id, object FROM touched)
SELECT pair_id, node, CASE left(node, 3) WHEN 'CUS' THEN 'customer' WHEN 'ORD' THEN 'order' WHEN 'PAR' THEN 'part' ELSE 'supplier' END AS category FROM n""")
def pair_subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: nodes of subgraphs with evidence centres."""
    return order_subgraphs(spark, sf_dir, with_edges=False)[0].select("pair_id", "node", "category")


@query("""WITH RECURSIVE pairs AS (SELECT o_orderkey AS pair_id, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
p AS (SELECT * FROM pairs WHERE b IS NOT NULL),
l AS (SELECT pair_id, 'ORD:' || l_orderkey AS o, 'PART:' || l_partkey AS t, 'SUPP:' || l_suppkey AS s FROM p JOIN lineitem ON l_orderkey = a OR l_orderkey = b),
e AS (SELECT pair_id, o AS x, t AS y FROM l UNION SELECT pair_id, t, o FROM l UNION SELECT pair_id, t, s FROM l UNION SELECT pair_id, s, t FROM l),
walk AS (SELECT pair_id, 'ORD:' || a AS node, false AS seen, 0 AS d FROM p
  UNION SELECT w.pair_id, e.y, w.seen OR e.y LIKE 'SUPP:%', w.d + 1 FROM walk w JOIN e ON e.pair_id = w.pair_id AND e.x = w.node WHERE w.d < 9)
SELECT p.pair_id, CAST(coalesce(min(d) FILTER (seen AND node = 'ORD:' || b), 0) AS DOUBLE) AS hops FROM p LEFT JOIN walk w ON w.pair_id = p.pair_id GROUP BY 1""")
def path_through_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops between a customer's successive orders along their lines, by way of a supplier."""
    order = table(spark, sf_dir, "orders")
    following = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    both = order.select(F.col("o_orderkey").alias("pair_id"), following.alias("b")).filter("b is not null")
    pairs = both.select("pair_id", commerce.named("ORD:", "pair_id").alias("subject"), commerce.named("ORD:", "b").alias("object"))
    lines = both.select("pair_id", F.explode(F.array("pair_id", "b")).alias("l_orderkey")).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey")
    part = commerce.named("PART:", "l_partkey")
    edges = lines.select("pair_id", commerce.named("ORD:", "l_orderkey").alias("subject"), part.alias("object")).union(lines.select("pair_id", part, commerce.named("SUPP:", "l_suppkey")))
    return subgraph.hops_through(pairs, edges, lambda c: c.startswith("SUPP:")).select("pair_id", "hops")


# Stores ----------------------------------------------------------------------------------------------------------


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


MERGED = {"name": "create", "first_flag": "create", "suppliers": "union", "shipped": "max", "lines": "sum"}


@query("""WITH u AS (SELECT l_partkey AS k, CASE WHEN l_quantity > 25 THEN l_extendedprice END AS price, l_returnflag AS flag, l_suppkey, l_shipdate, l_orderkey * 8 + l_linenumber AS o FROM lineitem WHERE l_partkey % 3 <> 0),
a AS (SELECT k, arg_max(price, o) FILTER (price IS NOT NULL) AS price, arg_min(flag, o) AS flag, list_sort(list_distinct(list(l_suppkey))) AS s, max(l_shipdate) AS d, count(*) AS n FROM u GROUP BY 1)
SELECT coalesce(p_partkey, k) AS partkey, CASE WHEN p_partkey IS NOT NULL THEN p_name ELSE 'unnamed' END AS name, coalesce(price, p_retailprice) AS price, CASE WHEN p_partkey IS NULL THEN flag END AS first_flag,
coalesce(array_to_string(s, ','), '') AS suppliers, d AS shipped, coalesce(n, 0) AS lines FROM (SELECT * FROM part WHERE p_size > 10) p FULL JOIN a ON p_partkey = k""")
def property_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines merged into a table of parts, each property by its own policy, in the buckets that they touch."""
    part = table(spark, sf_dir, "part").filter("p_size > 10")
    old = part.selectExpr("p_partkey as partkey", "p_name as name", "p_retailprice as price", "cast(null as string) as first_flag", "cast(array() as array<bigint>) as suppliers", "cast(null as timestamp_ntz) as shipped", "0L as lines", "0L as at")
    line = table(spark, sf_dir, "lineitem").filter("l_partkey % 3 <> 0")
    new = line.selectExpr(
        "l_partkey as partkey", "'unnamed' as name", "if(l_quantity > 25, l_extendedprice, null) as price", "l_returnflag as first_flag", "array(l_suppkey) as suppliers", "cast(l_shipdate as timestamp_ntz) as shipped", "1L as lines", "l_orderkey * 8 + l_linenumber as at"
    )
    path = new_folder(spark)
    for rows in (old, new):
        stores.merge_into(spark, path, rows, ["partkey"], MERGED, "at")
    return stores.table_at(spark, path).select("partkey", "name", "price", "first_flag", F.array_join("suppliers", ",").alias("suppliers"), "shipped", "lines")


@query("""SELECT 'LINE:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS identifier, CASE WHEN l_returnflag = 'R' AND l_quantity <= 3 THEN 'retracted' WHEN l_returnflag = 'A' AND l_quantity <= 3 THEN 'concern' ELSE 'clean' END AS status, bool_or(l_discount > 0.05) AS cached
FROM lineitem GROUP BY ALL""")
def provenance_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every line, after those with a large discount were asked for once."""
    known = commerce.provenance(spark, sf_dir).select("identifier", "status")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    asked = table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").select(F.concat(F.lit("LINE:"), key).alias("identifier"))
    fetch = lambda wanted: wanted.join(known.distinct(), "identifier")
    path = new_folder(spark)
    stores.through_cache(spark, path, asked, fetch, ["identifier"])
    return stores.through_cache(spark, path, known, fetch, ["identifier"]).select("identifier", "status", "cached")


@query("""WITH e AS (SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN 'PMID:' || l_partkey ELSE 'GO:' || l_suppkey END, ',' ORDER BY l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey AS VARCHAR) ELSE CAST(l_suppkey AS VARCHAR) END) FILTER (l_returnflag <> 'N') AS evidence FROM lineitem GROUP BY 1)
SELECT CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS claim_id, CASE WHEN o_orderkey % 50 <> 0 THEN 'order ' || o_orderkey ELSE '' END AS text, CASE WHEN o_orderkey % 50 = 0 THEN 0 WHEN o_custkey % 7 = 0 THEN 1 ELSE 2 END AS n_entities,
CASE WHEN o_orderkey % 50 <> 0 THEN coalesce(evidence, '') ELSE '' END AS evidence, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderstatus END AS expected_decision, o_orderkey % 50 = 0 AS is_broken FROM orders LEFT JOIN e ON l_orderkey = o_orderkey""")
def claims_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested claims in JSON lines, some of them cut off, written and read."""
    one = F.struct(F.col("l_linenumber").alias("no"), F.when(F.col("l_returnflag") == "R", "pubmed").when(F.col("l_returnflag") == "A", "go").otherwise("note").alias("type"), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("GO:"), F.col("l_suppkey"))).alias("id"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")).alias("pmid"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(one)).alias("evidence"))
    claims = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("claim"), F.struct(commerce.named("ORD:", "o_orderkey").alias("curie"), F.lit("order").alias("label")).alias("subject"),
        F.struct(commerce.named("CUST:", "o_custkey").alias("curie"), F.when(F.col("o_custkey") % 7 == 0, "").otherwise("customer").alias("label")).alias("object"), "evidence", F.col("o_orderstatus").alias("expected_decision"),
    )
    text = F.to_json(F.struct(*(c for c in claims.columns if c != "o_orderkey")))
    path = new_folder(spark)
    claims.select(F.when(F.col("o_orderkey") % 50 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value")).write.text(path)
    found = stores.claims_from_json(spark, path)
    return found.select("claim_id", "text", F.size("entities").alias("n_entities"), F.array_join("evidence", ",").alias("evidence"), "expected_decision", F.col("broken").isNotNull().alias("is_broken"))


@query("""SELECT o_orderkey AS claim_id, count(l_orderkey) FILTER (l_returnflag = 'R' AND l_quantity <= 3) > 0 AS failed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the audit as JSON text and back; failed ones are those with a retracted line."""
    found = audit.audit_evidence(commerce.claims(spark, sf_dir), commerce.provenance(spark, sf_dir), commerce.AS_OF_YEAR).select("claim_id", "score", "verdict", "trace", "gate_trace")
    path = new_folder(spark)
    stores.reports_to_json(found).write.parquet(path)
    back = stores.reports_from_json(spark.read.parquet(path), found.schema)
    retracted = F.exists("gate_trace", lambda g: g.startswith("gate:retraction"))
    return back.select("claim_id", ((F.col("verdict") == "FAIL") & retracted).alias("failed"))


@query("""SELECT o_orderpriority AS label, CASE WHEN o_custkey % 3 = 0 THEN 'pubmed' WHEN o_custkey % 3 = 1 THEN 'doi' ELSE 'other' END AS type, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS with_comment FROM orders GROUP BY ALL""")
def feedback_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled claims appended in two batches, each of them twice."""
    kind = F.when(F.col("o_custkey") % 3 == 0, "PMID:").when(F.col("o_custkey") % 3 == 1, "doi:").otherwise("note ")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey")).alias("claim"), F.array(F.concat(kind, F.col("o_custkey")), F.lit(" ")).alias("evidence"), F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderstatus") == "F", "seen").otherwise("").alias("comment")
    )
    path = new_folder(spark)
    for _ in range(2):
        stores.append_feedback(rows.filter("o_orderkey % 2 = 0"), path, "even", "2026-01-01T00:00:00+00:00")
        stores.append_feedback(rows.filter("o_orderkey % 2 = 1"), path, "odd", "2026-01-01T00:00:00+00:00")
    kept = spark.read.schema("expected_decision string, evidence array<struct<type: string>>, metadata struct<comment: string>").json(path)
    one = kept.select(F.col("expected_decision").alias("label"), F.explode("evidence.type").alias("type"), "metadata.comment")
    return one.groupBy("label", "type").agg(F.count("*").alias("n"), F.count("comment").alias("with_comment"))
