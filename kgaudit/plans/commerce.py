"""A knowledge graph and claims over the order tables, on which the catalogue's queries run.

Nodes are CUST, ORD, PART, SUPP, NAT and REG; a claim is an order, its citations are its lines. Each view is a plain
projection, so filters and pruning reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.functions.text import Lexicon
from kgaudit.session import table

AS_OF_YEAR = 2001
CATEGORIES = {"customer": ("CUST:",), "order": ("ORD:",), "part": ("PART:",), "supplier": ("SUPP:",), "nation": ("NAT:",), "region": ("REG:",)}
#: Words that the English documents hold, in the roles of the domain's.
WORDS = Lexicon(positive=("from", "with"), negative=("that", "was"), causal=("from", "that"), association=("and the",), hedges={"of": "of", "to": "to"}, negations=("this",), sections={"results": ("of the",), "conclusion": ("to the",)})


def named(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))


def line_status() -> Column:
    few = F.col("l_quantity") <= 3
    return F.when((F.col("l_returnflag") == "R") & few, "retracted").when((F.col("l_returnflag") == "A") & few, "concern").otherwise("clean")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(claim_id, identifier, status, pub_year)``: the lines of each order."""
    line = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return line.select(F.col("l_orderkey").alias("claim_id"), F.concat(F.lit("LINE:"), key).alias("identifier"), line_status().alias("status"), F.year("l_shipdate").alias("pub_year"))


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """``(subject, predicate, object)``, each once, or as often as lines name it where the operator tells equal ones itself."""
    each = lambda df: df.distinct() if once else df
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    line = t("lineitem")
    parts = [
        edge(t("orders"), named("CUST:", "o_custkey"), "placed", named("ORD:", "o_orderkey")),
        each(edge(line, named("ORD:", "l_orderkey"), "contains", named("PART:", "l_partkey"))),
        each(edge(line, named("PART:", "l_partkey"), "supplied_by", named("SUPP:", "l_suppkey"))),
        edge(t("supplier"), named("SUPP:", "s_suppkey"), "located_in", named("NAT:", "s_nationkey")),
        edge(t("customer"), named("CUST:", "c_custkey"), "located_in", named("NAT:", "c_nationkey")),
        edge(t("nation"), named("NAT:", "n_nationkey"), "part_of", named("REG:", "n_regionkey")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


EDGES_SQL = """edges AS (
  SELECT 'CUST:' || o_custkey AS subject, 'placed' AS predicate, 'ORD:' || o_orderkey AS object FROM orders
  UNION ALL SELECT DISTINCT 'ORD:' || l_orderkey, 'contains', 'PART:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'PART:' || l_partkey, 'supplied_by', 'SUPP:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'SUPP:' || s_suppkey, 'located_in', 'NAT:' || s_nationkey FROM supplier
  UNION ALL SELECT 'CUST:' || c_custkey, 'located_in', 'NAT:' || c_nationkey FROM customer
  UNION ALL SELECT 'NAT:' || n_nationkey, 'part_of', 'REG:' || n_regionkey FROM nation),
steps AS (SELECT subject AS node, object AS next FROM edges UNION SELECT object, subject FROM edges)"""


def supply_edges(spark: SparkSession, sf_dir: str, by_part: bool = False) -> DataFrame:
    """Part-supplier associations with what is known of them, for labels and support; dealt out by part where graphs of parts are made of them."""
    citing = (F.col("l_returnflag") == "N") & (F.col("l_quantity") <= 3)
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.round(F.col("l_discount") * 100).cast("long").alias("points"), (line_status() == "retracted").alias("retracted"), citing.alias("citing"))
    line = line.repartition("l_partkey") if by_part else line
    return line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_sources"), F.sum("points").alias("discount_points"), F.count_if("retracted").alias("n_retracted"), F.count_if("citing").alias("n_citing_retracted"))


def co_order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand in one order, as pairs ``(subject, predicate, object)`` of their keys, one for each order.

    An order has a bounded number of lines, so its pairs are bounded too.
    """
    line = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null")
    parts = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    first = parts.select("parts", F.posexplode("parts").alias("i", "subject"))
    return first.select("subject", F.lit("ordered_with").alias("predicate"), F.explode(F.expr("slice(parts, i + 2, size(parts))")).alias("object"))


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' edges to their regions."""
    return table(spark, sf_dir, "nation").select(named("NAT:", "n_nationkey").alias("subject"), F.lit("part_of").alias("predicate"), named("REG:", "n_regionkey").alias("object"))


def place_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of each nation and the nation five keys on, in a circle."""
    nation = table(spark, sf_dir, "nation")
    following = (F.col("n_nationkey") + 5) % 25
    return nation.select(F.col("n_nationkey").alias("pair_id"), named("NAT:", "n_nationkey").alias("subject"), named("NAT:", following).alias("object"))


PLACES_SQL = """e AS (SELECT 'NAT:' || n_nationkey AS subject, 'part_of' AS predicate, 'REG:' || n_regionkey AS object FROM nation),
steps AS (SELECT subject AS node, object AS next FROM e UNION SELECT object, subject FROM e),
pairs AS (SELECT n_nationkey AS pair_id, 'NAT:' || n_nationkey AS subject, 'NAT:' || ((n_nationkey + 5) % 25) AS object FROM nation)"""
