"""Queries of graph, provenance and rule operators, each over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.operators import claims as cl
from kgaudit.operators import conditions, evidence, graph, learning, nli, rules
from kgaudit.plans import commerce
from kgaudit.plans.catalogue import NLI_SQL, nli_sentences
from kgaudit.plans.registry import query
from kgaudit.session import table

BILLION = lambda c: F.floor(c * 1e9 + 0.5).cast("long")


@query("""SELECT DISTINCT l_partkey AS subject, l_suppkey AS object, 'PMID:' || l_orderkey AS pub_id FROM lineitem WHERE l_returnflag <> 'N'""")
def edge_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: publications of parts' edges to suppliers, from the edges' own sources and from associations."""
    line = table(spark, sf_dir, "lineitem")
    pub = commerce.named("PMID:", "l_orderkey")
    own = line.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("subject"), F.lit("p").alias("predicate"), F.col("l_suppkey").alias("object"), F.array(pub, F.lit("DOI:1")).alias("sources"))
    rest = line.filter("l_returnflag = 'R'").withColumn("association_id", F.concat_ws("-", "l_partkey", "l_suppkey"))
    made = rest.select("association_id", F.col("l_partkey").alias("subject"), F.lit("p").alias("predicate"), F.col("l_suppkey").alias("object")).distinct()
    return graph.edge_publications(own, made, rest.select("association_id", pub.alias("pub_id"))).select("subject", "object", "pub_id")


@query("""WITH a AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity), b AS (SELECT *, l_quantity > 40 AS hit FROM a)
SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (hit), max(l_linenumber)) AS attempt_no, coalesce(arg_min(CAST(l_quantity AS BIGINT), l_linenumber) FILTER (hit), 0) AS n_edges FROM b GROUP BY 1""")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's attempts in turn, the first that finds edges, else the last."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    tries = line.select("l_orderkey", F.col("l_linenumber").alias("attempt_no"), F.when(F.col("q") > 40, F.col("q")).otherwise(0).cast("long").alias("n_edges"))
    return graph.first_hit(tries, "l_orderkey")


@query("""WITH e AS (SELECT l_partkey AS a, l_partkey + l_suppkey AS b, l_returnflag AS predicate FROM lineitem), p AS (SELECT DISTINCT l_partkey AS x, l_partkey + l_suppkey AS y FROM lineitem WHERE l_quantity > 40)
SELECT x, y, predicate, count(*) AS n FROM p JOIN e ON a = x AND b = y OR a = y AND b = x AND x <> y GROUP BY ALL""")
def edges_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known edges between both ends of a pair, whichever way they point."""
    line = table(spark, sf_dir, "lineitem")
    edges = line.select(F.col("l_partkey").alias("subject"), F.expr("l_partkey + l_suppkey").alias("object"), F.col("l_returnflag").alias("predicate"))
    pairs = line.filter("l_quantity > 40").select(F.col("l_partkey").alias("object"), F.expr("l_partkey + l_suppkey").alias("subject")).distinct()
    found = graph.either_way(pairs.withColumn("pair_id", F.struct(F.col("object").alias("x"), F.col("subject").alias("y"))), edges)
    return found.groupBy("pair_id.x", "pair_id.y", "predicate").agg(F.count("*").alias("n"))


_CITES = "c AS (SELECT DISTINCT 'PMID:' || l_partkey AS s, 'PMID:' || l_suppkey AS o FROM lineitem), u AS (SELECT s AS node, o AS next FROM c WHERE s <> o UNION SELECT o, s FROM c WHERE s <> o)"


@query(f"""WITH {_CITES}, d AS (SELECT s_suppkey AS request_id, 'PMID:' || s_suppkey AS node, 0 AS dist FROM supplier UNION ALL SELECT s_suppkey, next, 1 FROM supplier JOIN u ON node = 'PMID:' || s_suppkey),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY dist, node) AS r FROM d) WHERE r <= 100),
e AS (SELECT x.request_id, s, o FROM c JOIN n x ON x.node = s JOIN n y ON y.node = o AND y.request_id = x.request_id), k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s, o) AS r FROM e)
SELECT request_id, s AS subject, o AS object FROM k WHERE r <= 200""")
def citation_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations among the first hundred publications around each seed, at most two hundred, as the report shows them."""
    cites = table(spark, sf_dir, "lineitem").select(commerce.named("PMID:", "l_partkey").alias("subject"), commerce.named("PMID:", "l_suppkey").alias("object")).distinct()
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"), commerce.named("PMID:", "s_suppkey").alias("node"))
    return graph.citation_subgraph(seeds, cites)[1].select("request_id", "subject", "object")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_tax, [l_tax, -l_discount, 0.0] AS w, l_returnflag = 'R' AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, 2 AS n_sources, CASE WHEN r THEN 2 ELSE 1 END AS n_pmids, 1.0::DOUBLE AS confidence, CASE WHEN l_tax > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS has_retracted_support, CAST(floor(1e9 * (w[1] + w[2] + w[3]) + 0.5) AS BIGINT) AS rule_sum,
CAST(floor(1e9 * (w[1] - w[2]) + 0.5) AS BIGINT) AS rule_abs_sum, CAST(floor(1e9 * w[1] + 0.5) AS BIGINT) AS rule_positive_sum, CAST(floor(1e9 * w[2] + 0.5) AS BIGINT) AS rule_negative_sum, (w[1] <> 0)::INT + (w[2] <> 0)::INT AS rule_nonzero_count,
CAST(floor(1e9 * greatest(w[1], 0) + 0.5) AS BIGINT) AS rule_max, CAST(floor(1e9 * least(w[2], 0) + 0.5) AS BIGINT) AS rule_min FROM e""")
def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of what edges lack, and sums of their rules' features."""
    line = table(spark, sf_dir, "lineitem").withColumns({"sources": F.expr("if(l_returnflag = 'R', array('PMID:1', 'pmid:2'), array('PMID:1', 'GO:1'))"), "retracted_support_ratio": F.col("l_tax"), "weights": F.create_map(F.lit("a"), F.col("l_tax"), F.lit("b"), -F.col("l_discount"), F.lit("c"), F.lit(0.0))})
    told = graph.edge_defaults(line).withColumns(graph.rule_aggregates(F.col("weights")))
    whole = ("rule_sum", "rule_abs_sum", "rule_positive_sum", "rule_negative_sum", "rule_max", "rule_min")
    return told.select("l_orderkey", "l_linenumber", "l_partkey", "n_sources", "n_pmids", "confidence", "has_retracted_support", *(BILLION(F.col(c)).alias(c) for c in whole), "rule_nonzero_count")


@query("""WITH c AS (SELECT DISTINCT l_orderkey % 2000 AS a, l_partkey AS b FROM lineitem), n AS (SELECT a, count(*) AS n FROM c GROUP BY 1)
SELECT p_partkey AS pub_id, CASE WHEN p_size = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS is_retracted, CAST(floor(1e9 * coalesce(CASE WHEN p_size < 9 THEN p_size END, 0) / greatest(coalesce(n, 1), 1) + 0.5) AS BIGINT) AS ratio, CAST(floor(1e9 * ln(1 + coalesce(CASE WHEN p_size < 9 THEN p_size END, 0)) + 0.5) AS BIGINT) AS log_count FROM part LEFT JOIN n ON a = p_partkey""")
def publication_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    pubs = table(spark, sf_dir, "part").selectExpr("p_partkey as pub_id", "p_size = 1 as retracted", "if(p_size < 9, p_size, null) as cites_retracted_count")
    cites = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 2000 as citing", "l_partkey as cited")
    found = graph.publication_features(pubs, cites)
    return found.select("pub_id", "is_retracted", BILLION(F.col("retracted_citation_ratio")).alias("ratio"), BILLION(F.col("cites_retracted_log")).alias("log_count"))


@query("""WITH e AS (SELECT l_orderkey AS pair_id, l_shipdate, l_partkey, 'PART ' || l_partkey % 3 AS label, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS ord, l_linenumber = 1 AS claim, l_returnflag = 'R' AS path, l_returnflag = 'A' AS touches, l_quantity > 45 AS flagged, l_tax * 10 AS s FROM lineitem),
k AS (SELECT pair_id, label, ord, CASE WHEN claim THEN 1000.0 ELSE 0 END + CASE WHEN flagged THEN 1000.0 ELSE 0 END + CASE WHEN s > 0 THEN 500.0 + 100.0 * s ELSE 0 END + CASE WHEN path THEN 100.0 ELSE 0 END + CASE WHEN touches THEN 50.0 ELSE 0 END AS score FROM e),
l AS (SELECT pair_id, label, arg_max(score, ord) AS score FROM k GROUP BY 1, 2) SELECT pair_id, label, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score_millionths, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, label) AS INT) AS rank FROM l""")
def edge_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each pair for choice, the last of equal labels."""
    line = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as pair_id", "concat('PART ', l_partkey % 3) as label", "l_partkey * 1000000 + l_suppkey * 100 + l_linenumber as ord", "l_linenumber = 1 as is_claim_edge", "l_returnflag = 'R' as on_path", "l_returnflag = 'A' as touches_endpoint", "l_quantity > 45 as flagged", "l_tax * 10 as suspicion",
        "false as touches_evidence", "false as shares_source",
    )
    return graph.ranked_options(line).select("pair_id", "label", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_millionths"), "rank")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_tax * 15 - 0.1, 0), 1) AS s FROM lineitem), c AS (SELECT *, CASE WHEN s < 0.5 THEN 510 * s ELSE 255 END AS r, CASE WHEN s < 0.5 THEN 255 ELSE 510 * (1 - s) END AS g FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, '#' || upper(printf('%02x', CAST(round(r) AS INT))) || upper(printf('%02x', CAST(round(g) AS INT))) || '00' AS colour FROM c""")
def edge_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", graph.suspicion_colour(F.col("l_tax") * 15 - 0.1).alias("colour"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS claim_id, l_partkey, l_partkey % 4 AS k FROM lineitem)
SELECT claim_id, CASE k WHEN 0 THEN 'PMID:' || l_partkey WHEN 1 THEN '10.1/retract' || l_partkey WHEN 2 THEN 'GO:' || l_partkey ELSE 'PMC' || l_partkey END AS identifier,
CASE WHEN k = 2 THEN 'clean' WHEN p_size = 50 THEN 'retracted' WHEN k = 0 THEN CASE WHEN p_size < 10 THEN 'concern' ELSE 'clean' END WHEN k = 1 THEN 'retracted' ELSE 'clean' END AS status, CASE WHEN k = 2 THEN 'other' WHEN k = 0 THEN 'cache' ELSE 'heuristic' END AS source FROM c JOIN part ON p_partkey = l_partkey""")
def provenance_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every order, by what was fetched, by what identifiers say, and by notices, which override."""
    name = "element_at(array(concat('PMID:', {0}), concat('10.1/retract', {0}), concat('GO:', {0}), concat('PMC', {0})), cast({0} % 4 + 1 as int))"
    line = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as claim_id", f"{name.format('l_partkey')} as identifier")
    cited = evidence.claim_citations(line.groupBy("claim_id").agg(F.collect_list(F.concat(F.lit(" "), "identifier")).alias("citations")))
    part = table(spark, sf_dir, "part")
    known = part.filter("p_partkey % 4 = 0").selectExpr("concat('PMID:', p_partkey) as identifier", "if(p_size < 10, 'concern', 'clean') as status")
    notices = part.selectExpr(f"{name.format('p_partkey')} as identifier", "if(p_size = 50, 'retracted', 'correction') as notice_status")
    return evidence.provenance(cited, known, notices).select("claim_id", "identifier", "status", "source")


@query(f"""WITH {NLI_SQL}, k AS (SELECT lang, label, doc_id, ord, row_number() OVER (PARTITION BY lang, label ORDER BY doc_id, ord) AS r FROM wt JOIN documents USING (doc_id)) SELECT lang, label, CAST(r AS INT) AS rank, doc_id AS paper_id FROM k WHERE r <= 3""")
def sentence_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the first three sentences of each label, a language as a claim, as the report shows them."""
    lang = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("claim_id"))
    rows = nli_sentences(spark, sf_dir).join(lang, "doc_id").withColumnRenamed("doc_id", "paper_id").withColumn("sentence", F.col("section"))
    return nli.examples(rows).select(F.col("claim_id").alias("lang"), "label", "rank", "paper_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' pieces, flag ' || l_returnflag || ', tax ' || printf('%.2f', l_tax) AS because FROM lineitem""")
def because_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations with facts filled in."""
    facts = F.struct(F.struct(F.col("l_quantity").cast("int").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("tax")).alias("f"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", facts.alias("facts"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", conditions.template(rows.schema["facts"].dataType, "{f.n} pieces, flag {f.flag}, tax {f.tax:.2f}").alias("because"))


RIVALS = (
    rules.Rule("bulk", 0.5, rules.all_of(("f.n", "gte", 20)), "many", rebuts=("returned",)), rules.Rule("returned", -1.0, rules.all_of(("f.flag", "equals", "R")), "returned", rebuts=("bulk",)),
    rules.Rule("taxed", 0.25, rules.all_of(("f.tax", "gt", 0.04)), "taxed", defeats=("returned",)), rules.Rule("plain", 0.125, rules.all_of(("f.n", "exists")), "always"),
)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity >= 20 AS b, l_returnflag = 'R' AS r, l_tax > 0.04 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT b THEN 'none' WHEN r AND NOT t THEN 'UNDECIDED' ELSE 'IN' END AS bulk, CASE WHEN NOT r THEN 'none' WHEN t THEN 'OUT' WHEN b THEN 'UNDECIDED' ELSE 'IN' END AS returned,
0.125 + CASE WHEN t THEN 0.25 ELSE 0 END + CASE WHEN b THEN 0.5 ELSE 0 END + CASE WHEN r AND NOT t THEN -1.0 ELSE 0 END::DOUBLE AS score FROM l""")
def rival_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that attack each other stay undecided, unless a third defeats one; what is undecided keeps its weight."""
    if not rules.has_defeasible_parts(RIVALS):
        raise ValueError("the rules attack each other")
    facts = F.struct(F.struct(F.col("l_quantity").cast("int").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("tax")).alias("f"))
    found = rules.evaluate(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", facts.alias("facts")), RIVALS)
    label = lambda r: F.coalesce(F.get(F.filter("trace", lambda t: t["rule_id"] == r), F.lit(0))["label"], F.lit("none")).alias(r)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", label("bulk"), label("returned"), "score")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'refute' WHEN '2-HIGH' THEN 'support' WHEN '3-MEDIUM' THEN 'refute' ELSE 'neutral' END AS stance, CASE WHEN o_orderstatus = 'F' THEN CAST(year(o_orderdate) AS INT) END AS year_read FROM orders""")
def stances_and_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence says of a claim, and years of dates, null where a date begins with none within bounds."""
    order = table(spark, sf_dir, "orders")
    text = F.expr("case o_orderpriority when '1-URGENT' then ' Refutes it' when '2-HIGH' then 'SUPPORTS it' when '3-MEDIUM' then 'contradicts' when '4-NOT SPECIFIED' then 'it supports' end")
    date = F.expr("case o_orderstatus when 'F' then date_format(o_orderdate, 'yyyy-MM') when 'O' then '1612-01' else 'in 1999' end")
    return order.select("o_orderkey", F.coalesce(cl.stance(text), F.lit("neutral")).alias("stance"), evidence.year_of(date, 2001).alias("year_read"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS p, l_tax * 12.5 AS q FROM lineitem), b AS (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS c FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(1e6 / (1 + exp(-(1.5 * ln(c / (1 - c)) - 0.25))) + 0.5) AS BIGINT) AS platt, CAST(floor(1e6 * CASE WHEN q <= 0.125 THEN 0.0 WHEN q <= 0.5 THEN 0.5 * (q - 0.125) / 0.375 WHEN q <= 0.75 THEN 0.5 + 0.25 * (q - 0.5) / 0.25 ELSE 0.75 END + 0.5) AS BIGINT) AS isotonic FROM b""")
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML19-ML21: both calibrations at given parameters."""
    line = table(spark, sf_dir, "lineitem")
    millionths = lambda c: F.floor(c * 1e6 + 0.5).cast("long")
    platt, steps = learning.apply_platt(F.col("l_discount") * 10, 1.5, -0.25), learning.apply_isotonic(F.col("l_tax") * 12.5, [0.125, 0.5, 0.75], [0.0, 0.5, 0.75])
    return line.select("l_orderkey", "l_linenumber", "l_partkey", millionths(platt).alias("platt"), millionths(steps).alias("isotonic"))


@query("""WITH k AS (SELECT l_orderkey AS claim_id, l_partkey, arg_max(l_returnflag, l_suppkey * 8 + l_linenumber) AS status FROM (SELECT DISTINCT ON (l_orderkey, l_partkey, l_suppkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag DESC) WHERE l_partkey % 3 <> 0 GROUP BY 1, 2),
e AS (SELECT DISTINCT l_orderkey AS claim_id, l_partkey FROM lineitem)
SELECT e.claim_id, e.l_partkey AS edge, 0 AS no, 'PMID:' || e.l_partkey AS identifier, 'pmid' AS source_type, coalesce(status, 'unknown') AS status FROM e LEFT JOIN k ON k.claim_id = e.claim_id AND k.l_partkey = e.l_partkey
UNION ALL SELECT claim_id, l_partkey, 1, '10.5/X' || l_partkey, 'doi', 'unknown' FROM e UNION ALL SELECT claim_id, l_partkey, 2, 'GO:' || l_partkey, 'go', 'unknown' FROM e""")
def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each claim's edges with kind and the last known status, in several spellings."""
    line = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    edges = line.select(F.col("l_orderkey").alias("claim_id"), part.alias("edge")).distinct()
    edges = edges.withColumn("sources", F.array(F.concat(F.lit("pmid: "), "edge"), F.concat(F.lit("https://doi.org/10.5/X"), "edge"), F.concat(F.lit("GO:"), "edge")))
    order = F.struct(F.expr("l_suppkey * 8 + l_linenumber"), F.col("l_returnflag"))
    known = line.filter("l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("claim_id"), part.cast("string").alias("identifier"), F.col("l_returnflag").alias("status"), order.alias("ord"))
    return evidence.source_references(edges, known, ["claim_id", "edge"])
