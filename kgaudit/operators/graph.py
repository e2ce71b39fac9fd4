"""Knowledge-graph queries, batched by request or pair.

Edges are ``(subject, predicate, object, …)``, a multigraph. A query is a table of requests that is joined with the
edges, so a thousand requests cost one plan. Hops are a fixed number of joins with lists of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgaudit.session import written

STRUCTURAL = ("SUBJECT_OF", "OBJECT_OF", "SUPPORTED_BY", "CITES")


def nodes_of(edges: DataFrame) -> DataFrame:
    """Nodes that the edges name, with the first label in edge order."""
    ends = edges.select(F.col("subject").alias("id"), F.col("subject_label").alias("label"), "ord").union(edges.select("object", "object_label", "ord"))
    return ends.groupBy("id").agg(F.min_by("label", "ord").alias("label"))


def query_edges(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from subject to object of each request ``(request_id, subject, object, predicate)``; a null predicate takes any (K1, K2)."""
    wanted = requests.withColumnRenamed("predicate", "wanted")
    return edges.join(wanted, ["subject", "object"]).filter(F.col("wanted").isNull() | (F.col("wanted") == F.col("predicate"))).drop("wanted")


def either_way(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between the two ends of each pair, in both directions."""
    keyed = edges.withColumns({"_low": F.least("subject", "object"), "_high": F.greatest("subject", "object")})
    wanted = pairs.select("pair_id", F.least("subject", "object").alias("_low"), F.greatest("subject", "object").alias("_high"))
    return keyed.join(wanted, ["_low", "_high"]).drop("_low", "_high")


def support_ratios(associations: DataFrame, support: DataFrame, publications: DataFrame) -> DataFrame:
    """Publications of each reified association and the shares of retracted ones and of those that cite retracted ones.

    Associations are ``(association_id, …)``, support ``(association_id, pub_id)``, publications
    ``(pub_id, retracted, cites_retracted_count)``. A share of zero is null, as if it weren't known.
    """
    told = support.dropDuplicates(["association_id", "pub_id"]).join(publications, "pub_id")
    counted = told.groupBy("association_id").agg(
        F.count("*").alias("n_publications"), F.count_if("retracted").alias("n_retracted"), F.count_if(F.col("cites_retracted_count") > 0).alias("n_citing_retracted")
    )
    share = lambda c: F.when(F.col(c) > 0, F.col(c) / F.col("n_publications"))
    out = associations.join(counted, "association_id", "left").na.fill(0, ["n_publications", "n_retracted", "n_citing_retracted"])
    return out.withColumns({"retracted_support_ratio": share("n_retracted"), "citing_retracted_ratio": share("n_citing_retracted")})


def steps_of(edges: DataFrame, direction: str = "both") -> DataFrame:
    """``(node, next)`` steps, as often as edges make them."""
    out = edges.select(F.col("subject").alias("node"), F.col("object").alias("next"))
    back = edges.select(F.col("object").alias("node"), F.col("subject").alias("next"))
    found = {"outgoing": out, "incoming": back}.get(direction)
    return (out.union(back) if found is None else found).filter("node <> next")


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Distinct ``(node, next)`` steps."""
    return steps_of(edges, direction).distinct()


#: Steps in one list, so that a hub has many lists.
LISTED = 1000


#: Names of a namespace and a number that fits an int, written as numbers are.
NUMBERED = r"\A[^:]*:(0|[1-9][0-9]{0,8})\z"


def packed(steps: DataFrame, *more: str) -> DataFrame:
    """``(node, more…, prefix, base, lows, wide, names)``: the distinct steps of each node in lists of at most ``LISTED``, dealt out by node.

    Numbered names of a namespace are a list of what their numbers exceed ``base`` by, in ``lows`` where that fits two
    bytes and else in ``wide``; other names are in ``names``. ``unpacked`` takes them apart.
    """
    told = F.col("next").rlike(NUMBERED)
    prefix, number = F.when(told, F.concat(F.substring_index("next", ":", 1), F.lit(":"))), F.when(told, F.substring_index("next", ":", -1).cast("int"))
    distinct = steps.select("node", *more, prefix.alias("prefix"), number.alias("number"), F.when(~told, F.col("next")).alias("name")).repartition("node").distinct()
    chunk = F.floor((F.row_number().over(W.partitionBy("node", *more, "prefix").orderBy("number", "name")) - 1) / LISTED)
    lists = distinct.withColumn("_chunk", chunk).groupBy("node", *more, "prefix", "_chunk").agg(F.min("number").alias("base"), F.max("number").alias("_top"), F.collect_list("number").alias("_n"), F.collect_list("name").alias("_names"))
    offsets = lambda kind: F.transform("_n", lambda n: (n - F.col("base")).cast(kind))
    near = F.col("_top") - F.col("base") < 1 << 15
    return lists.select("node", *more, "prefix", "base", F.when(near, offsets("smallint")).alias("lows"), F.when(~near, offsets("int")).alias("wide"), F.when(F.col("prefix").isNull(), F.col("_names")).alias("names"))


PACKED = ("prefix", "base", "lows", "wide", "names")


def alone(node: str = "node") -> list[Column]:
    """A node as a list of its own, in the columns of ``packed``."""
    told, kinds = F.col(node).rlike(NUMBERED), {"lows": "array<smallint>", "wide": "array<int>"}
    prefix, number = F.when(told, F.concat(F.substring_index(node, ":", 1), F.lit(":"))), F.when(told, F.substring_index(node, ":", -1).cast("int"))
    zero = F.when(told, F.array(F.lit(0).cast("smallint")))
    return [prefix.alias("prefix"), number.alias("base"), zero.alias("lows"), F.lit(None).cast(kinds["wide"]).alias("wide"), F.when(F.coalesce(~told, F.lit(True)), F.array(node)).alias("names")]


def unpacked(rows: DataFrame, *columns: str) -> DataFrame:
    """``(columns…, prefix, number)`` of each node in lists of ``packed``; ``whole_name`` gives its name. Names without a number are prefixes."""
    places = F.when(F.col("prefix").isNull(), F.sequence(F.lit(0), F.size("names") - 1)).otherwise(F.coalesce("wide", F.col("lows").cast("array<int>")))
    each = rows.select(*columns, "prefix", "base", "names", F.explode(places).alias("_i"))
    return each.select(*columns, F.coalesce("prefix", F.get("names", F.col("_i"))).alias("prefix"), (F.col("base") + F.col("_i")).alias("number"))


def whole_name() -> Column:
    return F.coalesce(F.concat("prefix", F.col("number").cast("string")), F.col("prefix"))


def reached(starts: DataFrame, steps: DataFrame, hops: int, key: str = "request_id") -> list[DataFrame]:
    """What ``distances`` gives for 0, 1, … hops.

    A hop is one join with packed lists of steps, of the namespaces that it starts from, and one shuffle of these by key.
    Lists are taken apart behind it, so no row for a node that is reached travels. All but the last hop are written.
    """
    states = [starts.select(key, "node", F.lit(0).alias("dist"), F.lit(1).cast("long").alias("paths")).dropDuplicates([key, "node"])]
    default = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for hop in range(1, hops + 1):
        before, parts = states[-1], ()
        if hop > 1:  # what is reached grows with what was
            n = before.count()
            parts = (n // 100_000,) if n // 100_000 > default else ()
        front = before.filter(F.col("dist") == hop - 1)
        lists = packed(steps.filter(within(namespaces(F.col("node"), starts if hop == 1 else front), "node")))
        moved = front.join(lists, "node").select(key, F.lit(hop).alias("dist"), "paths", *PACKED)
        both = before.select(key, "dist", "paths", *alone()).union(moved).repartition(*parts, key)
        new = F.col("dist") == hop
        merged = unpacked(both, key, "dist", "paths").groupBy(key, "prefix", "number")
        state = merged.agg(F.min("dist").alias("dist"), F.sum(F.when(~new, F.col("paths"))).alias("_old"), F.sum(F.when(new, F.col("paths"))).alias("_new"))
        state = state.select(key, whole_name().alias("node"), "dist", F.coalesce("_old", "_new").alias("paths"))
        states.append(written(state) if hop < hops else state)
    return states


def distances(starts: DataFrame, steps: DataFrame, hops: int, key: str = "request_id") -> DataFrame:
    """``(key, node, dist, paths)``: nodes within some hops of each start, and the number of shortest paths."""
    return reached(starts, steps, hops, key)[-1]


def namespaces(nodes: Column, rows: DataFrame, most: int = 100) -> list[str] | None:
    """What stands before the first colon in the nodes of some rows; none if there are more than ``most`` such."""
    found = rows.select(F.substring_index(nodes, ":", 1).alias("n")).filter("n is not null").distinct().limit(most + 1).collect()
    return [r["n"] for r in found] if len(found) <= most else None


def within(names: list[str] | None, node: str) -> Column:
    """Whether a node's namespace is one of ``namespaces``; nodes of others are equal to none of the rows'."""
    return F.col(node).isNotNull() if names is None else F.coalesce(F.substring_index(node, ":", 1).isin(names), F.lit(False))


def edges_around(expanded: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """The edges at each request's nodes ``(request_id, node)``, once for a request even if both ends are such nodes.

    Only edges with an end in a namespace of these nodes are joined. One that comes by its object is looked up by its
    subject if that may be such a node; the others are known to come once.
    """
    names = namespaces(F.col("node"), expanded)
    out = expanded.join(edges.filter(within(names, "subject")), F.col("node") == F.col("subject")).drop("node")
    if direction == "outgoing":
        return out
    back = lambda rows: expanded.join(rows.filter(within(names, "object")), F.col("node") == F.col("object")).drop("node")
    if direction == "incoming":
        return back(edges)
    twice = back(edges.filter(within(names, "subject"))).join(expanded.withColumnRenamed("node", "subject"), ["request_id", "subject"], "left_anti")
    return out.unionByName(back(edges.filter(~within(names, "subject")))).unionByName(twice)


def ego(requests: DataFrame, edges: DataFrame, hops: int, direction: str = "both", per_node: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges within some hops of each request's ``node``.

    Of edges that are equal in both ends and predicate the first stays, by their column ``ord`` (see ``first_of_equal``).
    ``per_node`` caps the neighbours that each node is expanded by, in the order of their names (K5).
    """
    steps = steps_of(edges, direction)
    if per_node:
        steps = steps.distinct().withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy("next"))).filter(F.col("_r") <= per_node).drop("_r")
    states = reached(requests, steps, hops)
    expanded = states[-2] if hops > 0 else states[0].filter("false")
    found = edges_around(expanded.select("request_id", "node"), first_of_equal(edges, ["subject", "predicate", "object"]), direction)
    return states[-1], found.select("request_id", *edges.columns)


def first_of_equal(edges: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """One edge for each key: the first in the column ``order``, else the one whose other columns are smallest.

    The whole row comes from one edge. Without an order column, the other columns are to be comparable.
    """
    rest = [c for c in edges.columns if c not in key]
    if not rest:
        return edges.distinct()
    tie = [c for c in rest if c == order or not edges.schema[c].dataType.simpleString().startswith("map")]
    tie.sort(key=lambda c: c != order)
    if len(tie) == len(rest):
        first = F.min(F.struct(*tie))
    else:
        first = F.min_by(F.struct(*rest), F.struct(*tie))
    found = edges.repartition(*key).groupBy(*key).agg(first.alias("_first"))  # rows differ mostly, so none are merged before the shuffle
    return found.select(*(F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in edges.columns))


def capped(rows: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    """At most so many rows of each key, in a stated order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def degrees(edges: DataFrame, key: str | None = None) -> DataFrame:
    """In- and out-degree of every node, each edge of the multigraph counted."""
    keys = [key] if key else []
    ends = edges.select(*keys, F.col("subject").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(*keys, "object", F.lit(0), F.lit(1)))
    return ends.groupBy(*keys, "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def clustering(edges: DataFrame, most_degree: int = 100) -> DataFrame:
    """Local clustering coefficient in the simple undirected graph; 0 below degree 2 and above ``most_degree``.

    Only wedges whose centre is within the bounds are made, and each once, so that hubs make none. They travel as lists:
    one of a centre's neighbours, and those after it by degree and name, which it meets among its own neighbours
    of larger degree. A node has no more of those than the root of twice the edges, so no list is longer.
    """
    distinct = edges.filter("subject <> object").select(F.least("subject", "object").alias("x"), F.greatest("subject", "object").alias("y")).distinct()
    pairs = written(distinct)
    degree = written(pairs.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("d")))
    side = lambda c: degree.select(F.col("node").alias(c), F.struct("d", "node").alias(f"_{c}"))
    placed = written(pairs.join(side("x"), "x").join(side("y"), "y").select(F.least("_x", "_y").alias("low"), F.greatest("_x", "_y").alias("high")))
    above = placed.groupBy(F.col("low.node").alias("x")).agg(F.collect_list("high.node").alias("above"))
    ends = placed.select(F.explode(F.array(F.struct(F.col("low").alias("c"), F.col("high").alias("n")), F.struct(F.col("high").alias("c"), F.col("low").alias("n")))).alias("e"))
    inside = ends.filter((F.col("e.c.d") >= 2) & (F.col("e.c.d") <= most_degree)).groupBy(F.col("e.c.node").alias("node")).agg(F.array_sort(F.collect_list("e.n"))["node"].alias("around"))
    wedges = inside.select("node", "around", F.posexplode("around").alias("i", "x")).select("node", "x", F.expr("slice(around, i + 2, size(around))").alias("after")).filter(F.size("after") > 0)
    closed = wedges.join(above.hint("shuffle_hash"), "x").groupBy("node").agg(F.sum(F.size(F.array_intersect("after", "above"))).alias("t"))
    found = degree.join(closed, "node", "left")
    fits = (F.col("d") >= 2) & (F.col("d") <= most_degree)
    return found.select("node", F.col("d").alias("simple_degree"), F.when(fits, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def weight_at_nodes(edges: DataFrame, weight: Column) -> DataFrame:
    """Sum and number of the edges' weights at both of their ends."""
    weighted = edges.withColumn("_w", F.coalesce(weight.try_cast("double"), F.lit(1.0)))
    ends = weighted.select(F.explode(F.array("subject", "object")).alias("node"), "_w")
    return ends.groupBy("node").agg(F.sum("_w").alias("weight_sum"), F.count("*").alias("weight_count"))


def pair_distances(pairs: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Nodes of each pair ``(pair_id, subject, object)`` with distance from both ends and shortest paths through them."""
    steps = neighbours(edges)
    side = lambda c, d, n: distances(pairs.select("pair_id", F.col(c).alias("node")), steps, hops, "pair_id").withColumnsRenamed({"dist": d, "paths": n})
    both = side("subject", "dist_s", "paths_s").join(side("object", "dist_o", "paths_o"), ["pair_id", "node"], "full")
    apart = both.join(pairs.select("pair_id", F.col("object").alias("node")), ["pair_id", "node"]).select("pair_id", F.col("dist_s").alias("apart"))
    out = both.join(apart, "pair_id", "left")
    on_path = F.col("dist_s") + F.col("dist_o") == F.col("apart")
    return out.withColumn("paths_on_shortest", F.when(on_path, F.col("paths_s") * F.col("paths_o")).otherwise(F.lit(0).cast("long")))


def edges_on_shortest_paths(pairs: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Edges of each pair that lie on a shortest path, in either orientation."""
    far = pair_distances(pairs, edges, hops)
    u = far.select("pair_id", F.col("node").alias("subject"), F.col("dist_s").alias("us"), F.col("dist_o").alias("uo"), "apart")
    v = far.select("pair_id", F.col("node").alias("object"), F.col("dist_s").alias("vs"), F.col("dist_o").alias("vo"))
    placed = u.join(edges, "subject").join(v, ["pair_id", "object"])
    on = (F.col("us") + 1 + F.col("vo") == F.col("apart")) | (F.col("vs") + 1 + F.col("uo") == F.col("apart"))
    return placed.filter(on).select("pair_id", *edges.columns)


def hops_to(starts: DataFrame, steps: DataFrame, goals: DataFrame, hops: int) -> DataFrame:
    """``(request_id, hops)`` from each start ``(request_id, node)`` to the nearest of the ``goals`` ``(node)``; null beyond ``hops``.

    The search goes back from the goals, for all starts at once: a hop finds nodes, not nodes of each start.
    """
    level = goals.select("node").distinct()
    near = level.withColumn("hops", F.lit(0))
    for hop in range(1, hops + 1):
        before = steps.join(level.select(F.col("node").alias("next")), "next", "left_semi").select("node").distinct()
        level = written(before.join(near, "node", "left_anti"))
        near = near.union(level.withColumn("hops", F.lit(hop)))
    found = starts.join(near, "node").groupBy("request_id").agg(F.min("hops").alias("hops"))
    return starts.select("request_id").distinct().join(found, "request_id", "left")


def hops_to_category(starts: DataFrame, edges: DataFrame, categories: DataFrame, category: str, hops: int) -> DataFrame:
    """Hops from each start to the nearest node ``(node, category)`` of a category; null beyond ``hops``.

    A path between two ends that touches such a node is ``subgraph.hops_through``.
    """
    return hops_to(starts, steps_of(edges), categories.filter(F.col("category") == category), hops)


def edge_defaults(edges: DataFrame) -> DataFrame:
    """Edge features with the defaults of what is missing."""
    n = lambda c, prefix: F.size(F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.upper(s).startswith(prefix)))
    have = lambda c, other: F.coalesce(F.col(c), other) if c in edges.columns else other
    return edges.withColumns(
        {
            "n_sources": have("n_sources", F.size(F.coalesce("sources", F.array().cast("array<string>")))),
            "n_pmids": have("n_pmids", n("sources", "PMID")),
            "confidence": have("confidence", F.lit(1.0)),
            "evidence_age": have("evidence_age", F.lit(0.0)),
            "has_retracted_support": (have("retracted_support_ratio", F.lit(0.0)) > 0).cast("double"),
            "is_perturbed_edge": have("is_perturbed_edge", F.lit(0.0)),
        }
    )


def rule_aggregates(features: Column) -> dict[str, Column]:
    """Sums, counts and bounds of a map of rule features."""
    values = F.map_values(features)
    total = lambda f: F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))
    return {
        "rule_sum": total(lambda x: x),
        "rule_abs_sum": total(F.abs),
        "rule_positive_sum": total(lambda x: F.greatest(x, F.lit(0.0))),
        "rule_negative_sum": total(lambda x: F.least(x, F.lit(0.0))),
        "rule_nonzero_count": F.size(F.filter(values, lambda x: x != 0)),
        "rule_max": F.coalesce(F.array_max(values), F.lit(0.0)),
        "rule_min": F.coalesce(F.array_min(values), F.lit(0.0)),
    }


def relevance(suspicion_at: float = 0.5) -> Column:
    """Points of an edge for being shown (G15); boolean columns say what it is."""
    c = lambda name, points: F.when(F.col(name), points).otherwise(0.0)
    suspicion = F.coalesce("suspicion", F.lit(0.0))
    return (
        c("is_claim_edge", 100.0) + c("on_path", 50.0) + c("touches_evidence", 30.0) + c("shares_source", 20.0)
        + F.when(suspicion >= suspicion_at, 25.0 + 10.0 * suspicion).otherwise(0.0)
        + c("touches_endpoint", 10.0) + F.when(F.col("rule_sum") < 0, 15.0).otherwise(0.0) + c("flagged", 100.0)
    )


def focus_edges(edges: DataFrame, most: int, suspicion_at: float = 0.5) -> DataFrame:
    """The most relevant edges of each pair, ties in their given order ``ord``."""
    scored = edges.withColumn("relevance", relevance(suspicion_at)).filter("relevance > 0")
    return capped(scored, ["pair_id"], [F.col("relevance").desc(), "ord"], most)


def citation_subgraph(seeds: DataFrame, cites: DataFrame, most_nodes: int = 100, most_edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """Publications one citation away from the seeds ``(request_id, node)``, and the citations among them."""
    near = distances(seeds, neighbours(cites), 1)
    nodes = capped(near, ["request_id"], ["dist", "node"], most_nodes)
    ends = lambda c: nodes.select("request_id", F.col("node").alias(c))
    among = cites.join(ends("subject"), "subject").join(ends("object"), ["request_id", "object"])
    return nodes, capped(among, ["request_id"], ["subject", "object"], most_edges)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str, first_wins: bool = False) -> DataFrame:
    """Rows of both tables, one for each key: the last by ``order``, or the first."""
    rows = old.unionByName(new, allowMissingColumns=True)
    by = F.col(order).asc() if first_wins else F.col(order).desc()
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(by))).filter("_r = 1").drop("_r")


def literature_triples(predications: DataFrame) -> DataFrame:
    """Extracted triples with their publications, each once (K9, K10); rows with a null part drop out."""
    whole = predications.dropna(subset=["subject", "predicate", "object"])
    return whole.groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_set("pmid")).alias("sources"), F.count("*").alias("mentions"))


def first_hit(attempts: DataFrame, key: str) -> DataFrame:
    """Of ordered attempts ``(key, attempt_no, n_edges)``, the first with edges, else the last."""
    rank = F.when(F.col("n_edges") > 0, F.col("attempt_no")).otherwise(F.lit(1_000_000) - F.col("attempt_no"))
    return attempts.groupBy(key).agg(F.min_by("attempt_no", rank).alias("attempt_no"), F.min_by("n_edges", rank).alias("n_edges"))


def edge_publications(direct: DataFrame, associations: DataFrame, support: DataFrame) -> DataFrame:
    """Distinct publications of each ``(subject, predicate, object)``, from edges' own sources and from associations (K8)."""
    own = direct.select("subject", "predicate", "object", F.explode("sources").alias("pub_id")).filter(F.upper("pub_id").startswith("PMID:"))
    reified = associations.join(support, "association_id").select("subject", "predicate", "object", "pub_id")
    return own.union(reified).distinct()


def retracted_support(associations: DataFrame, support: DataFrame, publications: DataFrame) -> DataFrame:
    """Associations with their retracted publications, sorted."""
    gone = publications.filter("retracted").select("pub_id")
    hits = support.join(gone, "pub_id", "left_semi").groupBy("association_id").agg(F.array_sort(F.collect_set("pub_id")).alias("retracted_pubs"))
    return associations.join(hits, "association_id")


def retraction_counts(publications: DataFrame) -> DataFrame:
    """Publications whose status is known, and the retracted ones."""
    return publications.agg(F.count("retracted").alias("checked"), F.count_if("retracted").alias("retracted"))


def linked_sets(edges: DataFrame) -> DataFrame:
    """The distinct objects of every subject, sorted."""
    return edges.groupBy("subject").agg(F.array_sort(F.collect_set("object")).alias("objects"))


def sampled_pairs(direct: DataFrame, associations: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Distinct ``(subject, object)`` pairs of both kinds of edges, capped by hash."""
    pairs = direct.select("subject", "object").union(associations.select("subject", "object")).distinct()
    return pairs.orderBy(F.xxhash64(F.lit(seed), "subject", "object"), "subject", "object").limit(most)


def publication_features(publications: DataFrame, cites: DataFrame) -> DataFrame:
    """Features of publication nodes: retracted, share of retracted among what they cite, its logarithm.

    A publication that cites nothing known counts as citing one.
    """
    out = cites.select("citing", "cited").distinct().groupBy(F.col("citing").alias("pub_id")).agg(F.count("*").alias("_out"))
    n = F.coalesce("cites_retracted_count", F.lit(0))
    return publications.join(out, "pub_id", "left").select(
        "pub_id", F.coalesce("retracted", F.lit(False)).cast("double").alias("is_retracted"),
        (n / F.greatest(F.coalesce("_out", F.lit(1)), F.lit(1))).alias("retracted_citation_ratio"), F.log1p(n.cast("double")).alias("cites_retracted_log"), F.lit(1.0).alias("is_publication"),
    )


def first_embedding(node2vec: Column, n2v: Column, embedding: Column) -> Column:
    """The first vector that a node has."""
    return F.coalesce(node2vec, n2v, embedding)


def worst_status(statuses: Column) -> Column:
    """The gravest status among an edge's sources."""
    chain = F
    for status in ("retracted", "concern", "clean"):
        chain = chain.when(F.array_contains(statuses, status), status)
    return chain.otherwise("unknown")


def origin(agent: Column, paper: Column) -> Column:
    """Where an edge comes from: an agent before a paper before curation."""
    return F.when(agent, "agent").when(paper, "paper").otherwise("curated")


def ranked_options(edges: DataFrame) -> DataFrame:
    """Edges of each pair for choice: the claim's and flagged ones first, then by suspicion, label breaking ties.

    Of equal labels the last in order ``ord`` stays.
    """
    c = lambda name, points: F.when(F.col(name), points).otherwise(0.0)
    suspicion = F.coalesce("suspicion", F.lit(0.0))
    score = c("is_claim_edge", 1000.0) + c("flagged", 1000.0) + F.when(suspicion > 0, 500.0 + 100.0 * suspicion).otherwise(0.0) + c("touches_evidence", 100.0) + c("on_path", 100.0) + c("shares_source", 75.0) + c("touches_endpoint", 50.0)
    scored = edges.withColumn("score", score).groupBy("pair_id", "label").agg(F.max_by("score", "ord").alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("pair_id").orderBy(F.col("score").desc(), "label")))


def ranked(rows: DataFrame, score: str, label: str, key: list[str] | None = None, into: str = "place") -> DataFrame:
    """Adds places from 1 by falling score, equal ones by label (W5). Without a key all rows are ranked as one, so there
    are to be few of them, as labels are."""
    return rows.withColumn(into, F.row_number().over(W.partitionBy(*(key or [])).orderBy(F.col(score).desc(), label)))


def suspicion_colour(suspicion: Column) -> Column:
    """Green to amber to red as a hex colour."""
    s = F.greatest(F.least(suspicion, F.lit(1.0)), F.lit(0.0))
    part = lambda x: F.lpad(F.hex(F.round(x).cast("long")), 2, "0")
    red = F.when(s < 0.5, 510 * s).otherwise(255.0)
    green = F.when(s < 0.5, 255.0).otherwise(510 * (1 - s))
    return F.concat(F.lit("#"), part(red), part(green), F.lit("00"))


def shares_source(mine: Column, theirs: Column) -> Column:
    """Whether two sets of sources meet; an unknown set meets nothing."""
    return F.coalesce(F.arrays_overlap(mine, theirs), F.lit(False))
