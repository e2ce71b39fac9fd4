"""Subgraphs around pairs of nodes, with evidence as further centres, and paths through a kind of node.

A pair ``(pair_id, subject, object)`` has its own nodes and edges, keyed by ``pair_id``. All pairs are expanded at once:
a frontier holds the nodes that each pair has reached, from any of its centres, and a hop is one join of it with the
graph's steps. So a thousand pairs cost one plan, and a hub is joined as often as pairs reach it, not expanded for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.functions import ids
from kgaudit.operators import graph
from kgaudit.session import written

KEY = ["pair_id", "subject", "predicate", "object"]


def centres(pairs: DataFrame, evidence: DataFrame | None = None, is_node: Callable[[Column], Column] = ids.is_graph_node) -> DataFrame:
    """``(pair_id, node)``: both ends of each pair and those of its evidence ``(pair_id, node)`` that may be nodes of the graph."""
    ends = pairs.select("pair_id", F.explode(F.array("subject", "object")).alias("node"))
    if evidence is not None:
        ends = ends.union(evidence.select("pair_id", "node").filter(is_node(F.col("node"))))
    return ends.distinct()


def pair_subgraph(
    pairs: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    hops: int,
    categories: tuple[str, ...],
    allowed: Callable[[Column, Column], Column] = ids.allowed_edge,
    evidence: DataFrame | None = None,
    category_of: Callable[[Column], Column] = ids.category_of,
    is_node: Callable[[Column], Column] = ids.is_graph_node,
    with_edges: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Nodes ``(pair_id, node, category)`` and edges of each pair: what is within some hops of its centres (G1).

    A node's category is the one that ``nodes(id, category)`` holds, else the one that its identifier tells. Nodes of
    other categories drop out. A centre whose identifier tells a wanted category is a node even if the graph has no
    edge of it. Edges stay between nodes whose identifiers' categories ``allowed`` joins; of edges that are equal in
    both ends and predicate the first by ``ord`` stays, whichever centre it was reached from (U6). Without a hop there are the
    two ends, and no edges. Where edges aren't wanted they are None, and nothing is written for them.
    """
    seeds = centres(pairs, evidence if hops > 0 else None, is_node)
    wanted = lambda c: F.coalesce(c.isin(*categories), F.lit(False))
    if hops <= 0:
        told = seeds.select("pair_id", "node", category_of(F.col("node")).alias("category"))
        return told.filter(wanted(F.col("category"))), edges.limit(0).withColumn("pair_id", F.lit(None).cast(pairs.schema["pair_id"].dataType))
    seeds = written(seeds)
    told = seeds.filter(wanted(category_of(F.col("node"))))
    known = nodes.groupBy("id").agg(F.min("category").alias("_c"))
    stored = lambda c: F.when(F.col("_c") != "", ids.normal_category(F.col("_c"))).otherwise(category_of(F.col(c)))
    placed = lambda rows, c, into: rows.join(known.withColumnRenamed("id", c), c, "left").withColumn(into, stored(c)).drop("_c")
    inner = graph.reached(seeds.withColumnRenamed("pair_id", "request_id"), graph.steps_of(edges), hops - 1)[-1].withColumnRenamed("request_id", "pair_id")

    # a node's category is known before pairs reach it; a centre may be wanted by either of its categories, the stored one comes first
    number = lambda c, late: (F.array_position(F.array(*map(F.lit, categories)), c) - 1 + late * len(categories)).cast("int")
    steps = graph.steps_of(edges).filter(graph.within(graph.namespaces(F.col("node"), inner), "node"))
    lists = graph.packed(placed(steps, "next", "_k").filter(wanted(F.col("_k"))).withColumn("no", number(F.col("_k"), 0)), "no")
    near = inner.filter(F.col("dist") == hops - 1).join(lists, "node").select("pair_id", "no", *graph.PACKED)
    near = near.union(placed(inner.select("pair_id", "node"), "node", "_k").filter(wanted(F.col("_k"))).select("pair_id", number(F.col("_k"), 0), *graph.alone()))
    near = near.union(told.select("pair_id", number(category_of(F.col("node")), 1), *graph.alone()))
    each = graph.unpacked(near.repartition("pair_id"), "pair_id", "no").groupBy("pair_id", "prefix", "number").agg(F.min("no").alias("no")).withColumn("node", graph.whole_name())
    kept = each.select("pair_id", "node", F.element_at(F.array(*map(F.lit, categories)), F.col("no") % len(categories) + 1).alias("category"))

    if not with_edges:
        return kept, None
    joins = allowed(category_of(F.col("subject")), category_of(F.col("object")))
    found = graph.first_of_equal(edges.filter(joins), ["subject", "predicate", "object"])
    for c in ("subject", "object"):  # ends that any pair wants, and those that only a pair does whose centre they are
        found = placed(found, c, "_k").withColumn(f"_{c}", wanted(F.col("_k"))).filter(F.col(f"_{c}") | wanted(category_of(F.col(c)))).drop("_k")
    found = written(found)
    inside = graph.edges_around(inner.select(F.col("pair_id").alias("request_id"), "node"), found).withColumnRenamed("request_id", "pair_id")
    for c in ("subject", "object"):
        if not found.filter(f"not _{c}").isEmpty():
            centre = told.select("pair_id", F.col("node").alias(c))
            inside = inside.filter(f"_{c}").unionByName(inside.filter(f"not _{c}").join(centre, ["pair_id", c], "left_semi"))
    return kept, inside.select("pair_id", *edges.columns)


def with_publications(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, cites: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A pair's subgraph with the publications of its edges' ``sources`` and of its evidence.

    Nodes gain ``publication`` ones; ``(pair_id, subject, predicate, object)`` gains ``SUPPORTED_BY`` from the pair's
    subject to each. With ``cites(subject, object)`` the publications one citation away come too, with ``CITES`` among
    those that are there and ``SUPPORTED_BY`` from the subject of each edge to its own sources.
    """
    paper = lambda c: ids.starts_with_any(F.upper(c), ("PMID:", "PMC"))
    sourced = edges.select(*KEY, F.explode("sources").alias("pub")).filter(paper(F.col("pub")))
    papers = sourced.select("pair_id", "pub").union(evidence.select("pair_id", "node").filter(paper(F.col("node")))).distinct()
    links = pairs.select("pair_id", "subject").join(papers, "pair_id").select("pair_id", "subject", F.lit("SUPPORTED_BY").alias("predicate"), F.col("pub").alias("object"))
    if cites is not None:
        near, among = graph.citation_subgraph(papers.select(F.col("pair_id").alias("request_id"), F.col("pub").alias("node")), cites.select("subject", "object"))
        papers = papers.union(near.select("request_id", "node")).distinct()
        own = sourced.select("pair_id", "subject", F.lit("SUPPORTED_BY"), "pub")
        links = links.union(own).union(among.select(F.col("request_id"), "subject", F.lit("CITES"), "object"))
    all_nodes = nodes.union(papers.select("pair_id", F.col("pub").alias("node"), F.lit("publication")).join(nodes, ["pair_id", "node"], "left_anti"))
    return all_nodes, edges.select(*KEY).union(links).distinct()


def hops_through(pairs: DataFrame, edges: DataFrame, holds: Callable[[Column], Column], most: int | None = None) -> DataFrame:
    """``(pair_id, hops)``: the length of the shortest walk from subject to object, in either direction of the pair's
    edges ``(pair_id, subject, object)``, that touches a node for which ``holds`` is true; 0.0 if there is none (G13).

    The shortest such walk is the shortest way to such a node and from there on. Pairs travel with their edges, each
    pair to one task, which searches many small pairs together (see ``searched``). Pairs with more than ``SMALL`` edges
    are searched by levels, as tables.
    """
    touches = lambda c: F.coalesce(holds(F.col(c)), F.lit(False))
    own = written(edges.select("pair_id", "subject", "object").dropna().join(pairs.select("pair_id").distinct(), "pair_id", "left_semi"))
    large = written(own.groupBy("pair_id").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("pair_id"))
    every = pairs.select("pair_id").distinct()
    one = F.struct("subject", "object", touches("subject").alias("s"), touches("object").alias("o"))
    ends = pairs.groupBy("pair_id").agg(F.collect_set("subject").alias("subjects"), F.collect_set("object").alias("objects"))
    small = own if large.isEmpty() else own.join(large, "pair_id", "left_anti")
    ready = small.groupBy("pair_id").agg(F.collect_list(one).alias("edges")).join(ends, "pair_id")
    kind = pairs.schema["pair_id"].dataType.simpleString()
    shortest = ready.mapInArrow(lambda batches: searched(batches, most), f"pair_id {kind}, hops double")
    if not large.isEmpty():
        shortest = shortest.union(hops_by_levels(pairs.join(large, "pair_id", "left_semi"), own.join(large, "pair_id", "left_semi"), touches, most))
    return every.join(shortest, "pair_id", "left").na.fill(0.0, ["hops"])


#: Edges of a pair that one task searches.
SMALL = 100_000


def searched(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """``(pair_id, hops)`` of rows ``(pair_id, edges, subjects, objects)`` whose ends are joined by a walk that touches a node that holds."""
    for batch in batches:
        table = {c: batch.column(c).to_pylist() for c in ("pair_id", "edges", "subjects", "objects")}
        found = []
        for edges, subjects, objects in zip(table["edges"], table["subjects"], table["objects"], strict=True):
            near, holding = {}, set()
            for e in edges:
                a, b = e["subject"], e["object"]
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
                if e["s"]:
                    holding.add(a)
                if e["o"]:
                    holding.add(b)
            there, back = hops_from(subjects, near), hops_from(objects, near)
            best = min((there[n] + back[n] for n in holding if n in there and n in back), default=None)
            found.append(None if best is None or (most is not None and best > most) else float(best))
        yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(found, pa.float64())], ["pair_id", "hops"])


def hops_from(starts: list[str], near: dict[str, set[str]]) -> dict[str, int]:
    """Hops to every node that the starts reach."""
    found, level, dist = {n: 0 for n in starts if n in near}, [n for n in starts if n in near], 0
    while level:
        dist += 1
        after = []
        for n in level:
            for m in near[n]:
                if m not in found:
                    found[m] = dist
                    after.append(m)
        level = after
    return found


def hops_by_levels(pairs: DataFrame, edges: DataFrame, touches: Callable[[str], Column], most: int | None) -> DataFrame:
    """``(pair_id, hops)`` as ``hops_through`` finds them, of pairs of any size that have such a walk.

    A state is a node and whether a node that holds was touched before it or is it, and the search is by levels over
    states: one join with the pair's steps and one anti-join with the states that were reached. Pairs whose object
    is reached leave the frontier. It ends when the frontier is empty, or after ``most`` levels; each level is written,
    so the plan doesn't grow.
    """
    both = edges.select("pair_id", F.col("subject").alias("node"), F.col("object").alias("next")).union(edges.select("pair_id", "object", "subject"))
    steps = written(both.distinct().withColumn("touched", touches("next")))
    ends = pairs.select("pair_id", F.col("object").alias("node"))
    level = pairs.select("pair_id", F.col("subject").alias("node"), touches("subject").alias("seen"))
    level = written(level.join(steps, ["pair_id", "node"], "left_semi").distinct())
    reached, found, dist = level, [], 0
    while True:
        hit = level.filter("seen").join(ends, ["pair_id", "node"], "left_semi").select("pair_id", F.lit(float(dist)).alias("hops"))
        found.append(hit)
        dist += 1
        if most is not None and dist > most:
            break
        going = level.join(hit, "pair_id", "left_anti")
        moved = going.join(steps, ["pair_id", "node"]).select("pair_id", F.col("next").alias("node"), (F.col("seen") | F.col("touched")).alias("seen")).distinct()
        level = written(moved.join(reached, ["pair_id", "node", "seen"], "left_anti"))
        if level.isEmpty():
            break
        reached = reached.union(level)
    hits = found[0]
    for hit in found[1:]:
        hits = hits.union(hit)
    return hits.groupBy("pair_id").agg(F.min("hops").alias("hops"))
