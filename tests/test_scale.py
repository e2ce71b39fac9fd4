"""What operators shuffle: lists and keys, not every combination that they count or return."""

import itertools

import pytest
from pyspark.sql import functions as F

from kgaudit.operators import graph, learning, subgraph, training


def shuffled_rows(spark, make) -> int:
    """Rows that all stages of a query write to shuffles."""

    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
        out = 0
        while stages.hasNext():
            out += stages.next().shuffleWriteRecords()
        return out

    small = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for c in small:
        spark.conf.set(c, "-1")  # as on large tables
    try:
        before = total()
        make().write.format("noop").mode("overwrite").save()
        return total() - before
    finally:
        for c in small:
            spark.conf.unset(c)


def test_wedges_travel_as_lists(spark):
    edges = spark.createDataFrame(list(itertools.combinations(range(80), 2)) + [(i, 1000) for i in range(80, 300)], "subject long, object long")
    got = {r["node"]: (r["simple_degree"], r["clustering"]) for r in graph.clustering(edges).collect()}
    assert got[0] == (79, pytest.approx(1.0)) and got[1000] == (220, 0.0) and got[299] == (1, 0.0)
    wedges = 80 * 79 * 78 // 2
    assert shuffled_rows(spark, lambda: graph.clustering(edges)) < wedges / 5


def star_of_parts(spark, orders=200, shared=60):
    """Orders with two parts each out of a few, and parts with many suppliers."""
    out = [(f"ORD:{i}", "contains", f"PART:{(i + k) % 5}") for i in range(orders) for k in range(2)] + [(f"PART:{p}", "supplied_by", f"SUPP:{s}") for p in range(5) for s in range(shared)]
    edges = spark.createDataFrame(out * 2, "subject string, predicate string, object string")
    return edges, spark.createDataFrame([(i, f"ORD:{i}") for i in range(orders)], "request_id long, node string")


def test_second_hop_travels_as_lists(spark):
    edges, starts = star_of_parts(spark)
    nodes = lambda: graph.ego(starts, edges, 2, "outgoing")[0]
    got = {(r["request_id"], r["node"]): (r["dist"], r["paths"]) for r in nodes().collect()}
    assert len(got) == 200 * (1 + 2 + 60) and got[3, "SUPP:7"] == (2, 2) and got[3, "PART:4"] == (1, 1) and got[3, "ORD:3"] == (0, 1)
    assert shuffled_rows(spark, nodes) < 200 * 2 * 60 / 5


ODD = ["A:007", "A:7", "A:1\n", "A:", ":5", "x", "A:B:3", "A:1234567890", "A:999999999", "A:0", "A:-3", "A: 4", "a:7", "A:٣", "", *(f"A:{i * 40}" for i in range(1, 900)), *(f"plain{i}" for i in range(1100))]


def test_packed_names_come_back_whole(spark):
    """Lists hold numbers; names that aren't a namespace and a number as numbers are written come back as they were."""
    edges = spark.createDataFrame([("s", "r", n) for n in ODD] * 2 + [("A:7", "r", "s"), ("A:7", "r", None)], "subject string, predicate string, object string")
    starts = spark.createDataFrame([(1, "s"), (2, "A:7"), (3, None)], "request_id long, node string")
    got = [(r["request_id"], r["node"], r["dist"]) for r in graph.ego(starts, edges, 2, "outgoing")[0].collect()]
    want = [(1, "s", 0), *((1, n, 1) for n in ODD), (2, "A:7", 0), (2, "s", 1), *((2, n, 2) for n in ODD if n != "A:7"), (3, None, 0)]
    assert not set(got) ^ set(want) and len(got) == len(want)


def test_second_hop_travels_as_numbers(spark):
    edges, starts = star_of_parts(spark, orders=2000, shared=400)
    rows, before = graph.packed(graph.steps_of(edges, "outgoing")), graph.steps_of(edges, "outgoing").distinct()
    assert rows.select(F.sum(F.size(F.coalesce("wide", F.col("lows").cast("array<int>"))))).first()[0] == before.count() and rows.filter("names is not null").count() == 0
    assert rows.filter("prefix = 'SUPP:' and lows is not null and wide is null").count() == 5
    nodes = graph.ego(starts, edges, 2, "outgoing")[0]
    assert nodes.filter("dist = 2").count() == 2000 * 400
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "array<smallint>" in plan or "lows" in plan


def test_nodes_alone_write_nothing_for_edges(spark, monkeypatch):
    from kgaudit.plans import store_queries

    tables, real = [], subgraph.written
    monkeypatch.setattr(subgraph, "written", lambda df: tables.append(df.columns) or real(df))
    assert store_queries.pair_subgraph_nodes(spark, "/root/testdata/sf0.001").count() > 0
    assert tables == [["pair_id", "node"]]


def test_hops_are_found_from_the_goals(spark):
    edges, starts = star_of_parts(spark)
    kinds = spark.createDataFrame([(f"SUPP:{i}", "supplier") for i in range(60)] + [("ORD:9", "supplier")], "node string, category string")
    far = starts.union(spark.createDataFrame([(777, "ORD:x")], starts.schema))
    hops = lambda: graph.hops_to_category(far, edges, kinds, "supplier", 2)
    assert {r["request_id"]: r["hops"] for r in hops().collect()} == {i: 0 if i == 9 else 2 for i in range(200)} | {777: None}
    assert shuffled_rows(spark, hops) < 200 * 60


def test_edges_of_other_namespaces_do_not_travel(spark):
    edges, starts = star_of_parts(spark, orders=50, shared=400)
    found = lambda: graph.ego(starts, edges, 1)[1]
    assert sorted((r["request_id"], r["object"]) for r in found().collect()) == sorted((i, f"PART:{(i + k) % 5}") for i in range(50) for k in range(2))
    assert shuffled_rows(spark, found) < 5 * 400
    both = spark.createDataFrame([(1, "ORD:1"), (1, "PART:1"), (1, "PART:2")], starts.schema)  # edges between two of a request's nodes come once
    assert sorted(r["object"] for r in graph.ego(both, edges, 1)[1].filter("subject = 'ORD:1'").collect()) == ["PART:1", "PART:2"]


def test_pair_edges_travel_once(spark):
    out = [(f"ORD:{i}", "contains", f"PART:{i % 40}", i) for i in range(200)] + [(f"CUST:{i % 4}", "placed", f"ORD:{i}", i) for i in range(200)]
    edges = spark.createDataFrame(out, "subject string, predicate string, object string, ord int")
    pairs = spark.createDataFrame([(i, f"ORD:{i}", f"CUST:{i % 4}") for i in range(200)], "pair_id long, subject string, object string")
    nodes = spark.createDataFrame([], "id string, category string").limit(0)
    kind = lambda c: F.lower(F.substring_index(c, ":", 1))
    made = lambda: subgraph.pair_subgraph(pairs, nodes, edges, 1, ("ord", "cust", "part"), lambda a, b: F.lit(True), category_of=kind)
    kept, inside = made()
    assert kept.count() == 200 * 52 and inside.count() == 200 * 51 and inside.distinct().count() == 200 * 51
    assert {tuple(r) for r in kept.filter("pair_id = 7").select("category").distinct().collect()} == {("ord",), ("cust",), ("part",)}
    assert shuffled_rows(spark, lambda: made()[0]) < 200 * 52 / 2
    assert shuffled_rows(spark, lambda: made()[1]) < 200 * 51 * 2


@pytest.mark.parametrize("small", [0, 100_000])
def test_small_pairs_are_searched_in_one_task(spark, monkeypatch, small):
    monkeypatch.setattr(subgraph, "SMALL", small)
    line = lambda p, n: [(p, f"N:{i}", f"N:{i + 1}") for i in range(n)] + [(p, f"N:{n}", "GO:x")]
    edges = spark.createDataFrame([e for p in range(30) for e in line(p, p % 5)], "pair_id long, subject string, object string")
    pairs = spark.createDataFrame([(p, "N:0", "N:0") for p in range(30)] + [(99, "N:0", "GO:x")], "pair_id long, subject string, object string")
    made = lambda: subgraph.hops_through(pairs, edges, lambda c: c.startswith("GO:"))
    assert {r["pair_id"]: r["hops"] for r in made().collect()} == {p: 2.0 * (p % 5 + 1) for p in range(30)} | {99: 0.0}
    if small:
        assert shuffled_rows(spark, made) < 450  # the edges once, and the pairs


def test_features_of_nodes_are_not_broadcast(spark):
    edges = spark.createDataFrame([(p, f"P:{p}", "r", f"S:{i}", i % 2, 1.0) for p in range(4) for i in range(3)], "pair_id long, subject string, predicate string, object string, y int, confidence double")
    features = edges.select("pair_id", F.explode(F.array("subject", "object")).alias("node")).distinct().withColumn("x", F.array(F.lit(0.5), F.lit(1.0)))
    weights = learning.ScorerWeights.seeded(2, 1, 1)
    for df in (learning.suspicion(edges, features, ["r"], weights, ("confidence",)), training.graphs(edges, features, ["r"], ("confidence",))):
        assert df.count() in (12, 4)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
