"""Pair subgraphs, paths through a kind of node, and stores."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from kgaudit.operators import graph, subgraph
from kgaudit.sources import stores

EDGE = "subject string, predicate string, object string, sources array<string>, weight int, ord int"
CATEGORIES = ("gene", "disease", "phenotype", "pathway")


def shortest_walk(subject, obj, edges, holds):
    """Breadth first over nodes and whether one that holds was touched."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    if subject not in near or obj not in near:
        return 0.0
    waiting, seen = deque([(subject, holds(subject), 0)]), {(subject, holds(subject))}
    while waiting:
        node, touched, dist = waiting.popleft()
        if node == obj and touched:
            return float(dist)
        for n in near[node]:
            state = (n, touched or holds(n))
            if state not in seen:
                seen.add(state)
                waiting.append((*state, dist + 1))
    return 0.0


def test_walks_through_pathways(spark):
    rng = random.Random(4)
    pairs, edges, want = [], [], {}
    for p in range(60):
        nodes = [f"HGNC:{i}" for i in range(6)] + [f"GO:{i}" for i in range(rng.randint(0, 2))]
        own = [tuple(rng.sample(nodes, 2)) for _ in range(rng.randint(0, 9))]
        s, o = rng.choice(nodes[:6] + nodes[-1:]), rng.choice(nodes[:6] + nodes[-1:])
        pairs.append((p, s, o))
        edges += [(p, a, b) for a, b in own]
        want[p] = shortest_walk(s, o, own, lambda n: n.startswith("GO:"))
    line = [f"HGNC:{i}" for i in range(12)] + ["GO:end"]
    pairs.append((100, "HGNC:0", "HGNC:1"))
    edges += [(100, a, b) for a, b in zip(line, line[1:])]  # there and back again
    want[100] = 23.0
    pairs, edges = spark.createDataFrame(pairs, "pair_id int, subject string, object string"), spark.createDataFrame(edges, "pair_id int, subject string, object string")
    holds = lambda c: c.startswith("GO:")
    assert {r["pair_id"]: r["hops"] for r in subgraph.hops_through(pairs, edges, holds).collect()} == want
    assert len(set(want.values())) > 4
    few = {r["pair_id"]: r["hops"] for r in subgraph.hops_through(pairs, edges, holds, most=2).collect()}
    assert few == {p: d if d <= 2 else 0.0 for p, d in want.items()}
    assert subgraph.hops_through(pairs, edges.limit(0), holds).agg(F.sum("hops")).first()[0] == 0.0


def around(spark, edges, evidence, hops=1, nodes=()):
    pairs = spark.createDataFrame([(1, "HGNC:1", "MONDO:1"), (2, "HGNC:9", "HP:9")], "pair_id int, subject string, object string")
    known = spark.createDataFrame(list(nodes), "id string, category string")
    centres = spark.createDataFrame(evidence, "pair_id int, node string")
    return pairs, *subgraph.pair_subgraph(pairs, known, spark.createDataFrame(edges, EDGE), hops, CATEGORIES, evidence=centres)


EDGES = [
    ("HGNC:1", "r", "MONDO:1", ["PMID:1"], 5, 3), ("HGNC:1", "r", "MONDO:1", ["PMID:2"], 6, 1), ("HGNC:1", "r", "MONDO:1", ["PMID:3"], 7, 2), ("HGNC:2", "q", "GO:7", ["PMID:4", "x"], 1, 4),
    ("HGNC:1", "q", "UBERON:1", [], 1, 5), ("MONDO:1", "q", "HP:1", [], 1, 6), ("HGNC:5", "r", "HGNC:6", [], 1, 7), ("HGNC:1", "t", "MONDO:5", [], 1, 8),
]


def test_evidence_centres_and_first_of_equal_edges(spark):
    evidence = [(1, "GO:7"), (1, "PMID:77"), (1, "GO:404"), (1, "UBERON:2"), (2, "GO:7")]
    for parts in (1, 3, 5):
        _, nodes, edges = around(spark, EDGES, evidence, nodes=[("MONDO:5", "biolink:AnatomicalEntity"), ("HGNC:2", "biolink:Gene")])
        kept = {(r["pair_id"], r["node"], r["category"]) for r in nodes.repartition(parts).collect()}
        assert kept == {(1, "HGNC:1", "gene"), (1, "MONDO:1", "disease"), (1, "HP:1", "phenotype"), (1, "GO:7", "pathway"), (1, "HGNC:2", "gene"), (1, "GO:404", "pathway"), (2, "HGNC:9", "gene"), (2, "HP:9", "phenotype"), (2, "GO:7", "pathway"), (2, "HGNC:2", "gene")}
        got = {(r["pair_id"], r["subject"], r["object"], r["weight"]) for r in edges.collect()}
        assert got == {(1, "HGNC:1", "MONDO:1", 6), (1, "HGNC:2", "GO:7", 1), (2, "HGNC:2", "GO:7", 1)}


def test_no_hops_gives_the_ends(spark):
    _, nodes, edges = around(spark, EDGES, [(1, "GO:7")], hops=0)
    assert {(r["pair_id"], r["node"]) for r in nodes.collect()} == {(1, "HGNC:1"), (1, "MONDO:1"), (2, "HGNC:9"), (2, "HP:9")} and edges.count() == 0


def test_publications_join_the_subgraph(spark):
    evidence = [(1, "GO:7"), (1, "PMID:77")]
    pairs, nodes, edges = around(spark, EDGES, evidence)
    asked = spark.createDataFrame(evidence, "pair_id int, node string")
    more, links = subgraph.with_publications(pairs, nodes, edges, asked)
    papers = {"PMID:2", "PMID:4", "PMID:77"}
    assert {r["node"] for r in more.filter("category = 'publication'").collect()} == papers
    assert {(r["subject"], r["object"]) for r in links.filter("predicate = 'SUPPORTED_BY'").collect()} == {("HGNC:1", p) for p in papers}
    cites = spark.createDataFrame([("PMID:2", "PMID:50"), ("PMID:50", "PMID:51")], "subject string, object string")
    more, links = subgraph.with_publications(pairs, nodes, edges, asked, cites)
    assert {r["node"] for r in more.filter("category = 'publication'").collect()} == papers | {"PMID:50"}
    got = {(r["subject"], r["predicate"], r["object"]) for r in links.filter("predicate in ('CITES', 'SUPPORTED_BY')").collect()}
    assert got == {("HGNC:1", "SUPPORTED_BY", p) for p in papers} | {("HGNC:2", "SUPPORTED_BY", "PMID:4"), ("PMID:2", "CITES", "PMID:50")}


def test_ego_keeps_the_first_of_equal_edges_in_any_partitioning(spark):
    edges = spark.createDataFrame([("a", "r", "b", [str(i)], i, 9 - i) for i in range(9)], EDGE)
    ask = spark.createDataFrame([(1, "a"), (1, "b")], "request_id int, node string")
    for parts in range(1, 6):
        found = graph.ego(ask, edges.repartition(parts), 1)[1].collect()
        assert [(r["weight"], r["ord"], r["sources"]) for r in found] == [(8, 1, ["8"])]
    assert graph.first_of_equal(edges.drop("ord"), ["subject", "predicate", "object"]).first()["weight"] == 0


POLICIES = {"made": "create", "tags": "union", "most": "max", "n": "sum"}
ROW = "id int, label string, made string, tags array<string>, most int, n int, at int"


def test_merge_by_property(spark, tmp_path):
    old = spark.createDataFrame([(1, "one", None, ["a"], 5, 1, 0), (2, "two", "old", None, None, 1, 0), (3, "three", "old", ["z"], 1, 1, 0)], ROW)
    new = spark.createDataFrame([(1, None, "new", ["b", "a"], 4, 1, 2), (1, "uno", "new", [], 9, 1, 1), (4, "four", None, ["c"], None, 1, 7), (4, None, "later", ["c"], 2, 1, 8)], ROW)
    want = {1: ("uno", None, ["a", "b"], 9, 3), 2: ("two", "old", [], None, 1), 3: ("three", "old", ["z"], 1, 1), 4: ("four", None, ["c"], 2, 2)}
    shown = lambda df: {r["id"]: (r["label"], r["made"], r["tags"], r["most"], r["n"]) for r in df.collect()}
    assert shown(stores.merged(old, new, ["id"], POLICIES, "at")) == want
    path = f"{tmp_path}/t"
    stores.merge_into(spark, path, old, ["id"], POLICIES, "at", buckets=8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    stores.merge_into(spark, path, new, ["id"], POLICIES, "at", buckets=8)
    assert shown(stores.table_at(spark, path)) == want
    touched = {f"bucket={r[0]}" for r in new.select(F.pmod(F.xxhash64("id"), F.lit(8))).distinct().collect()}
    for p, at in before.items():
        assert p.parent.name in touched or p.stat().st_mtime_ns == at
    stores.merge_into(spark, path, new.limit(0), ["id"], POLICIES, "at", buckets=8)
    assert shown(stores.table_at(spark, path)) == want


def test_merge_keeps_what_one_table_lacks(spark):
    old, new = spark.createDataFrame([(1, "x")], "id int, kept string"), spark.createDataFrame([(1, "y", 1)], "id int, added string, at int")
    got = stores.merged(old.withColumn("at", F.lit(0)), new, ["id"], {}, "at").first()
    assert (got["kept"], got["added"]) == ("x", "y")
    with pytest.raises(ValueError, match="policy"):
        stores.merged(old.withColumn("at", F.lit(0)), new, ["id"], {"kept": "other"}, "at")


def test_cache_is_read_before_fetching(spark, tmp_path):
    asked = []

    def fetch(wanted):
        asked.append(sorted(r["id"] for r in wanted.collect()))
        return wanted.filter("id <> 'none'").withColumn("status", F.concat(F.lit("s"), "id"))

    ask = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    run = lambda *names: {(r["id"], r["status"], r["cached"]) for r in stores.through_cache(spark, f"{tmp_path}/c", ask(*names), fetch, ["id"]).collect()}
    assert run("a", "b", "a") == {("a", "sa", False), ("b", "sb", False)}
    assert run("a", "b") == {("a", "sa", True), ("b", "sb", True)}
    assert run("b", "c", "none") == {("b", "sb", True), ("c", "sc", False)}
    assert run("c", "none") == {("c", "sc", True)}
    assert asked == [["a", "b"], [], ["c", "none"], ["none"]]


def test_claims_of_json_lines(spark, tmp_path):
    whole = {"id": "A", "claim": "TNF activates it.", "subject": {"curie": "HGNC:1", "label": "TNF"}, "subject_type": "gene", "predicate": "activates", "object": {"curie": "GO:1", "label": ""}, "qualifiers": {"tissue": "UBERON:1"}, "evidence": [{"type": "go", "id": "GO:1"}, {"type": "pubmed", "pmid": "24", "status": None}, {"type": "pubmed"}, {"type": "note", "id": "n"}, {"type": "uberon", "id": "UBERON:1"}], "expected_decision": "WARN", "more": [1]}
    (tmp_path / "claims.jsonl").write_text("\n".join([json.dumps(whole), "", '{"id": "B", "claim"', json.dumps({"id": "C"})]) + "\n")
    got = {r["claim_id"]: r for r in stores.claims_from_json(spark, f"{tmp_path}/claims.jsonl").collect()}
    a = got["A"]
    assert a["evidence"] == ["GO:1", "PMID:24", "UBERON:1"] and a["qualifiers"] == {"tissue": "UBERON:1"} and a["expected_decision"] == "WARN" and a["broken"] is None
    assert [(e["norm_id"], e["norm_label"], e["metadata"]) for e in a["entities"]] == [("HGNC:1", "TNF", {"category": "gene", "role": "subject"})]
    assert (got["C"]["text"], got["C"]["evidence"], got["C"]["entities"]) == ("", [], [])
    assert [r["broken"] for r in got.values() if r["broken"]] == ['{"id": "B", "claim"'] and len(got) == 3


def test_reports_come_back_equal(spark):
    rows = spark.createDataFrame([(1, 0.1 + 0.2, [("r", None)], {"k": 1}), (2, None, None, {})], "claim_id int, score double, trace array<struct<rule: string, because: string>>, facts map<string, int>")
    text = stores.reports_to_json(rows)
    assert json.loads(text.filter("claim_id = 2").first()["report"])["score"] is None
    assert sorted(stores.reports_from_json(text, rows.schema).collect()) == sorted(rows.collect())
    with pytest.raises(Exception, match="(?i)malformed"):
        stores.reports_from_json(text.withColumn("report", F.lit("{")), rows.schema).collect()


def test_feedback_of_a_batch_is_kept_once(spark, tmp_path):
    rows = spark.createDataFrame([("c1", ["PMID:1", " doi:10.1/x ", "", "note"], "PASS", None, False), ("c2", [], "FAIL", "odd", True)], "claim string, evidence array<string>, label string, comment string, normalization_failed boolean")
    for batch in ("b1", "b1", "b2"):
        stores.append_feedback(rows, f"{tmp_path}/f", batch, "2026-01-01T00:00:00+00:00")
    lines = [json.loads(x) for p in sorted((tmp_path / "f").rglob("*.json")) for x in p.read_text().splitlines()]
    assert len(lines) == 4 and len({x["id"] for x in lines}) == 4
    one, two = (next(x for x in lines if x["claim"] == c) for c in ("c1", "c2"))
    assert one["evidence"] == [{"type": "pubmed", "pmid": "1"}, {"type": "doi", "id": "10.1/x"}, {"type": "other", "id": "note"}] and one["expected_decision"] == "PASS"
    assert one["metadata"] == {"timestamp": "2026-01-01T00:00:00+00:00", "source": "user_feedback"} and two["metadata"]["comment"] == "odd" and two["metadata"]["normalization_failed"] is True
