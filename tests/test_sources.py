"""Readers and routing of files, upserts, seed graph and the stream."""

import gzip

from pyspark.sql import functions as F

from kgaudit.operators import graph
from kgaudit.sources import ingest
from kgaudit.streaming import audit_stream


def write(path, text):
    if str(path).endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return f"file://{path}"


def tuples(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_nodes_and_edges(spark, tmp_path):
    nodes = write(tmp_path / "n.tsv.gz", "id\tname\tcategory\tdescription\tsynonym\txref\nHGNC:1\tA\tx\t\ta|b\t\nhgnc:2\tB\tx\t\t\t\nZ:1\tC\tbiolink:Disease\td\t\tQ\n\tD\tbiolink:Gene\t\t\t\nHGNC:1\tA\tx\t\ta|b\t\n")
    known = ingest.nodes(ingest.read_tsv(spark, nodes))
    assert {(r["id"], tuple(r["synonyms"])) for r in known.collect()} == {("HGNC:1", ("a", "b")), ("Z:1", ())}
    edges = write(tmp_path / "e.tsv", "subject\tpredicate\tobject\tpublications\nHGNC:1\tbiolink:causes\tZ:1\t['PMID:1', 'PMID:2', 'x']\nHGNC:1\tbiolink:causes\tZ:1\tPMID:2|PMID:3\nHGNC:1\tcauses_more\tZ:1\t\nHGNC:1\tbiolink:causes_more\tZ:1\t\nHGNC:1\tbiolink:treats\tN:1\t\n\tbiolink:treats\tZ:1\t\n")
    assoc, links, direct = ingest.routed_edges(ingest.read_tsv(spark, edges), known, "v1")
    assert assoc.count() == 1 and tuples(links, "pub_id") == {("PMID:1",), ("PMID:2",), ("PMID:3",)}
    assert tuples(direct, "predicate") == {("causes_more",)}


def test_list_literals(spark):
    rows = {"['a', \"b\"]": ["a", "b"], "a|b| ": ["a", "b"], "one": ["one"], "": [], "[1, 2]": ["1", "2"]}
    df = spark.createDataFrame([(k,) for k in rows], "v string")
    assert {r[0]: r[1] for r in df.select("v", ingest.listed(F.col("v"))).collect()} == rows


def test_phenotypes_and_pathways(spark):
    genes = ingest.gene_map(spark.createDataFrame([("HGNC:7", "70"), ("HGNC:8", ""), (None, "9")], "hgnc_id string, entrez_id string"))
    rows = spark.createDataFrame([("NCBIGene:70", "HP:1"), ("71", "HP:2"), ("71", "HP:2"), ("", "HP:3")], "gene_id string, hpo_id string")
    assert tuples(ingest.gene_phenotypes(rows, genes), "subject", "object") == {("HGNC:7", "HP:1"), ("NCBIGene:71", "HP:2")}
    rows = spark.createDataFrame([("ORPHA:1", "", "HP:1", "PMID:1;OMIM:2"), ("OMIM:2", "NOT", "HP:1", "")], "database_id string, qualifier string, hpo_id string, reference string")
    assert tuples(ingest.disease_phenotypes(rows), "subject", "publications") == {("Orphanet:1", "PMID:1")}
    rows = spark.createDataFrame([("70", "R-HSA-1", "Homo sapiens"), ("70", "5", "Homo sapiens"), ("70", "6", "Mus musculus")], "gene_id string, pathway_id string, species string")
    assert tuples(ingest.gene_pathways(rows, genes), "subject", "object") == {("HGNC:7", "R-HSA-1"), ("HGNC:7", "REACT:5")}
    assert tuples(ingest.gene_pathways(rows), "subject") == {("UniProtKB:70",)}


def test_census(spark):
    rows = spark.createDataFrame([("Abc", "oncogene, TSG", "5", "1", "n", "x,y"), ("ABC", "fusion", "6", "1", "n", ""), ("DEF", "fusion", "", "?", "n", "Y,z")], "GENE_SYMBOL string, ROLE_IN_CANCER string, HGNC_ID string, TIER string, NAME string, SYNONYMS string").coalesce(1)
    census = ingest.gene_census(rows)
    assert tuples(census, "symbol", "gene_id", "role_class", "tier") == {("ABC", "HGNC:5", "both", 1), ("DEF", "COSMIC:DEF", "fusion", 2)}
    asked = spark.createDataFrame([("abc",), ("y",), ("Z",), ("q",)], "symbol string")
    got = {r["symbol"]: r["census"] and r["census"]["symbol"] for r in ingest.census_lookup(asked, census).collect()}
    assert got == {"abc": "ABC", "y": "ABC", "Z": "DEF", "q": None}


def test_publications(spark, tmp_path):
    article = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal><AuthorList>{}</AuthorList><PublicationTypeList><PublicationType>{}</PublicationType></PublicationTypeList></Article>{}</MedlineCitation></PubmedArticle>"
    author = "<Author><LastName>L{0}</LastName><ForeName>F</ForeName></Author>"
    notice = '<CommentsCorrectionsList><CommentsCorrections RefType="RetractionIn"/></CommentsCorrectionsList>'
    made = [article.format(1, "".join(author.format(i) for i in range(4)), "Journal Article", ""), article.format(2, author.format(0) + author.format(1), "Retracted Publication", ""), article.format(3, author.format(0), "Review", notice)]
    path = write(tmp_path / "a.xml", f"<Set>{''.join(made)}</Set>")
    got = tuples(ingest.publications(spark, path), "pub_id", "authors", "year", "retracted")
    assert got == {("PMID:1", "F L0 et al.", 2001, False), ("PMID:2", "F L0, F L1", 2001, True), ("PMID:3", "F L0", 2001, True)}
    pubs = ingest.publications(spark, path)
    cites = spark.createDataFrame([("PMID:1", "PMID:2"), ("PMID:1", "PMID:2"), ("PMID:1", "PMID:3"), ("PMID:2", "PMID:1")], "citing string, cited string")
    assert tuples(ingest.cites_retracted_counts(pubs, cites), "pub_id", "cites_retracted_count") == {("PMID:1", 2), ("PMID:2", 0), ("PMID:3", 0)}


def test_notices(spark):
    rows = [("a", "x", ["n"], []), ("b", "x", [], [("other",), ("Erratum",), ("retraction",)]), ("c", "Retraction", None, None), ("d", "x", None, [("expression-of-concern",)]), ("e", "x", None, None)]
    works = spark.createDataFrame(rows, "doi string, type string, retracted_by array<string>, updates array<struct<type: string>>")
    assert dict(tuples(ingest.retraction_status(works), "doi", "notice_status")) == {"a": "retracted", "b": "correction", "c": "retracted", "d": "concern", "e": "none"}


def test_upserts_and_seed(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "c", 3), (3, "d", 4)], "k int, v string, n int")
    assert tuples(graph.upsert(old, new, ["k"], "n"), "k", "v") == {(1, "c"), (2, "b"), (3, "d")}
    assert tuples(graph.upsert(old, new, ["k"], "n", first_wins=True), "k", "v") == {(1, "a"), (2, "b"), (3, "d")}
    genes = spark.createDataFrame([(i, f"g{i}") for i in range(10)], "g int, id string")
    others = spark.createDataFrame([(i, f"d{i}") for i in range(6)], "d int, id string")
    pmids = spark.createDataFrame([(i, f"PMID:{i}", 2000 + i) for i in range(3)], "no int, pmid string, year int")
    edges = ingest.seed_edges(genes, others, pmids, 5, 0)
    assert edges.count() == 60 + sum((g + d) % 5 == 0 for g in range(10) for d in range(6))


def test_stream(spark, tmp_path):
    claims = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "claim_id long, received_at string").withColumn("received_at", F.to_timestamp("received_at"))
    claims.write.parquet(f"file://{tmp_path}/in")
    prov = spark.createDataFrame([(1, "x", "retracted", 2000), (2, "y", "clean", 2000), (2, "z", "clean", 2001)], "claim_id long, identifier string, status string, pub_year int")
    stream = spark.readStream.schema(claims.schema).parquet(f"file://{tmp_path}/in")
    audit_stream.drain(audit_stream.audit_stream, stream, prov, 2001, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert tuples(spark.read.parquet(f"file://{tmp_path}/out"), "claim_id", "verdict") == {(1, "FAIL"), (2, "PASS")}
