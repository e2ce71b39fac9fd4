"""Queries of the readers: the given tables written as the files that sources bring, and read by ``ingest``, with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.plans.registry import query
from kgaudit.session import shared_folder, table
from kgaudit.sources import ingest


def as_tsv(df: DataFrame, header: bool = True, comment: str | None = None) -> str:
    """Writes rows as tab-separated files and gives their folder."""
    path = f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").csv(path)
    if comment:
        df.sparkSession.createDataFrame([(comment,)], "value string").write.mode("append").text(path)
    return path


def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes: genes, other things with a wanted prefix, and things that aren't taken in."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat(element_at(array('HGNC:', 'MONDO:', 'X:', 'x:'), cast(p_partkey % 4 + 1 as int)), p_partkey) as id", "p_name as name", "if(p_partkey % 4 = 3, 'biolink:Gene', 'other') as category", "p_brand as description",
        "if(p_size > 25, concat('[\"', p_brand, '\", \"', p_type, '\"]'), concat(p_brand, '| |', p_type)) as synonym", "if(p_size = 1, '', p_brand) as xref",
    )


_NODE = "(CASE p_partkey % 4 WHEN 0 THEN 'HGNC:' WHEN 1 THEN 'MONDO:' WHEN 2 THEN 'X:' ELSE 'x:' END) || p_partkey"


@query(f"""SELECT {_NODE} AS id, p_name AS name, CASE WHEN p_partkey % 4 = 3 THEN 'biolink:Gene' ELSE 'other' END AS category, p_brand || ';' || p_type AS synonyms, CASE WHEN p_size = 1 THEN 0 ELSE 1 END AS n_xrefs FROM part WHERE p_partkey % 4 <> 2""")
def ingest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a tab-separated file, filtered by category or prefix, lists in two spellings."""
    read = ingest.nodes(ingest.read_tsv(spark, as_tsv(node_rows(spark, sf_dir))))
    return read.select("id", "name", "category", F.array_join("synonyms", ";").alias("synonyms"), F.size("xrefs").alias("n_xrefs"))


@query(f"""WITH n AS (SELECT {_NODE} AS id, p_partkey FROM part WHERE p_partkey % 4 <> 2),
e AS (SELECT s.id AS subject, CASE l_linenumber % 3 WHEN 0 THEN 'biolink:interacts_with' WHEN 1 THEN 'interacts_with_more' ELSE 'biolink:eats' END AS predicate, o.id AS object, l_returnflag AS f, l_suppkey FROM lineitem JOIN n s ON s.p_partkey = l_partkey JOIN n o ON o.p_partkey = l_partkey + 1 WHERE l_linenumber % 3 <> 2)
SELECT 'association' AS kind, subject, predicate, object, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n FROM e WHERE f = 'R' GROUP BY ALL UNION ALL SELECT 'direct', subject, predicate, object, 1 FROM e WHERE f <> 'R' GROUP BY ALL""")
def ingest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a file between known nodes, those with publications as associations with their links."""
    name = lambda c: f"concat(element_at(array('HGNC:', 'MONDO:', 'X:', 'x:'), cast(({c}) % 4 + 1 as int)), {c})"
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        f"{name('l_partkey')} as subject", "element_at(array('biolink:interacts_with', 'interacts_with_more', 'biolink:eats'), cast(l_linenumber % 3 + 1 as int)) as predicate", f"{name('(l_partkey + 1)')} as object",
        "if(l_returnflag = 'R', concat('PMID:', l_suppkey, '|DOI:1'), '') as publications",
    )
    known = ingest.nodes(ingest.read_tsv(spark, as_tsv(node_rows(spark, sf_dir)))).select("id")
    made, links, direct = ingest.routed_edges(ingest.read_tsv(spark, as_tsv(rows)), known, "v1")
    counted = made.join(links.groupBy("association_id").agg(F.count("*").alias("n")), "association_id")
    shown = lambda df, kind, n: df.select(F.lit(kind).alias("kind"), "subject", "predicate", "object", n.alias("n"))
    return shown(counted, "association", F.col("n")).union(shown(direct, "direct", F.lit(1).cast("long")))


def hgnc_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of the suppliers: two approved ones for some numbers, none for others."""
    rows = table(spark, sf_dir, "supplier").selectExpr("if(s_suppkey % 5 = 0, '', cast(s_suppkey % 60 as string)) as entrez_id", "concat('HGNC:', lpad(s_suppkey, 6, '0')) as hgnc_id")
    return ingest.gene_map(ingest.read_tsv(spark, as_tsv(rows)))


_GENES = "m AS (SELECT s_suppkey % 60 AS e, max('HGNC:' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS h FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1)"


@query(f"""WITH {_GENES} SELECT DISTINCT coalesce(h, 'NCBIGene:' || l_suppkey) AS subject, 'biolink:has_phenotype' AS predicate, 'HP:' || l_linenumber AS object FROM lineitem LEFT JOIN m ON e = l_suppkey WHERE l_returnflag <> 'N'""")
def ingest_gene_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with phenotypes, their numbers mapped to approved ones."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("if(l_linenumber % 2 = 0, concat('NCBIGene:', l_suppkey), cast(l_suppkey as string)) as gene_id", "if(l_returnflag = 'N', '', concat('HP:', l_linenumber)) as hpo_id")
    return ingest.gene_phenotypes(ingest.read_tsv(spark, as_tsv(rows)), hgnc_map(spark, sf_dir))


@query("""SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'Orphanet:' ELSE 'OMIM:' END || l_suppkey AS subject, 'HP:' || l_partkey AS object, CASE WHEN l_returnflag = 'R' THEN 'PMID:' || l_orderkey || '|PMID:7' ELSE '' END AS publications FROM lineitem WHERE l_linenumber <> 1""")
def ingest_disease_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diseases with phenotypes of a file with comment lines; negated rows drop out."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "concat(if(l_suppkey % 2 = 0, 'ORPHA:', 'OMIM:'), l_suppkey) as database_id", "if(l_linenumber = 1, 'NOT', '') as qualifier", "concat('HP:', l_partkey) as hpo_id", "if(l_returnflag = 'R', concat('PMID:', l_orderkey, ';OMIM:3; PMID:7'), 'OMIM:3') as reference"
    )
    path = as_tsv(rows, header=False, comment="#description of the file")
    return ingest.disease_phenotypes(ingest.read_tsv(spark, path, rows.columns, comment="#")).select("subject", "object", "publications")


@query(f"""WITH {_GENES}, r AS (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), w AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'R-HSA-' ELSE 'REACT:' END || l_partkey AS object FROM r)
SELECT DISTINCT 'ncbi' AS kind, coalesce(h, 'NCBIGene:' || l_suppkey) AS subject, object FROM w LEFT JOIN m ON e = l_suppkey UNION ALL SELECT DISTINCT 'uniprot', 'UniProtKB:' || l_suppkey, object FROM w""")
def ingest_pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes and proteins in pathways of one species, from files without a header."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as gene_id", "concat(if(l_linenumber % 2 = 0, 'R-HSA-', ''), l_partkey) as pathway_id", "if(l_returnflag = 'R', 'Homo sapiens', 'Mus musculus') as species")
    path = as_tsv(rows, header=False)
    read = ingest.read_tsv(spark, path, rows.columns)
    ncbi, uniprot = ingest.gene_pathways(read, hgnc_map(spark, sf_dir)), ingest.gene_pathways(read)
    return ncbi.select(F.lit("ncbi").alias("kind"), "subject", "object").union(uniprot.select(F.lit("uniprot"), "subject", "object"))


@query("""SELECT l_suppkey AS subject, 'UMLS:C' || l_partkey AS object, max(CASE WHEN l_linenumber = 2 THEN 0.0 ELSE l_discount END)::DOUBLE AS score FROM lineitem GROUP BY ALL""")
def ingest_gene_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored associations in three spellings, the best of each; what is no number counts 0."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as gene_id", "concat(element_at(array('UMLS:', 'UMLS_', ''), cast(l_linenumber % 3 + 1 as int)), 'C', l_partkey) as disease_id", "if(l_linenumber = 2, 'n/a', cast(l_discount as string)) as score")
    found = ingest.gene_diseases(ingest.read_tsv(spark, as_tsv(rows)), "v1")
    return found.select(F.col("subject").cast("long").alias("subject"), "object", "score")


@query("""WITH p AS (SELECT p_partkey, p_size <= 5 AS retracted FROM part), c AS (SELECT DISTINCT l_orderkey % 2000 AS citing, l_partkey AS cited FROM lineitem), n AS (SELECT citing, count(*) AS n FROM c JOIN p ON cited = p_partkey AND retracted GROUP BY 1)
SELECT p_partkey AS pub_id, retracted, coalesce(n, 0) AS cites_retracted_count FROM p LEFT JOIN n ON citing = p_partkey""")
def publication_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many retracted publications each cites."""
    pubs = table(spark, sf_dir, "part").selectExpr("p_partkey as pub_id", "p_size <= 5 as retracted")
    cites = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 2000 as citing", "l_partkey as cited")
    return ingest.cites_retracted_counts(pubs, cites)


@query("""SELECT o_orderkey AS doi, CASE WHEN o_custkey % 11 = 0 THEN 'retracted' WHEN o_orderpriority = '1-URGENT' THEN 'concern' WHEN o_orderpriority = '2-HIGH' THEN 'correction' WHEN o_orderstatus = 'P' THEN 'retracted' ELSE 'none' END AS notice_status FROM orders""")
def work_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of works by relations, updates and their own type."""
    works = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as doi", "if(o_orderstatus = 'P', 'Retraction', 'article') as type", "if(o_custkey % 11 = 0, array('10.1/x'), null) as retracted_by",
        "case o_orderpriority when '1-URGENT' then array(named_struct('type', 'other'), named_struct('type', 'Expression-of-concern'), named_struct('type', 'retraction')) when '2-HIGH' then array(named_struct('type', 'erratum')) end as updates",
    )
    return ingest.retraction_status(works)


@query("""WITH l AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS nr FROM lineitem GROUP BY 1) SELECT 'PMID:' || p_partkey AS pub_id, p_name AS title, p_size AS year,
CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'A One' WHEN 2 THEN 'A One, Two' WHEN 3 THEN 'A One, Two, C Three' ELSE 'A One et al.' END AS authors, p_size <= 3 OR coalesce(nr, 0) > 12 AS retracted FROM part LEFT JOIN l ON l_partkey = p_partkey""")
def publication_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of XML files, with authors' lines and two signs of retraction."""
    people = [("A", "One"), ("", "Two"), ("C", "Three"), ("D", "Four")]
    person = [f"<Author>{f'<ForeName>{a}</ForeName>' if a else ''}<LastName>{b}</LastName></Author>" for a, b in people]
    listed = F.concat(*(F.when(F.col("p_partkey") % 5 > i, p).otherwise("") for i, p in enumerate(person)))
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("nr"))
    part = table(spark, sf_dir, "part").join(returned, "p_partkey", "left")
    text = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("p_partkey"), F.lit("</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>"), F.col("p_size"), F.lit("</Year></PubDate></JournalIssue></Journal><ArticleTitle>"), F.col("p_name"),
        F.lit("</ArticleTitle><AuthorList>"), listed, F.lit("</AuthorList><PublicationTypeList><PublicationType>Article</PublicationType>"), F.when(F.col("p_size") <= 3, "<PublicationType>Retracted Publication</PublicationType>").otherwise(""),
        F.lit("</PublicationTypeList></Article>"), F.when(F.coalesce("nr", F.lit(0)) > 12, '<CommentsCorrectionsList><CommentsCorrections RefType="RetractionIn"/></CommentsCorrectionsList>').otherwise(""), F.lit("</MedlineCitation></PubmedArticle>"),
    )
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    articles = part.groupBy(F.expr("p_partkey div 500").alias("batch")).agg(F.collect_list(text).alias("all"))  # files of 500 articles
    articles.select("batch", F.concat(F.lit("<PubmedArticleSet>"), F.array_join("all", ""), F.lit("</PubmedArticleSet>")).alias("value")).write.partitionBy("batch").text(path)
    return ingest.publications(spark, path).select("pub_id", "title", "year", "authors", "retracted")
