"""Readers of graph, association and publication files, and the routing of edges.

Every reader is a Spark read with a projection; versions and clocks are parameters. Files may be gzipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgaudit.functions.ids import association_id, content_hash, starts_with_any

# Categories, identifier prefixes and predicates that are taken in.
NODE_CATEGORIES = ("biolink:Gene", "biolink:Disease", "biolink:PhenotypicFeature", "biolink:BiologicalProcess", "biolink:MolecularActivity", "biolink:Pathway", "biolink:CellularComponent", "biolink:AnatomicalEntity", "biolink:ChemicalEntity", "biolink:Drug", "biolink:Protein")
NODE_PREFIXES = ("HGNC:", "NCBIGene:", "MONDO:", "HP:", "GO:", "REACT:", "R-HSA-", "UBERON:", "CL:", "CHEBI:", "DRUGBANK:", "UniProtKB:")
EDGE_PREDICATES = ("gene_associated_with_condition", "causes", "contributes_to", "correlated_with", "has_phenotype", "treats", "interacts_with", "physically_interacts_with", "genetically_interacts_with", "participates_in", "active_in", "located_in", "expressed_in", "enables", "involved_in", "acts_upstream_of", "related_to", "subclass_of")


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, comment: str | None = None) -> DataFrame:
    """Tab-separated rows as strings; with ``columns`` the file has no header."""
    reader = spark.read.option("sep", "\t").option("quote", "")
    if comment:
        reader = reader.option("comment", comment)
    if columns is None:
        return reader.option("header", True).csv(path)
    return reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def listed(value: Column, separator: str = "|") -> Column:
    """Items of a list literal, of a separated string, or the one item; empty gives an empty list."""
    text = F.btrim(F.coalesce(value, F.lit("")))
    literal = F.regexp_extract_all(text, F.lit(r"""['"]([^'"]*)['"]|(-?\d+(?:\.\d+)?)"""), 0)
    items = F.when(text.startswith("[") & text.endswith("]"), F.transform(literal, lambda x: F.btrim(x, F.lit("'\"")))).otherwise(F.split(text, "\\" + separator))
    return F.filter(F.transform(items, lambda x: F.btrim(x)), lambda x: x != "")


def wanted_nodes(rows: DataFrame) -> DataFrame:
    """Rows of a category or with an identifier prefix that is taken in, identifiers case-sensitive."""
    return rows.filter(F.coalesce(F.col("category").isin(*NODE_CATEGORIES), F.lit(False)) | starts_with_any(F.col("id"), NODE_PREFIXES))


def is_wanted_predicate(predicate: Column) -> Column:
    """Bare predicates that begin with a wanted one, and prefixed ones that equal one (S3)."""
    exact = predicate.isin(*(f"biolink:{p}" for p in EDGE_PREDICATES))
    return F.coalesce(exact | starts_with_any(predicate, EDGE_PREDICATES), F.lit(False))


def nodes(rows: DataFrame) -> DataFrame:
    """Nodes with their lists split, one for each id."""
    kept = wanted_nodes(rows).filter(F.coalesce(F.col("id"), F.lit("")) != "")
    return kept.select("id", "name", "category", "description", listed(F.col("synonym")).alias("synonyms"), listed(F.col("xref")).alias("xrefs")).dropDuplicates(["id"])


def routed_edges(rows: DataFrame, known: DataFrame, version: str, source: str = "monarch") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between known nodes: reified associations, their links to publications, and direct edges.

    An edge with a PubMed identifier becomes an association; of equal ones the first by content stays.
    """
    full = rows.filter(" and ".join(f"coalesce({c}, '') <> ''" for c in ("subject", "predicate", "object"))).filter(is_wanted_predicate(F.col("predicate")))
    inside = full.join(known.select(F.col("id").alias("subject")), "subject", "left_semi").join(known.select(F.col("id").alias("object")), "object", "left_semi")
    pmids = F.filter(listed(F.col("publications")), lambda p: p.startswith("PMID:"))
    content = (F.col("subject"), F.col("predicate"), F.col("object"), F.lit(source), F.lit(version))
    told = inside.select("subject", "predicate", "object", F.array_distinct(pmids).alias("pmids"), association_id(*content).alias("association_id"), content_hash(*content).alias("record_hash"), F.lit(source).alias("source_db"), F.lit(version).alias("db_version"))
    reified = told.filter(F.size("pmids") > 0)
    associations = reified.drop("pmids").dropDuplicates(["association_id"])
    links = reified.select("association_id", F.explode("pmids").alias("pub_id")).distinct()
    direct = told.filter(F.size("pmids") == 0).drop("pmids", "association_id").dropDuplicates(["subject", "predicate", "object"])
    return associations, links, direct


def gene_map(rows: DataFrame) -> DataFrame:
    """``(ncbi_id, hgnc_id)``; of several, the largest hgnc id."""
    both = rows.filter("coalesce(entrez_id, '') <> '' and coalesce(hgnc_id, '') <> ''")
    return both.groupBy(F.concat(F.lit("NCBIGene:"), "entrez_id").alias("ncbi_id")).agg(F.max("hgnc_id").alias("hgnc_id"))


def mapped_gene(rows: DataFrame, column: str, genes: DataFrame) -> DataFrame:
    """Replaces NCBI ids by HGNC ids where they are known."""
    bare = F.regexp_replace(F.col(column), "^NCBIGene:", "")
    keyed = rows.withColumn("ncbi_id", F.concat(F.lit("NCBIGene:"), bare)).join(genes, "ncbi_id", "left")
    return keyed.withColumn(column, F.coalesce("hgnc_id", "ncbi_id")).drop("ncbi_id", "hgnc_id")


def gene_phenotypes(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene to phenotype edges ``(gene_id, hpo_id)``."""
    told = mapped_gene(rows.filter("coalesce(gene_id, '') <> '' and coalesce(hpo_id, '') <> ''"), "gene_id", genes)
    return told.select(F.col("gene_id").alias("subject"), F.lit("biolink:has_phenotype").alias("predicate"), F.col("hpo_id").alias("object")).distinct()


def disease_phenotypes(rows: DataFrame) -> DataFrame:
    """Disease to phenotype rows in the shape that ``routed_edges`` takes; negated ones drop out."""
    kept = rows.filter("coalesce(qualifier, '') <> 'NOT' and coalesce(database_id, '') <> '' and coalesce(hpo_id, '') <> ''")
    disease = F.regexp_replace("database_id", "^ORPHA:", "Orphanet:")
    refs = F.array_join(F.filter(listed(F.col("reference"), ";"), lambda r: r.startswith("PMID:")), "|")
    return kept.select(disease.alias("subject"), F.lit("biolink:has_phenotype").alias("predicate"), F.col("hpo_id").alias("object"), refs.alias("publications"))


def gene_pathways(rows: DataFrame, genes: DataFrame | None = None, species: str = "Homo sapiens", gene_prefix: str = "UniProtKB:") -> DataFrame:
    """Gene or protein to pathway edges of one species."""
    kept = rows.filter((F.col("species") == species) & (F.coalesce("gene_id", F.lit("")) != ""))
    pathway = F.when(F.col("pathway_id").startswith("R-"), F.col("pathway_id")).otherwise(F.concat(F.lit("REACT:"), "pathway_id"))
    told = mapped_gene(kept, "gene_id", genes) if genes is not None else kept.withColumn("gene_id", F.concat(F.lit(gene_prefix), "gene_id"))
    return told.select(F.col("gene_id").alias("subject"), F.lit("biolink:participates_in").alias("predicate"), pathway.alias("object")).distinct()


def gene_diseases(rows: DataFrame, version: str) -> DataFrame:
    """Associations of genes with diseases, with scores; a score that is no number counts 0."""
    disease = F.when(F.col("disease_id").startswith("UMLS:"), F.col("disease_id")).otherwise(F.concat(F.lit("UMLS:"), F.regexp_replace("disease_id", "^UMLS_", "")))
    told = rows.select(F.col("gene_id").alias("subject"), F.lit("biolink:gene_associated_with_condition").alias("predicate"), disease.alias("object"), F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"))
    content = (F.col("subject"), F.col("predicate"), F.col("object"), F.lit("disgenet"), F.lit(version))
    return told.withColumn("association_id", association_id(*content)).groupBy("association_id", "subject", "predicate", "object").agg(F.max("score").alias("score"))


def gene_role(role: Column) -> Column:
    """Class of a gene by its census role."""
    text = F.lower(role)
    oncogene, suppressor = text.contains("oncogene"), text.contains("tsg")
    return F.when(oncogene & suppressor, "both").when(oncogene, "oncogene").when(suppressor, "tumor_suppressor").when(text.contains("fusion"), "fusion").otherwise("unknown")


def gene_census(rows: DataFrame) -> DataFrame:
    """``(symbol, gene_id, role_class, tier, name, synonyms)`` by upper-case symbol; the first row of a symbol stays."""
    symbol = F.upper(F.btrim("GENE_SYMBOL"))
    gene = F.when(F.coalesce("HGNC_ID", F.lit("")) != "", F.concat(F.lit("HGNC:"), F.regexp_replace("HGNC_ID", "^HGNC:", ""))).otherwise(F.concat(F.lit("COSMIC:"), symbol))
    told = rows.select(symbol.alias("symbol"), gene.alias("gene_id"), gene_role(F.col("ROLE_IN_CANCER")).alias("role_class"), F.coalesce(F.col("TIER").try_cast("int"), F.lit(2)).alias("tier"), F.col("NAME").alias("name"), listed(F.col("SYNONYMS"), ",").alias("synonyms"), F.monotonically_increasing_id().alias("_n"))
    return told.withColumn("_r", F.row_number().over(W.partitionBy("symbol").orderBy("_n"))).filter("_r = 1").drop("_r", "_n")


def census_lookup(symbols: DataFrame, census: DataFrame) -> DataFrame:
    """Census rows by symbol, else by synonym; of several synonyms' owners the first symbol."""
    by_name = census.select(F.col("symbol").alias("key"), F.struct("symbol", "gene_id", "role_class", "tier").alias("own"))
    by_synonym = census.select(F.explode(F.transform("synonyms", lambda x: F.upper(x))).alias("key"), F.struct("symbol", "gene_id", "role_class", "tier").alias("other"))
    by_synonym = by_synonym.groupBy("key").agg(F.min("other").alias("other"))
    keyed = symbols.withColumn("key", F.upper(F.btrim("symbol"))).join(by_name, "key", "left").join(by_synonym, "key", "left")
    return keyed.withColumn("census", F.coalesce("own", "other")).drop("own", "other", "key")


def authors_line(names: Column) -> Column:
    """Up to three authors, and ``et al.`` after the first of more."""
    return F.when(F.size(names) > 3, F.concat(names[0], F.lit(" et al."))).otherwise(F.array_join(names, ", "))


def publications(spark: SparkSession, path: str) -> DataFrame:
    """``(pub_id, title, authors, journal, year, retracted)`` of article XML."""
    schema = """MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>,
      AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>, PublicationTypeList: struct<PublicationType: array<string>>>,
      CommentsCorrectionsList: struct<CommentsCorrections: array<struct<_RefType: string>>>>"""
    rows = spark.read.option("rowTag", "PubmedArticle").option("ignoreNamespace", True).schema(schema).xml(path)
    a = "MedlineCitation.Article"
    names = F.filter(F.transform(f"{a}.AuthorList.Author", lambda x: F.btrim(F.concat_ws(" ", x["ForeName"], x["LastName"]))), lambda x: x != "")
    kind = F.exists(F.coalesce(f"{a}.PublicationTypeList.PublicationType", F.array().cast("array<string>")), lambda x: x.contains("Retracted Publication"))
    notice = F.exists(F.coalesce("MedlineCitation.CommentsCorrectionsList.CommentsCorrections", F.array().cast("array<struct<_RefType: string>>")), lambda x: x["_RefType"] == "RetractionIn")
    return rows.select(
        F.concat(F.lit("PMID:"), "MedlineCitation.PMID").alias("pub_id"), F.col(f"{a}.ArticleTitle").alias("title"), authors_line(names).alias("authors"),
        F.col(f"{a}.Journal.Title").alias("journal"), F.col(f"{a}.Journal.JournalIssue.PubDate.Year").try_cast("int").alias("year"),
        (F.coalesce(kind, F.lit(False)) | F.coalesce(notice, F.lit(False))).alias("retracted"),
    )


def needs_enrichment(pubs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Publications without a title that were not fetched yet."""
    return pubs.filter("title is null").join(fetched.select("pub_id"), "pub_id", "left_anti")


def cites_retracted_counts(pubs: DataFrame, cites: DataFrame) -> DataFrame:
    """Publications with the number of distinct retracted ones that they cite."""
    gone = pubs.filter("retracted").select(F.col("pub_id").alias("cited"))
    n = cites.select("citing", "cited").distinct().join(gone, "cited", "left_semi").groupBy(F.col("citing").alias("pub_id")).agg(F.count("*").alias("cites_retracted_count"))
    return pubs.join(n, "pub_id", "left").na.fill(0, ["cites_retracted_count"])


def retraction_status(works: DataFrame) -> DataFrame:
    """``(doi, notice_status)`` of works ``(doi, type, retracted_by array, updates array<struct<type>>)``.

    A retracting relation comes first, then the first update of a known kind, then the work's own type.
    """
    kinds = {"retraction": "retracted", "expression_of_concern": "concern", "expression-of-concern": "concern", "correction": "correction", "erratum": "correction"}
    names = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    known = F.filter(F.transform(F.coalesce("updates", F.array().cast(works.schema["updates"].dataType)), lambda u: names[F.lower(u["type"])]), lambda k: k.isNotNull())
    status = F.when(F.size(F.coalesce("retracted_by", F.array().cast("array<string>"))) > 0, "retracted").when(F.size(known) > 0, F.element_at(known, 1)).when(F.lower("type") == "retraction", "retracted").otherwise("none")
    return works.select("doi", status.alias("notice_status"))


def seed_edges(genes: DataFrame, others: DataFrame, citations: DataFrame, every: int, shift: int, as_of_year: int = 2024) -> DataFrame:
    """A generated graph of every gene ``(g, id)`` with every other term ``(d, id)``, citations dealt in turn.

    Both sides are small dictionaries; each ``every``-th pair gets a second edge with another citation.
    """
    n = F.lit(citations.count())
    base = genes.select("g", F.col("id").alias("subject")).crossJoin(F.broadcast(others.select("d", F.col("id").alias("object"))))
    first = base.withColumns({"no": (F.col("g") + F.col("d")) % n, "confidence": F.round(0.68 + 0.01 * ((F.col("g") + F.col("d")) % 18), 3), "predicate": F.when(F.col("d") % 3 == 0, "biolink:contributes_to").otherwise("biolink:related_to")})
    second = first.filter((F.col("g") + F.col("d")) % every == 0).withColumns({"no": (F.col("g") * 2 + F.col("d") + shift) % n, "confidence": F.round(F.col("confidence") + 0.05, 3), "predicate": F.lit("biolink:biomarker_for")})
    told = first.union(second).join(F.broadcast(citations), "no")
    return told.select("subject", "predicate", "object", "confidence", "pmid", F.greatest(F.lit(0.0), (as_of_year - F.col("year")).cast("double")).alias("evidence_age"))


def replace_source(df: DataFrame, path: str) -> None:
    """Overwrite the partitions of the sources in ``df``, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_db").parquet(path)
