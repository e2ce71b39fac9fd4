"""Normalisation of claims to typed triples.

A claim is a row; what it says about its subject and object is resolved by joins with label and identifier tables, in
an order of precedence that is a coalesce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgaudit.functions import text as tx
from kgaudit.functions.ids import category_of, has_category
from kgaudit.sources.ingest import census_lookup

#: Characters of a label's beginning by which texts are looked up.
START = 4
#: Labels that are looked for one by one.
FEW = 64
FALLBACK, CONDITION = "biolink:related_to", "biolink:gene_associated_with_condition"
# Keys that identify a piece of evidence, in order, and prefixes of stances.
EVIDENCE_KEYS = ("pmid", "pmcid", "doi", "id", "curie", "url", "type")
SUPPRESSORS, ONCOGENES = ("tumor_suppressor", "both"), ("oncogene", "both")
AGAINST, FOR = ("refute", "contradict"), ("support", "corroborates", "backs")


def label_index(edges: DataFrame) -> DataFrame:
    """``(key, id, label)``: the node that bears a label, by lower case; the last in edge order stays."""
    ends = edges.select(F.col("subject").alias("id"), F.col("subject_label").alias("label"), "ord").union(edges.select("object", "object_label", "ord"))
    named = ends.filter("coalesce(label, '') <> ''").groupBy(F.lower("label").alias("key"))
    return named.agg(F.max_by(F.struct("id", "label"), F.struct("ord", "id")).alias("n")).select("key", "n.id", "n.label")


def resolved(claims: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """Adds ``<column>_id``, ``<column>_label`` and ``<column>_category`` of a payload struct ``(id, label, mention)``.

    An id that is given stands; else the label or mention is looked up; else a mention with a colon is taken as an id.
    """
    p = lambda f: F.when(F.btrim(F.col(f"{column}.{f}")) != "", F.btrim(F.col(f"{column}.{f}")))
    said = F.coalesce(p("label"), p("mention"))
    found = index.select(F.col("key").alias("_key"), F.col("id").alias("_id"), F.col("label").alias("_label"))
    joined = claims.withColumn("_said", F.lower(said)).join(found, F.col("_said") == F.col("_key"), "left")
    ident = F.coalesce(p("id"), F.col("_id"), F.when(said.contains(":"), said))
    out = joined.withColumns({f"{column}_id": ident, f"{column}_label": F.coalesce(p("label"), F.col("_label"), said, ident)})
    return out.withColumn(f"{column}_category", category_of(F.coalesce(f"{column}_id", F.lit("")))).drop("_said", "_key", "_id", "_label")


def from_evidence(evidence: Column) -> Column:
    """``(subject, object)`` from identifiers among the evidence: a gene and a phenotype or disease, else two of these."""
    of = lambda *prefixes: F.filter(evidence, lambda e: tx.either([F.upper(e).startswith(p) for p in prefixes]))
    genes, phenotypes, diseases = of("HGNC:", "NCBIGENE:"), of("HP:"), of("MONDO:")
    both = F.concat(phenotypes, diseases)
    pair = lambda a, b: F.struct(a.alias("subject"), b.alias("object"))
    gene, first, second = F.get(genes, F.lit(0)), F.get(both, F.lit(0)), F.get(both, F.lit(1))
    return F.when(gene.isNotNull() & first.isNotNull(), pair(gene, first)).when(second.isNotNull(), pair(first, second))


def promoted_pathway(object_id: Column, evidence: Column) -> Column:
    """The object, or the first pathway among the evidence where the object is none."""
    pathways = F.filter(evidence, lambda e: has_category(e, "pathway"))
    return F.when(category_of(object_id) != "pathway", F.coalesce(F.get(pathways, F.lit(0)), object_id)).otherwise(object_id)


def inferred_predicate(predicate: Column, subject_category: Column, object_category: Column) -> Column:
    """The predicate, or the condition predicate for a gene and a condition where none is given."""
    general = F.coalesce(predicate, F.lit("")).isin("", FALLBACK)
    return F.when(general & (subject_category == "gene") & object_category.isin("disease", "phenotype"), CONDITION).when(F.coalesce(predicate, F.lit("")) == "", FALLBACK).otherwise(predicate)


def evidence_identifier(item: Column) -> Column:
    """The first key of a piece of evidence (a map) that is given."""
    return F.coalesce(*(F.when(F.btrim(item[k]) != "", F.btrim(item[k])) for k in EVIDENCE_KEYS))


def stance(text: Column) -> Column:
    """``refute``, ``support`` or ``neutral``."""
    lowered = F.lower(F.btrim(text))
    starts = lambda words: tx.either([lowered.startswith(w) for w in words])
    return F.when(starts(AGAINST), "refute").when(starts(FOR), "support").otherwise("neutral")


def citations_of(text: Column, given: Column) -> Column:
    """Citations that are given and those in the text, each once in order."""
    return F.array_distinct(F.concat(F.coalesce(given, F.array().cast("array<string>")), tx.citations(text)))


def spotted(claims: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """The first labels of a dictionary ``(id, label)`` in every claim's text, by where they stand.

    A label matches as a part of the text, whatever characters it holds, in lower case; empty labels match nothing. Up to
    ``FEW`` labels go to every task as one row and are looked for in place. With more of them, the
    distinct stretches of ``START`` characters of a text are joined with the labels that begin so, and the whole label is
    looked for in the texts that are left. So a large dictionary costs no product with the claims, and a text of
    n characters makes at most n rows, however long its words are. Labels shorter than that have keys of their own.
    """
    label, text = F.lower("label"), F.lower("text")
    rank = F.row_number().over(W.partitionBy("claim_id").orderBy("at", "id"))
    few = dictionary.filter(F.length("label") > 0).limit(FEW + 1).count() <= FEW
    if few:
        all_of = dictionary.filter(F.length("label") > 0).agg(F.collect_list(F.struct("id", "label", label.alias("low"))).alias("all"))
        held = claims.select("claim_id", text.alias("low")).crossJoin(F.broadcast(all_of))
        here = F.filter(F.transform("all", lambda d: F.struct(d["id"].alias("id"), d["label"].alias("label"), F.instr(F.col("low"), d["low"]).alias("at"))), lambda d: d["at"] > 0)
        hits = held.select("claim_id", F.explode(here).alias("d")).select("claim_id", "d.id", "d.label", "d.at")
        return hits.withColumn("rank", rank).filter(F.col("rank") <= most)
    named = dictionary.filter(F.length("label") > 0).select("id", "label", F.substring(label, 1, START).alias("key"))
    lengths = [r["n"] for r in named.select(F.char_length("key").alias("n")).distinct().collect()]  # at most START rows
    stretches = F.concat(F.array().cast("array<string>"), *(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)) for n in sorted(lengths)))
    keys = claims.select("claim_id", F.explode(stretches).alias("key"))
    likely = keys.join(named, "key").select("claim_id", "id", "label")
    hits = likely.join(claims.select("claim_id", "text"), "claim_id").withColumn("at", F.instr(text, F.lower(F.col("label")))).filter("at > 0").select("claim_id", "id", "label", "at")
    return hits.withColumn("rank", rank).filter(F.col("rank") <= most)


def normalised(claims: DataFrame, index: DataFrame) -> DataFrame:
    """Triples of claims ``(claim_id, text, subject, object, predicate, evidence)``.

    What the payload names comes first, then identifiers among the evidence; the object gives way to a pathway of the
    evidence, and the predicate is inferred last. ``is_low_confidence`` is true where an end is missing.
    """
    out = resolved(resolved(claims, "subject", index), "object", index)
    out = out.withColumn("_pair", F.when(F.col("subject_id").isNull() | F.col("object_id").isNull(), from_evidence(F.col("evidence"))))
    out = out.withColumns({"subject_id": F.coalesce("subject_id", "_pair.subject"), "object_id": F.coalesce("object_id", "_pair.object")})
    out = out.withColumn("object_id", promoted_pathway(F.col("object_id"), F.coalesce("evidence", F.array().cast("array<string>"))))
    out = out.withColumns({f"{c}_category": category_of(F.coalesce(f"{c}_id", F.lit(""))) for c in ("subject", "object")})
    predicate = inferred_predicate(F.col("predicate"), F.col("subject_category"), F.col("object_category"))
    mention = lambda c: F.coalesce(f"{c}.mention", f"{c}_label", F.lit(""))
    narrative = F.when(predicate == CONDITION, tx.between_mentions(F.col("text"), mention("subject"), mention("object")))
    return out.withColumns(
        {
            "_predicate": predicate,
            "association_narrative": narrative,
            "has_variant_context": (predicate == CONDITION) & tx.has_variant_context(F.col("text")),
            "is_low_confidence": F.col("subject_id").isNull() | F.col("object_id").isNull(),
            "predicate_is_fallback": predicate == FALLBACK,
            "citations": citations_of(F.col("text"), F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: has_category(e, "publication"))),
        }
    ).drop("predicate", "_pair").withColumnRenamed("_predicate", "predicate")


def type_facts(subject_category: Column, object_category: Column, predicate: Column) -> dict[str, Column]:
    """Whether the categories fit the predicate; only the condition predicate asks for some."""
    asked = predicate == CONDITION
    return {"domain_valid": ~asked | (subject_category == "gene"), "range_valid": ~asked | object_category.isin("disease", "phenotype")}


def curated_matches(pairs: DataFrame, associations: DataFrame, least_score: float = 0.3) -> DataFrame:
    """``(pair_id, matched_cui)`` of the pairs ``(pair_id, gene_id, cuis)`` that curated associations ``(gene_id, cui, score)`` hold."""
    bare = lambda c: F.regexp_replace(F.upper(c), "^UMLS[:_]", "")
    strong = associations.filter(F.col("score") >= least_score).select(F.col("gene_id").alias("_g"), bare(F.col("cui")).alias("_c"))
    asked = pairs.select("pair_id", "gene_id", F.posexplode("cuis").alias("_n", "cui"))
    hits = asked.join(strong.distinct(), (F.col("gene_id") == F.col("_g")) & (bare(F.col("cui")) == F.col("_c")))
    return hits.groupBy("pair_id").agg(F.min_by("cui", "_n").alias("matched_cui"))


def curated_support(pairs: DataFrame, associations: DataFrame, least_score: float = 0.3) -> DataFrame:
    """Adds whether curated gene-disease associations ``(gene_id, cui, score)`` hold a pair.

    Disease identifiers are compared without their prefix; ``matched_cui`` is the first of those that match.
    """
    return pairs.join(curated_matches(pairs, associations, least_score), "pair_id", "left").withColumn("disgenet_support", F.col("matched_cui").isNotNull())


def literature_counts(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """``(pair_id, structured_source_count)`` of the pairs ``(pair_id, subject, object, predicate)`` that triples hold.

    A triple's sources travel as the list that they are.
    """
    hits = triples.withColumnRenamed("predicate", "_p").join(pairs.select("pair_id", "subject", "object", "predicate"), ["subject", "object"])
    each = lambda lists: F.size(F.array_compact(F.array_distinct(F.flatten(F.collect_list(lists)))))
    found = hits.groupBy("pair_id").agg(each(F.when(F.col("_p") == F.col("predicate"), F.col("sources"))).alias("_e"), each(F.col("sources")).alias("_a"))
    return found.select("pair_id", F.when(F.col("_e") > 0, F.col("_e")).otherwise(F.col("_a")).alias("structured_source_count"))


def literature_facts(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """Adds the sources of literature triples ``(subject, predicate, object, sources)`` for each pair.

    Triples of the claim's predicate count; only where there are none, those of any predicate do.
    """
    n = F.coalesce("structured_source_count", F.lit(0))
    return pairs.join(literature_counts(pairs, triples), "pair_id", "left").withColumns({"structured_source_count": n, "has_structured_support": n > 0})


def polarity_conflict(pairs: DataFrame, context: DataFrame, lexicon: tx.Lexicon = tx.DEFAULT) -> DataFrame:
    """Adds whether known edges of a pair, in either direction, all have the polarity opposite to the claim's.

    Pairs are ``(pair_id, subject, object, predicate)``, context ``(pair_id, predicate)``; ``context_edges`` is the number
    of known edges, null where there are none.
    """
    mine = context.select("pair_id", tx.polarity(F.col("predicate"), lexicon).alias("p")).groupBy("pair_id")
    counts = mine.agg(F.count("*").alias("context_edges"), F.count_if(F.col("p") == "positive").alias("_pos"), F.count_if(F.col("p") == "negative").alias("_neg"))
    pure = F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), "mixed").when(F.col("_pos") > 0, "positive").when(F.col("_neg") > 0, "negative")
    out = pairs.join(counts, "pair_id", "left").withColumns({"claim_predicate_polarity": tx.polarity(F.col("predicate"), lexicon), "context_polarity": pure})
    opposite = F.col("context_polarity").isin("positive", "negative") & (F.col("context_polarity") != F.col("claim_predicate_polarity"))
    return out.withColumn("opposite_predicate_same_context", F.coalesce(opposite, F.lit(False))).drop("_pos", "_neg")


def gene_facts(claims: DataFrame, census: DataFrame) -> DataFrame:
    """Adds the struct ``gene`` to claims ``(subject_category, symbol)`` by the cancer gene census.

    Only genes are looked up; a gene of both roles is an oncogene and a tumour suppressor.
    """
    looked = census_lookup(claims.withColumn("_symbol", F.col("symbol")).withColumn("symbol", F.when(F.col("subject_category") == "gene", F.col("symbol"))), census)
    role = F.coalesce(F.when(F.col("census").isNotNull(), F.col("census.role_class")), F.lit("unknown"))
    checked = F.col("subject_category") == "gene"
    facts = F.struct(
        checked.alias("cosmic_checked"), F.col("census").isNotNull().alias("is_cancer_gene"), role.alias("function_class"),
        role.isin(*SUPPRESSORS).alias("is_tumor_suppressor"), role.isin(*ONCOGENES).alias("is_oncogene"), F.when(checked, F.coalesce("symbol", F.lit(""))).otherwise("").alias("gene_symbol"),
    )
    return looked.withColumn("gene", facts).drop("census", "symbol").withColumnRenamed("_symbol", "symbol")


def census_list(census: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Symbols of the census in one of the roles."""
    return census.filter(F.col("role_class").isin(*roles)).select("symbol")
