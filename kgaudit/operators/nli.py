"""Sentence-level support of claims by abstracts.

Papers are dealt by their id once and their sentences exploded behind that; all that follows, up to a paper's sums, stays
in that partitioning: expressions, the first place of a repeated sentence, and the aggregation of a paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgaudit.functions import text as tx
from kgaudit.functions.text import DEFAULT, Lexicon

# Cap of a paper, weight of contradiction, least sum of a paper that counts, sentences of a paper.
PAPER_CAP, CONTRADICTION, COUNTS_AT, TOP = 0.8, 1.3, 0.3, 3
SUPPORT_P, AGAINST_P = 0.8, 0.1


def paper_sentences(papers: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``(paper_id, ord, sentence, section, hedged, sentence_class, sentence_polarity, paper_type)``.

    Papers are ``(paper_id, title, journal, abstract)``, one a row; those without an abstract have no sentences. A
    sentence that repeats has the place of its first occurrence. Work grows in proportion to the text.
    """
    kind = tx.paper_type(F.col("title"), F.col("journal"), F.col("abstract"), lexicon)
    split = papers.select("paper_id", "title", "journal", "abstract").repartition("paper_id").withColumn("paper_type", kind).withColumn("_all", tx.sentences(F.col("abstract")))
    rows = split.select("paper_id", "paper_type", F.size("_all").alias("_n"), F.posexplode("_all").alias("ord", "sentence"))
    rows = rows.withColumn("_first", F.min("ord").over(W.partitionBy("paper_id", "sentence")))
    s = F.col("sentence")
    return rows.select(
        "paper_id", "paper_type", "ord", "sentence",
        tx.section(s, F.col("_first"), F.col("_n"), lexicon).alias("section"),
        tx.is_hedged(s, lexicon).alias("hedged"),
        tx.predicate_class(s, lexicon).alias("sentence_class"),
        tx.sentence_polarity(s, lexicon).alias("sentence_polarity"),
    )


def sentence_labels(claims: DataFrame, cited: DataFrame, sentences: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Every sentence of every cited paper with label and weight for the claim.

    Claims are ``(claim_id, subject, object, predicate, text, tissue)``, citations ``(claim_id, paper_id)``.
    """
    claim = cited.join(claims, "claim_id").withColumns(
        {
            "claim_class": tx.predicate_class(F.col("predicate"), lexicon),
            "claim_polarity": tx.sentence_polarity(F.concat_ws(" ", "predicate", "text"), lexicon) if "text" in claims.columns else tx.polarity(F.col("predicate"), lexicon),
        }
    )
    joined = claim.join(sentences, "paper_id")
    s = F.col("sentence")
    both = tx.mentions(s, F.col("subject")) & tx.mentions(s, F.col("object"))
    label = tx.nli_label(both, F.col("sentence_polarity"), F.col("claim_polarity"))
    tissue = F.when(F.col("tissue").isNotNull() & ~F.coalesce(F.lower(s).contains(F.lower(F.substring_index("tissue", ":", -1))), F.lit(False)), tx.OTHER_TISSUE_WEIGHT).otherwise(1.0)
    weight = tx.lookup(F.col("section"), tx.SECTION_WEIGHTS) * F.when(F.col("hedged"), tx.HEDGED_WEIGHT).otherwise(1.0) * tx.predicate_factor(F.col("sentence_class"), F.col("claim_class")) * tissue
    out = joined.withColumns({"label": label, "weight": weight})
    p = lambda mine, other: F.when(F.col("label") == mine, SUPPORT_P).when(F.col("label") == other, AGAINST_P).otherwise(0.0)
    return out.withColumns({"p_support": p("SUPPORT", "REFUTE"), "p_contradict": p("REFUTE", "SUPPORT")})


def paper_margins(labelled: DataFrame) -> DataFrame:
    """Sums of the three best sentences of each paper, for and against.

    A paper's sums don't depend on which of equally good sentences is taken, so one aggregation finds them: the largest
    values of either side, a number for each sentence of one paper.
    """
    best = lambda p: F.slice(F.sort_array(F.collect_list(F.col("weight") * F.col(p)), asc=False), 1, TOP)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.col("_paper") * x)
    label = lambda x: F.count_if(F.col("label") == x)
    made = labelled.groupBy("claim_id", "paper_id").agg(
        F.first("paper_type").alias("paper_type"), F.first("claim_class").alias("claim_predicate_class"),
        best("p_support").alias("_for"), best("p_contradict").alias("_against"),
        F.count("*").alias("sentence_count"), label("SUPPORT").alias("support_count"), label("REFUTE").alias("refute_count"), label("NEI").alias("nei_count"),
        F.count_if((F.col("claim_class") == "causal") & (F.col("sentence_class") == "association")).alias("predicate_mismatch_count"),
    ).withColumn("_paper", tx.lookup(F.col("paper_type"), tx.PAPER_WEIGHTS).cast("double"))
    counts = ("sentence_count", "support_count", "refute_count", "nei_count", "predicate_mismatch_count")
    return made.select("claim_id", "paper_id", "paper_type", "claim_predicate_class", total("_for").alias("s_pos"), total("_against").alias("s_neg"), *counts)


def claim_margins(papers: DataFrame) -> DataFrame:
    """The literature's margin of each claim, every paper capped (A2, A4)."""
    total = lambda c: F.sum(F.least(F.col(c), F.lit(PAPER_CAP)))
    out = papers.groupBy("claim_id").agg(
        F.lit(True).alias("checked"), F.first("claim_predicate_class").alias("claim_predicate_class"),
        *(F.sum(c).alias(c) for c in ("sentence_count", "support_count", "refute_count", "nei_count", "predicate_mismatch_count")),
        total("s_pos").alias("s_pos_total"), total("s_neg").alias("s_neg_total"),
        F.count_if(F.col("s_pos") > COUNTS_AT).alias("n_support"), F.count_if(F.col("s_neg") > COUNTS_AT).alias("n_contradict"),
        F.collect_list(F.struct("paper_id", "paper_type", "s_pos", "s_neg")).alias("paper_aggregates"),
    )
    return out.withColumn("m_lit", F.col("s_pos_total") - CONTRADICTION * F.col("s_neg_total"))


def examples(labelled: DataFrame, n: int = 3) -> DataFrame:
    """The first sentences of each label by citation and order (A3)."""
    rank = F.row_number().over(W.partitionBy("claim_id", "label").orderBy("paper_id", "ord"))
    return labelled.withColumn("rank", rank).filter(F.col("rank") <= n).select("claim_id", "label", "rank", "paper_id", "sentence")
