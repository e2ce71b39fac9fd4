"""Ontology checks as joins with small axiom tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Roots that do not make two terms siblings, by prefix.
ROOTS = {"HP": ("HP:0000118", "HP:0000001"), "MONDO": ("MONDO:0000001",), "GO": ("GO:0003674", "GO:0008150", "GO:0005575")}

# The default axioms. Classes with what they are disjoint with.
CLASSES = {
    "gene": ["disease", "phenotype", "tissue", "publication"],
    "disease": ["gene", "phenotype", "pathway", "tissue", "publication"],
    "phenotype": ["gene", "disease", "pathway", "tissue", "publication"],
    "pathway": ["disease", "phenotype", "tissue", "publication"],
    "tissue": ["gene", "disease", "phenotype", "pathway", "publication"],
    "publication": ["gene", "disease", "phenotype", "pathway", "tissue"],
}
# Predicates with domain and range.
PROPERTIES = {
    "biolink:gene_associated_with_condition": (["gene"], ["disease", "phenotype"]),
    "biolink:causes": (["gene", "disease", "pathway"], ["disease", "phenotype"]),
    "biolink:expressed_in": (["gene"], ["tissue"]),
    "biolink:participates_in": (["gene"], ["pathway"]),
    "biolink:part_of": (["pathway", "tissue", "phenotype"], ["pathway", "tissue", "phenotype"]),
    "biolink:has_phenotype": (["disease", "gene"], ["phenotype"]),
    "biolink:located_in": (["gene", "pathway"], ["tissue"]),
    "biolink:regulates": (["gene", "pathway"], ["gene", "pathway"]),
    "biolink:positively_regulates": (["gene", "pathway"], ["gene", "pathway"]),
    "biolink:negatively_regulates": (["gene", "pathway"], ["gene", "pathway"]),
    "biolink:interacts_with": (["gene"], ["gene"]),
    "biolink:related_to": (["gene", "disease", "phenotype", "pathway", "tissue"], ["gene", "disease", "phenotype", "pathway", "tissue"]),
}
# Chains of two predicates.
CHAINS = {
    "gene_pathway_tissue_expression": ("biolink:participates_in", "biolink:located_in"),
    "gene_phenotype_disease_association": ("biolink:causes", "biolink:part_of"),
    "gene_regulates_disease_gene": ("biolink:regulates", "biolink:gene_associated_with_condition"),
}
# Restrictions: kind, class, predicate, allowed classes, whether evidence is required.
RESTRICTIONS = (
    ("existential", "disease", "biolink:has_phenotype", [], False),
    ("universal", "gene", "biolink:expressed_in", ["tissue"], False),
    ("existential", "gene", "biolink:gene_associated_with_condition", [], True),
    ("universal", "gene", "biolink:participates_in", ["pathway"], False),
)


@dataclass(frozen=True)
class Axioms:
    """Classes, properties, chains and restrictions."""

    classes: dict[str, list[str]] = field(default_factory=lambda: dict(CLASSES))
    properties: dict[str, tuple[list[str], list[str]]] = field(default_factory=lambda: dict(PROPERTIES))
    chains: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(CHAINS))
    restrictions: tuple = RESTRICTIONS

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The tables that the checks join with, as constants of the plan, so that the planner knows how small they are."""

        def made(rows: list[tuple], schema: str) -> DataFrame:
            cell = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
            one = [F.struct(*map(cell, r)).cast(f"struct<{schema}>") for r in rows]
            return spark.range(0, 1, 1, 1).select(F.inline(F.array(*one).cast(f"array<struct<{schema}>>")))

        return (
            made(list(self.classes.items()), "name string, disjoint_with array<string>"),
            made([(i, p, *ends) for i, (p, ends) in enumerate(self.properties.items())], "ord int, predicate string, domain array<string>, range array<string>"),
            made([(i, *steps) for i, steps in self.chains.items()], "chain_id string, first string, second string"),
            made(list(self.restrictions), "kind string, on_class string, on_property string, allowed array<string>, requires_evidence boolean"),
        )


def load_axioms(path: str) -> Axioms:
    """Axioms of a YAML file with ``classes``, ``object_properties``, ``property_chains`` and ``restrictions``.

    Chains of other than two steps are left out; a restriction's class is ``on_class`` or ``domain``.
    """
    import yaml

    with open(path, encoding="utf-8") as f:
        spec = yaml.safe_load(f) or {}
    many = lambda x: [x] if isinstance(x, str) else list(x or [])
    chains = {c["id"]: tuple(s["predicate"] for s in c["chain"]) for c in spec.get("property_chains") or []}
    return Axioms(
        {name: many((c or {}).get("disjoint_with")) for name, c in (spec.get("classes") or {}).items()},
        {name: (many((p or {}).get("domain")), many((p or {}).get("range"))) for name, p in (spec.get("object_properties") or {}).items()},
        {name: steps for name, steps in chains.items() if len(steps) == 2},
        tuple((r["kind"], r.get("on_class", r.get("domain", "")), r.get("on_property", r.get("property", "")), many(r.get("allowed_fillers")), bool(r.get("requires_evidence"))) for r in spec.get("restrictions") or []),
    )


def check_all(rows: DataFrame, edges: DataFrame, axioms: Axioms = Axioms(), asked: DataFrame | None = None) -> DataFrame:
    """Adds the struct ``dl`` of all checks to ``(pair_id, subject, object, predicate, subject_class, object_class, has_evidence)``.

    ``edges`` are those known around the pairs, ``asked`` the pairs with their classes from a smaller plan. A class that is
    disjoint with itself is violated by whatever bears it. Axioms are held against the distinct kinds of pairs, by classes,
    predicate and whether there is evidence; a pair is joined with its kind once.
    """
    classes, properties, chains, restricted = axioms.tables(rows.sparkSession)
    asked = rows if asked is None else asked
    kinds = asked.select("subject_class", "object_class", "predicate").distinct().withColumn("has_evidence", F.explode(F.array(F.lit(True), F.lit(False), F.lit(None))))
    judged = restrictions(domain_range(disjoint_pairs(kinds, classes), properties), restricted)
    alike = F.lit(True)
    for c in kinds.columns:
        judged = judged.withColumnRenamed(c, f"_{c}")
        alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = property_chains(rows.join(judged, alike, "left").drop(*(f"_{c}" for c in kinds.columns)), edges, chains, asked)
    impossible = [name for name, others in axioms.classes.items() if name in others]
    own = lambda c: F.coalesce(F.col(c).isin(impossible), F.lit(False)) if impossible else F.lit(False)
    facts = ["disjoint_pair_violation", "domain_valid", "range_valid", "property_chain_support", "property_chain_conflict", "universal_violation", "existential_violation"]
    dl = F.struct(own("subject_class").alias("disjoint_subject_violation"), own("object_class").alias("disjoint_object_violation"), *facts)
    return out.withColumn("dl", dl).drop("disjoint_witness", *facts)


def disjoint_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``disjoint_pair_violation`` and its witness for ``(subject_class, object_class)``.

    Classes are ``(name, disjoint_with array)``; an axiom counts in both orientations.
    """
    pairs = classes.select(F.col("name").alias("_a"), F.explode("disjoint_with").alias("_b"))
    both = pairs.union(pairs.select("_b", "_a")).distinct().withColumn("_hit", F.lit(True))
    joined = rows.join(both, (F.col("subject_class") == F.col("_a")) & (F.col("object_class") == F.col("_b")), "left")
    witness = F.when(F.col("_hit"), F.array("subject_class", "object_class"))
    return joined.withColumns({"disjoint_pair_violation": F.coalesce("_hit", F.lit(False)), "disjoint_witness": witness}).drop("_a", "_b", "_hit")


def domain_range(rows: DataFrame, properties: DataFrame) -> DataFrame:
    """Adds ``domain_valid`` and ``range_valid`` of ``(predicate, subject_class, object_class)``.

    Properties are ``(ord, predicate, domain array, range array)``. An exact name wins, else the first whose whole
    name or part behind the last colon is equal but for case; unknown predicates and empty lists are valid. Rows are
    joined with the axioms twice and never with themselves.
    """
    short = lambda c: F.lower(F.substring_index(c, ":", -1))
    ends = F.min_by(F.struct(F.col("domain").alias("d"), F.col("range").alias("r")), "ord")
    exact = properties.groupBy(F.col("predicate").alias("_p")).agg(ends.alias("_exact"))
    like = properties.groupBy(short("predicate").alias("_k")).agg(ends.alias("_like"))
    joined = rows.join(exact, F.col("predicate") == F.col("_p"), "left").join(like, short("predicate") == F.col("_k"), "left").withColumn("_axiom", F.coalesce("_exact", "_like"))
    fits = lambda axiom, c: F.coalesce((F.size(axiom) == 0) | F.array_contains(axiom, F.col(c)), F.lit(True))
    return joined.withColumns({"domain_valid": fits(F.col("_axiom.d"), "subject_class"), "range_valid": fits(F.col("_axiom.r"), "object_class")}).drop("_axiom", "_exact", "_like", "_p", "_k")


def chain_facts(pairs: DataFrame, edges: DataFrame, chains: DataFrame) -> DataFrame:
    """``(pair_id, ended_at_object, ended_elsewhere)`` of the pairs from whose subject a chain of two edges starts.

    Only edges of the chains' predicates meet the pairs.
    """
    fits = lambda a, b: F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))
    used = edges.select("predicate").distinct()
    step = lambda name: chains.join(used, fits(F.col(name), F.col("predicate"))).select("chain_id", F.col("predicate").alias(name))
    e1 = edges.select("subject", F.col("predicate").alias("first"), F.col("object").alias("middle"))
    e2 = edges.select(F.col("subject").alias("middle"), F.col("predicate").alias("second"), F.col("object").alias("end"))
    began = pairs.select("pair_id", "subject", "object").join(e1.join(F.broadcast(step("first")), "first"), "subject")
    ended = began.join(e2.join(F.broadcast(step("second")), "second"), ["chain_id", "middle"])
    return ended.groupBy("pair_id").agg(F.bool_or(F.col("end") == F.col("object")).alias("ended_at_object"), F.bool_or(F.col("end") != F.col("object")).alias("ended_elsewhere"))


def property_chains(pairs: DataFrame, edges: DataFrame, chains: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Adds ``property_chain_support`` and ``property_chain_conflict`` for each pair ``(pair_id, subject, object)``.

    Chains are ``(chain_id, first, second)`` predicates; a step fits where either name is part of the other. A chain
    from the subject that ends at the object supports the pair, one that ends elsewhere conflicts. ``asked`` are the
    same pairs from a smaller plan, if there is one.
    """
    found = chain_facts(pairs if asked is None else asked, edges, chains)
    told = {"property_chain_support": F.coalesce("ended_at_object", F.lit(False)), "property_chain_conflict": F.coalesce("ended_elsewhere", F.lit(False))}
    return pairs.join(found, "pair_id", "left").withColumns(told).drop("ended_at_object", "ended_elsewhere")


def restrictions(rows: DataFrame, axioms: DataFrame) -> DataFrame:
    """Adds ``universal_violation`` and ``existential_violation``.

    Rows are ``(subject_class, predicate, object_class, has_evidence)``, axioms
    ``(kind, on_class, on_property, allowed array, requires_evidence)``. The existential kind doesn't look at the
    predicate. The axioms of a class are one array, so rows are joined once.
    """
    of_class = axioms.groupBy(F.col("on_class").alias("_class")).agg(F.collect_list(F.struct("kind", "on_property", "allowed", "requires_evidence")).alias("_axioms"))
    joined = rows.join(of_class, F.col("subject_class") == F.col("_class"), "left")
    p = F.lower("predicate")
    universal = lambda a: (a["kind"] == "universal") & (p.contains(F.lower(a["on_property"])) | F.lower(a["on_property"]).contains(p)) & ~F.array_contains(a["allowed"], F.col("object_class"))
    existential = lambda a: (a["kind"] == "existential") & a["requires_evidence"] & ~F.col("has_evidence")
    some = lambda holds: F.coalesce(F.exists("_axioms", lambda a: F.coalesce(holds(a), F.lit(False))), F.lit(False))
    return joined.withColumns({"universal_violation": some(universal), "existential_violation": some(existential)}).drop("_class", "_axioms")


def normal_ancestors(ids: Column) -> Column:
    """Ancestor identifiers trimmed, in upper case, each once."""
    return F.array_distinct(F.transform(F.filter(ids, lambda x: x.contains(":")), lambda x: F.upper(F.trim(x))))


def sibling_conflict(subject: dict[str, Column], obj: dict[str, Column], predicate: Column, roots: dict = ROOTS) -> Column:
    """Whether two terms are siblings: one category, neither above the other, a common ancestor that is no root."""
    mine, theirs = normal_ancestors(subject["ancestors"]), normal_ancestors(obj["ancestors"])
    a, b = F.upper(subject["id"]), F.upper(obj["id"])
    prefix = F.substring_index(a, ":", 1)
    excluded = F.array().cast("array<string>")
    for name, terms in roots.items():
        excluded = F.when(prefix == name, F.array(*map(F.lit, terms))).otherwise(excluded)
    shared = F.array_except(F.array_except(F.array_intersect(mine, theirs), excluded), F.array(a, b))
    known = (subject["category"] == obj["category"]) & (subject["category"] != "unknown")
    siblings = F.when(known & (a != b), ~F.array_contains(mine, b) & ~F.array_contains(theirs, a) & (F.size(shared) > 0))
    named = F.lower(predicate).contains("sibling_of") & (prefix == F.substring_index(b, ":", 1))
    return F.coalesce(siblings, F.lit(False)) | F.coalesce(named, F.lit(False))


def sibling_pairs(ancestors: DataFrame, roots: list[str]) -> DataFrame:
    """Distinct pairs of terms ``a < b`` that share an ancestor ``(term, ancestor)`` other than the roots.

    The join is on the ancestor; terms are compared only with those below the same one.
    """
    inside = ancestors.filter(~F.col("ancestor").isin(roots)).distinct()
    a = inside.select(F.col("term").alias("a"), "ancestor")
    return a.join(inside.select(F.col("term").alias("b"), "ancestor"), "ancestor").filter("a < b").select("a", "b").distinct()


def sibling_map(ancestors: DataFrame, roots: list[str]) -> DataFrame:
    """``(ancestor, terms)``: the groups of terms below one ancestor, of which any two are siblings.

    A group is a set, not its pairs; look pairs up with ``arrays_overlap`` of two terms' ancestors.
    """
    inside = ancestors.filter(~F.col("ancestor").isin(roots)).groupBy("ancestor").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return inside.filter(F.size("terms") > 1)


def unlinked(candidates: DataFrame, links: DataFrame, on: list[str]) -> DataFrame:
    """Candidates that are not linked already."""
    return candidates.join(links.select(*on).distinct(), on, "left_anti")


def tissue_mismatch(claimed: Column, observed: Column) -> Column:
    """Whether evidence names tissues other than the claimed one."""
    others = F.array_except(F.transform(observed, lambda x: F.upper(x)), F.array(F.upper(claimed)))
    return F.coalesce(F.upper(claimed).startswith("UBERON:") & (F.size(others) > 0), F.lit(False))
