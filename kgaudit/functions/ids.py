"""Column functions over identifiers: categories, citations, statuses and content hashes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier prefixes (upper case) by category.
CATEGORY_PREFIXES = {
    "gene": ("HGNC:", "NCBIGENE:"),
    "disease": ("MONDO:",),
    "phenotype": ("HP:",),
    "pathway": ("GO:", "R-HSA-", "REACT:"),
    "publication": ("PMID:", "PMC"),
}
# Category synonyms after the biolink prefix is gone.
CATEGORY_SYNONYMS = {
    "phenotypicfeature": "phenotype",
    "biologicalprocess": "pathway",
    "molecularactivity": "pathway",
    "cellularcomponent": "pathway",
    "article": "publication",
}
# Prefixes (upper case) of identifiers that may be nodes of the graph.
NODE_PREFIXES = ("GO:", "REACT:", "R-HSA-", "MONDO:", "HP:", "UBERON:", "CL:", "CHEBI:", "HGNC:", "NCBIGENE:", "DRUGBANK:")
#: Pairs of categories between which an edge belongs to a pair-subgraph.
ALLOWED_PAIRS = (("gene", "gene"), ("disease", "gene"), ("gene", "phenotype"), ("gene", "pathway"))
PAIR_LABELS = {("gene", "gene"): "G-G", ("disease", "gene"): "G-Dis", ("gene", "phenotype"): "G-Phe", ("gene", "pathway"): "G-Path"}


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a string starts with one of the prefixes; null is false."""
    found = F.lit(False)
    for prefix in prefixes:
        found = found | value.startswith(prefix)
    return F.coalesce(found, F.lit(False))


def category_of(identifier: Column, prefixes: dict[str, tuple[str, ...]] = CATEGORY_PREFIXES) -> Column:
    """Category by identifier prefix, whatever its case; ``unknown`` otherwise."""
    upper, chain = F.upper(identifier), F
    for category, starts in prefixes.items():
        chain = chain.when(starts_with_any(upper, starts), category)
    return chain.otherwise("unknown")


def has_category(identifier: Column, category: str) -> Column:
    """Whether ``category_of`` gives one category: as no prefix begins with another, its own prefixes tell."""
    return starts_with_any(F.upper(identifier), CATEGORY_PREFIXES[category])


def is_graph_node(identifier: Column) -> Column:
    """Whether an identifier may be a node of the graph and not a publication, whatever its case."""
    return starts_with_any(F.upper(identifier), NODE_PREFIXES)


def normal_category(category: Column) -> Column:
    """A stored category in the engine's vocabulary; null and empty give ``unknown``."""
    plain = F.regexp_replace(F.lower(category), "^biolink:", "")
    names = F.create_map(*(F.lit(x) for pair in CATEGORY_SYNONYMS.items() for x in pair))
    return F.when(F.coalesce(category, F.lit("")) == "", "unknown").otherwise(F.coalesce(names[plain], plain))


def allowed_edge(left: Column, right: Column, pairs: tuple = ALLOWED_PAIRS) -> Column:
    """Whether two categories may be joined by an edge, in either direction."""
    low, high = F.least(left, right), F.greatest(left, right)
    found = F.lit(False)
    for a, b in pairs:
        found = found | ((low == min(a, b)) & (high == max(a, b)))
    return F.coalesce(found, F.lit(False))


def edge_type(left: Column, right: Column, labels: dict = PAIR_LABELS) -> Column:
    """The label of a pair of categories, or ``Other``."""
    low, high, chain = F.least(left, right), F.greatest(left, right), F
    for (a, b), label in labels.items():
        chain = chain.when((low == min(a, b)) & (high == max(a, b)), label)
    return chain.otherwise("Other")


def normal_citation(identifier: Column) -> Column:
    """A citation in canonical form: bare DOI, ``PMC…`` or ``PMID:…``."""
    bare = F.regexp_replace(F.trim(identifier), r"(?i)^https?://doi\.org/", "")
    bare = F.trim(F.regexp_replace(bare, r"(?i)^doi:", ""))
    upper = F.upper(bare)
    code = F.trim(F.substring_index(upper, ":", -1))
    return (
        F.when(upper.startswith("PMCID:"), F.when(code.startswith("PMC"), code).otherwise(F.concat(F.lit("PMC"), code)))
        .when(upper.startswith("PMC"), upper)
        .when(upper.startswith("PMID:"), F.concat(F.lit("PMID:"), code))
        .when(bare.rlike(r"^\d+$"), F.concat(F.lit("PMID:"), bare))
        .otherwise(bare)
    )


def is_literature(identifier: Column) -> Column:
    """Whether an identifier names a publication."""
    text = F.trim(identifier)
    shape = text.rlike(r"(?i)^https?://(dx\.)?doi\.org/|^doi:|^10\.|^PMC|^PMID:\s*\d|^\d+$")
    return F.coalesce(shape | F.lower(text).rlike("retract|concern"), F.lit(False))


def citation_kind(identifier: Column) -> Column:
    """``pmcid``, ``doi`` or ``pmid``."""
    upper = F.upper(F.trim(identifier))
    return F.when(upper.startswith("PMC"), "pmcid").when(upper.startswith("10.") | upper.contains("/"), "doi").otherwise("pmid")


def status_hint(identifier: Column) -> Column:
    """The status that an identifier's own text names."""
    text = F.lower(identifier)
    return F.when(text.contains("retract"), "retracted").when(text.contains("concern"), "concern").otherwise("clean")


def source_kind(identifier: Column) -> Column:
    """Kind of a source reference."""
    upper = F.upper(F.trim(identifier))
    return (
        F.when(upper.startswith("PMID:") | upper.rlike(r"^\d+$"), "pmid")
        .when(upper.startswith("10.") | upper.startswith("DOI:"), "doi")
        .when(upper.startswith("GO:"), "go")
        .when(starts_with_any(upper, ("R-HSA-", "REACT:")), "reactome")
        .otherwise("other")
    )


def content_hash(*parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by bars; null counts as empty."""
    joined = []
    for i, part in enumerate(parts):
        joined += [F.lit("|")] * bool(i) + [F.coalesce(part.cast("string"), F.lit(""))]
    return F.sha2(F.concat(*joined), 256)


def association_id(*parts: Column) -> Column:
    """Identifier of a reified association by its content."""
    return F.concat(F.lit("assoc:"), F.substring(content_hash(*parts), 1, 16))


def claim_id(text: Column) -> Column:
    """Identifier of a claim by its text."""
    return F.concat(F.lit("claim-"), F.substring(F.sha1(text), 1, 10))


def hash_embedding(identifier: Column, size: int = 64) -> Column:
    """A vector of numbers in [0, 1) from hashes of the identifier and the place."""
    digest = lambda i: F.sha2(F.concat(identifier, F.lit("|"), i.cast("string")), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(digest(i), 1, 8), 16, 10).cast("double") / 4294967296.0)


class HashVectors:
    """Gives what ``hash_embedding`` does, one row an identifier, in tasks; those that a task has met are kept, up to so many."""

    def __init__(self, size: int = 64, most: int = 1 << 18):
        self.size, self.most, self.known = size, most, {}

    def __call__(self, identifiers: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
        new = {i: self.vector(i) for i in identifiers if i not in self.known}
        self.known |= new
        return np.frombuffer(b"".join([self.known[i] for i in identifiers])).reshape(len(identifiers), self.size)

    def vector(self, identifier: str) -> bytes:
        begun, first = hashlib.sha256(f"{identifier}|".encode()), bytearray()
        for i in range(self.size):
            whole = begun.copy()
            whole.update(str(i).encode())
            first += whole.digest()[:4]
        return (np.frombuffer(first, ">u4") / 4294967296.0).tobytes()
