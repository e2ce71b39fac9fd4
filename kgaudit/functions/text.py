"""Column functions over claim and abstract text (X2, X14-X15, X18-X19, X23-X32, X35). All word lists are parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lexicon:
    """Word lists by which text is read. The defaults are the domain's; tests and other corpora bring their own."""

    # Stems of the polarity markers; a marker's canonical form ends in s.
    positive: tuple[str, ...] = ("increase", "activate", "upregulate", "positively_regulate", "promote", "induce", "stimulate", "enhance", "contribute", "cause")
    negative: tuple[str, ...] = ("decrease", "inhibit", "downregulate", "negatively_regulate", "suppress", "reduce", "block")
    # Predicates of the causal and of the association class.
    causal: tuple[str, ...] = ("cause", "increase", "decrease", "induce", "leads to", "results in")
    association: tuple[str, ...] = ("associated with", "correlates with", "linked to", "related to")
    # Hedges by label, as word patterns.
    hedges: dict[str, str] = field(default_factory=lambda: {"might": "might", "possible": "possible", "possibly": "possibly", "may": "may", "could": "could", "seems": "seems?", "appears": "appears?", "suggests": "suggests?", "somehow": "somehow", "uncertain": "uncertain"})
    negations: tuple[str, ...] = ("cannot", "can't", "not")
    # Words of review, animal and human papers.
    review: tuple[str, ...] = ("review", "meta-analysis", "metaanalysis", "overview", "survey of")
    animal: tuple[str, ...] = ("mouse", "mice", "rat", "rats", "murine", "rodent", "zebrafish", "drosophila", "c. elegans", "animal model", "in vivo", "xenograft")
    human: tuple[str, ...] = ("patient", "patients", "human", "clinical", "cohort", "case-control", "randomized", "trial", "gwas", "genome-wide")
    # Phrases that show a sentence's section, in order of precedence.
    sections: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "results": ("we found", "we show", "we demonstrate", "our results", "analysis revealed"),
            "conclusion": ("in conclusion", "we conclude", "these findings suggest", "in summary", "taken together"),
            "methods": ("we used", "we performed", "was measured", "were analyzed", "methodology"),
            "introduction": ("previous studies", "it is known", "has been shown to", "background"),
        }
    )
    variants: str = r"\b(mutations?|variants?|allelic|alleles?|missense|nonsense|frameshift|truncating)\b"


DEFAULT = Lexicon()
# Weights of sections, of paper types, and of sentence class against claim class.
SECTION_WEIGHTS = {"results": 1.0, "conclusion": 1.0, "discussion": 0.9, "methods": 0.5, "introduction": 0.7, "background": 0.7, "abstract": 0.85}
PAPER_WEIGHTS = {"primary_human": 1.0, "animal": 0.6, "review": 0.4}
FACTORS = {("causal", "causal"): 1.2, ("causal", "association"): 1.0, ("association", "causal"): 0.5, ("association", "association"): 1.0, ("unknown", "causal"): 0.7, ("unknown", "association"): 0.8}
OTHER_WEIGHT, HEDGED_WEIGHT, OTHER_TISSUE_WEIGHT = 0.8, 0.5, 0.9


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the strings; null is false."""
    return F.coalesce(either([text.contains(w) for w in words]), F.lit(False))


def first_match(pairs: list[tuple[Column, str]]) -> Column:
    """The label of the first condition that holds, else null."""
    chain = F
    for condition, label in pairs:
        chain = chain.when(condition, label)
    return chain.otherwise(None) if pairs else F.lit(None).cast("string")


def citations(text: Column) -> Column:
    """PubMed identifiers, each once, then DOIs as often as they stand."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"((?i)PMID:\s*\d{4,9})"), 1), lambda x: F.regexp_replace(x, "^pmid:", "PMID:")))
    dois = F.transform(F.regexp_extract_all(text, F.lit(r"(10\.\d{4,9}/[^\s;]+)"), 1), lambda x: F.regexp_replace(x, r"\.+$", ""))
    return F.concat(ids, dois)


def polarity(predicate: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """``positive`` or ``negative`` by the first marker found as a part of the text, positive ones first."""
    text = F.translate(F.lower(predicate), " ", "_")
    return first_match([(has_any(text, lexicon.positive), "positive"), (has_any(text, lexicon.negative), "negative")])


def named_predicate(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The canonical predicate of the first marker that a text holds."""
    plain = F.translate(F.lower(text), " ", "_")
    return first_match([(plain.contains(stem), stem + "s") for stem in lexicon.positive + lexicon.negative])


def predicate_class(predicate: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """``causal``, ``association`` or ``unknown``."""
    plain = F.translate(F.lower(predicate), "_-", "  ")
    found = first_match([(has_any(plain, lexicon.causal), "causal"), (has_any(plain, lexicon.association), "association"), (polarity(predicate, lexicon).isNotNull(), "causal")])
    return F.coalesce(found, F.lit("unknown"))


def word_pattern(words) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def hedging_terms(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Labels of the hedges in a text, in the lexicon's order."""
    lowered = F.lower(text)
    marks = [F.when(lowered.rlike(rf"\b{pattern}\b"), label) for label, pattern in lexicon.hedges.items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def is_hedged(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return F.coalesce(F.lower(text).rlike(word_pattern(lexicon.hedges.values())), F.lit(False))


def is_negated(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Whether a text holds a negation."""
    return F.coalesce(F.lower(text).rlike(word_pattern(re.escape(w) for w in lexicon.negations)), F.lit(False))


def has_variant_context(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return F.coalesce(F.lower(text).rlike(lexicon.variants), F.lit(False))


def between_mentions(text: Column, subject: Column, obj: Column) -> Column:
    """The phrase between two mentions, or the whole text where there is none."""
    lowered = F.lower(text)
    first, second = F.instr(lowered, F.lower(subject)), F.instr(lowered, F.lower(obj))
    start = first + F.length(subject)
    phrase = F.btrim(F.substring(text, start, second - start), F.lit(" .,:;"))
    found = (F.length(subject) > 0) & (F.length(obj) > 0) & (first > 0) & (first < second) & (second > start)
    return F.when(found & (phrase != ""), phrase).otherwise(F.trim(text))


def sentences(text: Column) -> Column:
    """Sentences of a text, split behind ``.``, ``!`` and ``?``."""
    flat = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.btrim(s)), lambda s: s != "")


def section(sentence: Column, first_place: Column, total: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Section by phrase, else by where the sentence first stands among all."""
    lowered = F.lower(sentence)
    ratio = first_place / total
    by_phrase = [(has_any(lowered, phrases), name) for name, phrases in lexicon.sections.items()]
    by_place = [(ratio < 0.2, "introduction"), (ratio > 0.8, "conclusion"), (ratio > 0.5, "results")]
    return F.coalesce(first_match(by_phrase + by_place), F.lit("abstract"))


def lookup(value: Column, weights: dict[str, float], other: float = OTHER_WEIGHT) -> Column:
    chain = F
    for name, weight in weights.items():
        chain = chain.when(value == name, weight)
    return chain.otherwise(other)


def paper_type(title: Column, journal: Column, abstract: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """``review``, ``primary_human``, ``animal`` or ``unknown`` by words found as parts of the text."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (title, journal, abstract))))
    hits = lambda words: reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words], F.lit(0))
    human, animal = hits(lexicon.human), hits(lexicon.animal)
    return F.when(has_any(text, lexicon.review), "review").when(human > animal, "primary_human").when(animal > 0, "animal").when(human > 0, "primary_human").otherwise("unknown")


def predicate_factor(sentence_class: Column, claim_class: Column) -> Column:
    """How far a sentence's class of predicate bears on a claim's."""
    chain = F
    for (mine, claims), factor in FACTORS.items():
        chain = chain.when((sentence_class == mine) & (claim_class == claims), factor)
    return chain.otherwise(OTHER_WEIGHT)


def mentions(sentence: Column, term: Column) -> Column:
    """Whether a sentence holds a term as a word, whatever its case; an empty term is in none."""
    quoted = F.concat(F.lit(r"(?i)\b\Q"), term, F.lit(r"\E\b"))
    return F.coalesce((F.length(term) > 0) & F.expr("true") & F.regexp_like(sentence, quoted), F.lit(False))


def sentence_polarity(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Polarity by marker, and only without one by negation."""
    return F.coalesce(polarity(text, lexicon), F.when(is_negated(text, lexicon), "negative"))


def nli_label(both_terms: Column, mine: Column, claims: Column) -> Column:
    """``SUPPORT``, ``REFUTE`` or ``NEI`` of a sentence for a claim."""
    agree = mine == F.coalesce(claims, F.lit("positive"))
    return F.when(~both_terms | mine.isNull(), "NEI").when(agree, "SUPPORT").otherwise("REFUTE")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping places of a non-empty part."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def self_referential(subject_id: Column, object_id: Column, text: Column, label: Column) -> Column:
    """Whether a claim relates a thing with itself though its text names it once at most."""
    few = F.when(F.length(label) > 0, occurrences(F.lower(text), F.lower(label)) < 2).otherwise(F.lit(True))
    return F.coalesce((subject_id == object_id) & (F.length(text) > 0) & few, F.lit(False))
