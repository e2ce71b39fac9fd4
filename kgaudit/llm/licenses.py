"""Licence scan: Aho-Corasick over words and tags, and a shunting-yard parser for licence expressions.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z. One automaton over the words
of a text finds notice phrases and names of licences, another over its characters the identifier tags. What follows a
tag on its line is read as an expression of licence names with ``and``, ``or``, ``with`` and parentheses; it is put
into postfix order and evaluated to the labels that bind and to a strictness: ``and`` takes both sides and the stricter
value, ``or`` the milder side alone (the left one of equal sides), ``with`` eases a licence by an exception.

A text's labels are those of its phrases and those that its expressions come to. Its score is the strictness of what
binds: the largest over the phrases that stand in it and the values of its expressions.

Defined results: a null text is empty; without any finding labels are empty and the score is 0; places may overlap and
all count; an expression that doesn't parse yields no label; a name that isn't known has no label and strictness 0.5;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import ASCII_LOWER, ASCII_WORDS, table, text_bytes

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases that the method knows. They add labels, never places.
NAMED = {"gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd", "isc license": "isc", "creative commons attribution": "cc-by", "eclipse public license": "epl"}
#: What licence tags are called; a colon and the expression follow.
TAGS = ("spdx-license-identifier", "license-expression")
#: Parameter: label and strictness (0 free, 1 strict) by the first word of a name in an expression. The values only order
#: licences by what they ask of those who copy: nothing, a notice, weak or strong copyleft.
NAMES = {"mit": ("mit", 0.1), "isc": ("isc", 0.1), "bsd": ("bsd", 0.15), "0bsd": ("bsd", 0.05), "apache": ("apache", 0.2), "cc0": ("cc0", 0.0), "cc": ("cc-by", 0.3), "mpl": ("mpl", 0.5), "epl": ("epl", 0.5), "lgpl": ("lgpl", 0.6), "gpl": ("gpl", 0.8), "agpl": ("agpl", 0.95)}
EASED, UNKNOWN = 0.75, 0.5
#: Operators by how tightly they bind.
BINDING = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
TAGGED = re.compile(r"[ \t]*:[ \t]*([^\r\n]*)")


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: the longest expression that the tokens begin with, in postfix order; None if there is none."""
    out, waiting, operand, ended = [], [], False, 0
    depth = 0
    best = None

    def closed() -> list[str]:
        return out + waiting[::-1]

    for token in tokens:
        if token in BINDING:
            if not operand:
                break
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            waiting.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        else:
            if operand:
                break
            out.append(token)
            operand = True
        if operand and not depth:
            best = closed()
    return best


def evaluate(rpn: list[str], names: dict[str, tuple[str, float]] = NAMES) -> tuple[set[str], float]:
    """Labels that bind and strictness of a postfix expression."""
    stack: list[tuple[set[str], float]] = []
    for token in rpn:
        if token not in BINDING:
            label, strictness = names.get(re.split(r"[-.+]", token)[0], ("", UNKNOWN))
            stack.append(({label} - {""}, strictness))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, a * EASED))
        elif token == "and":
            stack.append((left | right, max(a, b)))
        else:
            stack.append((left, a) if a <= b else (right, b))
    return stack[0]


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of the phrases, between spaces, and of the tags."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (BASE | NAMED).items():
        phrases.add_word(f" {phrase} ", (phrase, label))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(data: bytes, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton, names: dict[str, tuple[str, float]] = NAMES) -> dict:
    """Base places, labels and score of one text."""
    words = data.translate(ASCII_WORDS).split()
    line = f" {b' '.join(words).decode()} "
    starts, base, labels, expressed, values = [], set(), set(), set(), []
    last, counted = 0, 0
    for end, (phrase, label) in phrases.iter(line):
        labels.add(label)
        if phrase in BASE:
            at = end - len(phrase) - 1
            counted += line.count(" ", last, at + 1) if at >= last else -line.count(" ", at + 1, last)
            last = at + 1
            starts.append(counted - 1)
            base.add(label)
    if b":" in data:
        lowered = data.translate(ASCII_LOWER).decode()
        for end, _ in tags.iter(lowered):
            if match := TAGGED.match(lowered, end + 1):
                rpn = postfix(TOKEN.findall(match[1]))
                if rpn:
                    binding, value = evaluate(rpn, names)
                    expressed |= binding
                    values.append(value)
    by_label = {label: value for label, value in reversed(names.values())}
    values += [by_label.get(x, UNKNOWN) for x in labels]
    joined = lambda found: ",".join(sorted(found))
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": joined(base), "labels": joined(labels | expressed), "score": max(values, default=0.0), "expression_labels": joined(expressed)}


SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expression_labels", pa.string())])


def license_scan(docs: DataFrame, names: dict[str, tuple[str, float]] = NAMES) -> DataFrame:
    """One row per document with what the scan finds."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = automata()
        for batch in it:
            found = [scan(t, phrases, tags, names) for t in text_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([x[f.name] for x in found], f.type) for f in list(SCHEMA)[1:])], schema=SCHEMA)

    sql = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression_labels string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, sql)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that don't depend on the method's own labels."""
    return op1_license_scan(spark, sf_dir).drop("labels", "score", "expression_labels")


def _stands(phrase: str) -> str:
    return " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))


_PLACES = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(1, n + 1), lambda i: {_stands(p)})) - 1 AS pos, '{label}' AS label FROM words" for p, label in BASE.items())
BASE_SQL = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT doc_id, w, len(w) AS n FROM split), places AS ({_PLACES}),
found AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1)
SELECT words.doc_id, n AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM words LEFT JOIN found ON words.doc_id = found.doc_id
"""
