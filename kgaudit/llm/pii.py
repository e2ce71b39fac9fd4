"""Personal data by patterns and a skip-chain conditional random field.

The base patterns give spans that always stay. The field labels the tokens that could be personal data (those with a
digit or an at-sign; groups of digits side by side are one token) as none, email, ip, card or phone. Neighbouring tokens share a transition potential; tokens of a
document that repeat or resemble each other (equal letters and digits, equal last seven digits, equal part before
the at-sign) share a skip potential, however far apart. Loopy sum-product messages run over all links of a batch of
documents at once, and base spans are fixed. A token that is linked to others, that no base span touches and whose
belief in a kind is at least ``LEAST_BELIEF`` becomes a span of that kind, so an entity found once is found at its
other places.

The field is trained on at most ``max_train_docs`` documents of at most MAX_TRAIN_CHARS characters that may hold a base
span, those of the least hashes, which are found before their texts are fetched: token scores from shapes and neighbours, transitions, and the skip potential. What is
labelled covers all documents.

Defined results: null and empty texts have no spans and the digest of an empty string; matches of a pattern that fail
its test are dropped without another try; without any document to train on only base spans are found; repeated rows
get equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base kinds.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s,;:!?\"'()<>\[\]{}|]+")
GROUP = re.compile(r"\+?[0-9]+(?:-[0-9]+)*")
GAP = re.compile(r"[\x20()-]{1,3}")
MAX_TRAIN_DOCS, MAX_TRAIN_CHARS, LEAST_BELIEF, ROUNDS, FEATURES, SEED = 2000, 20_000, 0.9, 50, 4096, 5
Span = tuple[int, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each at-sign outwards: linear in the text, however long its words are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """``(kind number, start, end)`` by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def active_tokens(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, place among all tokens)`` of the tokens that hold a digit or an at-sign."""
    if not DIGIT.search(text) and "@" not in text:
        return []
    out = []
    for place, m in enumerate(TOKEN.finditer(text)):
        word = m[0]
        if "@" in word or DIGIT.search(word):
            start, end = m.span()
            while end > start and text[end - 1] in ".*#$%&-_":
                end -= 1
            while start < end and text[start] in ".*#$%&-_":
                start += 1
            if start < end:
                out.append((start, end, place))
    return joined(text, out)


def joined(text: str, tokens: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tokens, groups of digits that stand side by side as one if they have as many digits as a phone or card."""
    runs, sizes = [], []
    for token in tokens:
        start, end, _ = token
        size = sum("0" <= c <= "9" for c in text[start:end]) if GROUP.fullmatch(text, start, end) else 0
        if size and runs and sizes[-1] and GAP.fullmatch(text, runs[-1][-1][1], start) and min(size, sizes[-1]) < 7:
            runs[-1].append(token)
        else:
            runs.append([token])
        sizes.append(size)
    out, fewer, at = [], 0, 0
    for run in runs:
        if len(run) > 1 and 7 <= sum(sizes[at : at + len(run)]) <= 19:
            start, end = run[0][0], run[-1][1]
            if text[start - 1 : start] == "(" and ")" in text[start:end]:
                start -= 1
            out.append((start, end, run[0][2] - fewer))
            fewer += len(run) - 1
        else:
            out += [(start, end, place - fewer) for start, end, place in run]
        at += len(run)
    return out


def token_features(text: str, start: int, end: int) -> list[int]:
    """Hashed features: shape, its ends, length, and what stands before."""
    word = text[start:end]
    shape = re.sub(r"[A-Za-z\u0080-￿]+", "a", re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 6), word))
    before = text[max(0, start - 2) : start]
    ideas = (f"s{shape}", f"c{shape[:3]}", f"e{shape[-3:]}", f"l{min(len(word), 24)}", f"b{before}", f"d{sum(c.isdigit() for c in word)}", f"p{before}{shape}")
    return [xxhash.xxh32_intdigest(x.encode(), SEED) % FEATURES for x in ideas]


def resemblances(word: str) -> list[str]:
    """Keys that tokens of one entity share."""
    plain = "".join(c for c in word.lower() if c.isalnum())
    digits = "".join(c for c in word if "0" <= c <= "9")
    keys = ["w" + plain] if len(plain) >= 5 else []
    if len(digits) >= 7:
        keys.append("d" + digits[-7:])
    local = word.partition("@")[0].lower()
    if len(local) >= 5 and DIGIT.search(local):
        keys.append("l" + local)
    return keys


def resembling(text: str) -> bool:
    """Whether two tokens share a key; where none do, the field adds no span."""
    seen: set[str] = set()
    for start, end, _ in active_tokens(text):
        keys = resemblances(text[start:end])
        if not seen.isdisjoint(keys):
            return True
        seen.update(keys)
    return False


class Graph:
    """The tokens of a batch of documents, their features, and chain and skip links."""

    def __init__(self):
        self.doc, self.span, self.feature, self.chain, self.skip, self.fixed = [], [], [], [], [], []

    def add(self, doc: int, text: str, base: list[Span]) -> None:
        starts = sorted((a, b, k) for k, a, b in base)
        last_place, seen = None, {}
        at = 0
        for start, end, place in active_tokens(text):
            node = len(self.doc)
            while at < len(starts) and starts[at][1] <= start:
                at += 1
            label = 0
            over = at  # spans of different kinds may overlap: the first one by place that touches the token counts
            while over < len(starts) and starts[over][0] < end:
                if start < starts[over][1]:
                    label = starts[over][2] + 1
                    break
                over += 1
            self.doc.append(doc)
            self.span.append((start, end))
            self.fixed.append(label)
            self.feature.append(token_features(text, start, end))
            if last_place is not None and place - last_place <= 2:
                self.chain.append((node - 1, node))
            last_place = place
            for key in resemblances(text[start:end]):
                if key in seen and seen[key] != node:
                    self.skip.append((seen[key], node))
                seen[key] = node


def train(texts: list[str]) -> dict:
    """Token scores (softmax regression by gradient steps), transitions and skip potential from base labels."""
    graph = Graph()
    for i, text in enumerate(texts):
        graph.add(i, text, base_spans(text))
    labels, n = np.array(graph.fixed, np.int64), len(KINDS) + 1
    score = np.zeros((FEATURES, n))
    if len(labels):
        feature = np.array(graph.feature)
        goal = np.eye(n)[labels]
        for _ in range(150):
            belief = np.exp(score[feature].sum(axis=1))
            belief /= belief.sum(axis=1, keepdims=True)
            slope = np.zeros_like(score)
            np.add.at(slope, feature.ravel(), np.repeat(goal - belief, feature.shape[1], axis=0))
            seen = np.maximum(np.bincount(feature.ravel(), minlength=FEATURES)[:, None], 1)
            score += 0.5 * (slope / seen - 0.002 * score)

    def log_odds(pairs: list[tuple[int, int]]) -> np.ndarray:
        """Of two labels side by side against apart; labels that are seldom seen stay near even."""
        seen = np.zeros((n, n))
        np.add.at(seen, tuple(labels[np.array(pairs, np.int64).reshape(-1, 2)].T), 1)
        one, other = seen.sum(axis=1) + 1, seen.sum(axis=0) + 1
        apart = np.outer(one / one.sum(), other / other.sum())
        seen += 50 * apart
        return np.clip(np.log(seen / seen.sum() / apart), -3, 3)

    agree = [(a, b) for a, b in graph.skip if labels[a] or labels[b]]
    same = sum(labels[a] == labels[b] for a, b in agree)
    return {"score": score, "chain": log_odds(graph.chain), "skip": float(np.clip(np.log((same + 20) / (len(agree) - same + 1)), 1.0, 4.0))}


def beliefs(graph: Graph, model: dict) -> np.ndarray:
    """Marginal label probabilities of every token, by damped loopy sum-product, until messages stay as they are."""
    n = len(KINDS) + 1
    own = model["score"][np.array(graph.feature)].sum(axis=1)
    fixed = np.array(graph.fixed)
    own[fixed > 0] = -30.0
    own[np.flatnonzero(fixed), fixed[fixed > 0]] = 0.0
    skip = np.full((n, n), 0.0)
    np.fill_diagonal(skip, model["skip"])
    pairs = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
    potential = np.concatenate([np.repeat(model["chain"][None], len(graph.chain), axis=0), np.repeat(skip[None], len(graph.skip), axis=0)])
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    potential = np.exp(np.concatenate([potential, potential.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(source), n))
    for _ in range(ROUNDS):
        total = own.copy()
        np.add.at(total, target, message)
        out = total[source] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.maximum(np.einsum("ei,eij->ej", out, potential), 1e-30))
        new -= new.max(axis=1, keepdims=True)
        new = 0.3 * message + 0.7 * new
        moved = np.abs(new - message).max(initial=0.0)
        message = new
        if moved < 1e-6:
            break
    total = own.copy()
    np.add.at(total, target, message)
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def find_all(texts: list[str], model: dict | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    more: dict[int, list[Span]] = defaultdict(list)
    graph = Graph()
    for i, text in enumerate(texts):
        if resembling(text):
            graph.add(i, text, base[i])
    if model is not None and graph.skip:
        belief = beliefs(graph, model)
        kind = belief.argmax(axis=1)
        linked = {x for pair in graph.skip for x in pair}
        for node in sorted(linked):
            if kind[node] and not graph.fixed[node] and belief[node, kind[node]] >= LEAST_BELIEF:
                more[graph.doc[node]].append((int(kind[node]) - 1, *graph.span[node]))
    return [(b, sorted(b + more[i]) if i in more else b) for i, b in enumerate(base)]


def training_texts(docs: DataFrame, max_train_docs: int) -> list[str]:
    """At most so many texts of bounded length, by the least hashes."""
    likely = docs.select("text", F.xxhash64(F.lit(SEED), "text").alias("draw")).filter(F.col("text").rlike(r"@|\+[0-9]|[0-9]\.[0-9]|[0-9]{4}[ -]?[0-9]{4}") & (F.length("text") <= MAX_TRAIN_CHARS))
    draws = [r["draw"] for r in likely.select("draw").distinct().orderBy("draw").limit(max_train_docs).collect()]
    if not draws:
        return []
    rows = likely.filter(F.col("draw") <= F.lit(draws[-1])).dropDuplicates(["draw"])
    return [r["text"] for r in sorted(rows.toLocalIterator(), key=lambda r: r["draw"])]


def fitted(docs: DataFrame, max_train_docs: int):
    """The trained field, sent to all tasks; null without any document to train on."""
    known = training_texts(docs, max_train_docs)
    return docs.sparkSession.sparkContext.broadcast(train(known) if known else None)  # FEATURES rows of scores


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, their union by the first one's kind."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, with_text: bool = False, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """Counts and spans of every document; ``with_text`` adds the redacted text (null where nothing is found)."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = fitted(texts, max_train_docs)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                text = [t or "" for t in part["text"].to_pylist()]
                found = find_all(text, model.value)
                counts = [[sum(s[0] == k for s in b) for b, _ in found] for k in range(len(KINDS))]
                digest = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]
                gone = [redact(t, s) if with_text and s else None for t, (_, s) in zip(text, found, strict=True)]
                columns = [part["doc_id"], *counts, digest, [listed(s) for _, s in found], gone]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    sql = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    found = texts.mapInArrow(scan, sql)
    return found if with_text else found.drop("redacted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; all columns stay, n_chars follows the text."""
    model = fitted(docs, MAX_TRAIN_DOCS)
    place = docs.columns.index("text")

    def replace(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                column = part.column(place)
                text = column.to_pylist()
                found = find_all([t or "" for t in text], model.value)
                new = [redact(t, s) if s else t for t, (_, s) in zip(text, found, strict=True)]
                arrays = [pa.array(new, column.type) if i == place else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    out = docs.mapInArrow(replace, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that count base spans."""
    return op6_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in KINDS))


BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[ -]', '', 'g'))) AS card,
  list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phone FROM t)
SELECT doc_id, len(email) AS n_email,
  len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda y: coalesce(try_cast(y AS HUGEINT), 999) > 255)) = 0)) AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[i] AS INT) WHEN x[i] > '4' THEN 2 * CAST(x[i] AS INT) - 9 ELSE 2 * CAST(x[i] AS INT) END)) % 10 = 0)) AS n_card,
  len(list_filter(phone, lambda x: x BETWEEN 8 AND 15)) AS n_phone FROM m
"""
