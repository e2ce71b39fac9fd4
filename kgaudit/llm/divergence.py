"""Audit of how the sources of a language differ in their terms: divergence of pairs, and each source's leading terms.

Terms are counted in the tasks that read the texts and summed by language, source and term. A language keeps the terms
of enough documents; a term's share in a source or language is smoothed and rounded down to an integer, so all
arithmetic is exact.

Pairs of sources: a term that a source lacks has the source's baseline share there, so only terms that occur are
looked at. The sum of differences over all V kept terms is V times the difference of the baselines, and corrections:
for the terms of either source against the other's baseline, by running sums over the distinct shares of a source into
which the other baselines are sorted, and for the terms of both by a join on the term. Rows of that join are summed in
the task that makes them; a term has one row for each source.

Leading terms: radix select. Histograms over eight value bits at a time, from the highest, tell in which bin the k-th
value of each group is, until it is known; among equal values histograms over the first byte in which the rest differ
tell the last term that is in. A window then sorts k rows a group.

No group meets in one task but as a histogram: bins a group, and distinct shares of a source. The result has a row for
each pair of sources of a language, as asked; sources are to be far fewer than terms.

Defined results: null texts, languages and sources are empty strings; a source without terms, and a language that keeps
none, still have their pairs, at baselines alone or at 0; equal values are ordered by their names' UTF-8 bytes; repeated
rows count each; rows without a doc_id count; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgaudit.llm.common import cut, drop_cut, table, text_bytes

#: Parameters of the query: documents that a kept term is in, the scale of shares, what smoothing adds, terms a source.
LEAST_DOCS, SCALE, SMOOTHING, LEADING = 30, 1_000_000_000, 5, 50
#: Terms that a task holds before it passes their counts on; bytes of a text that are split at once.
HELD_TERMS, SLICE = 200_000, 1 << 20
#: Bits of a value that can be ranked, and of a histogram's bins.
VALUE_BITS, BIN_BITS = 40, 8
#: ASCII letters in lower case; other ASCII is a space; bytes of other characters stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time."""
    low = 0
    while low < len(text):
        high = text.find(b" ", low + SLICE) if low + SLICE < len(text) else len(text)
        high = len(text) if high < 0 else high
        yield text[low:high].split()
        low = high


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: places of a term and documents with it; each pair of language and source also has a row without a term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flushed(places: dict, docs_of: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), count in places.items():
            terms = list(count)
            held = docs_of[lang, source]
            whole = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * whole, pa.string()), pa.array([source] * whole, pa.string()), pa.array([None, *(t.decode() for t in terms)], pa.string()), pa.array([0, *count.values()], pa.int64()), pa.array([0, *(held[t] for t in terms)], pa.int64())],
                schema=schema,
            )
        places.clear()
        docs_of.clear()

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, docs_of, rows = defaultdict(Counter), defaultdict(Counter), 0
        for batch in it:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), text_bytes(batch["text"]), strict=True):
                group, seen = (lang, source), set()
                count = places[group]
                before = len(count)
                for words in words_of(text.translate(TERMS)):
                    count.update(words)
                    seen.update(words)
                docs_of[group].update(seen)
                rows += len(count) - before
                if rows >= HELD_TERMS:
                    yield from flushed(places, docs_of)
                    rows = 0
        yield from flushed(places, docs_of)

    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string"))
    counted = named.mapInArrow(apply, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """A smoothed share, scaled and rounded down; never 0."""
    whole = lambda c: c.cast("decimal(18,0)")
    above, below = whole(F.lit(SCALE)) * whole(count + SMOOTHING), whole(total) + whole(kept) * SMOOTHING
    return F.lit(1) + F.call_function("div", above, below)


def top_k(rows: DataFrame, keys: list[str], value: str, item: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the largest values, ties by the item's UTF-8 bytes, and their ``rank`` from 1.

    Values are whole and from 0 to below 2 ** VALUE_BITS; ``rows`` is read several times, so give a written table.
    """
    held = rows.groupBy(*keys).agg(F.least(F.count("*"), F.lit(k)).alias("need"))
    state = held.select(*keys, "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("bin"))
    for shift in range(VALUE_BITS - BIN_BITS, -1, -BIN_BITS):
        live = rows.join(state, keys).filter(F.shiftright(value, shift + BIN_BITS) == F.col("prefix"))
        bins = live.groupBy(*keys, "need", "prefix", F.shiftright(value, shift).alias("digit")).agg(F.count("*").alias("bin"))
        state = first_bin(bins, keys, F.col("digit").desc()).select(*keys, "need", F.col("digit").alias("prefix"), "bin")
    state = cut(state.select(*keys, "need", F.col("prefix").alias("least"), "bin"))
    last = last_items(rows.join(state.filter("need < bin"), keys).filter(F.col(value) == F.col("least")).select(*keys, F.encode(item, "UTF-8").alias("item"), "need"), keys)
    ends = state.select(*keys, "least").join(last, keys, "left")
    inside = (F.col(value) > F.col("least")) | (F.col(value) == F.col("least")) & (F.col("last").isNull() | (F.encode(item, "UTF-8") <= F.col("last")))
    best = rows.join(ends, keys).filter(inside).drop("least", "last")
    return best.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc(), item)))


def first_bin(bins: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The bin of each group in which its ``need``-th row is, and the number ``need`` of that row within the bin."""
    before = F.sum("bin").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    placed = bins.withColumn("before", F.coalesce(before, F.lit(0)))
    return placed.filter((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("bin"))).withColumn("need", F.col("need") - F.col("before"))


def last_items(tied: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, last)``: the ``need``-th of the distinct binary items of each group.

    Each round looks at the first byte in which a group's items differ, so that it leaves fewer of them.
    """
    spark, alive, found = tied.sparkSession, cut(tied), []
    while not alive.isEmpty():
        bounds = alive.groupBy(*keys).agg(F.min("item").alias("low"), F.max("item").alias("high"))
        differs = F.expr("filter(sequence(1, length(high)), i -> not (substring(low, i, 1) <=> substring(high, i, 1)))[0]")
        digit = F.hex(F.expr("substring(item, place, 1)"))  # none sorts first: the item ends there
        placed = alive.join(bounds.select(*keys, F.coalesce(differs, F.lit(1)).alias("place")), keys).withColumn("digit", digit)
        bins = first_bin(placed.groupBy(*keys, "need", "digit").agg(F.count("*").alias("bin")), keys, F.col("digit").asc())
        left = cut(placed.drop("need", "place").join(bins.select(*keys, "digit", "need", "bin"), [*keys, "digit"]))
        found.append(cut(left.filter("need = bin").groupBy(*keys).agg(F.max("item").alias("last"))))
        drop_cut(alive)
        alive = cut(left.filter("need < bin").select(*keys, "item", "need"))
        drop_cut(left)
    out = spark.createDataFrame([], tied.select(*keys, F.col("item").alias("last")).schema)
    for part in found:
        out = out.union(part)
    return out


def pair_divergence(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language, from ``rated(lang, source, term, p)`` and ``groups(lang, source, kept, base)``."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    pairs = cut(groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", "kept", "base", "other"))
    shares = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    none = F.lit(None)
    sorted_in = shares.select("lang", "source", "p", "n", none.cast("string").alias("item")).union(pairs.filter("kept > 0").select("lang", "source", "other", F.lit(0).cast("long"), "item"))
    whole, below = W.partitionBy("lang", "source"), W.partitionBy("lang", "source").orderBy("p").rangeBetween(W.unboundedPreceding, -1)
    weight = F.col("n") * F.col("p")
    sums = {"n_below": F.coalesce(F.sum("n").over(below), F.lit(0)), "p_below": F.coalesce(F.sum(weight).over(below), F.lit(0)), "n_all": F.sum("n").over(whole), "p_all": F.sum(weight).over(whole)}
    against = sorted_in.withColumns(sums).filter(F.col("item").isNotNull())
    against = against.select("lang", "source", "item", F.col("n_all").alias("terms"), (F.col("p") * (2 * F.col("n_below") - F.col("n_all")) + F.col("p_all") - 2 * F.col("p_below")).alias("apart"))
    one = pairs.join(against, ["lang", "source", "item"], "left").withColumn("gap", F.abs(F.col("base") - F.col("other")))
    one = one.select("lang", "source", "item", "kept", "gap", F.coalesce(F.col("apart") - F.col("terms") * F.col("gap"), F.lit(0)).alias("value"))
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    base = rated.join(groups.select("lang", "source", "base"), ["lang", "source"])
    left = base.select("lang", "term", "source", "p", "base")
    right = base.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("base").alias("other"))
    corrected = F.expr("abs(p - q) - abs(p - other) - abs(base - q) + abs(base - other)")
    both = left.join(right, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(corrected).alias("value"))
    both = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s"), "value").select("lang", "s.source", "s.item", "value")
    baseline = one.select("lang", "source", "item", (F.col("kept") * F.coalesce("gap", F.lit(0))).alias("value"))
    parts = baseline.union(one.select("lang", "source", "item", "value")).union(back).union(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, leading: int = LEADING) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far every source is from the others of its language, and the terms it leads in."""
    counts = cut(term_counts(docs))
    terms = cut(counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"))
    kept = cut(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_total"))
    groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["kept", "lang_total", "source_total"])
    groups = cut(groups.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), F.col("source_total"), F.col("kept")))))
    drop_cut(counts)
    p, q = share(F.col("n"), F.col("source_total"), F.col("kept")), share(F.col("total"), F.col("lang_total"), F.col("kept"))
    rated = cut(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")))
    drop_cut(kept)
    ahead = cut(rated.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    best = top_k(ahead, ["lang", "source"], "value", "item", leading).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    pairs = pair_divergence(rated, groups.select("lang", "source", "kept", "base"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


#: The same with every kept term of every source written out.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
every_term AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS source_total, sum(total) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v FROM every_term),
s AS (SELECT lang, source, term, n, CAST(1 + 1000000000::HUGEINT * (n + 5) // (source_total + 5 * v) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (total + 5) // (lang_total + 5 * v) AS BIGINT) AS q FROM summed),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(apart.value, 0) AS BIGINT) AS value FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source
        LEFT JOIN apart ON apart.lang = g.lang AND apart.source = g.source AND apart.item = o.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
