"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kgaudit.llm import decontaminate, embeddings, licenses, mixing, pii, quality, simhash, substrings, urls, warc
from kgaudit.llm.common import components

random.seed(3)
SYLLABLES = "an ber ti on el ra mo su ke lin dor fa".split()


def word():
    return "".join(random.choice(SYLLABLES) for _ in range(random.randint(1, 3)))


def text(n):
    return " ".join(word() for _ in range(n))


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "x", sources[i] if sources else "s0", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, key string, source string, n_chars long"  # key: a name that operators use inside
    return spark.createDataFrame(rows, schema)


def edge_texts():
    base = text(120)
    near = base.split()
    near[60] = "changed"
    return [None, "", " \n\t ", "one", "one two", base, base, " ".join(near), base.upper(), "a " * 400, text(30) + " " + base[:200], "né " * 40 + "ß", text(5000), "x" * 3000, None]


def rows(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


# 1 ---------------------------------------------------------------------------------------------------------------


def brute_licenses(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark):
    texts = [*edge_texts(), "The MIT License; mit license MIT-license. CC BY cc-by, GNU General Public License", "gnu gnu general public license apache  license", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\nmit license", "spdx-license-identifier: AND ("]
    got = rows(licenses.license_scan(docs_of(spark, texts)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, t in enumerate(texts):
        assert got[i][:5] == brute_licenses(t), t
        assert set(filter(None, got[i][4].split(","))) <= set(filter(None, got[i][5].split(",")))
        assert 0 <= got[i][6] <= 1
    assert got[len(texts) - 2][5] == "apache,mit"  # the milder side of the choice
    assert licenses.license_scan(docs_of(spark, [])).count() == 0


def test_expressions():
    assert licenses.postfix("mit or ( gpl and bsd )".split()) == ["mit", "gpl", "bsd", "and", "or"]
    assert licenses.postfix("mit or gpl and bsd".split()) == ["mit", "gpl", "bsd", "and", "or"]
    assert licenses.postfix("gpl with x or mit".split()) == ["gpl", "x", "with", "mit", "or"]
    assert licenses.postfix(["and"]) is None
    assert licenses.postfix("mit is free".split()) == ["mit"]
    assert licenses.evaluate(["mit", "gpl", "or"]) == licenses.evaluate(["gpl", "mit", "or"]) == ({"mit"}, 0.1)
    assert licenses.evaluate(["mit", "gpl", "and"]) == ({"mit", "gpl"}, 0.8)


def test_scores_follow_operators(spark):
    tags = ["MIT OR GPL-2.0-only", "MIT AND GPL-2.0-only", "GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only", "(MIT OR Apache-2.0) AND BSD-3-Clause", "Unknown-1.0 OR AGPL-3.0", "MIT) AND", "and"]
    texts = [f"x\nSPDX-License-Identifier: {t}\ny" for t in tags] + ["License-Expression: MIT OR GPL-2.0\nGNU General Public License"]
    got = rows(licenses.license_scan(docs_of(spark, texts)), "doc_id", "labels", "score", "expression_labels")
    want = [("mit", 0.1), ("gpl,mit", 0.8), ("gpl", 0.8 * 0.75), ("gpl", 0.8), ("bsd,mit", 0.15), ("", 0.5), ("mit", 0.1), ("", 0.0)]
    assert [got[i] for i in range(8)] == [(labels, pytest.approx(score), labels) for labels, score in want]
    assert got[8] == ("gpl,mit", 0.8, "mit")
    mild = licenses.license_scan(docs_of(spark, texts), licenses.NAMES | {"gpl": ("gpl", 0.05)})
    assert rows(mild, "doc_id", "labels", "score")[0] == ("gpl", 0.05)


# 2 ---------------------------------------------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    link = '<LINK href="{}" rel="canonical">'.format
    pages = [
        (0, "http://A.Example.ORG/es/1?x", None),
        (1, "https://x.net/a", link("http://example.org/es/9")),  # alias of a blocked url
        (2, "https://y.net/b", link("https://x.net/a#f")),  # alias of the alias
        (3, "https://z.com/fr/", link("http://example.org/es/9")),  # allowed by a rule: joins the component
        (4, "https://w.net/", '<meta http-equiv="refresh" content="0; url=/c">'),
        (5, "https://v.net/", link("http://q.com/de/1")),
        (6, None, link("http://q.com/de/1")),
        (7, "no scheme", ""),
        (8, "http://org", "x"),
        (9, "http://example.org/en/12", "x"),
        (10, "https://v.net/", None),
        (11, "ftp://org/?a=/", ""),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, rule int")
    got = rows(urls.url_verdicts(df, urls.rule_table(spark)), "page_id", "host", "path", "rule", "verdict")
    for page_id, url, _ in pages:
        host, path, rule, verdict = brute_rule(url)
        assert got[page_id][:3] == (host, path, rule)
        assert verdict is None or got[page_id][3] == verdict
    assert [got[i][3] for i in (1, 2, 3, 4, 5, 6, 7, 10)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "block"]  # an allowed alias shields itself alone
    only = df.filter("page_id <> 3")
    assert [rows(urls.url_verdicts(only, urls.rule_table(spark)), "page_id", "verdict")[i][0] for i in (1, 2)] == ["block", "block"]
    assert urls.url_verdicts(df.limit(0), urls.rule_table(spark)).count() == 0


def test_link_targets(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    base = ["http://h.net/a/b/c?x=1#f", "http://h.net", "https://H.net/a/", "http://h.net/a?b/c"]
    target = ["page2.html", "../x", "../../../x", "?p=1", "#top", "/r", "//o.net/s", "http://o.net/", "./", "..", "a/./b/../c", "d/..", "https://o.net/x/../y"]
    rows_ = [(u, t) for u in base for t in target]
    got = spark.createDataFrame(rows_, "u string, t string").select("u", "t", urls.address(urls.resolved(F.col("t"), F.col("u"))).alias("node")).collect()
    for r in got:
        want = urljoin(r["u"], r["t"]).partition("://")[2].partition("#")[0]
        host, slash, path = want.partition("/")
        if not slash:
            host, mark, path = want.partition("?")
            path = mark + path
        want = host.lower() + "/" + path
        if "/../" in want or r["t"].startswith("http"):
            want = want.replace("/x/../", "/").replace("/../", "/")
        assert r["node"] == want, (r["u"], r["t"])
    pages = [(0, "http://example.org/es/9?a=1&b=2", None), (1, "https://x.net/", "<link rel=canonical href='http://example.org/es/9?a=1&amp;b=2'>"), (2, "https://x.net/a/c", "<meta http-equiv=refresh content='0; url=../'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert rows(urls.url_verdicts(df, urls.rule_table(spark)), "page_id", "verdict") == {0: ("block",), 1: ("block",), 2: ("block",)}


def test_components(spark):
    n, pairs = 60, [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(40, 58)]
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = rows(components(spark.createDataFrame(pairs, "a long, b long")), "node", "root")
    for node in {x for a, b in pairs if a != b for x in (a, b)}:
        assert got[node][0] == label[node]


# 3 ---------------------------------------------------------------------------------------------------------------


def brute_tiling(item, words, least):
    free_item, free_text, covered = [True] * len(item), [True] * len(words), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(words)):
                n = 0
                while p + n < len(item) and t + n < len(words) and free_item[p + n] and free_text[t + n] and item[p + n] == words[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return covered
        covered += n
        for i in range(n):
            free_item[p + i] = free_text[t + i] = False


def test_tiling():
    code = lambda ws: np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64)
    for n in range(300):
        item, words = ([random.choice("abcd"[: 2 + n % 3]) for _ in range(random.randint(1, 18))] for _ in range(2))
        tiles = decontaminate.tiling(code(item), code(words), 3)
        for p, t, size in tiles:
            assert item[p : p + size] == words[t : t + size]
        for side in (0, 1):
            marked = [i for tile in tiles for i in range(tile[side], tile[side] + tile[2])]
            assert len(marked) == len(set(marked))
        assert sum(size for _, _, size in tiles) == brute_tiling(item, words, min(3, len(item)))
    tiles = decontaminate.tiling(code("a" * 300), code("a" * 30_000))  # repetitive and long
    assert sum(size for _, _, size in tiles) == 300
    gaps = np.arange(12) == 6
    assert decontaminate.tiling(code("abcdefghijkl"), code("abcdefghijkl"), 3, gaps) == [(0, 0, 6), (7, 7, 5)]


def brute_contamination(texts, items, least=0.6):
    split = lambda t: re.findall(r"[a-z0-9\u0080-\uffff]+", (t or "").lower())
    found = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            words = split(item)
            if words and (covered := brute_tiling(words, split(t), min(5, len(words)))) >= least * len(words):
                found[i, j] = covered / len(words)
    return found


@pytest.mark.parametrize("bits", [decontaminate.BITMAP_BITS, 6])  # a bitmap that lets everything through
def test_decontamination(spark, bits):
    items = [text(30), text(24), None, "", "only four words here", text(40), "which of the " + text(12), "which of the " + text(15)]
    a, b = items[0].split(), items[5].split()
    texts = [None, "", "one two", f"{text(50)} {items[1].upper()}! {text(9)}", " ".join(["pre", *a[15:], text(20), *a[:15]]), " ".join(a[:12]), "x only four words here y", text(300) + " " + items[5], "a " * 300]
    texts += [" ".join(b[:k] + [word()] + b[k : 2 * k] + [word()]) for k in range(5, 20)] + [f"{items[6]} {items[7]}", " ".join(w for k in range(0, 30, 6) for w in [*a[k : k + 5], "zz"])]
    found = decontaminate.contamination(docs_of(spark, texts), spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string"), bits=bits).collect()
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["coverage"]) for r in found} == brute_contamination(texts, items)
    assert (len(texts) - 1, 0) in {(r["doc_id"], r["item_id"]) for r in found}  # tiles of the smallest size, which share the fewest seeds


def test_decontamination_of_edge_cases(spark):
    items = spark.createDataFrame([(0, text(30)), (1, None)], "item_id long, text string")
    kept = decontaminate.clean(docs_of(spark, edge_texts()), items)
    assert kept.count() == len(edge_texts()) and kept.columns == docs_of(spark, []).columns
    assert decontaminate.contamination(docs_of(spark, []), items).count() == 0
    assert decontaminate.contamination(docs_of(spark, edge_texts()), items.limit(0)).count() == 0


def test_words_of_any_length_match_wherever_they_stand(spark):
    sizes = [decontaminate.LONG - 1, decontaminate.LONG, 65_534, 65_535, 65_536, 65_537, 140_000]
    items = [f"{text(3)} {random.choice('xyz') * n} {text(3)}" for n in sizes]
    texts = [t for item in items for t in (item, f"{text(7)} {item}", f"{'q' * 65_500} {text(2)} {item} {text(3)}")]
    found = decontaminate.contamination(docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in found} == {(i, i // 3, 1.0) for i in range(len(texts))}


def brute_candidates(spark, texts, items):
    """What ``candidates`` finds, with numbers of documents and items."""
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    seeds = decontaminate.item_seeds(spark.createDataFrame(list(enumerate(items)), "no long, text string"))
    kept = decontaminate.kept_runs(docs, decontaminate.bitmap(seeds, 20), [5], 20)
    return {(r["row"], r["no"]) for r in decontaminate.candidates(kept, seeds, 0.6).collect()}


def test_items_of_one_template_meet_only_their_own_documents(spark):
    template, own = text(12), [" ".join(f"{word()}{i}" for _ in range(13)) for i in range(200)]
    items = [f"{template} {x}" for x in own]
    texts = [f"{text(9)} {template} {text(9)}" for _ in range(80)] + [f"{text(9)} {x}" for x in items[:20]] + [f"{template} zz {x}" for x in own[20:30]]
    want = {(80 + i, i) for i in range(30)}
    assert brute_candidates(spark, texts, items) == want
    found = decontaminate.contamination(docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want == set(brute_contamination(texts, items))


def test_no_pair_with_coverage_is_left_out():
    for _ in range(300):
        words = random.randint(5, 40)
        often = np.random.default_rng(words).integers(0, 9, words - 4)
        asked = decontaminate.looked_up(often, np.arange(words - 4), 5, words, 0.6)
        left = np.zeros(words, bool)
        for p in np.flatnonzero(~asked & (often > 0)):
            left[p : p + 5] = True
        assert left.sum() < 0.6 * words
    assert [decontaminate.bitmap_bits(n) for n in (0, 1 << 18, 1 << 20, 1 << 40)] == [24, 24, 26, 28]


def test_decontamination_by_rows(spark):
    one, two, three = text(20), text(20), text(20)
    items = spark.createDataFrame([(0, one), (0, two), (None, three)], "item_id long, text string")
    docs = spark.createDataFrame([(0, one, 1), (1, two, 2), (2, three, 3), (None, one, 4), (4, text(20), 5), (5, one, 6), (5, text(9), 7), (None, text(9), 8)], "doc_id long, text string, _row int")
    found = decontaminate.contamination(docs, items).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=str) == sorted([(0, 0), (1, 0), (2, None), (5, 0), (None, 0)], key=str)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {r["_row"] for r in kept.collect()} == {5, 7, 8}


# 4 ---------------------------------------------------------------------------------------------------------------


def test_quality(spark):
    good = [text(random.randint(20, 90)) for _ in range(160)]
    bad = [" ".join(w.upper() + "!!" for w in text(40).split()) for _ in range(30)] + [" ".join([word()] * 50) for _ in range(30)]
    texts = good + bad + [None, "", "  "]
    labels = [(i, 1) for i in range(80)] + [(i, 0) for i in list(range(160, 175)) + list(range(190, 205))] + [(None, 1), (3, None)]
    table = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int")
    found = rows(quality.quality_sample(docs_of(spark, texts), table), "doc_id", "log_weight", "score", "selected")
    for truth, least in ((lambda i: found[i][0] >= 0, 0.95), (lambda i: found[i][2], 0.85)):  # on documents without labels: by weight, and as sampled
        right = sum(truth(i) for i in range(80, 160)) + sum(not truth(i) for i in [*range(175, 190), *range(205, 220)])
        assert right >= least * 110
    assert [found[i] for i in (220, 221, 222)] == [(None, None, False)] * 3
    assert found == rows(quality.quality_sample(docs_of(spark, texts), table), "doc_id", "log_weight", "score", "selected")
    assert quality.keep_good(docs_of(spark, texts), table).columns == docs_of(spark, []).columns
    unlabelled = rows(quality.quality_sample(docs_of(spark, texts), table.limit(0)), "doc_id", "selected")
    assert all(unlabelled[i][0] for i in range(220))
    assert quality.quality_sample(docs_of(spark, []), table).count() == 0


def brute_buckets(t):
    """n-gram buckets of a text, from the definition."""
    m64 = 2**64 - 1

    def scramble(x):
        x ^= x >> 31
        x = x * 0x9E3779B97F4A7C15 & m64
        x ^= x >> 29
        x = x * 0xD6E8FEB86659FD93 & m64
        return x ^ x >> 32

    base = 0x5851F42D4C957F2D
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if w]
    hashes = [scramble(sum(scramble((b + 32 if 65 <= b <= 90 else b) * 7 + 7 & m64) * pow(base, i, 2**64) for i, b in enumerate(w)) & m64) for w in words]
    shapes = []
    for w in words:
        big = sum(65 <= b <= 90 for b in w)
        odd = sum(32 < b < 127 and not chr(b).isalnum() for b in w)
        shapes.append(min(big, 3) * 64 + min(odd, 3) * 16 + int(min(np.log2(len(w) + 1), 7)) * 2 + (65 <= w[0] <= 90))
    pairs = [scramble(a * 3 + b + 5 & m64) for a, b in zip(hashes, hashes[1:])]
    forms = [scramble(((x * 1021 + y) * 2 + (a == b) + (1 << 40)) & m64) for x, y, a, b in zip(shapes, shapes[1:], hashes, hashes[1:])]
    return [h >> 48 for h in (*hashes, *pairs, *forms)]


def test_quality_is_that_of_plain_counts(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    texts = [text(random.randint(1, 60)) for _ in range(60)] + [text(30).upper() + "!!" for _ in range(12)] + [None, " ", "Oné É É x"]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 0) for i in range(60, 70)], "doc_id long, quality int")
    docs = docs_of(spark, texts)
    found = rows(quality.quality_sample(docs, labels), "doc_id", "log_weight", "score", "selected")
    roles = {r["doc_id"]: r["role"] for r in quality.labelled(docs, labels, 1000).collect()}
    draws = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(quality.SEED), "doc_id", "text").alias("h")).collect()}
    grams = [brute_buckets(t) for t in texts]
    raw, target = Counter(g for x in grams for g in x), Counter(g for i, x in enumerate(grams) if roles[i] == 1 for g in x)
    total = sum(raw.values()) + 65536
    ratio = lambda g: np.log((target[g] + 1000 * (raw[g] + 1) / total) / (sum(target.values()) + 1000) / ((raw[g] + 1) / total))
    evidence = [sum(map(ratio, x)) / (len(x) + 16) if x else None for x in grams]
    at, scale = quality.log_odds(*(np.array([evidence[i] for i in range(len(texts)) if roles[i] == role]) for role in (0, 2)))
    score = {}
    for i, e in enumerate(evidence):
        if e is None:
            assert found[i] == (None, None, False)
            continue
        u = ((draws[i] % 2**64 >> 11) + 0.5) / 2**53
        score[i] = scale * (e - at) - np.log(-np.log(u))
        assert found[i][0] == pytest.approx(scale * (e - at), abs=1e-9) and found[i][1] == pytest.approx(score[i], abs=1e-9)
    k = sum(e is not None and e >= at for e in evidence)
    best = sorted(score, key=lambda i: -score[i])[:k]
    assert {i for i in found if found[i][2]} == set(best)


def test_noise_counts_where_evidence_is_weak():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, 500), rng.normal(-1, 1, 500)
    at, scale = quality.log_odds(good, bad)
    assert abs(at) < 0.7 and 1.2 < scale < 3  # the log odds of these two are 2 x
    assert quality.log_odds(good, good[:0]) == (-np.inf, 0.0)
    at, scale = quality.log_odds(good + 20, bad - 20)
    assert 4 < scale * (good + 20 - at).mean() < 12


def test_kth_largest(spark):
    values = [random.gauss(0, 50) for _ in range(500)] + [7.5] * 20
    df = spark.createDataFrame([(v,) for v in values], "score double")
    for k in (1, 17, 300, 520):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


# 5 ---------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = sum(w for s, w in weight.items() if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * w / share for s, w in weight.items()}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    names = ["s1", "s0", "é", None, "hot", "z"]
    texts = [text(random.randint(0, 60)) for _ in range(300)] + [None, "", text(4000)]
    sources = [random.choice(["hot", *names]) for _ in texts]
    df = docs_of(spark, texts, sources)
    placed, pieces = mixing.mixture(df, block_words=16, shard_blocks_=32)
    pieces = pieces.toPandas()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    by_source = {}
    for i, s in enumerate(sources):
        by_source[s] = by_source.get(s, 0) + size[i]
    target = brute_targets(by_source)
    got = rows(placed, "doc_id", "size", "source", "source_size", "target")
    taken = pieces.groupby("doc_id")["words"].sum().to_dict()
    for i, (n, s, total, t) in got.items():
        assert (n, s, total) == (size[i], sources[i], by_source[sources[i]])
        assert t == pytest.approx(target[s])
        assert taken.get(i, 0) <= 2 * n
    for s, t in target.items():
        assert abs(sum(taken.get(i, 0) for i in got if sources[i] == s) - t) <= 1
    blocks = pieces.groupby("shard").apply(lambda g: len(set(zip(g["source"].fillna("-"), g["block"]))))
    assert len(blocks) > 4 and blocks.max() - blocks.min() <= 1  # shards hold equal numbers of blocks
    assert pieces.groupby([pieces["source"].fillna("-"), "block"])["shard"].nunique().max() == 1  # and these are disjoint
    again = mixing.mixture(df.repartition(7), block_words=16, shard_blocks_=32)[1].toPandas()
    order = ["doc_id", "block", "first"]
    assert pieces.sort_values(order)[[*order, "shard", "words"]].values.tolist() == again.sort_values(order)[[*order, "shard", "words"]].values.tolist()
    mixed = mixing.mixed_corpus(df).toPandas()
    assert mixed["text"].map(lambda t: len(t.split())).sum() == sum(taken.values())
    assert all(r.text in texts[r.doc_id] and r.n_chars == len(r.text) for r in mixed.itertuples())
    assert mixing.mixture(docs_of(spark, []))[1].count() == 0


@pytest.mark.parametrize("words", [(150, 50, 50), (60, 20, 40), (10, 0, 0), (1, 1, 1), (7, 300, 2, 5)])
def test_targets_of_sources_that_tie(spark, words):
    data = [(i, " ".join("w" * n), f"s{i}") for i, n in enumerate(words)]
    placed, pieces = mixing.mixture(spark.createDataFrame(data, "doc_id long, text string, source string"))
    want = brute_targets({f"s{i}": n for i, n in enumerate(words)})
    got = {r["source"]: r["target"] for r in placed.collect()}
    assert got == pytest.approx(want)
    taken = {r["source"]: r["n"] for r in pieces.groupBy("source").agg({"words": "sum"}).toDF("source", "n").collect()}
    assert all(abs(taken.get(s, 0) - t) <= 0.5 for s, t in want.items())


def test_deep_trees(spark):
    docs = docs_of(spark, [" ".join("w" * 400) for _ in range(30)], [f"s{i % 4}" for i in range(30)])
    shards = mixing.mixture(docs, block_words=8, shard_blocks_=4)[1].select("source", "block", "shard").distinct().groupBy("shard").count().collect()
    assert len(shards) == 1024 and {r["count"] for r in shards} <= {2, 3} and sum(r["count"] for r in shards) >= 18_000 / 8


def brute_shards(spark, blocks, shard_blocks):
    """Shard of each block, by source and block: the tree from its definition, with the library's uniform numbers."""
    from math import comb

    from pyspark.sql import functions as F

    names = sorted((s for s in blocks if s is not None), key=lambda s: s.encode()) + [None] * (None in blocks)
    depth = 0
    while shard_blocks << depth < sum(blocks.values()):
        depth += 1
    asked = spark.createDataFrame([(p, i + 1) for p in range(1, 1 << depth) for i in range(len(names))], "path long, no int")
    drawn = {(r["path"], r["no"]): r["u"] for r in asked.select("path", "no", mixing.uniform(F.lit(mixing.SEED), "path", "no").alias("u")).collect()}
    level = {1: [blocks[s] for s in names]}
    for _ in range(depth):
        below = {}
        for path, quotas in level.items():
            pool, draws, left = sum(quotas), (sum(quotas) + 1) // 2, []
            for i, n in enumerate(quotas):
                got = 0
                if draws and n:
                    weights = {k: comb(n, k) * comb(pool - n, draws - k) for k in range(max(0, draws - pool + n), min(n, draws) + 1)}
                    mode = min(max((draws + 1) * (n + 1) // (pool + 2), min(weights)), max(weights))
                    goal, seen = drawn[path, i + 1] * sum(weights.values()), 0
                    for got in [*range(mode, max(weights) + 1), *range(mode - 1, min(weights) - 1, -1)]:
                        seen += weights[got]
                        if seen >= goal:
                            break
                left.append(got)
                pool, draws = pool - n, draws - got
            below[2 * path], below[2 * path + 1] = left, [n - x for n, x in zip(quotas, left)]
        level = below
    found, used = {}, dict.fromkeys(names, 0)
    for path in sorted(level):
        for s, n in zip(names, level[path]):
            found |= {(s, used[s] + k): path - (1 << depth) for k in range(n)}
            used[s] += n
    return found


def test_shards_are_those_of_the_tree(spark):
    texts = [text(random.randint(0, 90)) for _ in range(160)] + [None, "", text(900)]
    sources = [random.choice(["a", "b", "hot", "hot", None]) for _ in texts]
    got = rows(mixing.taken_words(docs_of(spark, texts, sources), 16, 32), "doc_id", "size", "target", "taken", "n_shards", "first_shard")
    size = [len((t or "").split()) for t in texts]
    owed = {s: round(got[i][1]) for i, s in enumerate(sources)}
    shards = brute_shards(spark, {s: -(-n // 16) for s, n in owed.items()}, 32)
    assert len(set(shards.values())) > 4
    for s in owed:
        mine = sorted((i for i in range(len(texts)) if sources[i] == s), key=lambda i: hashlib.md5(f"{mixing.SEED}:{i}".encode()).digest())
        at, whole = 0, sum(size[i] for i in mine)
        for i in mine:
            places = [w for w in (*range(at, at + size[i]), *range(at + whole, at + whole + size[i])) if w < owed[s]]
            want = {shards[s, w // 16] for w in places}
            assert got[i][2:] == (len(places), len(want), min(want, default=None))
            at += size[i]


def test_mixing_of_clashing_columns(spark):
    names = "source text doc_id shard shuffle_key _row d p pieces n_chars".split()
    docs = spark.createDataFrame([("s", text(9), None, 1, "k", "r", 1, 2, 3, 4), ("s", text(9), 5, None, "k", "r", 1, 2, 3, 4)], "source string, text string, doc_id long, shard int, shuffle_key string, _row string, d int, p int, pieces int, n_chars int")
    assert docs.columns == names
    mixed = mixing.mixed_corpus(docs)
    assert mixed.columns == [*names, "shard_", "shuffle_key_"]
    got = mixed.collect()
    assert sum(len(r["text"].split()) for r in got) == 27 and {(r["doc_id"], r["shard"], r["_row"]) for r in got} == {(None, 1, "r"), (5, None, "r")}


def test_hypergeometric(spark):
    from pyspark.sql import functions as F

    n, marked, draws = 60, 25, 20
    df = spark.range(4000).select(mixing.hypergeometric(F.lit(marked), F.lit(n), F.lit(draws), mixing.uniform(F.lit(1), F.col("id"))).alias("k"))
    got = df.toPandas()["k"]
    assert got.min() >= 0 and got.max() <= draws
    mean, var = draws * marked / n, draws * marked / n * (1 - marked / n) * (n - draws) / (n - 1)
    assert abs(got.mean() - mean) < 0.15 and abs(got.var() - var) < 0.35


# 6 ---------------------------------------------------------------------------------------------------------------


def brute_pii(t):
    t, out = t or "", []
    luhn = lambda d: sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(f"email:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(f"ip:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(f"card:{m.start()}:{m.end()}")
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(f"phone:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    made = ["mail a.b@c.de, x@y.z@w.v..q é@a.b b@c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111", "+1 (988) 555-2485 then 555-2485 and +12 3 +49 30 1234567890123", "a@" * 50 + "b.c", "ü +1-800-555-0199 ü 1.1.1.1@x.y"]
    random_texts = ["".join(random.choice("12 .@+-(ab") for _ in range(80)) for _ in range(300)]
    texts = [*edge_texts(), *made, *random_texts]
    got = rows(pii.pii_spans(docs_of(spark, texts)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in enumerate(texts):
        want = brute_pii(t)
        assert got[i][:4] == tuple(sum(s.startswith(k) for s in want) for k in ("email:", "ip:", "card:", "phone:")), t
        assert got[i][4] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(filter(None, got[i][5].split(",")))
    assert pii.pii_spans(docs_of(spark, [])).count() == 0
    masked = pii.masked(docs_of(spark, texts))
    assert masked.columns == docs_of(spark, []).columns
    after = rows(masked, "doc_id", "text", "n_chars")
    assert after[0][0] is None and "[CARD]" in after[len(edge_texts()) + 2][0]
    assert all(n == len(t) for t, n in after.values() if t is not None)


def test_pii_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "a@" * 100_000):
        pii.base_spans(t)


def test_skip_links_carry_labels():
    seen = [f"{text(20)} call +1 ({random.randint(200, 999)}) 555-{random.randint(1000, 9999)} or user{i}.{i}@mail{i}.example.com {text(5)}" for i in range(200)]
    model = pii.train(seen + [f"{text(10)} {i} items {i * 7}" for i in range(50)])
    t = "write to user7.42@mail.example.com today; user7.42@mail said so; 12 items"
    (base, every), = pii.find_all([t], model)
    assert [t[a:b] for _, a, b in base] == ["user7.42@mail.example.com"]
    assert "user7.42@mail" in [t[a:b] for _, a, b in every] and "12" not in [t[a:b] for _, a, b in every]


def test_beliefs_are_marginals(monkeypatch):
    """Of graphs without a loop exactly, of loops nearly: all labellings are enumerated."""
    from itertools import product

    rng = np.random.default_rng(5)
    for chain, skip, near in (([(0, 1), (1, 2)], [], 1e-5), ([(0, 1)], [(1, 2), (0, 3)], 1e-5), ([], [(0, 2), (2, 1)], 1e-5), ([(0, 1), (1, 2)], [(0, 2)], 0.1)):
        graph = pii.Graph()
        n = 1 + max(max(x) for x in chain + skip)
        graph.feature, graph.fixed, graph.chain, graph.skip = rng.integers(0, 16, (n, 3)).tolist(), [0] * (n - 1) + [2], chain, skip
        model = {"score": rng.normal(0, 0.4, (16, 5)), "chain": rng.normal(0, 0.5, (5, 5)), "skip": 1.2}
        own = model["score"][np.array(graph.feature)].sum(axis=1)
        marginal = np.zeros((n, 5))
        for labels in product(range(5), repeat=n):
            if labels[-1] == 2:
                value = sum(own[i, x] for i, x in enumerate(labels[:-1])) + sum(model["chain"][labels[a], labels[b]] for a, b in chain) + sum(1.2 * (labels[a] == labels[b]) for a, b in skip)
                for i, x in enumerate(labels):
                    marginal[i, x] += np.exp(value)
        assert np.abs(pii.beliefs(graph, model) - marginal / marginal.sum(axis=1, keepdims=True)).max() < near


def test_training_texts_are_those_of_the_least_hashes(spark):
    texts = [f"mail a{i}@b.example" for i in range(30)] + ["nothing", None, "x@y " * 9000, "mail a1@b.example"]
    found = pii.training_texts(docs_of(spark, texts), 10)
    assert len(found) == len(set(found)) == 10 and set(found) <= set(texts[:30])
    assert found == pii.training_texts(docs_of(spark, texts).repartition(5), 10) and pii.training_texts(docs_of(spark, []), 10) == []


def test_field_needs_no_base_span():
    seen = [f"{text(20)} call +1 ({random.randint(200, 999)}) 555-{random.randint(1000, 9999)} or user{i}.{i}@mail{i}.example.com {text(5)}" for i in range(200)]
    model = pii.train(seen + [f"{text(10)} {i} items {i * 7}" for i in range(50)])
    spread = "ask (017) 555-7713 or (017) 555-7713 today"
    (_, beside), (base, alone) = pii.find_all([f"{spread}. Not x.y@unrelated.example.org", spread], model)
    assert not base and [spread[a:b] for _, a, b in alone] == ["(017) 555-7713"] * 2 and set(alone) < set(beside)
    for t in ("4111 1111 1111 1111", "+49 30 1234 5678", "(017) 555-7713"):
        assert [t[a:b] for a, b, _ in pii.active_tokens(t)] == [t] and pii.resemblances(t)
    t = "in 2019 or 12 34, 5551234567 5551234568"
    assert [t[a:b] for a, b, _ in pii.active_tokens(t)] == ["2019", "12", "34", "5551234567", "5551234568"]


# 7 ---------------------------------------------------------------------------------------------------------------


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    base = text(300).split()
    texts = edge_texts()
    for i in range(60):
        some = list(base)
        for _ in range(i % 4):
            some[random.randrange(len(some))] = word()
        texts.append(" ".join(some))
    texts += [text(random.randint(1, 6)) for _ in range(40)]
    prints = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    got = rows(simhash.simhash_components(docs_of(spark, texts)), "doc_id", "fp", "component_id")
    assert {i: (v[0] % 2**64, v[1]) for i, v in got.items()} == {i: (p, label[i]) for i, p in enumerate(prints)}
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, texts)).collect()}
    assert kept == set(label)
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


def test_rows_without_an_id_link_others(spark):
    base = text(200).split()
    near = [" ".join(base[:i] + ["new"] * i + base[2 * i :]) for i in range(6)]
    prints = [brute_fingerprint(t) for t in near]
    rows_ = [(5, near[0]), (None, near[1]), (3, near[2]), (None, near[3]), (None, "other words alone")]
    label = [[j for j in range(4) if (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(4)]
    got = simhash.simhash_components(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    by_print = {r["fp"] % 2**64: r["component_id"] for r in got}
    assert len(got) == 5 and by_print[brute_fingerprint("other words alone")] is None
    if 1 in label[0] and 2 in label[1]:
        assert by_print[prints[0]] == by_print[prints[2]] == 3


@pytest.mark.parametrize("most", [simhash.MOST, 20, 0])
def test_shared_segments_are_looked_up_further(spark, most):
    rng = random.Random(6)
    low = rng.getrandbits(32)
    prints = {rng.getrandbits(32) << 32 | low ^ (rng.random() < 0.3 and 1 << rng.randrange(32)) for _ in range(120)}
    for p in list(prints):
        q = p
        for _ in range(rng.randint(1, 4)):
            q ^= 1 << rng.randrange(64)
        prints.add(q)
    prints = [p - 2**64 if p >= 2**63 else p for p in prints]
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) % 2**64).bit_count() <= 3}
    got = [tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp long"), most).collect()]
    assert set(got) == want and len(got) == len(want)


def test_near_pairs_at_every_distance(spark):
    rng = random.Random(5)
    prints, want = [], set()
    for i in range(60):
        p = rng.getrandbits(64)
        q = p
        for bit in rng.sample(range(64), i % 6):
            q ^= 1 << bit
        prints += [p, q]
        if 0 < i % 6 <= 3:
            want.add(tuple(sorted(x - 2**64 if x >= 2**63 else x for x in (p, q))))
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    got = simhash.near_pairs(spark.createDataFrame(signed, "fp long").distinct()).collect()
    assert {tuple(r) for r in got} == want


# 8 ---------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    vectors = []
    for size in (1, 1, 3, 40, 900):
        centre = rng.standard_normal(16)
        vectors += [(centre + rng.standard_normal(16) * 0.12).tolist() for _ in range(size)]
    vectors += [rng.standard_normal(16).tolist() for _ in range(200)]
    vectors += [vectors[0], vectors[0], [0.0] * 16, None, [], [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 4, [2.0] * 4]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, id string")
    found, recall = embeddings.near_links(df)
    got = rows(found, "vec_id", "n_links", "component_id")
    good = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    want = np.zeros(len(vectors), int)
    for i, v in enumerate(vectors):
        for j, w in enumerate(vectors):
            if i != j and good[i] and good[j] and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                want[i] += 1
    have = np.array([got[i][0] for i in range(len(vectors))])
    assert len(got) == len(vectors) and (have <= want).all() and have.sum() >= 0.97 * want.sum() and recall >= 0.9
    assert all(got[i] == (0, i) for i in range(len(vectors)) if not good[i])
    assert got[len(vectors) - 1] == (1, len(vectors) - 2)
    assert embeddings.near_links(df.limit(0))[0].count() == 0


def brute_links(vectors, least=0.9):
    """Links and smallest reachable id of ``(id, vector)`` rows, each a vector of its own."""
    n = len(vectors)
    near = np.zeros((n, n), bool)
    for i, (_, v) in enumerate(vectors):
        for j, (_, w) in enumerate(vectors):
            near[i, j] = i != j and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= least
    label = np.array([i for i, _ in vectors])
    for _ in range(n):
        label = np.minimum(label, np.where(near, label, label.max()).min(axis=1))
    return sorted((i, int(near[x].sum()), int(label[x])) for x, (i, _) in enumerate(vectors))


def test_embeddings_that_repeat_ids_and_differ_in_length(spark):
    rng = np.random.default_rng(9)
    rows_ = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])] + [(100 + i, rng.standard_normal(16).tolist()) for i in range(31)] + [(200 + i, [1.0, 1.0, 1.0, 1.0 + i / 9]) for i in range(2)]
    for centre in range(6):
        base = rng.standard_normal(5)
        rows_ += [(300 + 7 * centre + i % 4, (base + rng.standard_normal(5) * 0.3).tolist()) for i in range(8)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").coalesce(1)
    found, recall = embeddings.near_links(df)
    assert sorted(map(tuple, found.collect())) == brute_links(rows_) and recall == 1


@pytest.mark.parametrize("most", [10, 40, 160])  # the group of 90 is compared exactly, or its lists hold it
def test_saturated_lists_are_enlarged(spark, most):
    rng = np.random.default_rng(3)
    rows_ = [(i, (np.eye(12)[0] * 3 + rng.standard_normal(12) * 0.25).tolist()) for i in range(90)]
    rows_ += [(100 + i, (np.eye(12)[i // 3 % 12] * 2 + np.eye(12)[i // 36 + 1] + rng.standard_normal(12) * 0.2).tolist()) for i in range(100)]
    found, recall = embeddings.near_links(spark.createDataFrame(rows_, "vec_id long, embedding array<double>"), most=most)
    assert sorted(map(tuple, found.collect())) == brute_links(rows_) and recall == 1


def test_chunks_of_a_tight_block_connect(spark):
    n = 1300  # rounding noise: all codes agree, so that each code has one block of three chunks
    vectors = [[1.0, 2.0, 3.0 + i * 1e-13] for i in range(n)]
    _, vec = embeddings.classes(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    blocks = embeddings.coded(vec, 0, 2, 4).cache()
    dealt = [{(r["id"], r["chunk"]) for r in blocks.filter(f"code_no = {no}").collect()} for no in (0, 1)]
    assert dealt[0] != dealt[1] and {c for _, c in dealt[0]} == {0, 1, 2}
    roots = components(embeddings.from_blocks(blocks.filter("code_no = 0"), 10).select("a", "b")).collect()
    assert len(roots) == n and {r["root"] for r in roots} == {0}


def test_links_between_saturated_groups(spark):
    rng = np.random.default_rng(6)
    one, other = np.eye(16)[0], np.eye(16)[0] * 0.93 + np.eye(16)[1] * (1 - 0.93**2) ** 0.5
    vectors = [c + rng.standard_normal(16) * 1e-3 for c in (one, other) for _ in range(30)] + [rng.standard_normal(16) for _ in range(20)]
    near = np.array([v / np.linalg.norm(v) for v in vectors])
    near = near @ near.T >= 0.9
    assert near[:60, :60].all() and not near[:60, 60:].any()
    found, _ = embeddings.near_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    got = rows(found, "vec_id", "n_links", "component_id")
    assert all(got[i] == (59, 0) for i in range(60)) and [got[i][0] for i in range(80)] == (near.sum(axis=0) - 1).tolist()


def test_audit_counts_each_class(spark):
    rng = np.random.default_rng(7)
    vectors = [np.eye(24)[0] + rng.standard_normal(24) * 1e-3 for _ in range(200)]  # a hot group and ten pairs
    vectors += [np.eye(24)[i // 2 + 1] + rng.standard_normal(24) * 1e-3 for i in range(20)]
    _, vec = embeddings.classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    named = {r["low"]: r["id"] for r in vec.collect()}
    links = [(named[i], 199 if i < 200 else 1) for i in range(220)]
    assert embeddings.audited(vec, spark.createDataFrame(links, "id long, links long")) == 1
    assert embeddings.audited(vec, spark.createDataFrame(links[:200], "id long, links long")) == 0  # 0.9995 of all links
    assert embeddings.audited(vec, spark.createDataFrame(links[:210], "id long, links long")) == 0.5


def test_failed_audit_is_repaired(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = [c + rng.standard_normal(16) * 0.15 for c in rng.standard_normal((12, 16)) for _ in range(5)]
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    near = unit @ unit.T >= 0.9
    monkeypatch.setattr(embeddings, "from_blocks", lambda blocks, k: blocks.selectExpr("id a", "id b", "cast(0 as double) cosine").limit(0))
    monkeypatch.setattr(embeddings, "TRIES", 1, raising=False)
    found, recall = embeddings.near_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    reach = np.linalg.matrix_power(near.astype(float), 60) > 0
    assert recall == 1 and near.sum() > 120
    assert rows(found, "vec_id", "n_links", "component_id") == {i: (near[i].sum() - 1, reach[i].argmax()) for i in range(60)}


# 9 ---------------------------------------------------------------------------------------------------------------


def brute_substrings(texts):
    seen, out = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def substrings_of(docs, **how):
    found = substrings.removal(docs, **how).collect()
    return [(r["doc_id"], (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())) for r in found]


@pytest.mark.parametrize("size, most", [(substrings.CHUNK, substrings.MOST), (256, 40), (300, 0)])  # pieces of texts, large buckets
def test_substrings(spark, size, most):
    passage = text(40)
    texts = edge_texts()
    for i in range(60):
        texts.append(text(random.randint(0, 40)) + passage[random.randint(0, 40) : random.randint(60, len(passage))] + text(random.randint(0, 40)))
    texts += ["ab" * 60, "ab" * 70, "b" + "ab" * 40, "é" * 60, "x" * 49, "x" * 50, "x" * 51]
    texts += [f"{text(3)}a common line of thirty bytes!!{text(3)}" for _ in range(60)]
    found = dict(substrings_of(docs_of(spark, texts), size=size, most=most))
    assert found == dict(enumerate(brute_substrings(texts)))
    assert substrings.removal(docs_of(spark, []), size, most).count() == 0


def test_windows_stand_once_in_the_pieces():
    for t in edge_texts():
        data, rolling = (t or "").encode(), substrings.Rolling(256 + 50)
        nodes = [np.zeros(0, int)] + [np.repeat(a[0] - np.cumsum(a[1]) + a[1], a[1]) + np.arange(a[1].sum()) for a in substrings.anchors(data, 256, rolling)]
        assert np.concatenate(nodes).tolist() == list(range(max(0, len(data) - 49)))


@pytest.mark.parametrize("most", [substrings.MOST, 0])
def test_substrings_of_rows_that_repeat_an_id(spark, most):
    one, two, three = text(30), text(30), text(30)
    data = [(1, one), (1, two), (1, one), (2, f"{two} {one[5:]}"), (2, three), (None, one), (None, three), (3, f"x{three}"), (3, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    seen = {1: brute_substrings([one]) + brute_substrings([two]) + brute_substrings([one])}
    first = f"{one}\x00{two}"  # all that document 1 holds
    seen[2] = [brute_substrings([first, data[3][1]])[1], brute_substrings([three])[0]]
    seen[3] = [brute_substrings([three, data[7][1]])[1], brute_substrings([None])[0]]
    seen[None] = brute_substrings([one]) + brute_substrings([three])
    found = substrings_of(docs, most=most)
    for i, want in seen.items():
        assert sorted(v for k, v in found if k == i) == sorted(want), i


def test_settling_is_the_same_in_any_batches():
    rng = np.random.default_rng(2)
    rows = np.stack([rng.integers(0, 12, 400), rng.integers(0, 3, 400), rng.integers(0, 5, 400)], axis=1)  # key, check, doc
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    columns = [rows[:, 0], rows[:, 2], np.zeros(400, np.int32), np.arange(400) << substrings.START_AT | 1, rows[:, 1]]
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, substrings.NODES)], schema=substrings.NODES)
    want = set()
    for key in range(12):
        mine = [i for i in range(400) if rows[i, 0] == key]
        low = {c: min(rows[i, 2] for i in mine if rows[i, 1] == c) for c in {rows[i, 1] for i in mine}}
        several = len(set(low.values())) > 1
        want |= {(i, bool(rows[i, 2] > low[rows[i, 1]])) for i in mine if several or rows[i, 2] > low[rows[i, 1]]}
    for size in (1, 3, 7, 50, 400):
        found = pa.Table.from_batches(substrings.settle(iter([whole.slice(at, size) for at in range(0, 400, size)]))).to_pydict()
        assert sorted(zip(found["start"], found["settled"])) == sorted(want), size


def test_rows_without_an_id(spark):
    base = text(80)
    rows_ = [(0, base, "s", 1), (None, base, "s", 1), (None, None, None, None), (1, base + " x", "s", 1), (1, base + " x", "s", 1), (2, text(30), None, None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string, n_chars long")
    labels = spark.createDataFrame([(0, 1), (None, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(0, text(20)), (None, base)], "item_id long, text string")
    assert licenses.license_scan(docs).count() == simhash.simhash_components(docs).count() == pii.pii_spans(docs).count() == 6
    assert quality.quality_sample(docs, labels).count() == substrings.removal(docs).count() == mixing.mixture(docs)[0].count() == 6
    assert decontaminate.contamination(docs, items).count() == 4  # each row that holds the item without an id
    assert simhash.keep_one(docs).filter("doc_id is null").count() == 1 and quality.keep_good(docs, labels).count() == 5
    removed = {r["doc_id"]: r["n_removed"] for r in substrings.removal(docs.filter("doc_id is not null")).collect()}
    assert removed[0] == 0 and removed[1] == len(base) and removed[2] == 0
    assert mixing.mixed_corpus(docs).count() > 0 and pii.masked(docs).count() == 6
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_links(vectors)[0].collect()), key=str) == [(1, 1, 1), (2, 1, 1), (None, 0, None)]


def test_rows_are_told_apart(spark):
    texts = [text(30 + i) for i in range(40)]
    data = [(None if i < 10 else i // 2, t, "s", len(t)) for i, t in enumerate(texts)] + [(99, texts[0], "s", 1), (99, texts[0], "s", 1), (98, texts[1], "s", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mixed_corpus(docs)
    assert mixed.columns == [*docs.columns, "shard", "shuffle_key"]
    taken = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    size = sum(len(t.split()) for _, t, _, _ in data)
    assert abs(sum(len(t.split()) for _, t in taken) - 1.5 * size) <= 1 and any(i is None for i, _ in taken)
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()]
    assert kept.count((99, texts[0])) == 1 and len(kept) == len(data) - 3 and kept.count((98, texts[1])) == 1


# 10 --------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    long = "<p>" + "ü" * 120_000
    html = [None, "", "a", "x" * 1000, "x" * 1000, "x" * 999, "x" * 999, long, long, "\r\n\r\nWARC/1.1\r\n" + "0\r\n\r\n" * 400, "é" * 700, "x" * 1000]
    pages = [(i, None if i == 2 else f"http://e.org/{i}\r\nX: 1", h, "x") for i, h in enumerate(html)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archives(df, f"file://{tmp_path}/a")
    got = rows(warc.resolved(warc.read_archives(spark, f"file://{tmp_path}/a")), "page_id", "bytes", "sha1", "kind", "refers_to", "complete")
    last = {}
    for i, h in enumerate(html):
        last[h or ""] = i
    for i, h in enumerate(html):
        b = (h or "").encode()
        again = len(b) >= 1000 and last[h] != i
        assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[h] if again else None, True), i
    assert warc.segments(spark, f"file://{tmp_path}/a").filter("number > 1").count() > 3
    warc.write_archives(df.limit(0), f"file://{tmp_path}/b")


def test_warc_of_rows_that_repeat_an_id(spark, tmp_path):
    a, b = "<p>" + "a" * 1200, "<p>" + "b" * 40_000
    data = [(1, "u", a), (1, "v", b), (1, "u", "short"), (1, "u", "short"), (None, "u", a), (None, "w", b), (None, None, None), (7, "u", b), (7, "u", b), (3, "u", a)]
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, record string").repartition(3)
    warc.write_archives(df, f"file://{tmp_path}/a")
    got = warc.resolved(warc.read_archives(spark, f"file://{tmp_path}/a")).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(1, a, "revisit", 3), (1, b, "revisit", 7), (1, "short", "response", None), (1, "short", "response", None), (None, a, "revisit", 3), (None, b, "revisit", 7), (None, "", "response", None), (7, b, "response", None), (7, b, "revisit", 7), (3, a, "response", None)]
    assert sorted(((r["page_id"], r["bytes"], r["sha1"], r["kind"], r["refers_to"]) for r in got), key=str) == sorted(((i, len(t), sha(t), kind, to) for i, t, kind, to in want), key=str)
    assert all(r["complete"] for r in got)


def test_warc_gaps(spark, tmp_path):
    made = list(warc.page_records(warc.named(1, 5), "u", b"y" * 100_000, "d", None)) + list(warc.page_records(warc.named(2, 6), "u", b"ok", "d", None))
    for name, kept in (("all", made), ("gap", [r for r in made if b"WARC-Segment-Number: 2\r\n" not in r])):
        lines = spark.createDataFrame([(r,) for r in kept], "v binary").selectExpr("cast(v as string) v").coalesce(1)
        lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(f"file://{tmp_path}/{name}")
        got = rows(warc.read_archives(spark, f"file://{tmp_path}/{name}"), "page_id", "bytes", "complete")
        assert got == {5: (100_000, True) if name == "all" else (None, False), 6: (2, True)}
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1 200\r\n\r\n"))
    assert warc.unchunked(warc.chunked(b"a" * 20_000)) == b"a" * 20_000
