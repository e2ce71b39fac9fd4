"""The pipeline on a small corpus against a brute-force version of its stages."""

import random
import re

import corpus_pipeline
from test_corpus_operators import brute_fingerprint, brute_pii, brute_targets

SYLLABLES = "an ber ti on el ra mo su ke lin dor fa".split()


def text(n):
    return " ".join("".join(random.choice(SYLLABLES) for _ in range(random.randint(1, 3))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    random.seed(8)  # whatever ran before
    items = [text(25) for _ in range(3)]
    good = [text(random.randint(40, 120)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in text(40).split()) for _ in range(40)]
    good[20], good[21] = good[10], good[10]  # copies
    good[30] = f"{text(40)} {items[1]} {text(40)}"
    good[40] += " mail a.b@mail.example.com or +1 (988) 555-2485"
    texts = good + bad + [None, ""]
    texts += [good[10], good[30], bad[0], text(80)]  # rows that repeat an id or have none are judged, too
    ids = list(range(len(texts) - 4)) + [None, None, None, 5]
    sources = [f"s{i % 3}" for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100)] + [(i, 0, 0) for i in range(150, 175)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts) if i < 150 or i == len(texts) - 1}
    root = {i: min(j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
    survivors = {i for i in prints if root[i] == i} - {30}
    assert 10 in survivors and not survivors & {20, 21} and len(texts) - 1 in survivors

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"file://{tmp_path}")
        assert kept.columns == docs.columns, name
        kept.write.parquet(f"file://{tmp_path}/{name}")
        kept = spark.read.parquet(f"file://{tmp_path}/{name}")
    masked = good[40].replace("a.b@mail.example.com", "[EMAIL]").replace("+1 (988) 555-2485", "[PHONE]")
    rows = {i: masked if i == 40 else texts[i] for i in survivors}
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((ids[i], t) for i, t in rows.items()) and not brute_pii(masked)

    size = {i: len(t.split()) for i, t in rows.items()}
    target = brute_targets({s: sum(n for i, n in size.items() if sources[i] == s) for s in ("s0", "s1", "s2")})
    mixed = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    taken = {s: sum(len(r["text"].split()) for r in mixed if r["source"] == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    for r in mixed:
        assert any(re.search(r"(^|\s)" + re.escape(r["text"]) + r"($|\s)", t) for i, t in rows.items() if ids[i] == r["doc_id"])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "source_mixing"]
