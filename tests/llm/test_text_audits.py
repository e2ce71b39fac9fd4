"""Runs of words, divergence of sources and SentencePiece ids, against brute force, SQL and the library."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from kgaudit.llm import divergence, pieces, repetitions
from kgaudit.llm.catalogue import oracle_sql

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string"


def brute_runs(words, least):
    """Every period and every stretch in which words one period apart agree."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_those_of_brute_force(least):
    rng = random.Random(least)
    for _ in range(700):
        n, letters = rng.randint(0, 90), rng.randint(1, 4)
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 3 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, n // 3 + 1)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert repetitions.find_runs(np.array(words, np.int64), least) == brute_runs(words, least)


def test_long_runs():
    words = np.arange(60_000) % 7
    assert repetitions.find_runs(words) == [(0, 60_000, 7)]
    words = np.random.default_rng(1).integers(0, 10**6, 50_000)
    words[20_000:] = words[20_000 + np.arange(30_000) % 9_000]
    assert repetitions.find_runs(words) == [(20_000, 30_000, 9_000)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "cc", "é x"]) for _ in range(rng.randint(0, 60))), "en", "s") for i in range(300)]
    rows += [(400, None, None, None), (401, "", "", ""), (402, " \t\n", "en", "s"), (None, "a " * 30, "en", "s"), (7, rows[7][1], "en", "s"), (403, "x " * 5000, "en", "s")]
    spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "runs").write.parquet(f"{tmp_path}/documents.parquet")
    got = repetitions.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for number, text, _, _ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(number).encode())
        if number is not None and h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words, 12)
        drop = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop).decode()
        want.append((number, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(kept)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 10 and got[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_no_documents(spark):
    assert repetitions.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_prefix_table_encodes_as_the_library():
    table = pieces.PrefixTable(pieces.read_model(MODEL))
    rng = random.Random(3)
    letters = [*"aehinorst .,", "  ", "     ", "▁", "\n", "\x00", "é", "日", "本", "𝄞", "²", ".", "<s>", "<0x41>", "the ", "ing", *rng.sample([t for t in table.text if t], 300)]
    for _ in range(3000):
        text = "".join(rng.choice(letters if rng.random() < 0.4 else letters[:12]) for _ in range(rng.randint(0, 60)))
        ids = table.encode(text)
        assert ids == table.library.encode(text), text
        assert table.decode(ids) == table.library.decode(table.library.encode(text))
    for long in ("ab" * 40_000, " " * 5000, "x" + "日" * 3000, "".join(rng.choice("aeinrst") for _ in range(50_000))):
        assert table.encode(long) == table.library.encode(long)


def test_prefix_table_without_borders_and_with_full_memories(monkeypatch):
    monkeypatch.setattr(pieces.PrefixTable, "borders", lambda self: "(?s:.+)")
    monkeypatch.setattr(pieces, "KEPT_STRETCHES", 3)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 5)
    table = pieces.PrefixTable(pieces.read_model(MODEL))
    for text in ("The theatre's 3 doors.  Open  at 9:00!", "été à la mer", "a b a b a b"):
        assert table.encode(text) == table.library.encode(text)


def test_last_token_of_every_prefix():
    table = pieces.PrefixTable(pieces.read_model(MODEL))
    text = "▁international"
    last = table.last_tokens(text)
    for i in range(1, len(text) + 1):
        assert table.text[last[i]] == table.merged(text[:i])[-1]


def test_sentencepiece_query(spark, tmp_path):
    rows = [(1, "Hello  world.\nNew line", "en", "s"), (2, None, None, None), (3, "", "en", ""), (4, " ", "en", ""), (None, "no id", "en", ""), (1, "Hello  world.\nNew line", "en", "s"), (5, "wort " * 30_000, "de", "s"), (6, "日本語 𝄞\x00", "ja", "s")]
    spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "ids").write.parquet(f"{tmp_path}/documents.parquet")
    library = pieces.PrefixTable(pieces.read_model(MODEL)).library
    want = []
    for number, text, _, _ in rows:
        ids = library.encode(text or "")
        want.append((number, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    got = pieces.op13_sentencepiece(spark, str(tmp_path), MODEL).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_results_go_out_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_IDS", 5)
    docs = spark.range(50).selectExpr("id as doc_id", "repeat('word ', cast(id as int)) as text")
    got = pieces.encoded(docs, pieces.read_model(MODEL)).collect()
    assert sorted(r.doc_id for r in got) == list(range(50)) and all(r.decoded == "word " * r.doc_id for r in got)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.read_model(str(tmp_path / "m"))


def divergence_rows(rng, n):
    words = ["Ähre", "ähre", "b", "ab", "aab", "zz", "Zz", "é", "x1y", "same", "samf"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None])) for i in range(n)]


def against_sql(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, DOCS)
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()['op12_source_divergence']})").fetchall()
    got = [tuple(r) for r in divergence.op12_source_divergence(spark, str(tmp_path)).select(columns).collect()]
    assert sorted(got) == sorted(want)
    return got


def test_divergence_against_sql(spark, tmp_path):
    rows = divergence_rows(random.Random(1), 400) + [(None, None, "fr", "alone"), (1, "few words", "fr", "other"), (1, "few words", "it", "single")]
    got = against_sql(spark, tmp_path, rows)
    assert {r[:5] for r in got if r[0] == "fr"} == {("fr", "alone", "pair", "other", 0), ("fr", "other", "pair", "alone", 0)}
    assert not [r for r in got if r[0] == "it"]


def test_divergence_with_ties_at_the_last_rank(spark, tmp_path):
    """120 terms that stand equally often in one source only: the first 50 by bytes lead, ties told apart late."""
    terms = ["t" * (1 + i % 7) + chr(97 + i % 26) + "é" * (i % 3) + chr(97 + i // 26) for i in range(120)]
    assert len(set(terms)) == 120
    rows = [(i, " ".join(terms), "en", "a") for i in range(30)] + [(100 + i, "other words", "en", "b") for i in range(30)]
    got = against_sql(spark, tmp_path, rows)
    lead = [r[3] for r in sorted((r for r in got if r[2] == "term" and r[1] == "a"), key=lambda r: r[5])]
    assert lead == sorted(terms, key=lambda t: t.encode())[:50]


def test_top_k_of_any_values(spark):
    rng = random.Random(9)
    rows = [(g, f"{rng.choice(['', 'a', 'ab', 'é'])}{i}", rng.choice([0, 1, 255, 256, 2**20, 2**33, rng.randrange(2**40)])) for g in ("x", "y", "z") for i in range({"x": 300, "y": 3, "z": 40}[g])]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for k in (1, 7, 40):
        got = {(r.g, r.item, r.value, r["rank"]) for r in divergence.top_k(df, ["g"], "value", "item", k).collect()}
        want = set()
        for g in ("x", "y", "z"):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))
            want |= {(*r, i) for i, r in enumerate(own[:k], 1)}
        assert got == want


def test_divergence_of_no_documents(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_terms_are_counted_whole_in_slices_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 10)
    monkeypatch.setattr(divergence, "HELD_TERMS", 2)
    docs = spark.createDataFrame([(1, "alpha beta " * 20 + "longerthanaslice", "en", "s"), (2, "Beta1beta", "en", "s"), (3, None, None, None)], DOCS)
    got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in divergence.term_counts(docs).collect()}
    assert got == {("en", "s", None): (0, 0), ("", "", None): (0, 0), ("en", "s", "alpha"): (20, 1), ("en", "s", "beta"): (22, 2), ("en", "s", "longerthanaslice"): (1, 1)}


def test_embeddings_of_extreme_size(spark):
    """Cosines of finite doubles whose squares overflow or vanish."""
    from kgaudit.llm import embeddings

    vectors = [[1e-200, 1e-200], [1.0, 0.1], [1e200, 1e200], [1e200, 1.01e200], [5e-324, 0.0], [1.7e308, 1.6e307], [0.0, 1e-300]]
    found, recall = embeddings.near_links(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert got == {0: (2, 0), 1: (2, 1), 2: (2, 0), 3: (2, 0), 4: (2, 1), 5: (2, 1), 6: (0, 6)} and recall == 1
