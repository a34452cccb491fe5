"""Importance resampling, token files and phrase mining against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from saltfinger.llm import importance, phrases, ranking, token_files
from saltfinger.llm.queries import ORACLES, QUERIES
from saltfinger.llm.screen import new_folder

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

ODD = [
    (5, "The cat. The cat! the CAT; a b, c", "en", "s"),
    (2, None, None, None),
    (3, "", "en", None),
    (None, "no id here", "fr", "s"),
    (4, "... ;; 123 --", None, "s"),
    (7, "the cat the cat the cat " * 30, "en", "hot"),
    (7, "the cat the cat the cat " * 30, "en", "hot"),
    (9, "x" * 5000 + " y " + "É" * 3000 + " don't <|endoftext|>   é", "und", "s"),
    (9, "Straße 12 the cat\tnew\vline\nİ ſ K naïve", "de", "s"),
]
COLUMNS = "doc_id long, text string, lang string, source string, score long, rank int, key string, n long"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], COLUMNS)


# --- importance resampling


def buckets(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def expected_scores(docs, target):
    own = [(i, *buckets(t)) for i, t in docs]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for x in target for b in buckets(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, n_words, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] if r[0] is not None else -1))
    top = fit[: 25 * len(fit) // 100]
    return [(r[0], r[2], r[3], r[4], next((k for k, x in enumerate(top, 1) if x is r), None)) for r in rows]


def test_scores_equal_brute_force(spark, small):
    got = importance.op11_query(spark, small).toPandas()
    docs, target = (pd.read_parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = expected_scores(list(zip(docs.doc_id, docs.text)), target.text)
    key = lambda r: tuple(-1 if x is None else int(x) for x in r)
    rows = got[["doc_id", "n_features", "weight", "score", "rank"]].astype(object).where(got.notna(), None)
    assert sorted(map(key, rows.itertuples(index=False))) == sorted(map(key, want))
    assert got["rank"].notna().sum() == 25 * sum(buckets(t)[0] >= 20 for t in docs.text) // 100


def test_scores_of_odd_rows(spark):
    target = spark.createDataFrame([("the cat",), (None,), ("",)], "text string")
    got = importance.scores(odd(spark), target, percent=50).collect()
    want = expected_scores([r[:2] for r in ODD], ["the cat", None, ""])
    assert sorted((r.doc_id or -1, r.n_features, r.weight, r.score) for r in got) == sorted((r[0] or -1, *r[1:4]) for r in want)
    # the two rows of 180 words are the only ones with 20 or more words; one of them is drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == [1]
    kept = importance.resample(odd(spark), target, percent=50)
    assert kept.columns == [c.split()[0] for c in COLUMNS.split(", ")] and [r.doc_id for r in kept.collect()] == [7, 7]


def test_empty_tables(spark):
    none = odd(spark, [])
    assert importance.scores(none, none).collect() == [] and importance.resample(none, none).collect() == []
    assert phrases.mine(none).collect() == []
    path = new_folder(spark, "tokens")
    token_files.write_sequences(none, path, P.path("word_bpe_49k.json"))
    assert token_files.read_documents(spark, path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB1 é.\0-_\U0001f600" + "z" * 3), max_size=120), max_size=6))
def test_streams_are_crc32_buckets(texts):
    import pyarrow as pa

    from saltfinger.llm.textkit import utf8

    out, offsets, n_words = importance.streams(*utf8(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        n, want = buckets(text)
        assert n_words[i] == n and out[offsets[i] : offsets[i + 1]].tolist() == want


def test_long_words_are_hashed_alike():
    import pyarrow as pa

    from saltfinger.llm.textkit import utf8

    text = " ".join("ab" * n for n in (1, 23, 24, 25, 60, 3000, 2))
    assert importance.streams(*utf8(pa.array([text])))[0].tolist() == buckets(text)[1]


def test_merged_runs_are_counts():
    rng = np.random.default_rng(1)
    own = [rng.integers(0, 50, n).astype(np.uint16) for n in (0, 1, 500, 77)]
    value, count = importance._merge([importance._lengths(np.sort(x)) for x in own])
    assert dict(zip(value.tolist(), count.tolist())) == Counter(np.concatenate(own).tolist())


def test_ranks_in_groups(spark):
    from pyspark.sql import functions as F

    rows = [("ab"[i % 3 == 0], (i * 37) % 11, i) for i in range(500)] + [(None, 1, 1000), ("b", 0, 1001)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = ranking.ranked(df, [F.asc("g"), F.desc("v"), F.asc("i")], ["g"])
    for g in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [r.i for r in sorted(got.where(F.col("g").eqNullSafe(g)).collect(), key=lambda r: r["rank"])] == [r[2] for r in own]
    alone = ranking.ranked(df, [F.asc("i")], name="place").collect()
    assert sorted(r.place for r in alone) == list(range(1, len(rows) + 1))


# --- token files


def encoder():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return token_files.Encoder(f.read())


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def by_unit():
    return encoder()


def check_encoding(by_unit, whole, texts):
    import pyarrow as pa

    from saltfinger.llm.textkit import utf8

    ids, at = by_unit.encode(*utf8(pa.array(texts, pa.string())))
    assert by_unit.by_unit
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text


ALPHABET = "aBz's.,!'\"-<|>_ \t\n\v\f\r\x1c\x85  ̸́ͅéßİΣςſK0１٣12»«–中😀‍"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=25), min_size=1, max_size=4))
def test_units_give_the_ids_of_whole_texts(by_unit, whole, texts):
    check_encoding(by_unit, whole, texts)


def test_units_of_known_traps(by_unit, whole):
    check_encoding(by_unit, whole, ["don't they're x's 'S 'LL I'Ve a.'s .'s '.s", "a<|endoftext|>b <|EndOfText|> <|startoftext|>. <|x", "≠ ≮ a.̸b", "", " ", "...!!! a..b--c", "Ümlaut É, é. 3.14,2"])


def test_documents_come_back_from_the_files(spark, small, whole):
    got = {r.doc_id: r for r in token_files.op12_query(spark, small).collect()}
    docs = pd.read_parquet(f"{small}/documents.parquet").sort_values("doc_id")
    start = 0
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_sequences_by_number_are_views_of_the_files(spark, whole):
    docs = spark.createDataFrame([(i, "the cat sat " * (i * 7 % 40)) for i in range(120)], "doc_id long, text string")
    path = new_folder(spark, "tokens")
    rows = token_files.write_sequences(docs, path, P.path("word_bpe_49k.json"), length=16, per_batch=4).collect()
    assert len(rows) > 2 and any(r["sequences"] > 8 for r in rows)
    seq = token_files.Sequences(path, rows)
    got = []
    for i in range(len(seq)):
        ids, mask = seq[i]
        assert len(ids) == len(mask) == 16 and not ids.flags.owndata and not ids.flags.writeable
        got += ids[mask.to_numpy(zero_copy_only=False)].tolist()
    assert got == [t for i in range(120) for t in [*whole.encode("the cat sat " * (i * 7 % 40), add_special_tokens=False).ids, 1]]
    assert sum(r["n"] for r in rows) == len(got)
    with pytest.raises(IndexError):
        seq[len(seq)]


def test_odd_documents_as_tokens(spark, whole):
    path = new_folder(spark, "tokens")
    token_files.write_sequences(odd(spark), path, P.path("word_bpe_49k.json"), length=8, per_batch=2)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 3, 4, 5, 7, 7, 9, 9]
    assert (got[1].n_tokens, got[2].n_tokens) == (1, 1)
    want = Counter((i, zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t, *_ in ODD)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want


def test_another_tokenizer_encodes_whole_texts(spark):
    path = new_folder(spark, "tokens")
    token_files.write_sequences(odd(spark), path, P.path("byte_bpe_50k.json"), length=8, per_batch=2, end_id=0)
    other = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter(zlib.crc32(np.array([*other.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t, *_ in ODD)
    assert Counter(r.ids_crc32 for r in token_files.read_documents(spark, path).collect()) == want


# --- phrases


def expected_phrases(docs, longest, least, inside, keep):
    counts, n = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    best = {}
    for (lang, w), a in counts.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(1000000 * a * a // (l * r), k, l, r) for k in range(1, len(w)) for l, r in [(counts[lang, w[:k]], counts[lang, w[k:]])]]
        best[lang, w] = (a, *min(cuts))
    out = []
    for (lang, w), (a, score, _, l, r) in best.items():
        longer = [x[0] for (m, v), x in best.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * x >= inside * a for x in longer):
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k, *x[1:]) for k, x in enumerate(own[:keep], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("longest, least, keep", [(2, 3, 2000), (3, 2, 7), (4, 3, 2000)])
def test_phrases_equal_brute_force(spark, longest, least, keep):
    rng = np.random.default_rng(longest)
    words, marks = ["new", "york", "city", "É", "b" * 300, "the", "of", "x-y", "\0"], [" ", " ", "\t", "  ", ". ", ",", "\n", " THE "]
    rows = [("".join(words[min(rng.geometric(0.3), 9) - 1] + marks[rng.integers(len(marks))] for _ in range(rng.integers(0, 60))), ["en", "fr", None][rng.integers(3)]) for _ in range(60)]
    rows += [(None, "en"), ("", None), *[("hot new york city", "en")] * 40, *((t, g) for _, t, g, _ in ODD)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, rank int").repartition(5)
    got = sorted(tuple(r) for r in phrases.mine(docs, longest, least, 50, keep).collect())
    assert got == expected_phrases(rows, longest, least, 50, keep)


def test_few_buckets_and_small_chunks_change_nothing(spark, monkeypatch):
    rows = [(f"one two {'three' if i % 3 else 'four'}. five six, one two\tthree " * 5, "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    want = expected_phrases(rows, 3, 10, 50, 2000)
    assert sorted(tuple(r) for r in phrases.mine(docs).collect()) == want
    import pyarrow as pa

    cuts = list(phrases.pieces(pa.array(["en"] * 20), pa.array([t for t, _ in rows]), 50))
    assert len(cuts) > 40 and b"".join(bytes(d) for d, _, _ in cuts) == "".join(t for t, _ in rows).encode()
    assert all(len(at) == len(langs) + 1 and at[-1] == len(data) for data, at, langs in cuts)


def test_products_beyond_64_bits(spark):
    row = spark.sql("SELECT (1000000 * (x * x)) div (y * z) s FROM (SELECT CAST(30000000001 AS decimal(15,0)) x, CAST(50000000000 AS decimal(15,0)) y, CAST(40000000000 AS decimal(15,0)) z)").first()
    assert row.s == 1000000 * 30000000001**2 // (50000000000 * 40000000000)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_phrase_mining"])
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    got = QUERIES[name](spark, small)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    key = lambda r: [str(x) for x in r]
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
