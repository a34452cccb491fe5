import hashlib
import random

import numpy as np
import pytest

from saltfinger.llm import suffix_dedup as S
from saltfinger.llm.merge_runs import common_prefix, front_code, merge


def brute(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for x in raw:
        for p in range(len(x) - size + 1):
            seen[x[p : p + size]] = seen.get(x[p : p + size], 0) + 1
    out = []
    for (d, _), x in zip(rows, raw, strict=True):
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - size + 1):
            if seen[x[p : p + size]] > 1:
                gone[p : p + size] = True
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        out.append((d, len(x), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [400, 90])
def test_removed_bytes(docs, corpus, size):
    got = [tuple(r) for r in S.removal_digest(docs, size).collect()]
    assert sorted(got, key=str) == brute(corpus, size)


def test_few_letters(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(400))) for i in range(12)] + [(20, "ab" * 200), (21, "b" * 300)]
    rows += [(30 + i, rows[i][1][i * 20 : i * 20 + 120] + "c" * i) for i in range(8)]
    got = [tuple(r) for r in S.removal_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 60).collect()]
    assert sorted(got, key=str) == brute(rows, 60)


def test_merge_of_runs():
    rng = random.Random(2)
    for count in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 20))) for _ in range(count)]
        got = list(merge([front_code(r) for r in runs]))
        assert [x for *_, x in got] == sorted(x for r in runs for x in r)
        assert all(runs[r][i] == x for r, i, _, x in got)
        for (*_, a), (_, _, lcp, b) in zip(got[:-1], got[1:], strict=True):
            assert lcp == common_prefix(a, b, 0)


def test_common_prefix():
    a = bytes(range(200))
    for n in (0, 1, 15, 16, 17, 80, 199):
        b = a[:n] + bytes([255]) + a[n + 1 :]
        assert common_prefix(a, b, 0) == common_prefix(a, b, n // 2) == n
    assert common_prefix(a, a[:50], 0) == 50


def test_drop_repeats(docs, corpus, no_docs):
    out = S.drop_repeats(docs, 90)
    assert out.columns == docs.columns
    rows = {(r.doc_id): r for r in out.collect()}
    assert 100 not in rows and rows[400].text is None and rows[401].text == ""
    assert all(r.n_chars == len(r.text) for r in rows.values() if r.text is not None)
    long = {d: n for d, n, gone, *_ in brute(corpus, 90) if not gone}
    assert all(d in rows for d in long if d is not None)
    assert S.drop_repeats(no_docs).count() == S.removal_digest(no_docs).count() == 0


def test_passages_of_a_second_length(docs, corpus):
    got = sorted((tuple(r) for r in S.removal_digest(docs, 400, 90).collect()), key=str)
    long, short = {}, {}
    for (d, n, gone, runs, digest), (_, _, passages, *_) in zip(brute(corpus, 400), brute(corpus, 90), strict=True):
        long.setdefault((d, n, gone, runs, digest), []).append(passages)
    for *key, passages in got:
        short.setdefault(tuple(key), []).append(passages)
    assert {k: sorted(v) for k, v in short.items()} == {k: sorted(v) for k, v in long.items()}


@pytest.mark.parametrize("hot", [0, 6])
def test_hot_anchors_are_counted(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_PLACES", hot)
    got = [tuple(r) for r in S.removal_digest(docs, 90).collect()]
    assert sorted(got, key=str) == brute(corpus, 90)


def test_equal_rows_do_not_multiply_spans(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    counts = []
    for n in (3, 60):
        docs = spark.createDataFrame([(1, text)] * n, "doc_id long, text string").repartition(3)
        found = S.repeated_spans(docs, 100).collect()
        assert len(found) == 1 and S.removal_digest(docs, 100).where("n_removed = 2000").count() == n
        counts.append(len(found[0].spans))
    assert counts[0] == counts[1]
