import random
import re

import pytest

from saltfinger.llm import jaccard_join as J
from saltfinger.llm import components
from saltfinger.llm.components import connected_components

from .conftest import words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components_are_those_of_all_links(docs, corpus, n, percent):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs, n, percent).collect()]
    assert sorted(got, key=str) == brute(corpus, n, percent)


@pytest.mark.parametrize(("leaders", "rounds"), [(1, 0), (1, 3)])
def test_leaders_and_rounds_lose_no_link(docs, corpus, monkeypatch, leaders, rounds):
    monkeypatch.setattr(J, "LEADERS", leaders)
    monkeypatch.setattr(J, "BEST_ROUNDS", rounds)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs, 4, 70).collect()]
    assert sorted(got, key=str) == brute(corpus, 4, 70)


@pytest.mark.parametrize(("n", "percent", "cell", "least"), [(4, 85, 256, 5), (1, 80, 4, 50)])
def test_every_link_is_given(docs, corpus, monkeypatch, n, percent, cell, least):
    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "LARGE_BLOCK", 8)
    sets = [shingles(t, n) for _, t in corpus]
    names = {}
    for (d, _), s in zip(corpus, sets, strict=True):
        names[s] = min((x for x in (d, names.get(s)) if x is not None), default=None)
    kinds = [s for s in names if s]
    linked = {(s, t): len(s & t) for s in kinds for t in kinds if s != t and 100 * len(s & t) >= percent * len(s | t)}
    got = [(frozenset([(r.class_a, r.n_a), (r.class_b, r.n_b)]), r.overlap) for r in J.jaccard_links(docs, n, percent).collect()]
    want = {(frozenset([(names[s], len(s)), (names[t], len(t))]), both) for (s, t), both in linked.items()}
    assert len(got) == len(linked) // 2 and set(got) == want and len(got) > least
    rows = [(r.doc_id, r.n_shingles, r.class_id, r.n_copies, r.n_links) for r in J.link_counts(docs, n, percent).collect()]
    hand = [(d, len(s), names[s] if s else d, sets.count(s) - 1 if s else 0, sum(a == s for a, _ in linked)) for (d, _), s in zip(corpus, sets, strict=True)]
    assert sorted(rows, key=str) == sorted(hand, key=str)


def test_keep_one(docs, corpus):
    want = brute(corpus, 5, 80)
    kept = J.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}, key=str) == sorted({d for d, n, c in want if not n or d == c}, key=str)


def test_keep_one_decides_by_row(spark):
    rng = random.Random(16)
    x, y, z, u, v = (words(rng, 40) for _ in range(5))
    near = z + " end"
    rows = [(5, x), (5, y), (2, y), (None, z), (None, near), (None, u), (None, x), (7, v), (7, v), (7, v + " end"), (None, "")]
    docs = spark.createDataFrame([(i, t, {"a": 1}) for i, t in rows], "doc_id long, text string, m map<string, int>").repartition(3)
    kept = J.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [r for r in got if r[1] not in (z, near) and r[0] != 7] == sorted([(5, x), (2, y), (None, u), (None, "")], key=str)
    assert sum(r[1] in (z, near) for r in got) == 1 and sum(r[0] == 7 for r in got) == 1


def test_empty(no_docs):
    assert J.jaccard_components(no_docs).count() == 0
    assert J.keep_one(no_docs).count() == 0


def test_percent_is_checked():
    with pytest.raises(ValueError, match="percent"):
        J.Threshold(20)


def test_rounds_end_at_stars(spark):
    stars = lambda edges: components._stars(spark.createDataFrame(edges, "u long, v long"))
    assert stars([]) and stars([(2, 1), (3, 1), (5, 4)])
    assert not stars([(2, 1), (3, 2)]) and not stars([(3, 1), (3, 2)])


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (70, 70), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
