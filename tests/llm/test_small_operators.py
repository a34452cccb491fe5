import hashlib
import json
import random
import zlib

import pytest

from saltfinger.llm import decontaminate, fingerprint, language_id, licenses, main_text, mixing, preferences, warc
from saltfinger.llm.queries import QUERIES

from .conftest import words


# op1


def test_licenses(spark, no_docs):
    text = "Intro line. Licensed under the Apache License, Version 2.0.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n# Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nall rights reserved! You may not use this file except in compliance with the License."
    rows = [(1, text), (2, None), (3, ""), (4, "nothing here"), (5, "Released under the MIT License."), (6, "This is licensed to you"), (7, "x " * 20000 + "\nLicensed under CC BY-NC 4.0."), (5, "Released under the MIT License.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 5, 7}
    assert got[1].licenses == ["BSD-2-Clause", "Apache-2.0", "all-rights-reserved"] and got[1].unknown == ["apache2_copy"]
    assert got[5].licenses == ["MIT"] and got[7].licenses == ["CC-BY-NC-4.0"]
    assert licenses.scan(no_docs).count() == 0


WRAPPED = {
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
}


def test_sentences_and_rules_belong_together():
    import re as regex

    every = [x for own in licenses.SENTENCES.values() for x in own]
    assert len(every) == len(set(every)) and all(regex.search(licenses.LICENSE_WORDS, x) and regex.fullmatch("[a-z0-9]+( [a-z0-9]+)*", x) for x in every)
    assert {i for _, rule in licenses.RULES for i in rule} <= set(licenses.SENTENCES)


FULL = {
    "MIT": """MIT License

Copyright (c) 2020 A B

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004

   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
}


def test_official_texts(spark):
    rows = [(2 * i + k, "\n".join(mark + line for line in text.split("\n"))) for i, text in enumerate(FULL.values()) for k, mark in enumerate(("", "# "))]
    got = {r.doc_id: (r.licenses, r.unknown) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2 * i + k: ([name], []) for i, name in enumerate(FULL) for k in (0, 1)}


def test_scan_equals_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(23)
    texts = [*FULL.values(), *WRAPPED.values(), "All rights reserved", "mit license\nthe mit license\n\n; mit", "released under the mit license. Licensed under CC BY 4.0!"]
    rows = [(i, f"{words(rng, 3)}. {a}\n{words(rng, 2)}\n{b} {rng.choice(['', '.', ' x'])}\n\n{c}") for i in range(80) for a, b, c in [rng.sample(texts, 3)]] + [(900, None), (901, ""), (902, "permission")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(licenses.OP1_SQL).fetchall())
    got = sorted((r.doc_id, r.sentence_ids, r.licenses, r.unknown) for r in licenses.op1_query(spark, str(tmp_path)).collect())
    assert got == want and len(got) == 80


def test_wrapped_license_headers(spark):
    rows = [(2 * i + k, "int a\n" + "\n".join(mark + line for line in text.split("\n")) + "\nint b") for i, text in enumerate(WRAPPED.values()) for k, mark in enumerate(("", " * "))]
    got = {r.doc_id: (r.licenses, r.unknown) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2 * i + k: ([name], []) for i, name in enumerate(WRAPPED) for k in (0, 1)}


# op2


def test_contamination(spark, no_docs):
    rng = random.Random(3)
    items = [(i, words(rng, rng.randint(15, 60))) for i in range(10)] + [(10, None), (11, ""), (12, "too short"), (13, words(rng, 8))]
    clean = [(i, words(rng, 120)) for i in range(50)]

    def planted(doc, item, changes):
        w = items[item][1].split(" ")
        for at in rng.sample(range(len(w)), changes):
            w[at] = "Zz" + w[at]
        return doc, f"{words(rng, 30)}. {' '.join(w).upper()}! {words(rng, 10)}"

    dirty = [planted(100 + i, i, 0) for i in range(10)] + [planted(200 + i, i, 2) for i in range(10)] + [planted(300, 13, 0)]
    rows = clean + dirty + [(400, None), (401, ""), dirty[0]]
    docs = spark.createDataFrame([(d, t, 9, "h") for d, t in rows], "doc_id long, text string, item_id long, hits string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    assert {(100 + i, i) for i in range(10)} | {(300, 13)} <= got
    assert {(200 + i, i) for i in range(10) if len(items[i][1].split()) >= 20} <= got
    assert all(d >= 100 for d, _ in got)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.contamination(no_docs, bench).count() == decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_short_items_are_found_whole(spark):
    items = [(1, "Only these six words stand here"), (2, "two words"), (3, ""), (4, "seven words are as many as a"), (5, "once")]
    rows = [(1, "Well, only these SIX words, stand here."), (2, "only these six words stand there"), (3, "two other words"), (4, "these are Two Words."), (5, "once"), (6, None), (7, "x seven words are as many as a y")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (4, 2), (5, 5), (7, 4)}


def test_recall_against_brute_force(spark):
    """All items against all rows on every diagonal; seeds may miss few passages."""
    import re

    import numpy as np

    rng = random.Random(22)
    items = [(i, words(rng, rng.randint(13, 40))) for i in range(12)]
    rows = []
    for i in range(240):
        w = items[i % 12][1].split(" ")
        for at in rng.sample(range(len(w)), rng.randint(0, len(w) // 4)):
            w[at] = "zz" + w[at]
        rows.append((i, f"{words(rng, rng.randint(0, 20))} {' '.join(w)} {words(rng, 10)}"))
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    want = set()
    for d, text in rows:
        a = np.array(split(text))
        for i, item in items:
            b = np.array(split(item))
            for diagonal in range(-len(b) + 1, len(a)):
                low, high = max(0, diagonal), min(len(a), diagonal + len(b))
                equal = decontaminate.widest_stretch(a[low:high] == b[low - diagonal : high - diagonal], 0.8)[2]
                if equal >= (13 if len(b) > 13 else -(-4 * len(b) // 5)):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 150


def test_widest_stretch_is_brute_force():
    import numpy as np

    rng = random.Random(14)
    for _ in range(300):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randint(1, 30))])
        first, end, equal = decontaminate.widest_stretch(same, 0.8)
        rule = [(int(same[a:z].sum()), a - z, -a) for a in range(len(same)) for z in range(a + 1, len(same) + 1) if same[a] and same[z - 1] and 5 * same[a:z].sum() >= 4 * (z - a)]
        assert (equal, first - end, -first) == max(rule, default=(0, 0, 0))


def test_stretch_with_a_change_near_its_end(spark):
    rng = random.Random(15)
    items = [(0, words(rng, 16)), (1, words(rng, 10))]
    rows = []
    for item, at in ((0, 3), (0, 12), (1, 1), (1, 8)):
        w = items[item][1].split(" ")
        w[at] = "zzz" + w[at]
        rows.append((10 * item + at, f"{words(rng, 30)} {' '.join(w)} {words(rng, 30)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_equal, r.n_words) for r in got} == {(3, 0, 15, 16), (12, 0, 15, 16), (11, 1, 9, 10), (18, 1, 9, 10)}


def test_decontaminate_decides_by_row(spark):
    rng = random.Random(17)
    item = words(rng, 30)
    rows = [(None, item), (None, words(rng, 30)), (5, item), (5, words(rng, 30)), (6, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r.text != item)


# op3


def test_main_text():
    model = main_text.trained()
    page = "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>First  <b>bold</b>\ntext here.<p>Second&nbsp;one<br>after.<script>var t='</p>'</script></article><div class='comments'><p>Nice!</p></div><footer>Copyright</footer></body>"
    assert main_text.main_text(page, model) == "A & B First bold text here. Second one after."
    assert main_text.main_text(None, model) == main_text.main_text("", model) == main_text.main_text("<div></div>", model) == ""
    deep = "<div>" * 20000 + "<p>Deep text, quite deep it is.</p>"
    assert main_text.main_text(deep, model) in ("", "Deep text, quite deep it is.")
    for broken in ("<", "<p", "</p></div>", "<!-- open", "<script>x", "a < b and c > d", "<p>&#0;&bogus;</p>"):
        main_text.main_text(broken, model)


HOSTILE = {
    "unclosed tags": "<a " * 100_000, "unclosed tags and an end": "<a " * 100_000 + ">", "stray ends": "<b>" * 50_000 + "</i>" * 50_000, "bounded ends": "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000,
    "open quote": "<a x=1 " * 50_000 + '"' + ">", "quoted ends": '<a ">" ' * 50_000, "attributes": "<a " + 'x="1" ' * 50_000 + ">text", "comments": "<!-" * 100_000, "no head": "<head>" * 50_000, "scripts": "<textarea>" * 30_000,
    "deep": "<div>" * 60_000 + "<p>" * 60_000, "lists": "<ul><li>" * 30_000, "less": "<" * 300_000, "tables": "<table><td>" * 20_000 + "</p>" * 20_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    import time

    model = main_text.trained()
    began = time.perf_counter()
    main_text.main_text(HOSTILE[name], model)
    assert time.perf_counter() - began < 10


def test_markup_inside_an_article():
    texts = lambda page: [n[3] for n in main_text.parse(page) if n[1] == "#run"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo>2</math> be.</p>") == ["Let", "x", "=", "2", "be."]
    assert texts("<p title='a > b'>one</p><p data-x=\"<p>\">two</p>") == ["one", "two"]
    assert texts("<p>a<script>if (a</b) '<p>'</script>b") == ["ab"] and texts("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert texts("<p>a<p>b</i></p>c<!-- <p>no --> d") == ["a", "b", "c d"] and texts("a <b>c</b> < d & e") == ["a c < d & e"]


def test_marginals_are_brute_force():
    import itertools
    import math

    rng = random.Random(6)
    for _ in range(20):
        n = rng.randint(1, 7)
        up = [-1, *(rng.randrange(i) for i in range(1, n))]
        odds = [rng.gauss(0, 2) for _ in range(n)]
        edge = [[math.exp(rng.gauss(0, 1)) for _ in range(4)] for _ in range(n)]
        on, all_ = [0.0] * n, 0.0
        for state in itertools.product((0, 1), repeat=n):
            p = math.prod(math.exp(odds[i] * state[i]) for i in range(n)) * math.prod(edge[i][2 * state[up[i]] + state[i]] for i in range(1, n))
            all_ += p
            for i in range(n):
                on[i] += p * state[i]
        belief = main_text.marginals(up, odds, edge)[0]
        assert [1 / (1 + math.exp(-b)) for b in belief] == pytest.approx([x / all_ for x in on])


def test_unseen_layouts_are_read():
    model, good, total = main_text.trained(), 0, 0
    for page, runs in main_text.labelled_pages(100, seed=99):
        nodes = main_text.parse(page)
        labels = main_text.labels_of(nodes, runs)
        for node, b, label in zip(nodes, model.content(nodes), labels, strict=True):
            if node[1] == "#run":
                total += 1
                good += (b > 0) == label
    assert good / total > 0.97


# op4


def test_canonical_fingerprints():
    assert fingerprint.fingerprint("Ｆoo  BAR\n") == fingerprint.fingerprint("foo bar") != fingerprint.fingerprint("foo baz")
    assert fingerprint.canonical("Straße ﬁ") == "strasse fi"


def test_texts_of_one_fingerprint_are_told_apart(spark):
    assert spark.sql("SELECT xxhash64('a1b2') AS h").first().h == fingerprint.print_keys(["a1b2"]).view("int64")[0]
    docs = spark.createDataFrame([(5, "Same text"), (3, "same  TEXT"), (2, "some text"), (9, "some text"), (1, "sole"), (None, "some text"), (7, "other")], "doc_id long, text string").repartition(3)
    want = {(5, 3), (3, 3), (2, 2), (9, 2), (1, 1), (None, 2), (7, 7)}
    for digest in (fingerprint.wide, lambda raw: raw[:1].decode()):
        assert {(r.doc_id, r.class_id) for r in fingerprint.copy_classes(docs, digest).collect()} == want


def test_neighbours_and_classes(docs, corpus, no_docs):
    rows = sorted(((-(2**63) if d is None else d), t or "") for d, t in corpus)
    got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in fingerprint.neighbours(docs).collect())
    want = []
    for i, (d, t) in enumerate(rows):
        other, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(fingerprint.fingerprint(t) == fingerprint.fingerprint(other))))
    # rows of one doc_id are in the order of their fingerprints
    assert [w for w in got if w[0] != 5] == [w for w in sorted(want) if w[0] != 5]
    classes = {(r.doc_id, r.class_id) for r in fingerprint.copy_classes(docs).collect()}
    assert {(100 + i, 0) for i in range(12)} | {(403, 403), (404, 403), (401, 400), (402, 400)} <= classes
    assert fingerprint.neighbours(no_docs).count() == fingerprint.copy_classes(no_docs).count() == 0


# op6


def test_preferences(spark):
    rows = [(0, 0, "system", "be nice"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", None), (4, 0, "assistant", "same"), (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (None, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, at long").repartition(3)
    got = {r.conv_id: r for r in preferences.format_preferences(preferences.pairs_from_turns(turns)).collect()}
    assert set(got) == {0, 1, 2, 4, 5}
    assert got[0].n_prompt_turns == 2 and got[0].prompt == "<|system|>\nbe nice<|end|>\n<|user|>\nhi<|end|>\n"
    assert got[0].chosen == "<|assistant|>\nhello<|end|>\n" and got[0].rejected == "<|assistant|>\n<|end|>\n"
    first, end = got[0].chosen_mask[0]
    assert got[0].chosen[first:end] == "hello<|end|>\n"
    assert got[2].rejected is None and got[2].prompt == "" and got[2].chosen == "<|user|>\n<|end|>\n"
    assert got[4].n_prompt_turns == 1 and got[4].chosen == got[4].rejected == "" and got[4].chosen_mask == []
    assert preferences.format_preferences(preferences.pairs_from_turns(turns.limit(0))).count() == 0


# op7


def test_raking_and_sampling(spark, no_docs):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(5, 60)), rng.choice(["en", "en", "en", "fr", None]), "hot" if i % 3 else f"s{i % 7}", 0) for i in range(3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, weight long").repartition(4)
    targets = {"lang": {"en": 0.4, "fr": 0.4, None: 0.2}}
    celled = mixing.with_cells(docs, mixing.fit_topics(docs)).cache()
    local = {(r.source, r.lang, r.topic): (r.weight, r.p) for r in mixing.probabilities(celled, targets).collect()}
    far = {(r.source, r.lang, r.topic): (r.weight, r.p) for r in mixing.probabilities(celled, targets, sweeps=6, local_cells=0).collect()}
    for lang, share in targets["lang"].items():
        assert sum(w for (_, code, _), (w, _) in local.items() if code == lang) == pytest.approx(share, abs=1e-6)
    assert set(local) == set(far) and all(far[c][1] == pytest.approx(local[c][1], abs=5e-3) for c in local)
    kept = mixing.sample(docs, targets).collect()
    tokens = sum(len(t.split()) for _, t, *_ in rows)
    assert sum(r.tokens for r in kept) == pytest.approx(0.5 * tokens, rel=0.1)
    assert {r.doc_id for r in kept} == {r.doc_id for r in mixing.sample(docs, targets).collect()}
    clashing = mixing.sample(docs.withColumns({"p": docs.text, "tokens": docs.lang, "topic": docs.doc_id}), targets)
    assert {(r.doc_id, r.tokens) for r in clashing.collect()} == {(r.doc_id, r.tokens) for r in kept}
    assert mixing.sample(no_docs.drop("k", "sig")).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.sample(nothing).count() == 0


def test_topics_are_word_clusters_of_the_corpus(spark):
    import numpy as np

    rng = random.Random(18)
    kinds = [[words(rng, 1) for _ in range(40)] for _ in range(2)]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(80)) + "  \n") for i in range(200)] + [(900, None), (901, ""), (902, "a  b c\n\nd")]
    docs = spark.createDataFrame([(*r, "s", "en") for r in rows], "doc_id long, text string, source string, lang string").repartition(3)
    topics = mixing.fit_topics(docs)
    again = mixing.fit_topics(docs.repartition(5))
    assert (topics.mean == again.mean).all() and (topics.axes == again.axes).all()
    shares = []
    for _, text in rows:
        own = mixing.words(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0]
        if len(own):
            shares.append(np.bincount((own & np.uint64(63)).astype(int), minlength=64) / len(own))
    cov = np.cov(np.array(shares).T, bias=True)
    lead = np.linalg.eigh(cov)[1][:, -1]
    assert topics.mean == pytest.approx(np.mean(shares, axis=0), abs=1e-8) and abs(lead @ topics.axes[:, 0]) == pytest.approx(1, abs=1e-4)
    got = {r.doc_id: (r["__topic"], r["__tokens"]) for r in mixing.with_cells(docs, topics).collect()}
    assert got[900] == got[901] == ("none", 0) and got[902][1] == 4 and all(got[i][1] == 80 for i in range(200))
    bit = {i: int(got[i][0][1:]) & 1 for i in range(200)}
    assert len({bit[i] for i in range(0, 200, 2)}) == len({bit[i] for i in range(1, 200, 2)}) == 1 and bit[0] != bit[1]


def test_sample_is_that_of_a_second_computation(spark):
    """Raking, scale and draws computed again with plain loops."""
    import numpy as np

    rng = random.Random(19)
    rows = [(i, words(rng, rng.randint(1, 40)), rng.choice(["a", "b", "c", None]), rng.choice(["en", "en", "fr"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    topics = mixing.fit_topics(docs)
    cell = {r.doc_id: (r.source, r.lang, r["__topic"], r["__tokens"]) for r in mixing.with_cells(docs, topics).collect()}
    tokens: dict = {}
    for *c, t in cell.values():
        tokens[tuple(c)] = tokens.get(tuple(c), 0) + t
    weight = {c: t / sum(tokens.values()) for c, t in tokens.items()}
    goals = []
    for d in range(3):
        share: dict = {}
        for c, w in weight.items():
            share[c[d]] = share.get(c[d], 0) + w
        goals.append({v: x**0.5 for v, x in share.items()})
        goals[-1] = {v: x / sum(goals[-1].values()) for v, x in goals[-1].items()}
    for _ in range(300):
        for d in range(3):
            for v, goal in goals[d].items():
                now = sum(w for c, w in weight.items() if c[d] == v)
                for c in weight:
                    if c[d] == v:
                        weight[c] *= goal / now
    low, high = 0.0, 1e12
    for _ in range(200):
        scale = (low + high) / 2
        kept = sum(min(tokens[c], scale * weight[c]) for c in tokens)
        low, high = (scale, high) if kept < 0.5 * sum(tokens.values()) else (low, scale)
    p = {c: min(1.0, low * weight[c] / tokens[c]) for c in tokens}
    draw = {r.doc_id: (r.h % 2**64 >> 1) / 2**63 for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 0) AS h").collect()}
    want = {d for d, c in cell.items() if draw[d] < p[c[:3]]}
    got = {r.doc_id: r.p for r in mixing.sample(docs).collect()}
    assert set(got) == want and len(want) > 100
    assert all(got[d] == pytest.approx(p[cell[d][:3]], rel=1e-6) for d in got)
    assert np.isfinite(list(got.values())).all()


def test_raking_in_spark_ends_as_in_the_driver(spark, monkeypatch):
    cells = [("s0", "en", 1000), ("s1", "en", 10), ("s1", "fr", 10), ("s2", "fr", 1000), (None, "de", 500)]
    docs = spark.createDataFrame([(s, lang, "note", t) for s, lang, t in cells], "__source string, __lang string, __topic string, __tokens long")
    targets = {"source": {"s0": 0.35, "s1": 0.2, "s2": 0.2, None: 0.25}, "lang": {"en": 0.45, "fr": 0.3, "de": 0.25}}
    asked, rake = [], mixing._rake_in_spark

    def watched(cells, shares, sweeps):
        asked.append(sweeps)
        return rake(cells, shares, sweeps)

    monkeypatch.setattr(mixing, "_rake_in_spark", watched)
    # the marginals are met after two sweeps; no path has a limit of its own
    local, far = ({(r.source, r.lang): (r.weight, r.p) for r in mixing.probabilities(docs, targets, local_cells=n).collect()} for n in (100, 0))
    assert asked == [200]
    assert set(local) == set(far) and all(far[c] == pytest.approx(local[c], rel=0, abs=1e-12) for c in local)


# op8


def test_chunked_framing():
    for body in (b"", b"x", ("é" * 5000).encode(), b"a\r\n\r\nWARC/1.1\r\n" * 900):
        assert warc.unchunked(warc.chunked(body)) == body
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 4000 + "</p>"
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, None), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", "y" * 100), (7, "u", "y" * 100), (0, "u", "y" * 100), (7, "u", "y" * 100), (None, "u", "z" * 200)]
    pages = spark.createDataFrame([(*r, "d", 3) for r in rows], "page_id long, url string, html string, digest string, head long").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=5000)
    records = warc.read_records(spark, str(tmp_path / "w"))
    back = warc.reassemble(records).collect()
    assert sorted(str(r.page_id) for r in back) == sorted(str(i) for i, *_ in rows)
    got = {r.page_id: r for r in back}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 7, None}
    for page, _, html in rows:
        raw = (html or "").encode()
        assert got[page].payload_digest == hashlib.sha256(raw).hexdigest() and got[page].payload_bytes == len(raw) and got[page].intact
    assert got[1].n_segments > 5 and got[1].record_type == "response" and got[2].refers_to == 1
    assert [got[i].record_type for i in (0, 6, 7, 4, 5, 3)] == ["response", "revisit", "revisit", "response", "response", "response"] and got[7].refers_to == 0
    lost = records.where("NOT (kind = 'continuation' AND segment = 3)")
    assert not {r.page_id: r for r in warc.reassemble(lost).collect()}[1].intact
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.reassemble(warc.read_records(spark, str(tmp_path / "none"))).count() == 0


# op9


def test_language(spark, no_docs):
    rng = random.Random(9)
    sound = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "sch"], "cc": ["ção", "é", "lh"]}
    rows = [(i, " ".join("".join(rng.choice(sound[lang]) for _ in range(3)) for _ in range(30)), lang) for i, lang in enumerate(rng.choice(list(sound)) for _ in range(400))]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 %%", "bb"), (903, "kalomi " * 5000, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, backoff long").repartition(3)
    models = language_id.fit(docs)
    assert models.langs == sorted(sound)
    got = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text"), models).collect()}
    assert all(got[d].lang_pred == lang and not got[d].rejected and 0 <= got[d].score <= 1 for d, _, lang in rows[:400])
    assert all(got[d].lang_pred == "und" and got[d].score == 0 and got[d].rejected for d in (900, 901, 902)) and got[903].lang_pred == "aa"
    noise = spark.createDataFrame([(1, "zzqx xqzj jqxz wqzx vvxq " * 40)], "doc_id long, text string")
    assert language_id.identify(noise, models).first().rejected
    clashing = docs.withColumns({"score": docs.doc_id, "nats": docs.text, "rejected": docs.lang})
    again = language_id.identify(clashing, models)
    assert {r.doc_id: (r.lang_pred, r.score) for r in again.collect()} == {d: (r.lang_pred, r.score) for d, r in got.items()} and dict(again.dtypes)["score"] == "double"
    known = language_id.known(clashing, models)
    assert known.columns == clashing.columns and {r.doc_id for r in known.collect()} == {d for d, r in got.items() if not r.rejected}
    held = {r[0]: r[1] for r in docs.select("doc_id", language_id.held_out(docs.doc_id)).collect()}
    assert all(v == (zlib.crc32(str(d).encode()) % 4 == 2) for d, v in held.items())
    assert language_id.fit(no_docs) is None
    assert {r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), None).collect()} == {"und"}


def test_language_left_out_of_training(spark):
    """Texts of a language that no model knows are rejected; a mislabelled row does
    not lift the bounds, and texts longer than the sample's bound are learned from."""
    rng = random.Random(21)
    sound = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["str", "ung", "sch", "ei"], "cc": ["ção", "é", "lh", "que"]}
    text = lambda lang, n=60: " ".join("".join(rng.choice(sound[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choice(["aa", "bb"]) for _ in range(600))]
    wrong = [(1000 + i, text("bb"), "aa") for i in range(6)]
    known = spark.createDataFrame(rows + wrong, "doc_id long, text string, lang string")
    models = language_id.fit(known)
    assert models.langs == ["aa", "bb"] and models.false_rejections <= 0.03
    new = spark.createDataFrame([(i, text("cc", 40)) for i in range(50)], "doc_id long, text string")
    assert language_id.identify(new, models).where("rejected").count() == 50
    fresh = spark.createDataFrame([(i, text(rng.choice(["aa", "bb"]), rng.randint(5, 80))) for i in range(200)], "doc_id long, text string")
    assert language_id.identify(fresh, models).where("rejected").count() <= 2
    long = spark.createDataFrame([(i, text("aa", 300), "aa") for i in range(20)], "doc_id long, text string, lang string")
    assert language_id.fit(long, sample_chars=500).langs == ["aa"]


def test_kneser_ney_is_brute_force():
    """Interpolated Kneser-Ney probabilities by nested counting over strings."""
    import math
    from collections import Counter

    import numpy as np

    texts = {"x": ["abcab cab bca aab cabc"] * 2, "y": ["dede ed dde abed"] * 2}
    models = language_id.Models(["x", "y"], texts)
    size = 1 + len({c for t in texts.values() for c in "".join(t) + " "})

    def tables(own):
        grams = {n: Counter() for n in range(1, 6)}
        for t in own:
            padded = " " * 4 + t
            for e in range(4, len(padded)):
                grams[5][padded[e - 4 : e + 1]] += 1
        for n in range(4, 0, -1):
            for g in grams[n + 1]:
                grams[n][g[1:]] += 1
        return grams

    def prob(grams, history, c):
        p = 1 / size
        for n in range(1, 6):
            context = history[len(history) - n + 1 :] if n > 1 else ""
            own = {g: k for g, k in grams[n].items() if g[:-1] == context}
            if not own:
                continue
            n1, n2 = sum(k == 1 for k in grams[n].values()), sum(k == 2 for k in grams[n].values())
            d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
            total = sum(own.values())
            p = max(own.get(context + c, 0) - d, 0) / total + d * len(own) / total * p
        return p

    for history in ("abca", " cab", "dede", "zzzz", "    "):
        for c in "abcde z":
            sym = np.array([0 if x == " " else ord(x) for x in history + c], np.uint32)
            got = models._log(sym)[0]
            want = [math.log(prob(tables(texts[lang]), history, c)) for lang in ("x", "y")]
            assert got.tolist() == pytest.approx(want, abs=1e-5), (history, c)


def test_model_is_a_distribution():
    import numpy as np

    models = language_id.Models(["x", "y"], {"x": ["abcab cab bca aab"] * 3, "y": ["dede ed dde"] * 3})
    letters = sorted({int(c) for c in np.frombuffer("abcde".encode(), np.uint8)} | {0})
    for history in ("abca", "xx a", "dede", "zzzz"):
        logs = []
        for c in [*letters, ord("z")]:
            sym = np.array([*(ord(h) if h != " " else 0 for h in history), c], np.uint32)
            logs.append(models._log(sym)[0])
        assert np.exp(np.array(logs)).sum(axis=0) == pytest.approx([1.0, 1.0], abs=1e-5)


# all


def test_queries_are_named_by_their_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_queries_run(spark, small):
    for name, fn in QUERIES.items():
        assert fn(spark, small).limit(5).toJSON().map(json.loads).count() >= 0, name
