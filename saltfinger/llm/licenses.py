"""License scan by sentence recognition and ordered rules (operator 1).

Texts are cut into sentences, sentences are normalised (lower case, punctuation
to spaces, runs of spaces folded, comment marks dropped) and looked up among the
known sentences of licenses; a known sentence has an identifier. The identifiers
of a document, in order, are then matched against an ordered list of rules: a
rule is a sequence of identifiers that must follow each other, and the
identifiers that an earlier rule has used are no longer there for a later one.
Identifiers that no rule uses are reported as unknown.

Sentences may go over several pieces of the cut: hard-wrapped ones, with or without
comment marks, and those with ; : or "v." inside. From each piece that begins a
known sentence, pieces are joined as long as they follow one; empty ones do not
count. The longest is taken, and the search goes on behind it. Documents without one
of the license words are left out before that; only documents with a known sentence
come back. Null and empty texts have no sentence. Rows that repeat a
doc_id are scanned as the one text whose parts they are, in the order of their
texts' hashes. Other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public license texts and notices.
SENTENCES = {
    "apache2_notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache2_copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may not use this file except in compliance with the license"],
    "asis_software": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit_notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit_title": ["mit license", "the mit license", "the mit license mit"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "asis_mit": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl3_notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gpl version 3", "licensed under gplv3"],
    "gpl2_notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "licensed under the gpl version 2", "licensed under gplv2"],
    "gpl_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl_notice": ["licensed under the gnu lesser general public license version 2 1", "this library is licensed under the gnu lesser general public license version 2 1"],
    "lgpl3_notice": ["licensed under the gnu lesser general public license version 3", "this library is licensed under the gnu lesser general public license version 3"],
    "agpl3_notice": ["licensed under the gnu affero general public license version 3"],
    "mpl2_notice": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "ccby_notice": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa_notice": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccbync_notice": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0_notice": ["released under cc0 1 0", "licensed under cc0 1 0", "this work is released into the public domain under cc0 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "mit_liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc_warranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc_liability": ["in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "bsd_warranty": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd_liability": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "apache2_title": ["apache license version 2 0 january 2004"],
    "apache2_grant": ["subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"],
    "gpl_copy": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl_free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3_free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl_hope": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "agpl3_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "mpl2_copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "zlib_asis": ["this software is provided as is without any express or implied warranty"],
    "zlib_liability": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "epl2_notice": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "licensed under the eclipse public license version 2 0"],
    "epl1_notice": ["all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution"],
    "boost_notice": ["distributed under the boost software license version 1 0"],
    "ccbynd_notice": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "ccbyncsa_notice": ["licensed under cc by nc sa 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    "reserved": ["all rights reserved", "copyright all rights reserved"],
}
#: Rules in order, license <- identifiers that follow each other.
RULES = [
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_warranty", "bsd_liability"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty", "bsd_liability"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_title", "mit_grant", "mit_keep", "asis_mit", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_keep", "asis_mit", "mit_liability"]),
    ("MIT", ["mit_title", "mit_grant", "mit_keep", "asis_mit"]),
    ("MIT", ["mit_grant", "mit_keep", "asis_mit"]),
    ("ISC", ["isc_grant", "isc_warranty", "isc_liability"]),
    ("Zlib", ["zlib_asis", "zlib_liability", "zlib_grant"]),
    ("Apache-2.0", ["apache2_title", "apache2_grant"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_copy"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_copy"]),
    ("LGPL-2.1-or-later", ["lgpl_free", "lgpl_hope"]),
    ("LGPL-3.0-or-later", ["lgpl3_free", "lgpl_hope"]),
    ("AGPL-3.0-or-later", ["agpl3_free", "gpl_hope"]),
    ("MPL-2.0", ["mpl2_notice", "mpl2_copy"]),
    ("MIT", ["mit_grant", "mit_keep"]),
    ("Apache-2.0", ["apache2_notice", "apache2_copy", "apache2_copy", "asis_software"]),
    ("Apache-2.0", ["apache2_notice", "apache2_copy"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope"]),
    ("Apache-2.0", ["apache2_notice"]),
    ("MIT", ["mit_notice"]),
    ("ISC", ["isc_grant"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("GPL-3.0-only", ["gpl3_notice"]),
    ("GPL-2.0-only", ["gpl2_notice"]),
    ("LGPL-2.1-only", ["lgpl_notice"]),
    ("LGPL-3.0-only", ["lgpl3_notice"]),
    ("AGPL-3.0-only", ["agpl3_notice"]),
    ("MPL-2.0", ["mpl2_notice"]),
    ("CC-BY-4.0", ["ccby_notice"]),
    ("CC-BY-SA-4.0", ["ccbysa_notice"]),
    ("CC-BY-NC-4.0", ["ccbync_notice"]),
    ("CC0-1.0", ["cc0_notice"]),
    ("Unlicense", ["unlicense"]),
    ("LGPL-2.1-or-later", ["lgpl_free"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("AGPL-3.0-or-later", ["agpl3_free"]),
    ("Zlib", ["zlib_grant"]),
    ("EPL-2.0", ["epl2_notice"]),
    ("EPL-1.0", ["epl1_notice"]),
    ("BSL-1.0", ["boost_notice"]),
    ("CC-BY-ND-4.0", ["ccbynd_notice"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa_notice"]),
    ("Apache-2.0", ["apache2_title"]),
    ("MIT", ["mit_title"]),
    ("all-rights-reserved", ["reserved"]),
]
# a line "SPDX-License-Identifier: <name>" is a sentence and a rule of its own for each name
for _name in sorted({name for name, _ in RULES} - {"all-rights-reserved"}):
    SENTENCES[f"spdx_{_name}"] = ["spdx license identifier " + re.sub("[^a-z0-9]+", " ", _name.lower())]
    RULES.append((_name, [f"spdx_{_name}"]))
#: A word that every known sentence has.
LICENSE_WORDS = "in no event|of the mpl|licen|permission|permitted|redistribut|copyright|warrant|public domain|free software|unencumbered|cc0|rights reserved|compliance|endorse|merchantab"
#: A sentence ends at a line end, or at . ! ? ; : before white space or the end.
SENTENCE_END = r"\n|[.!?;:]+(\s+|$)"


def _recognised(pieces: list[str], known: dict[str, str], heads: set[str]) -> list[tuple[int, str]]:
    """(place, identifier) of the known sentences that pieces make up, in order."""
    found, i = [], 0
    while i < len(pieces):
        line, best, j = pieces[i], None, i
        while line in heads:
            if line in known:
                best = (known[line], j)
            j += 1
            while j < len(pieces) and not pieces[j]:
                j += 1
            if j == len(pieces):
                break
            line += " " + pieces[j]
        if best:
            found.append((i, best[0]))
            i = best[1]
        i += 1
    return found


def known_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, part, pos, sentence_id) of the known sentences of every document."""
    known = {s: i for i, own in SENTENCES.items() for s in own}
    heads = {" ".join(s.split(" ")[: n + 1]) for s in known for n in range(s.count(" ") + 1)}
    schema = "doc_id long, part long, pos int, sentence_id string"

    def run(batches):
        end, other = re.compile(SENTENCE_END.replace("(", "(?:"), re.ASCII), re.compile("[^a-z0-9]+")
        for batch in batches:
            rows = []
            for doc, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = [other.sub(" ", piece).strip() for piece in end.split(text)]
                rows += [(doc, part, *hit) for hit in _recognised(pieces, known, heads)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "part", "pos", "sentence_id"])

    text = F.col("text").cast("string")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("part"), F.lower(text).alias("text"))
    return marked.where(F.col("text").rlike(LICENSE_WORDS)).mapInArrow(run, schema)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses, unknown): the known sentences in order,
    the licenses that the rules find, distinct and in the rules' order, and the
    identifiers that no rule used."""
    return _by_rules(known_sentences(docs))


def _by_rules(sentences: DataFrame) -> DataFrame:
    found = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "sentence_id"))).alias("own"))
    ids = found.select("doc_id", F.transform("own", lambda x: x["sentence_id"]).alias("sentence_ids"))
    # " a  b  c ": each identifier between spaces of its own; a used one becomes "-"
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(rule) + " ").alias("want")) for name, rule in RULES))
    start = F.struct(line.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        hit = F.contains(acc["left"], rule["want"])
        return F.struct(F.replace(acc["left"], rule["want"], F.lit(" - ")).alias("left"), F.when(hit, F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    out = ids.withColumn("__end", F.aggregate(rules, start, step)).select("doc_id", "sentence_ids", F.col("__end.left").alias("__left"), F.col("__end.found").alias("licenses"))
    unknown = F.filter(F.split(F.trim("__left"), " +"), lambda x: (x != "-") & (x != ""))
    return out.select("doc_id", "sentence_ids", "licenses", unknown.alias("unknown"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    """The documents that hold known license sentences, and their licenses."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.array_join("unknown", " ").alias("unknown"))


def _oracle() -> str:
    table = ", ".join(f"('{s}', '{i}')" for i, own in SENTENCES.items() for s in own)
    left, found = "' ' || sentence_ids_2 || ' '", "''"
    steps = []
    for n, (license_, rule) in enumerate(RULES):
        want = " " + "  ".join(rule) + " "
        steps.append(f"s{n + 1} AS (SELECT doc_id, sentence_ids, replace(l, '{want}', ' - ') AS l, CASE WHEN contains(l, '{want}') AND NOT contains(',' || f || ',', ',{license_},') THEN CASE WHEN f = '' THEN '{license_}' ELSE f || ',{license_}' END ELSE f END AS f FROM s{n})")
    return f"""WITH RECURSIVE known(sentence, sentence_id) AS (VALUES {table}),
heads AS (SELECT DISTINCT array_to_string(list_slice(w, 1, n), ' ') AS head FROM (SELECT w, unnest(range(1, len(w) + 1)) AS n FROM (SELECT string_split(sentence, ' ') AS w FROM known))),
cut AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\n|[.!?;:]+(\\s+|$)')) AS s, generate_subscripts(string_split_regex(lower(text), '\\n|[.!?;:]+(\\s+|$)'), 1) AS pos FROM documents WHERE regexp_matches(lower(text), '{LICENSE_WORDS}')),
piece AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM (SELECT doc_id, pos, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS n FROM cut) WHERE n <> ''),
line AS (SELECT doc_id, r AS r0, r, n AS l FROM piece JOIN heads ON head = n UNION ALL SELECT line.doc_id, r0, piece.r, l || ' ' || n FROM line JOIN piece ON piece.doc_id = line.doc_id AND piece.r = line.r + 1 JOIN heads ON head = l || ' ' || n),
hit AS (SELECT doc_id, r0, max(r) AS e, arg_max(sentence_id, r) AS sentence_id FROM line JOIN known ON l = sentence GROUP BY doc_id, r0),
next AS (SELECT a.*, (SELECT min(b.r0) FROM hit b WHERE b.doc_id = a.doc_id AND b.r0 > a.e) AS r1 FROM hit a),
taken AS (SELECT * FROM next QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r0) = 1 UNION ALL SELECT next.* FROM taken JOIN next ON next.doc_id = taken.doc_id AND next.r0 = taken.r1),
own AS (SELECT doc_id, string_agg(sentence_id, ' ' ORDER BY r0) AS sentence_ids, string_agg(sentence_id, '  ' ORDER BY r0) AS sentence_ids_2 FROM taken GROUP BY doc_id),
s0 AS (SELECT doc_id, sentence_ids, {left} AS l, {found} AS f FROM own),
{", ".join(steps)}
SELECT doc_id, sentence_ids, f AS licenses, array_to_string(list_filter(string_split_regex(trim(l), ' +'), lambda x: x <> '-' AND x <> ''), ' ') AS unknown FROM s{len(RULES)}"""


OP1_SQL = _oracle()
