"""Phrase collocation mining with hashed bucket counts (operator 13).

The corpus is read once for each phrase length. The pass for n words counts exactly the
phrases that can still be frequent, and at the same time counts phrases of n + 1 words
into hash buckets. A task keeps one byte a bucket, which stops at the least count asked
for; segments of the tasks' counters are added up in groups of at most ``FAN`` and become
a bitmap of the buckets that are full enough. The next pass counts a phrase only if its
bucket is (the bitmap is broadcast) and both phrases of one word less are frequent
(Apriori, by a screen). Bitmap and screen have bounds that do not grow with the input;
beyond them more phrases are counted than need be, and counts stay exact, since every
phrase is told apart by its text.

Everything is per language. ``mine`` scores each frequent phrase of two words or more by
its weakest cut, drops those that a longer frequent phrase mostly explains, and ranks the
rest by a range sort, so that no task holds a whole language. Products are decimals of
up to 38 digits: exact for counts below 10**15.

Null texts are empty, a null language is "und"; phrases never cross a piece or document.
Of repeated documents each counts. Of the input, lang and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .screen import Screen, input_bytes, new_folder
from .textkit import lowered, mix, release, rolling, runs, signed, span_hash, strings, utf8

CHUNK_BYTES = 2 << 20
#: Counters of a segment, the piece in which a task's counters are sent on.
SEGMENT = 1 << 14
#: Tasks whose counters are added up in one group.
FAN = 128
#: Bounds of the buckets' number, as powers of two; in between, an eighth of the input's bytes.
LEAST_BITS, MOST_BITS = 14, 25

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~(_BLANK | _BREAK)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def text_hash(column: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    data, at = utf8(column)
    return mix(span_hash(rolling(data), at[:-1], at[1:]) + np.diff(at).astype(np.uint64))


def first_key(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(lang * _STEP + word)


def next_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(key * _STEP + word)


def pieces(langs: pa.Array, texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(bytes, offsets, language of each row) of at most limit bytes. Longer rows are
    cut at their last break before the limit, as often as there is one."""
    data, at = utf8(texts)
    row, n, here = 0, len(texts), 0
    while row < n:
        end = int(np.searchsorted(at, here + limit, "right")) - 1
        if end > row:  # whole rows, the first from here on
            yield data[here : at[end]], np.concatenate(([here], at[row + 1 : end + 1])) - here, langs[row:end]
            row, here = end, int(at[end])
            continue
        breaks = np.flatnonzero(_BREAK[data[here : here + limit]])
        stop = here + int(breaks[-1]) + 1 if len(breaks) else int(at[row + 1])
        yield data[here:stop], np.array([0, stop - here]), langs[row : row + 1]
        here = stop
        if here == at[row + 1]:
            row += 1
    release()


class Grams:
    """The words of a chunk and, length by length, its phrases that still count.

    ``kind[i]`` is the number of the distinct (language, phrase) that begins at word i,
    ``live[i]`` whether one does; ``key`` has a 64-bit hash of each kind, and ``word``
    the number of its last word. Numbers are told apart by text, not by hash.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: pa.Array):
        data = lowered(data)
        start, end = runs(data, at, _WORD)
        coded = strings(data, start, end, _WORD).dictionary_encode()
        self.words, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        own = langs.dictionary_encode()
        self.langs = own.dictionary
        row = np.searchsorted(at, start, "right") - 1
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_BREAK[data], out=breaks[1:])
        self.joined = np.zeros(len(start), dtype=bool)
        self.joined[:-1] = (breaks[start[1:]] == breaks[end[:-1]]) & (row[1:] == row[:-1])
        lang = own.indices.to_numpy().astype(np.int64)[row]
        n_words = max(len(self.words), 1)
        kinds, self.kind = np.unique(lang * n_words + index, return_inverse=True)
        self.lang, self.parts = kinds // n_words, [kinds % n_words]
        self.live = np.ones(len(start), dtype=bool)
        self.word_hash = text_hash(self.words)
        self.key = first_key(text_hash(self.langs)[self.lang], self.word_hash[self.parts[0]])

    def keep(self, ok: np.ndarray) -> None:
        """Go on with the kinds that ok has."""
        if len(ok):
            self.live &= ok[self.kind]

    def longer(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, 64-bit key at each) of the phrases of one word more whose two
        parts of the present length are both live."""
        place = np.flatnonzero(self.joined[:-1] & self.live[:-1] & self.live[1:])
        last = self.parts[-1][self.kind[place + 1]]
        return place, next_key(self.key[self.kind[place]], self.word_hash[last])

    def grow(self, place: np.ndarray, key: np.ndarray) -> None:
        """Go on with the phrases of one word more at these places."""
        n_kinds = max(len(self.parts[-1]), 1)
        pairs, first, kind = np.unique(self.kind[place] * n_kinds + self.kind[place + 1], return_index=True, return_inverse=True)
        head, tail = pairs // n_kinds, pairs % n_kinds
        self.parts = [p[head] for p in self.parts] + [self.parts[-1][tail]]
        self.lang, self.key = self.lang[head], key[first]
        self.kind = np.zeros_like(self.kind)
        self.kind[place] = kind
        self.live = np.zeros_like(self.live)
        self.live[place] = True

    def counts(self) -> list[pa.Array]:
        """lang, phrase, n of the live phrases."""
        n = np.bincount(self.kind[self.live], minlength=len(self.key))
        some = np.flatnonzero(n)
        words = [self.words.take(pa.array(p[some])) for p in self.parts]
        text = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))
        return [self.langs.take(pa.array(self.lang[some])).cast(pa.string()), text.cast(pa.string()), pa.array(n[some], pa.int64())]


class Known:
    """What a pass knows from the one before: its frequent phrases, and which buckets
    for phrases of one word more are full."""

    def __init__(self, frequent: DataFrame, bitmap: np.ndarray):
        spark = frequent.sparkSession
        self.frequent = Screen.of(frequent.select("lang", "phrase").mapInArrow(_keys, "k bigint"), "k")
        self.bitmap, self.bits = spark.sparkContext.broadcast(bitmap), len(bitmap).bit_length() + 2

    def step(self, grams: Grams) -> None:
        grams.keep(self.frequent.may_hold(signed(grams.key)))
        place, key = grams.longer()
        bucket = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        full = (self.bitmap.value[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1
        grams.grow(place[full], key[full])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of phrases, all of the same number of words, as Grams has them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = utf8(batch.column(1))
        start, end = runs(data, at, _WORD)
        word = text_hash(strings(data, start, end, _WORD)).reshape(batch.num_rows, -1)
        key = reduce(next_key, word.T[1:], first_key(text_hash(batch.column(0)), word[:, 0]))
        yield pa.RecordBatch.from_arrays([pa.array(signed(key))], names=["k"])


_ROW = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "segment": pa.int32(), "task": pa.int64(), "counters": pa.binary()}


def _count(docs: DataFrame, known: list[Known], bits: int, least: int) -> DataFrame:
    """Rows of two sorts: counts (lang, phrase, n) of phrases of len(known) + 1 words, and,
    if bits is not 0, (segment, task, counters) for phrases of one word more."""
    stop = min(least, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in _ROW.items()], names=list(_ROW))

        counters = np.zeros(1 << bits if bits else 0, np.uint8)
        for batch in batches:
            for data, at, langs in pieces(batch.column(0), batch.column(1)):
                grams = Grams(data, at, langs)
                for k in known:
                    k.step(grams)
                if bits:
                    bucket, n = np.unique(grams.longer()[1] >> np.uint64(64 - bits), return_counts=True)
                    bucket = bucket.astype(np.int64)
                    counters[bucket] = np.minimum(counters[bucket] + n, stop)
                yield rows(**dict(zip(("lang", "phrase", "n"), grams.counts(), strict=True)))
        codec, own = pa.Codec("zstd", 1), counters.reshape(-1, SEGMENT)
        some = np.flatnonzero(own.any(axis=1))
        for a in range(0, len(some), 256):
            which = some[a : a + 256]
            packed = pa.array([codec.compress(own[i].tobytes(), asbytes=True) for i in which.tolist()], pa.binary())
            yield rows(segment=pa.array(which, pa.int32()), task=pa.array(np.full(len(which), TaskContext.get().partitionId()), pa.int64()), counters=packed)

    return docs.mapInArrow(run, "lang string, phrase string, n bigint, segment int, task bigint, counters binary")


def _bitmap(counters: DataFrame, bits: int, tasks: int, least: int) -> np.ndarray:
    """The buckets whose counters, over all tasks, come to least (or 255), as bits."""
    stop = min(least, 255)

    def add(table: pa.Table) -> pa.Table:
        codec, total = pa.Codec("zstd", 1), np.zeros(SEGMENT, np.uint16)
        for packed in table["counters"]:
            total = np.minimum(total + np.frombuffer(codec.decompress(packed.as_buffer(), SEGMENT), np.uint8), stop).astype(np.uint16)
        return pa.table({"segment": table["segment"][:1], "task": pa.array([table["task"][0].as_py() // FAN], pa.int64()), "counters": pa.array([codec.compress(total.astype(np.uint8).tobytes(), asbytes=True)], pa.binary())})

    schema = "segment int, task bigint, counters binary"
    counters = counters.groupBy("segment", F.expr(f"task div {FAN}")).applyInArrow(add, schema)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        counters = counters.groupBy("segment", F.expr(f"task div {FAN}")).applyInArrow(add, schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            full = [np.packbits(np.frombuffer(codec.decompress(x.as_buffer(), SEGMENT), np.uint8) >= stop, bitorder="little").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, pa.binary())], names=["segment", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in counters.select("segment", "counters").mapInArrow(pack, "segment int, bits binary").toArrow().to_pylist():
        a = row["segment"] * (SEGMENT // 8)
        out[a : a + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def frequent(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """(for each length up to longest: lang, phrase, f of the phrases that occur least
    times or more; lang, n of all words). All are tables in the shared folder."""
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "phrases")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits = min(MOST_BITS, max(LEAST_BITS, (input_bytes(docs) // 8).bit_length()))
    known: list[Known] = []
    for n in range(1, longest + 1):
        _count(docs, known, bits if n < longest else 0, least).write.option("compression", "zstd").parquet(f"{path}/pass-{n}")
        rows = spark.read.parquet(f"{path}/pass-{n}")
        counts = rows.where("segment IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        counts.write.option("compression", "zstd").parquet(f"{path}/frequent-{n}")
        if n < longest:
            counters = rows.where("segment IS NOT NULL").select("segment", "task", "counters")
            tasks = (counters.agg(F.max("task")).first()[0] or 0) + 1
            known.append(Known(spark.read.parquet(f"{path}/frequent-{n}"), _bitmap(counters, bits, tasks, least)))
    words = spark.read.parquet(f"{path}/pass-1").where("segment IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return [spark.read.parquet(f"{path}/frequent-{n}") for n in range(1, longest + 1)], words


def mine(docs: DataFrame, longest: int = 3, least: int = 10, inside_percent: int = 50, keep: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two to
    longest words. A phrase is as good as its weakest cut into two parts that occur l
    and r times: a * a / (l * r), in millionths. Phrases inside a longer frequent one
    with inside_percent of their occurrences are left out."""
    by_length, words = frequent(docs, longest, least)
    every = reduce(DataFrame.unionByName, by_length)
    phrases = reduce(DataFrame.unionByName, by_length[1:]).withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    part = lambda a, n: F.concat_ws(" ", F.slice("w", a, n))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.size("w") - F.col("k"))})
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", *(exact[c].alias(f"x{c}") for c in exact)).withColumn("score", F.expr("(1000000 * (xa * xa)) div (xl * xr)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    if longest > 2:
        inner = phrases.where(F.size("w") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
        inner = inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        best = best.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {inside_percent} * a")).drop("longer")
    top = ranked(best, [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")], ["lang"]).where(F.col("rank") <= keep)
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_query(spark, sf_dir: str) -> DataFrame:
    """Contract: collocations of two and three words of documents, 2000 a language."""
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') w FROM pieces),
words AS (SELECT lang, unnest(w) w1, unnest(list_append(w[2:], NULL)) w2, unnest(list_concat(w[3:], [NULL, NULL])[1:len(w)]) w3 FROM listed WHERE len(w) > 0),
f1 AS (SELECT lang, w1 p, count(*)::BIGINT f FROM words GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*)::BIGINT f FROM words WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*)::BIGINT f FROM words WHERE w2 IS NOT NULL AND w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
total AS (SELECT lang, sum(f)::BIGINT n FROM f1 GROUP BY 1),
cuts AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 phrase, b.f a, 1 k, x.f l, y.f r FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.p = b.w1 JOIN f1 y ON y.lang = b.lang AND y.p = b.w2 WHERE b.f >= 10
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.p = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.p = c.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, p phrase, max(f) longer FROM (SELECT lang, w1 || ' ' || w2 p, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
ranks AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranks r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
