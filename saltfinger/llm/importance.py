"""Importance resampling towards a target distribution by external sort-count (operator 11).

Features of a text are its words and pairs of adjacent words, hashed into ``BUCKETS``
buckets by crc32. ``write_streams`` reads each text once and writes the buckets of its
features as packed uint16 streams with document offsets. ``sort_counts`` sorts each
stream, run-length encodes it and merges the runs, first within a task, then in Spark,
so that the counts of all occurrences come from at most ``BUCKETS`` rows a task.
``gains`` turns the counts of target and corpus into a log ratio for each bucket.
``weigh`` goes through the streams again and gathers the gains with np.add.reduceat.
``draw`` adds Gumbel noise from doc_id and seed to the weights and takes the highest
scores of all documents that are long enough.

The tables of counts and gains have ``BUCKETS`` rows whatever the input. Ranks come from
a range sort of the rows that can be drawn at all: scores are whole numbers between
bounds that doubles set, so their histogram is bounded (some 110,000 rows) and gives the
least score that is drawn.

A null text has no words; a text without words has weight 0. Rows that repeat a doc_id
are rows of their own, with one noise; of equal doc_id and score any may be drawn. A null
doc_id has the noise of the empty id and comes before all others in ties. Of the input,
doc_id and text are read; other columns stay in ``resample``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .ranking import ranked
from .screen import cut, new_folder, row_key
from .textkit import ALNUM, chunks, lowered, release, runs

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25

#: Words of more bytes are hashed one by one.
_SHORT = 48
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _zeros_table() -> np.ndarray:
    """What n zero bytes make of a register, for each of its four bytes and n up to
    _SHORT; the register's own is the XOR of four entries."""
    out = np.empty((_SHORT + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(_SHORT):
        out[n + 1] = _CRC[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out.ravel()


_ZEROS = _zeros_table()


def _step(register: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(register ^ byte) & np.uint32(255)] ^ (register >> np.uint32(8))


def crc_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of the words data[start:end], and of word i, a space and word i + 1 for
    each i in pairs."""
    size = end - start
    short = np.minimum(size, _SHORT)
    order = np.argsort(_SHORT - short.astype(np.uint8), kind="stable")
    at, register = start[order], np.full(len(start), _ONES)
    longer = len(start) - np.cumsum(np.bincount(short, minlength=_SHORT + 1))
    for j in range(_SHORT):
        if not (n := int(longer[j])):
            break
        register[:n] = _step(register[:n], data[at[:n] + j].astype(np.uint32))
    word = np.empty_like(register)
    word[order] = register
    for i in np.flatnonzero(size > _SHORT).tolist():
        word[i] = np.uint32(zlib.crc32(data[start[i] : end[i]])) ^ _ONES
    # after word i and a space; the second word's own register is XOR-ed on what its zeros make of that
    first = _step(word[pairs], np.uint32(0x20)) ^ _ONES
    row = np.minimum(size[pairs + 1], _SHORT) << 10
    both = word[pairs + 1].copy()
    for i in range(4):
        both ^= _ZEROS[row + (i << 8) + ((first >> np.uint32(8 * i)) & np.uint32(255)).astype(np.int64)]
    for i in np.flatnonzero(size[pairs + 1] > _SHORT).tolist():
        k = pairs[i] + 1
        both[i] = np.uint32(zlib.crc32(data[start[k] : end[k]], int(first[i]))) ^ _ONES
    return word ^ _ONES, both ^ _ONES


def streams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, offsets of the rows' features, words of each row):
    first a row's words, then its pairs."""
    data = lowered(data)
    start, end = runs(data, at, ALNUM)
    word_at = np.searchsorted(start, at, "left")
    n_words = np.diff(word_at)
    n_pairs = np.maximum(n_words - 1, 0)
    offsets = np.zeros(len(at), np.int64)
    np.cumsum(n_words + n_pairs, out=offsets[1:])
    inner = np.ones(len(start), dtype=bool)
    inner[word_at[1:][n_words > 0] - 1] = False
    pairs = np.flatnonzero(inner)
    one, two = crc_features(data, start, end, pairs)
    out = np.empty(int(offsets[-1]), np.uint16)
    out[np.arange(len(start)) + np.repeat(offsets[:-1] - word_at[:-1], n_words)] = one % np.uint32(BUCKETS)
    out[pairs + np.repeat(offsets[:-1] - word_at[:-1] + n_words, n_pairs)] = two % np.uint32(BUCKETS)
    return out, offsets, n_words


_STREAM = "doc_id array<bigint>, key array<bigint>, n_words array<bigint>, offsets array<bigint>, stream binary"


def write_streams(docs: DataFrame, path: str) -> DataFrame:
    """Write the packed streams of docs(doc_id, text) to path, a row for about each MB
    of text, and read them back. key is the row's (doc_id and text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in chunks(batch.column(2)):
                out, offsets, n_words = streams(data, at)
                rows = [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n_words, pa.int64()), pa.array(offsets, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in rows), pa.array([out.tobytes()], pa.binary())],
                    names=["doc_id", "key", "n_words", "offsets", "stream"],
                )

    docs.mapInArrow(run, _STREAM).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_STREAM).parquet(path)


def _lengths(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length encoding of a sorted array."""
    if not len(run):
        return run, np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    return run[new], np.diff(np.append(new, len(run)))


def _merge(encoded: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run-length encoding of several."""
    value = np.concatenate([v for v, _ in encoded])
    order = np.argsort(value, kind="stable")
    value, count = value[order], np.concatenate([c for _, c in encoded])[order]
    new = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.empty(0, np.int64)
    return value[new], np.add.reduceat(count, new) if len(new) else count


def sort_counts(own: DataFrame) -> DataFrame:
    """(bucket, n): occurrences of each bucket in the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = [(np.empty(0, np.uint16), np.empty(0, np.int64))]
        for batch in batches:
            for stream in batch.column(0):
                encoded.append(_lengths(np.sort(np.frombuffer(stream.as_buffer(), np.uint16), kind="stable")))
                if len(encoded) == 32:
                    encoded = [_merge(encoded)]
        value, count = _merge(encoded)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(value, pa.int32()), pa.array(count, pa.int64())], names=["bucket", "n"])

    return own.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counted(own: DataFrame) -> list[int]:
    """The counts of all BUCKETS buckets."""
    rows = sort_counts(own).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out.tolist()


def gains(target: list[int], corpus: list[int]) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in target over that in corpus."""
    big_t, big_s = float(sum(target) + BUCKETS), float(sum(corpus) + BUCKETS)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * big_s) / ((s + 1.0) * big_t))) for t, s in zip(target, corpus, strict=True)], np.int64)


def weigh(own: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight) of each row of the streams."""
    table = own.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "key", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, key, n_words, offsets = (batch.column(c)[i].values for c in range(4))
                at = offsets.to_numpy()
                n, total = np.diff(at), np.zeros(len(at) - 1, np.int64)
                if at[-1]:
                    each = table.value[np.frombuffer(batch.column(4)[i].as_buffer(), np.uint16)]
                    total[n > 0] = np.add.reduceat(each, at[:-1][n > 0])
                yield pa.RecordBatch.from_arrays([doc_id, key, n_words, pa.array(n), pa.array(total // np.maximum(n, 1))], names=names)
        release()

    return own.mapInArrow(run, StructType([StructField(c, LongType()) for c in names]))


def score(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights with column score: the weight plus Gumbel noise of doc_id and seed."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).substr(1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share))))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (a table that is cheap to read again) with column rank: 1, 2, 3 ... for the
    percent of the rows with enough words that score highest, null for all others."""
    fit = F.col("n_words") >= least_words
    several = scored.where(fit).groupBy("score").count().orderBy(F.desc("score")).toArrow().to_pydict()
    size = sum(several["count"]) * percent // 100
    if not size:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    so_far = np.cumsum(several["count"])
    least = several["score"][int(np.searchsorted(so_far, size))]
    high = fit & (F.col("score") >= least)
    ties = scored.where(high).withColumn("__tie", F.monotonically_increasing_id())
    tops = ranked(ties, [F.desc("score"), F.asc("doc_id"), F.asc("key"), F.asc("__tie")]).drop("__tie")
    tops = tops.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    return tops.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def scores(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight, score, rank) of each row of docs.
    target has a column text."""
    spark = docs.sparkSession
    path = new_folder(spark, "streams")
    own = write_streams(docs, f"{path}/corpus")
    wanted = write_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), f"{path}/target")
    weights = weigh(own, gains(_counted(wanted), _counted(own)))
    return draw(cut(score(weights, seed)), percent, least_words)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, all columns kept. Rows that repeat doc_id and
    text stay together if one of them is drawn."""
    drawn = scores(docs, target, percent, least_words, seed).where("rank IS NOT NULL").select(F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", row_key())
    return keyed.join(drawn, "__key", "left_semi").drop("__key")


def op11_query(spark, sf_dir: str) -> DataFrame:
    """Contract: every document's weight and score towards benchmark, and the draw."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return scores(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc_table AS (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) c FROM range(256) r(i))),
texts AS (SELECT row_number() OVER () row, doc_id, text, true AS corpus FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
listed AS (SELECT row, doc_id, corpus, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM texts),
featured AS (SELECT row, corpus, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f FROM listed),
codes AS (SELECT f, hex(f) h FROM (SELECT DISTINCT f FROM featured)),
buckets AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 b FROM codes, crc_table),
placed AS (SELECT row, corpus, b FROM featured JOIN buckets USING (f)),
counted AS (SELECT b, count(*) FILTER (corpus) s, count(*) FILTER (NOT corpus) t FROM placed GROUP BY b),
gained AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE))) g FROM counted),
weighed AS (SELECT row, count(*) n, floor(sum(g) / count(*))::BIGINT weight FROM placed JOIN gained USING (b) WHERE corpus GROUP BY row),
scored AS (SELECT l.row, doc_id, len(w) n_words, coalesce(n, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT score FROM listed l LEFT JOIN weighed x ON x.row = l.row WHERE corpus),
placed_ranks AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored s LEFT JOIN placed_ranks r ON r.row = s.row
"""
