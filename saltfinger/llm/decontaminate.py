"""Benchmark decontamination by spaced seeds (operator 2).

A seed is a fixed mask over consecutive words: positions with 0 are ignored, so
a substituted word under a 0 does not hide the match. Words are runs of letters
and digits, A-Z lower-cased.

1. Every mask is hashed at every word of every benchmark item.
2. Every mask is hashed at every word of every document. Hashes that no item has
   are dropped by a bounded screen; what is left, with the words around it, is a
   hit region. Documents are read once and never shuffled.
3. Spark joins hits and item seeds on the hash. Each (region, item, diagonal) is
   verified once: word by word along the diagonal, of the stretches with at
   least ``identity`` of their words equal the one with most equal words must
   have ``min_words`` of them (or all words of a shorter item but one in five).

An item with fewer words than the shortest mask has one seed, its words without a
gap, and is found where it stands whole. Null texts have no words. Rows that repeat a doc_id are searched each; one row for each
doc_id and item comes back, with the longest stretch (the first, if several are
as long). A null doc_id is reported as null. Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .screen import Screen, cut, row_key, without
from .textkit import ALNUM, chunks, mix, signed, words

#: Masks of weight six; 0 is an ignored word.
MASKS = ("1110111", "11011011", "110100111", "1010110011")
#: Words kept on either side of a hit for the verification.
AROUND = 48
_STEP = np.uint64(0xD6E8FEB86659FD93)
_NONE = -(1 << 63)


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask at each position where it fits."""
    m = max(len(hashes) - len(mask) + 1, 0)
    h = np.full(m, np.uint64(len(mask)), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            h = h * _STEP + hashes[j : j + m]
    return mix(h)


#: Words of the shortest mask.
SHORTEST = min(map(len, MASKS))


def _masks(n: int) -> tuple[str, ...]:
    """The masks of an item of n words."""
    return MASKS if n >= SHORTEST else ("1" * n,) if n else ()


def _item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, h, q): the seeds of every item and their word positions."""

    def run(batches):
        for batch in batches:
            for first, _, data, at in chunks(batch.column(1)):
                hashes, own = words(data, at, ALNUM)
                for row, (a, z) in enumerate(zip(own[:-1].tolist(), own[1:].tolist(), strict=True), first):
                    for mask in _masks(z - a):
                        h = _seeds(hashes[a:z], mask)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(h), row))), pa.array(signed(h)), pa.array(np.arange(len(h), dtype=np.int32))], names=["item_id", "h", "q"])

    return items.mapInArrow(run, "item_id long, h long, q int")


def _item_words(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [b""] * batch.num_rows
            for first, _, data, at in chunks(batch.column(1)):
                hashes, own = words(data, at, ALNUM)
                for row, (a, z) in enumerate(zip(own[:-1].tolist(), own[1:].tolist(), strict=True), first):
                    out[row] = hashes[a:z].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["item_id", "item_words"])

    return items.mapInArrow(run, "item_id long, item_words binary")


def _regions(docs: DataFrame, screen: Screen, masks: list[str]) -> DataFrame:
    """(doc_id, key, region, start, words, hits): the words around the seed hits
    of each document; key is the row's, hits are (h, p) with p counted from the
    region's start."""
    names = ["doc_id", "key", "start", "words", "hits"]
    hit = pa.struct([("h", pa.int64()), ("p", pa.int32())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys = batch.column(2).to_pylist()
            rows: list[tuple] = []
            for first, _, data, at in chunks(batch.column(1)):
                hashes, own = words(data, at, ALNUM)
                found = []
                for mask in masks:
                    h = _seeds(hashes, mask)
                    p = np.flatnonzero(screen.may_hold(h)) if len(h) else np.empty(0, np.int64)
                    owner = np.searchsorted(own, p, "right") - 1
                    ok = p + len(mask) <= own[owner + 1]
                    found.append((p[ok], h[p[ok]], owner[ok]))
                p, h, owner = (np.concatenate([f[i] for f in found]) for i in range(3))
                order = np.argsort(p, kind="stable")
                p, h, owner = p[order], h[order], owner[order]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(p) > 2 * AROUND) | (np.diff(owner) > 0)))) if len(p) else []
                for a, z in zip(new, [*new[1:], len(p)] if len(new) else [], strict=True):
                    d = int(owner[a])
                    begin, end = max(int(own[d]), int(p[a]) - AROUND), min(int(own[d + 1]), int(p[z - 1]) + AROUND + 16)
                    rows.append((ids[first + d], keys[first + d], begin - int(own[d]), hashes[begin:end].tobytes(), [{"h": int(x), "p": int(y) - begin} for x, y in zip(signed(h[a:z]), p[a:z], strict=True)]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(hit))], names=names)

    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long"), text, row_key())
    regions = keyed.mapInArrow(run, "doc_id long, key long, start long, words binary, hits array<struct<h: long, p: int>>")
    return regions.withColumn("region", F.xxhash64("key", "start"))


def widest_stretch(same: np.ndarray, identity: float) -> tuple[int, int, int]:
    """(first, end, equal words) of the stretch with most equal words among those
    that begin and end with an equal word and have at least ``identity`` of their
    words equal; of several the shortest, then the first. In integers."""
    ends = np.flatnonzero(same) + 1
    if not len(ends):
        return 0, 0, 0
    share = Fraction(str(identity))
    hits = np.concatenate(([0], np.cumsum(same, dtype=np.int64)))
    total = share.denominator * hits - share.numerator * np.arange(len(hits))
    # the first place from which the sum does not fall below 0 on the way to each end
    first = np.searchsorted(-np.minimum.accumulate(total), -total[ends])
    equal = hits[ends] - hits[first]
    first = ends[hits[first]] - 1  # its first equal word
    best = np.lexsort((first, ends - first, -equal))[0]
    return int(first[best]), int(ends[best]), int(equal[best])


def _passages(docs: DataFrame, items: DataFrame, min_words: int, identity: float) -> DataFrame:
    """(key, doc_id, item_id, n_equal, n_words, first_word): the passages found
    on each diagonal of each row, which key names."""
    items = cut(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL"))
    seeds = cut(_item_seeds(items))
    screen = Screen.of(seeds.select("h").distinct(), "h", words_per_key=16)
    short = _item_words(items).select(F.floor(F.octet_length("item_words") / 8).cast("int").alias("n")).where(f"n < {SHORTEST}").distinct().collect()  # a few lengths
    regions = cut(_regions(docs, screen, [*MASKS, *(m for r in short for m in _masks(r["n"]))]))
    hits = regions.select("region", F.inline("hits")).join(seeds, "h")
    lines = hits.select("region", "item_id", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    asked = lines.join(regions.select("region", "key", "doc_id", "start", "words"), "region").join(_item_words(items), "item_id")
    out = "key long, doc_id long, item_id long, n_equal long, n_words long, first_word long"

    def verify(batches):
        for batch in batches:
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("key", "doc_id", "item_id", "diagonal", "start", "words", "item_words")]
            for key, doc, item, diagonal, start, text, other in zip(*cols, strict=True):
                a, b = np.frombuffer(text, np.uint64), np.frombuffer(other, np.uint64)
                low, high = max(0, diagonal), min(len(a), diagonal + len(b))
                first, end, equal = widest_stretch(a[low:high] == b[low - diagonal : high - diagonal], identity)
                need = min_words if len(b) > min_words else -(-4 * len(b) // 5)
                if equal and equal >= need:
                    rows.append((key, doc, item, equal, end - first, start + low + first))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in out.split(", ")])

    return asked.select("key", "doc_id", "item_id", "diagonal", "start", "words", "item_words").mapInArrow(verify, out)


def contamination(docs: DataFrame, items: DataFrame, min_words: int = 13, identity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_equal, n_words, first_word): documents that hold a
    passage of an item. first_word counts from 0."""
    found = _passages(docs, items, min_words, identity)
    best = F.min(F.struct((-F.col("n_equal")).alias("e"), "first_word", "n_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.e")).alias("n_equal"), "b.n_words", "b.first_word")


def decontaminate(docs: DataFrame, items: DataFrame, min_words: int = 13, identity: float = 0.8) -> DataFrame:
    """The rows of docs that have no passage of an item, decided for each row also
    where doc_id is null or repeated."""
    bad = _passages(docs, items, min_words, identity).select(F.col("key").alias("__k"))
    return without(docs, row_key(), cut(bad.distinct()))


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Passages of benchmark in documents: one row for each document and item."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
