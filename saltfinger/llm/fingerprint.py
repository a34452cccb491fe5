"""Canonical exact fingerprints of documents (operator 4).

A text's canonical form is NFKC, case-folded, NFKC again, with runs of white
space made one space and the ends trimmed. Its fingerprint is the 128-bit xxhash
(XXH3) of that form's UTF-8 in hex. Being exact, two fingerprints are alike by 1
if they are equal, else by 0.

``fingerprints`` has one column-parallel pass. ``copy_kinds`` groups the texts whose
fingerprint several rows have by fingerprint and canonical bytes; copies collapse in
the task that reads them, so a hot text is a row for each task, and texts that only
share a fingerprint (a hash collision) stay apart.
``neighbours`` needs each text beside that of the next doc_id: texts travel once,
compressed, to ranges of doc_id, and the first text of each range also to the
range before.

Null texts are empty, and empty texts have the fingerprint of the empty string.
Rows that repeat a doc_id are ordered by text and each other's next; a null
doc_id comes first. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .screen import Screen, cut, parts, split

_NULL_ID = -(1 << 63)


def canonical(text: str) -> str:
    """NFKC, case folding, NFKC, white space folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).casefold()
        text = unicodedata.normalize("NFKC", text)
    else:
        text = text.lower()
    return " ".join(text.split())


Digest = Callable[[bytes], str]


def wide(raw: bytes) -> str:
    """128 bits of XXH3 in hex."""
    return xxhash.xxh3_128_hexdigest(raw)


def fingerprint(text: str, digest: Digest = wide) -> str:
    return digest(canonical(text).encode("utf-8", "surrogatepass"))


def print_keys(prints: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for the fingerprints."""
    return np.array([xxhash.xxh64_intdigest(p, 42) for p in prints], np.uint64)


def fingerprints(docs: DataFrame, digest: Digest = wide) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches):
        for batch in batches:
            own = pa.array([fingerprint(t.as_py() or "", digest) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), own], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def copy_kinds(docs: DataFrame, digest: Digest = wide) -> DataFrame:
    """(fingerprint, form, class_id, copies) of the canonical texts that several rows
    have: class_id is the least doc_id. Buckets are grouped by the canonical bytes
    themselves, whole, so equal fingerprints of different texts stay apart. A task
    sends one row for each text that it holds, however many rows have it."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = fingerprints(docs, digest)
    buckets = cut(marks.groupBy("fingerprint").agg(F.count("*").alias("c")).where("c > 1").select("fingerprint", F.xxhash64("fingerprint").alias("k")))
    screen = Screen.of(buckets, "k")

    def form(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            kinds: dict[bytes, list] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = canonical(text.as_py() or "").encode("utf-8", "surrogatepass")
                own = kinds.setdefault(raw, [doc, 0])
                own[0] = doc if own[0] is None or doc is not None and doc < own[0] else own[0]
                own[1] += 1
            prints = [digest(raw) for raw in kinds]
            rows = [(p, press.compress(raw), *own) for ok, p, (raw, own) in zip(screen.may_hold(print_keys(prints)), prints, kinds.items(), strict=True) if ok]
            cols = zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["fingerprint", "form", "doc_id", "c"])

    kinds = docs.mapInArrow(form, "fingerprint string, form binary, doc_id long, c long").groupBy("fingerprint", "form").agg(F.min("doc_id").alias("class_id"), F.sum("c").alias("copies"))
    return kinds.where("copies > 1")


def with_classes(rows: DataFrame, docs: DataFrame, digest: Digest = wide) -> DataFrame:
    """rows(doc_id, fingerprint, ...) of docs with class_id: the least doc_id with the
    same canonical text, the row's own if no other has it."""
    kinds = cut(copy_kinds(docs, digest))
    several = cut(kinds.groupBy("fingerprint").agg(F.count("*").alias("c")).where("c > 1").select("fingerprint"))
    plain = kinds.join(several, "fingerprint", "left_anti").select("fingerprint", "class_id")
    out = rows.join(plain, "fingerprint", "left")
    if not several.isEmpty():  # texts of one fingerprint: rows are told apart by their bytes
        own = _collided(docs, kinds.join(several, "fingerprint", "left_semi"), digest).groupBy("doc_id", "fingerprint").agg(F.min("class_id").alias("__class"))
        own = own.withColumnRenamed("doc_id", "__doc").withColumnRenamed("fingerprint", "__print")
        out = out.join(own, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("fingerprint") == F.col("__print")), "left").withColumn("class_id", F.coalesce("class_id", "__class")).drop("__doc", "__print", "__class")
    return out.withColumn("class_id", F.coalesce("class_id", "doc_id"))


def copy_classes(docs: DataFrame, digest: Digest = wide) -> DataFrame:
    """(doc_id, fingerprint, class_id) of every row."""
    return with_classes(fingerprints(docs, digest), docs, digest).select("doc_id", "fingerprint", "class_id")


def _collided(docs: DataFrame, kinds: DataFrame, digest: Digest) -> DataFrame:
    """The classes of rows whose fingerprint is that of several texts, by the bytes."""
    screen = Screen.of(kinds.select(F.xxhash64("fingerprint").alias("k")), "k")

    def form(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            own = [canonical(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            prints = [digest(x) for x in own]
            cols = [batch.column(0), pa.array(prints, pa.string()), pa.array([press.compress(x) for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fingerprint", "form"]).filter(pa.array(screen.may_hold(print_keys(prints))))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(form, "doc_id long, fingerprint string, form binary")
    return rows.join(kinds.select("fingerprint", "form", "class_id"), ["fingerprint", "form"]).select("doc_id", "fingerprint", "class_id")


_PACKED = "range int, ghost boolean, key long, text binary"
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text (its last floor(n / 2)
    code points replaced by as many first ones, or all, of the next doc_id's
    text; the first follows the last), and their likenesses."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = parts(docs, 8 << 20)
    ids = docs.select("key")
    cuts = np.unique(np.array(ids.approxQuantile("key", [i / pieces for i in range(1, pieces)], 1 / (4 * pieces)), np.int64)) if ids.head(1) else np.empty(0, np.int64)

    def least(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            own = np.searchsorted(cuts, key, "right")
            order = np.lexsort((key, own))
            first = order[np.unique(own[order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(own[first].astype(np.int32)), pa.array(key[first])], names=["range", "key"])

    found = ids.mapInArrow(least, "range int, key long").groupBy("range").agg(F.min("key").alias("key")).toArrow()
    heads = dict(sorted(zip(found["range"].to_pylist(), found["key"].to_pylist(), strict=True)))  # a row for each range
    dense = np.cumsum(np.isin(np.arange(len(cuts) + 1), list(heads))) - 1  # of those that have rows
    keys = list(heads.values())
    before = {k: (i - 1) % len(keys) for i, k in enumerate(keys)}

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            own = dense[np.searchsorted(cuts, keys, "right")]
            for at in range(0, len(keys), 512):
                rows = []
                for i, t in enumerate(batch.column(1)[at : at + 512], at):
                    packed, key = press.compress(t.as_py().encode()), int(keys[i])
                    rows.append((int(own[i]), False, key, packed))
                    if key in before:
                        rows.append((before[key], True, key, packed))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=["range", "ghost", "key", "text"])

    def walk(batches) -> Iterator[pa.RecordBatch]:
        """Rows come by range and, inside a range, by doc_id; ghosts last."""
        unpack = zstandard.ZstdDecompressor()
        held: tuple | None = None  # range, id, text, fingerprint
        tied: list[tuple] = []
        out: list[tuple] = []

        def step(r, ghost, key, text):
            nonlocal held
            own = fingerprint(text)
            if held is not None and held[0] == r:
                _, doc, mine, print_ = held
                half = len(mine) // 2
                edited = mine[: len(mine) - half] + text[:half]
                other = fingerprint(edited)
                out.append((None if doc == _NULL_ID else doc, len(mine), hashlib.sha256(edited.encode()).hexdigest(), print_, other, float(other == print_), float(own == print_)))
            held = None if ghost else (r, key, text, own)

        def flush():
            for x in sorted(tied, key=lambda x: x[3]):
                step(*x)
                if x[1]:  # of several rows with the next doc_id the first counts
                    break
            tied.clear()

        for batch in batches:
            for r, ghost, key, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = (r, ghost, key, unpack.decompress(text).decode())
                if tied and tied[0][:3] != x[:3]:
                    flush()
                tied.append(x)
            if out:
                yield emit(out)
                out.clear()
        flush()
        if out:
            yield emit(out)

    def emit(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

    packed = docs.mapInArrow(pack, _PACKED)
    dealt = packed.repartitionById(max(1, len(heads)), F.col("range")).sortWithinPartitions("range", "ghost", "key")
    return dealt.mapInArrow(walk, _OUT)


def op4_query(spark, sf_dir: str) -> DataFrame:
    """Contract columns, and class_id: the least doc_id with the same canonical
    text (the row's own if no other has it)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = neighbours(docs)
    return with_classes(near, docs).select(*near.columns, "class_id")
