"""Token ids in Arrow stream files with fixed-size-list batches (operator 12).

``write_sequences`` deals the documents out by range of doc_id; each task encodes its
range with a tokenizer file and writes it as one Arrow stream file: record batches of
``per_batch`` sequences, each a fixed-size list of ``length`` ids and one of as many mask
bits (not set where padding is). The ids of a range follow each other without gaps;
only a file's last sequence is padded.
Batches have no nulls and no compression, so all but the last of a file have the same
number of bytes: ``Sequences`` finds any sequence by arithmetic in the memory-mapped
file and gives views of it, not copies. A second stream file beside each has doc_id,
first id and number of ids of its documents, and the Parquet table ``manifest`` a row
for each file, with the ids and sequences before it.

``read_documents`` reads the files back, a file in a task, batch after batch.

Tasks write under a name of their own, which the manifest keeps; what a lost or repeated
task leaves is in no manifest. The folder must be one that all executors share and
pyarrow can open (a local path, or a URI of a file system that pyarrow knows).

Null texts are empty: their document is the end id alone. Documents without doc_id come
first; rows that repeat a doc_id stand in the order of their text's hash, and equal rows
in any order. Of the input, doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import range_parts
from .screen import new_folder
from .textkit import release, runs, strings, utf8

END_ID = 1
CHUNK_BYTES = 8 << 20
#: Distinct units whose ids a worker keeps (some 150 bytes each).
KEEP_UNITS = 600_000

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = ~_BLANK
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Second bytes of the letters from U+00C0 to U+00FF, whose first byte is 0xC3.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII marks at which a unit may end; the apostrophe and the signs of special tokens are not among them.
_MARK = np.zeros(256, dtype=bool)
_MARK[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True

#: The normaliser, split and word end for which texts may be cut into units.
_CUT_AT_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    "</w>",
)

_WORKER: dict = {}


class Encoder:
    """A tokenizer and what it has encoded before.

    A tokenizer that drops white space and splits at it encodes the pieces between
    blanks on their own; so it does where Latin letters meet a plain ASCII mark. Such
    units repeat a lot, and only new ones go to the tokenizer. Texts for any other
    kind of tokenizer are encoded whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = json.loads(spec)
        splits = (own.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        self.tokenizer = Tokenizer.from_str(spec)
        self.by_unit = (own.get("normalizer"), splits[0], own["model"].get("end_of_word_suffix")) == _CUT_AT_WORDS and own.get("post_processor") is None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        if self.by_unit:
            self.last = np.zeros(size, dtype=bool)  # ids that end a word
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(_CUT_AT_WORDS[2])]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, self.kind)
        self.at = np.zeros(1 << 16, np.int64)
        self.n = 0

    def _learn(self, units: list[str]) -> np.ndarray:
        """The number of each unit; new ones are encoded."""
        if self.n + len(units) > KEEP_UNITS:
            self._clear()
        get = self.known.get
        number = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(number < 0)
        # words of letters alone go to the tokenizer many at a time, since each ends with an id that ends words
        plain = np.fromiter((_PLAIN.fullmatch(units[i]) is not None for i in new.tolist()), bool, len(new))
        words, rest = ([units[i] for i in new[ok].tolist()] for ok in (plain, ~plain))
        lines = self._ids([" ".join(words[a : a + 500]) for a in range(0, len(words), 500)])[0]
        self._store(words, lines, np.flatnonzero(self.last[lines]) + 1)
        self._store(rest, *self._ids(rest))
        number[new] = [get(units[i]) for i in new.tolist()]
        return number

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end)."""
        own = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, self.kind), *own]), np.cumsum([len(x) for x in own], dtype=np.int64)

    def _store(self, units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        if len(units) != len(ends):
            raise ValueError("the tokenizer does not end each word with an id of its own")
        n, used = self.n + len(units), int(self.at[self.n])
        self.known.update(zip(units, range(self.n, n), strict=True))
        self.at, self.ids = _room(self.at, n + 1), _room(self.ids, used + len(ids))
        self.at[self.n + 1 : n + 1] = used + ends
        self.ids[used : used + len(ids)] = ids
        self.n = n

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows' ids)."""
        if not self.by_unit:
            ids, ends = self._ids([bytes(data[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)])
            return ids, np.concatenate(([0], ends))
        start, end = self.units(data, at)
        coded = strings(data, start, end, _SOLID).dictionary_encode()
        number = self._learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        first, size = self.at[number], self.at[number + 1] - self.at[number]
        before = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        ids = self.ids[np.arange(int(before[-1])) + np.repeat(first - before[:-1], size)]
        return ids, before[np.searchsorted(start, at, "left")]

    @staticmethod
    def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the units: runs without blanks, cut where a letter and a mark meet."""
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        inside, mark, before = np.zeros(n + 2, dtype=bool), _MARK[data], _LETTER[data]
        inside[1:-1] = _SOLID[data]
        after = before.copy()
        latin = (data[:-1] == 0xC3) & _LATIN[data[1:]]
        before[1:] |= latin  # a letter's last byte
        after[:-1] |= latin  # a letter's first byte
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        edge[1:n] |= (before[:-1] & mark[1:]) | (mark[:-1] & after[1:])
        return np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2])), np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.resize(x, max(n, 2 * len(x)))


def _encoder(spec: str) -> Encoder:
    """This worker's encoder; it outlives the task."""
    name = hashlib.sha256(spec.encode()).digest()
    if _WORKER.get("name") != name:
        _WORKER.update(name=name, encoder=Encoder(spec))
    return _WORKER["encoder"]


def _bundles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = utf8(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
    release()


def _sequence_schema(kind: pa.DataType, length: int) -> pa.Schema:
    item = lambda t: pa.list_(pa.field("item", t, nullable=False), length)
    return pa.schema([pa.field("ids", item(kind), nullable=False), pa.field("mask", item(pa.bool_()), nullable=False)], metadata={"length": str(length)})


_DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])


class _Writer:
    """One range of documents on its way into its two files."""

    def __init__(self, path: str, name: str, kind: type, length: int, per_batch: int):
        fs, at = pafs.FileSystem.from_uri(path)
        fs.create_dir(at, recursive=True)
        self.outs = [fs.open_output_stream(f"{at}/{name}.{x}") for x in ("arrow", "docs.arrow")]
        self.schema, self.kind = _sequence_schema(pa.from_numpy_dtype(kind), length), kind
        self.files = [pa.ipc.new_stream(o, s) for o, s in zip(self.outs, (self.schema, _DOCS), strict=True)]
        self.length, self.per_batch, self.head, self.batch_bytes = length, per_batch, 0, 0
        self.rest: list[np.ndarray] = []
        self.waiting = self.n = self.sequences = self.docs = 0

    def add(self, doc_id: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        """The ids of some more documents, n of each."""
        first = self.n + np.cumsum(n) - n
        self.files[1].write_batch(pa.record_batch([doc_id, pa.array(first), pa.array(n)], schema=_DOCS))
        self.n, self.docs = self.n + len(ids), self.docs + len(n)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.length * self.per_batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, step = np.concatenate(self.rest), self.length * self.per_batch
        mask = np.ones(len(ids), dtype=bool)
        if last and (gap := -len(ids) % self.length):
            ids, mask = np.append(ids, np.zeros(gap, ids.dtype)), np.append(mask, np.zeros(gap, dtype=bool))
        whole = len(ids) if last else len(ids) - len(ids) % step
        for a in range(0, whole, step):
            b = min(a + step, whole)
            own = [pa.FixedSizeListArray.from_arrays(pa.array(x[a:b]), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
            batch = pa.record_batch(own, schema=self.schema)
            self.files[0].write_batch(batch)
            if not self.batch_bytes:  # the first: the schema's message stands before it
                self.batch_bytes = pa.ipc.get_record_batch_size(batch)
                self.head = self.outs[0].tell() - self.batch_bytes
            self.sequences += (b - a) // self.length
        self.rest = [ids[whole:]]
        self.waiting = len(ids) - whole

    def close(self) -> None:
        if self.waiting:
            self._flush(True)
        for f in (*self.files, *self.outs):
            f.close()


_FILE = "part int, file string, n bigint, sequences bigint, documents bigint, head bigint, batch_bytes bigint, length int, per_batch int"


def write_sequences(docs: DataFrame, path: str, tokenizer: str, length: int = 2048, per_batch: int = 32, end_id: int = END_ID, file_bytes: int = 32 << 20) -> DataFrame:
    """Write the ids of docs(doc_id, text) below path in ascending doc_id, each document
    with end_id; the manifest. A file gets some file_bytes of the input."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("tie"))
    n = range_parts(own, file_bytes)
    order = [F.asc("doc_id"), F.asc("key"), F.asc("tie")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, name, encoder = TaskContext.get().partitionId(), None, "", None
        for batch in batches:
            for a, b, data, at in _bundles(batch.column(1)):
                if out is None:
                    name, encoder = f"part-{part:05d}-{uuid.uuid4().hex}", _encoder(spec.value)
                    out = _Writer(f"{path}/sequences", name, encoder.kind, length, per_batch)
                ids, offsets = encoder.encode(data, at)
                out.add(batch.column(0)[a:b], np.insert(ids, offsets[1:], end_id), np.diff(offsets) + 1)
        if out is not None:
            out.close()
            row = (part, name, out.n, out.sequences, out.docs, out.head, out.batch_bytes, length, per_batch)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS, strict=True)], names=_NAMES)
        release()

    written = own.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, _FILE)
    written.write.parquet(f"{path}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.parquet(f"{path}/written").withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "sequences")})
    files.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


_NAMES = [x.split()[0] for x in _FILE.split(", ")]
_KINDS = [{"int": pa.int32(), "string": pa.string(), "bigint": pa.int64()}[x.split()[1]] for x in _FILE.split(", ")]


def _open(path: str, name: str):
    fs, at = pafs.FileSystem.from_uri(f"{path}/sequences")
    at = f"{at}/{name}"
    return pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files below path; the
    crc is of all their ids as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(path, f"{name}.arrow") as f, _open(path, f"{name}.docs.arrow") as g:
                    yield from _digests(pa.ipc.open_stream(f), pa.ipc.open_stream(g), before)
        release()

    files = spark.read.parquet(f"{path}/manifest").select("file", "n_before")
    return files.repartition(max(1, min(files.count(), 1 << 16)), "file").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _digests(sequences: pa.RecordBatchReader, docs: pa.RecordBatchReader, before: int) -> Iterator[pa.RecordBatch]:
    ids, at = np.empty(0, "<u4"), 0  # ids from place at on that no document has used up
    for own in docs:
        crc = np.zeros(own.num_rows, np.int64)
        for i, (first, n) in enumerate(zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True)):
            value, left = 0, n
            while left:
                if first + n - left == at + len(ids):
                    at, batch = at + len(ids), sequences.read_next_batch()
                    ids = batch.column(0).flatten().to_numpy()[batch.column(1).flatten().to_numpy(zero_copy_only=False)].astype("<u4")
                a = first + n - left - at
                piece = ids[a : a + left]
                value, left = zlib.crc32(piece, value), left - len(piece)
            crc[i] = value
        yield pa.RecordBatch.from_arrays([own.column(0), pa.array(own.column(1).to_numpy() + before), own.column(2), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


class Sequences:
    """Random access to the sequences below a path, by number, as views of the mapped
    files. ``manifest`` is what write_sequences returns, as rows."""

    def __init__(self, path: str, manifest: list):
        self.path, self.files = path, sorted(manifest, key=lambda r: r["part"])
        self.before = np.array([r["sequences_before"] for r in self.files])
        self.mapped: dict[int, tuple[pa.Buffer, pa.Schema]] = {}

    def __len__(self) -> int:
        return sum(r["sequences"] for r in self.files)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence i: a NumPy view and an Arrow view."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.before, i, "right")) - 1
        row = self.files[k]
        if k not in self.mapped:
            source = _open(self.path, f"{row['file']}.arrow")
            self.mapped[k] = source.read_buffer(), pa.ipc.open_stream(_open(self.path, f"{row['file']}.arrow")).schema
        data, schema = self.mapped[k]
        batch, at = divmod(i - row["sequences_before"], row["per_batch"])
        message = pa.ipc.read_message(data.slice(row["head"] + batch * row["batch_bytes"]))
        own = pa.ipc.read_record_batch(message, schema)
        ids, mask = (own.column(c).flatten().slice(at * row["length"], row["length"]) for c in (0, 1))
        return ids.to_numpy(), mask


def op12_query(spark, sf_dir: str) -> DataFrame:
    """Contract: documents encoded, written in ascending doc_id and read back."""
    import public_tokenizers

    path = new_folder(spark, "tokens")
    write_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)
