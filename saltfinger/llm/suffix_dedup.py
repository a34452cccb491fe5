"""Suffix-array removal of repeated byte passages (operator 10).

A byte goes when a ``min_len``-byte string covering it also starts at another
place of the corpus. Strings never cross rows. Sorting every suffix of the corpus
would exchange some hundred bytes a byte; this sorts only suffixes that can
matter, and the result is exactly that of the full suffix array:

1. Anchors. In every window of ``min_len - ANCHOR + 1`` start positions the
   position with the least hash of its ANCHOR-byte string is an anchor (the left
   one of ties). Which position that is depends on the window's bytes alone, so
   two equal strings have their anchors at the same place inside them. Spark
   counts anchor hashes; a string whose anchor is unique is not repeated.
2. Runs. Suffixes at repeated anchors (``min_len`` bytes; and the bytes before
   them) are sorted where they are read. Equal contexts of a run are one entry
   with a number. The runs are front-coded, cut at splitters of the suffix order
   (whole anchor strings) and exchanged. Where the contexts stand is not sent
   along: a place joins its context again by a 128-bit key, so copies do not
   fill a range.
3. Merge. Each range merges its runs with a loser tree that never re-compares
   known prefixes, which also yields the LCP array. For an anchor at distance d
   from the start of the string, the string is repeated iff another suffix
   shares min_len - d bytes to the right and d bytes to the left; both are runs
   of the two LCP arrays. Several lengths are answered from one merge.
4. Hot anchors. Suffixes with one anchor stay together in a range. An anchor with
   more than ``HOT_PLACES`` places is no range: the strings around it are hashed
   at every distance and counted by Spark, which gives the same answer.
5. The covered ranges go to their rows, are united and cut out.

Null texts are empty. Rows that repeat a doc_id are told apart by their texts'
hashes; rows that repeat both are copies, whose bytes all go if there are
min_len of them. A null doc_id is kept. Columns besides doc_id and text are
ignored by ``repeated_spans`` and kept by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .merge_runs import front_code, merge
from .screen import Screen, cut, parts
from .textkit import chunks, mix, release, rolling, signed, span_hash

#: Bytes whose hash chooses the anchors.
ANCHOR = 64
_POSITION_BITS = 24
#: Places of an anchor from which on its strings are counted, not sorted in a range.
HOT_PLACES = 1 << 16
#: Places of repeated anchors a range that the splitters are chosen from.
SAMPLE = 16
#: Bytes of a passage of some fifty words of four letters, with room for short words.
PASSAGE = 200
#: Bytes of the contexts of a run.
_RUN_BYTES = 6 << 20
#: Rows whose texts are taken out of a batch at once.
SLICE = 1024
#: Bytes of rows whose anchors are looked for at once, or one row.
_AT_ONCE = 1 << 19


class Shape:
    """The lengths looked for at once and what they ask of the contexts. Anchors
    are those of the least length; longer strings hold a string of that length at
    their start, and so its anchor."""

    def __init__(self, *lengths: int):
        if min(lengths) < 16:
            raise ValueError("a length must be 16 at least")
        self.lengths, self.base, self.top = lengths, min(lengths), max(lengths)
        self.k = min(ANCHOR, max(8, self.base // 16 * 8))
        self.before = self.base - self.k


def anchors(data: np.ndarray, at: np.ndarray, min_len: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a chunk of rows."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(data) - k + 1
    span = min_len - k + 1
    if len(data) < min_len:
        return none
    start = np.arange(n)
    hashes = mix(span_hash(rolling(data), start, start + k))
    bits = np.uint64(max(_POSITION_BITS, int(n).bit_length()))
    keys = (hashes >> bits << bits) | start.astype(np.uint64)
    # least key of each window, from prefix and suffix minima of blocks
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    block = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(len(data) - min_len + 1)
    least = np.minimum(back[first], ahead[first + span - 1])
    ends = np.repeat(at[1:], np.diff(at))[: len(first)]
    least = least[first + min_len <= ends]
    if not len(least):
        return none
    low = (np.uint64(1) << bits) - np.uint64(1)
    new = np.concatenate(([True], least[1:] != least[:-1]))
    place = np.unique((least[new] & low).astype(np.int64))
    return place, hashes[place]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _sliced(batches):
    """The batches in pieces of ``SLICE`` rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)
        release()


def _repeated(docs: DataFrame, shape: Shape) -> DataFrame:
    """(h, c): hashes of anchors that occur more than once, with their number."""

    def run(batches):
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0), _AT_ONCE):
                _, hashes = anchors(data, at, shape.base, shape.k)
                if len(hashes):
                    h, count = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(count)], names=["h", "c"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, c long")
    return found.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")


_RUN = "range int, shared binary, ends binary, tails binary, left_ends binary, lefts binary, counts binary"
_NULL_ID = np.iinfo(np.int64).min


def _contexts(batch_texts: pa.Array, screen: Screen, shape: Shape) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(row, place, right, left) of every anchor that the screen lets through."""
    for row, _, data, at in chunks(batch_texts, _AT_ONCE):
        place, hashes = anchors(data, at, shape.base, shape.k)
        place = place[screen.may_hold(hashes)]
        owner = np.searchsorted(at, place, "right") - 1
        raw = data.tobytes()
        for p, d, b, e in zip(place.tolist(), (owner + row).tolist(), at[owner].tolist(), at[owner + 1].tolist(), strict=True):
            yield d, p - b, raw[p : min(p + shape.top, e)], raw[max(b, p - shape.before) : p]


def _context_key(right: bytes, left: bytes) -> tuple[int, int]:
    """128-bit key of a context, as two signed longs."""
    x = xxhash.xxh3_128_digest(len(left).to_bytes(4, "big") + left + right)
    return int.from_bytes(x[:8], "big", signed=True), int.from_bytes(x[8:], "big", signed=True)


def _leads(raw: list[bytes], k: int) -> np.ndarray:
    return np.array([x[:k] for x in raw], f"S{k}")


def _runs(docs: DataFrame, screen: Screen, splitters: np.ndarray, shape: Shape) -> DataFrame:
    """Front-coded sorted runs of the suffixes at repeated anchors, by range. Equal
    contexts of a run are one entry with their number."""

    def run(batches):
        entries: dict[tuple[bytes, bytes], int] = {}
        held = 0
        for batch in batches:
            for _, _, right, left in _contexts(batch.column(0), screen, shape):
                if (right, left) not in entries:
                    held += len(right) + len(left)
                entries[right, left] = entries.get((right, left), 0) + 1
                if held > _RUN_BYTES:
                    yield from emit(entries)
                    entries, held = {}, 0
        if entries:
            yield from emit(entries)

    def emit(entries):
        order = sorted(entries)
        bounds = np.concatenate(([0], np.searchsorted(_leads([right for right, _ in order], shape.k), splitters, "left"), [len(order)]))
        names = [f.split()[0] for f in _RUN.split(", ")]
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[r] : bounds[r + 1]]
            shared, tails = front_code([right for right, _ in own])
            counts = [min(entries[c], (1 << 31) - 1) for c in own]
            blobs = np.array(shared, np.int32), np.cumsum([len(t) for t in tails]), b"".join(tails), np.cumsum([len(left) for _, left in own]), b"".join(left for _, left in own), np.array(counts, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in blobs)], names=names)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, _RUN)


def _places(docs: DataFrame, screen: Screen, shape: Shape) -> DataFrame:
    """(c1, c2, places): where each context of the screened anchors stands. A slice of
    a batch gives a row for each of its contexts, so that one which a third of all rows
    have is as many rows as there are slices with it."""

    def run(batches):
        kind = pa.struct([("doc", pa.int64()), ("key", pa.int64()), ("at", pa.int64())])
        for batch in _sliced(batches):
            ids = batch.column(0).fill_null(_NULL_ID).to_pylist()
            keys = batch.column(1).to_pylist()
            found: dict[tuple[int, int], dict[tuple[int, int, int], None]] = {}
            for d, at, right, left in _contexts(batch.column(2), screen, shape):
                found.setdefault(_context_key(right, left), {})[ids[d], keys[d], at] = None
            flat = [x for own in found.values() for x in own]
            cols = list(zip(*flat, strict=True)) or [(), (), ()]
            items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(kind))
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found.values()]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in found], pa.int64()) for i in (0, 1)] + [pa.ListArray.from_arrays(ends, items)], names=["c1", "c2", "places"])

    return _keyed(docs).mapInArrow(run, "c1 long, c2 long, places array<struct<doc: long, key: long, at: long>>")


def _left_order(group: np.ndarray, lefts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the reversed left contexts inside each group, and the LCP of each
    with the one before it in that order (-1 across groups)."""
    m = len(lefts)
    size = np.array([len(x) for x in lefts], np.int64)
    grid = np.zeros((m, width + 6), np.uint8)
    grid[:, :4] = group.astype(">u4").view(np.uint8).reshape(m, 4)
    flat = b"".join(x[::-1].ljust(width, b"\0") for x in lefts)
    grid[:, 4 : 4 + width] = np.frombuffer(flat, np.uint8).reshape(m, width)
    grid[:, 4 + width :] = size.astype(">u2").view(np.uint8).reshape(m, 2)
    order = np.argsort(grid.view(f"S{width + 6}").ravel(), kind="stable")
    lcp = np.full(m, -1, np.int64)
    for a in range(1, m, 4096):
        z = min(m, a + 4096)
        now, prev = grid[order[a:z]], grid[order[a - 1 : z - 1]]
        differ = now[:, 4 : 4 + width] != prev[:, 4 : 4 + width]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        n = np.minimum(n, np.minimum(size[order[a:z]], size[order[a - 1 : z - 1]]))
        lcp[a:z] = np.where(group[order[a:z]] == group[order[a - 1 : z - 1]], n, -1)
    return order, lcp


def covers(rights: list[int], lefts: list[bytes], lcp: np.ndarray, count: np.ndarray, min_len: int, shape: Shape, by_left: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in order: the least and the greatest distance d for which the
    min_len-byte string starting d bytes before the anchor is repeated; (1, 0)
    if there is none. rights are their lengths, lcp[i] the prefix that i and
    i - 1 share, count the number of places of each."""
    m = len(rights)
    low, high = np.ones(m, np.int64), np.zeros(m, np.int64)
    if not m:
        return low, high
    right = np.array(rights, np.int64)
    left = np.array([len(x) for x in lefts], np.int64)
    several = np.flatnonzero(count > 1)
    least = np.maximum(0, min_len - right)
    good = several[least[several] <= left[several]]
    low[good], high[good] = least[good], left[good]
    # groups that share an anchor and have several members go through the distances
    todo, order, back = by_left or left_order(lefts, lcp, shape)
    if not len(todo):
        return low, high
    h = lcp[todo].copy()
    place = np.empty(len(todo), np.int64)
    for d in range(shape.before + 1):
        a = np.cumsum(h < min_len - d)
        place[order] = np.cumsum(back < d)
        pair = a << 32 | place
        rank = np.argsort(pair, kind="stable")
        same = pair[rank[1:]] == pair[rank[:-1]]
        twice = np.zeros(len(todo), bool)
        twice[rank[1:][same]] = True
        twice[rank[:-1][same]] = True
        hit = todo[twice]
        none = low[hit] > high[hit]
        low[hit] = np.where(none, d, np.minimum(low[hit], d))
        high[hit] = np.where(none, d, np.maximum(high[hit], d))
    return low, high


def left_order(lefts: list[bytes], lcp: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes whose anchor another one has too, and ``_left_order`` of them."""
    group = np.cumsum(lcp < shape.k)
    todo = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(todo):
        return todo, todo, todo
    return todo, *_left_order(group[todo], [lefts[i] for i in todo.tolist()], shape.before)


_COVER = "c1 long, c2 long, low array<int>, high array<int>"


def _merged(table: pa.Table, shape: Shape) -> pa.Table:
    """The contexts of a range that hold a repeated string, with the least and the
    greatest distance for each length."""
    runs, lefts, counts = [], [], []
    for i in range(table.num_rows):
        row = {c: table.column(c)[i].as_py() for c in table.column_names if c != "range"}
        cut_up = lambda blob, ends: [blob[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
        runs.append((np.frombuffer(row["shared"], np.int32).tolist(), cut_up(row["tails"], np.frombuffer(row["ends"], np.int64).tolist())))
        lefts.append(cut_up(row["lefts"], np.frombuffer(row["left_ends"], np.int64).tolist()))
        counts.append(np.frombuffer(row["counts"], np.int32))
    lengths, left, lcp, count, keys = [], [], [], [], []
    spare: dict[bytes, int] = {}
    for r, i, shared, item in merge(runs):
        here = lefts[r][i]
        if not lengths or shared < lengths[-1] or shared < len(item):
            spare = {}
        if (same := spare.get(here)) is not None:  # the same context came in another run
            count[same] += int(counts[r][i])
            continue
        spare[here] = len(lengths)
        lengths.append(len(item))
        left.append(here)
        lcp.append(shared)
        count.append(int(counts[r][i]))
        keys.append(_context_key(item, here))
    steps, many = np.array(lcp, np.int64), np.array(count, np.int64)
    by_left = left_order(left, steps, shape)
    found = [covers(lengths, left, steps, many, size, shape, by_left) for size in shape.lengths]
    some = np.flatnonzero(np.any([low <= high for low, high in found], axis=0)) if lengths else np.empty(0, np.int64)
    at = pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(shape.lengths))
    side = lambda i: pa.ListArray.from_arrays(at, pa.array(np.stack([x[i][some] for x in found], axis=1).ravel().astype(np.int32)))
    return pa.table({"c1": pa.array([keys[i][0] for i in some], pa.int64()), "c2": pa.array([keys[i][1] for i in some], pa.int64()), "low": side(0), "high": side(1)})


def _counted(docs: DataFrame, hot: Screen, shape: Shape) -> DataFrame:
    """What ``_merged`` gives, for the contexts of hot anchors, of which no number is
    one group: every string of each length around the anchor is hashed, and Spark
    counts the hashes with partial sums."""
    names = ["s1", "s2", "c1", "c2", "which", "d", "c"]

    def run(batches):
        for batch in batches:
            seen: dict[tuple[bytes, bytes], int] = {}
            for _, _, right, left in _contexts(batch.column(0), hot, shape):
                seen[right, left] = seen.get((right, left), 0) + 1
            rows: list[tuple] = []
            for (right, left), c in seen.items():
                key, both = _context_key(right, left), left + right
                for which, size in enumerate(shape.lengths):
                    for d in range(max(0, size - len(right)), len(left) + 1):
                        x = xxhash.xxh3_128_digest(both[len(left) - d : len(left) - d + size])
                        rows.append((int.from_bytes(x[:8], "big", signed=True), int.from_bytes(x[8:], "big", signed=True), *key, which, d, c))
                if len(rows) > 1 << 16:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    each = docs.select(F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    each = cut(each.groupBy(*names[:-1]).agg(F.sum("c").alias("c")))
    # with the distance: one place of a string may hold two anchors
    string = ["which", "d", "s1", "s2"]
    twice = each.groupBy(*string).agg(F.sum("c").alias("n")).where("n > 1")
    hit = each.join(twice, string, "left_semi")
    per = hit.groupBy("c1", "c2").agg(*(f(F.when(F.col("which") == w, F.col("d"))).alias(f"{n}{w}") for w in range(len(shape.lengths)) for n, f in (("low", F.min), ("high", F.max))))
    side = lambda n, none: F.array(*(F.coalesce(F.col(f"{n}{w}"), F.lit(none)).cast("int") for w in range(len(shape.lengths)))).alias(n)
    return per.select("c1", "c2", side("low", 1), side("high", 0))


def repeated_spans(docs: DataFrame, *lengths: int) -> DataFrame:
    """(doc_id, text_key, spans, spans1, ...): for each row that has any, the byte
    ranges [first, end) that repeated strings of the first length cover, one of
    each anchor, and the same for the further lengths. text_key is xxhash64 of
    the text."""
    shape = Shape(*lengths or (400,))
    repeated = cut(_repeated(docs, shape))
    hot = repeated.where(f"c > {HOT_PLACES}")
    plain = repeated.where(f"c <= {HOT_PLACES}")
    pieces = parts(docs, 3 << 20, most=1 << 18)
    screen = Screen.of(plain, "h")
    runs = _runs(docs, screen, _splitters(docs, plain, screen, pieces, shape), shape)
    covered = runs.groupBy("range").applyInArrow(lambda table: _merged(table, shape), _COVER)
    if not hot.isEmpty():
        # an anchor that both screens let through is counted in full by either way
        covered = covered.unionAll(_counted(docs, Screen.of(hot, "h"), shape))
    spots = covered.join(_places(docs, Screen.of(repeated, "h"), shape), ["c1", "c2"]).select("low", "high", F.explode("places").alias("p"))
    name = lambda i: f"spans{i or ''}"
    ranges = [F.when(F.col("low")[i] <= F.col("high")[i], F.struct((F.col("p.at") - F.col("high")[i]).alias("first"), (F.col("p.at") - F.col("low")[i] + size).alias("end"))).alias(name(i)) for i, size in enumerate(shape.lengths)]
    spots = spots.select(F.nullif(F.col("p.doc"), F.lit(int(_NULL_ID))).alias("doc_id"), F.col("p.key").alias("text_key"), *ranges)
    return spots.groupBy("doc_id", "text_key").agg(*(F.collect_set(name(i)).alias(name(i)) for i in range(len(shape.lengths))))


def _splitters(docs: DataFrame, repeated: DataFrame, screen: Screen, pieces: int, shape: Shape) -> np.ndarray:
    """Anchor strings that cut the suffix order into about equal pieces. They come
    from some ``SAMPLE`` places of repeated anchors a piece, in texts chosen by their
    hashes; where the cuts lie has no part in the result."""
    places = repeated.agg(F.sum("c")).first()[0]
    if not places:
        return np.empty(0, f"S{shape.k}")
    share = max(1, places // (SAMPLE * pieces))

    def run(batches):
        for batch in batches:
            own = {right[: shape.k] for _, _, right, _ in _contexts(batch.column(0), screen, shape)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.binary())], names=["lead"])

    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(share)) == 0)
    found = some.mapInArrow(run, "lead binary").distinct().orderBy(F.xxhash64("lead")).limit(4 * SAMPLE * pieces).toArrow()
    leads = np.sort(_leads(found["lead"].to_pylist(), shape.k))
    return np.unique(leads[len(leads) * np.arange(1, pieces) // pieces]) if len(leads) else leads


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges made one, in order."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _with_spans(docs: DataFrame, lengths: tuple[int, ...], run, schema) -> DataFrame:
    """run on the batches of docs, whose rows have the columns of repeated_spans as
    __spans, __spans1, ...; only rows that may have spans are shuffled."""
    spans = cut(repeated_spans(docs, *lengths))
    screen = Screen.of(spans.select(F.xxhash64("doc_id", "text_key").alias("k")), "k")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("*", F.xxhash64(text).alias("__text_key"), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("__key"))

    def may_have(batch: pa.RecordBatch) -> np.ndarray:
        return screen.may_hold(batch.column("__key").to_numpy(zero_copy_only=False))

    def passing(batches):
        return (batch.filter(pa.array(may_have(batch))) for batch in _sliced(batches))

    def others(batches):
        return run(batch.filter(pa.array(~may_have(batch))) for batch in _sliced(batches))

    here = [c for c in spans.columns if c.startswith("spans")]
    right = spans.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__tk"), *(F.col(c).alias(f"__{c}") for c in here))
    some = keyed.mapInArrow(passing, keyed.schema)
    some = some.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__text_key") == F.col("__tk")), "left")
    return some.mapInArrow(lambda batches: run(_sliced(batches)), schema).unionAll(keyed.mapInArrow(others, schema))


def _spans_of(batch: pa.RecordBatch, which: int = 0) -> list[list[tuple[int, int]]]:
    at = batch.schema.get_field_index(f"__spans{which or ''}")
    if at < 0:
        return [[] for _ in range(batch.num_rows)]
    return [united([(s["first"], s["end"]) for s in x or ()]) for x in batch.column(at).to_pylist()]


def removal_digest(docs: DataFrame, min_len: int = 400, passage_len: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row. With
    passage_len also n_passage_bytes: the bytes that strings of this length cover
    which start elsewhere too; they are reported, not removed."""
    lengths = (min_len,) if passage_len is None else (min_len, passage_len)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            spans = _spans_of(batch)
            short = _spans_of(batch, 1) if passage_len is not None else [[]] * batch.num_rows
            for first, end, data, at in chunks(batch.column(1)):
                view = memoryview(data)
                for row in range(first, end):
                    a, z = int(at[row - first]), int(at[row - first + 1])
                    digest, done = hashlib.sha256(), a
                    for s, e in spans[row]:
                        digest.update(view[done : a + s])
                        done = a + e
                    digest.update(view[done:z])
                    for column, value in zip(out, (z - a, sum(e - s for s, e in spans[row]), len(spans[row]), digest.hexdigest(), sum(e - s for s, e in short[row])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"
    own = _with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), lengths, run, schema)
    return own.select(names if passage_len is not None else names[:-1])


def drop_repeats(docs: DataFrame, min_len: int = 400) -> DataFrame:
    """docs with the repeated bytes cut out of text. A character goes if all of
    its bytes go; rows whose text becomes empty go, rows that came empty stay.
    n_chars, if there, is that of what is left."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            spans = _spans_of(batch)
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for i, own in enumerate(spans):
                if own:
                    raw, done, left = texts[i].encode(), 0, []
                    for s, e in own:
                        while s < len(raw) and raw[s] & 0xC0 == 0x80:
                            s += 1
                        while e < len(raw) and raw[e] & 0xC0 == 0x80:
                            e -= 1
                        if e > s:
                            left.append(raw[done:s])
                            done = e
                    left.append(raw[done:])
                    texts[i] = b"".join(left).decode()
                    keep[i] = bool(texts[i])
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(x) for x in spans])], names=[*names, "__cut"]).filter(pa.array(keep))

    texts = docs.withColumn("text", F.col("text").cast("string"))
    left = _with_spans(texts, (min_len,), run, StructType([*texts.schema, StructField("__cut", BooleanType())]))
    if "n_chars" in names:
        own = F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars"))
        left = left.withColumn("n_chars", F.when(F.col("__cut"), own).otherwise(F.col("n_chars")))
    return left.select(names)


def op10_query(spark, sf_dir: str) -> DataFrame:
    """Contract: bytes covered by 400-byte strings that also start elsewhere. The
    further column n_passage_bytes is the same at ``PASSAGE`` bytes."""
    return removal_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), 400, PASSAGE)
