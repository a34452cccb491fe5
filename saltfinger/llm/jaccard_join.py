"""N-gram Jaccard join by vertical partitioning (operator 5).

Each text becomes a set of word n-gram hashes. The hash order is the global
n-gram order. The join has four Spark steps:

1. ``classes``: equal sets collapse to one class, so copies cost one row each.
2. ``_index``: of every class the least hashes (a prefix of the order long
   enough that linked sets must meet in it several times) go to the fragment of
   the order they lie in. A fragment counts in how many classes each n-gram
   occurs; n-grams of one class are dropped. Classes with too few shared
   n-grams to be linked with anything drop out; the others keep their rarest
   shared n-grams as blocking keys, as many as the prefix principle asks for.
3. ``_overlaps``: for the pairs to verify, the whole sets are cut into fragments
   of the order, the overlap in each fragment is counted on its own, and the
   partial overlaps are summed per pair. Links are decided by exact integer
   arithmetic on that sum.
4. Pairs inside a block are not all emitted. Its members are first verified against
   a few leaders; then only pairs whose members are in different components are
   left. Each class carries a parity bitmap of its set: n-grams of one set only
   flip a bit at most, so two bitmaps bound the overlap from above, and pairs whose
   bound is too low are not emitted at all. Of what is left, each two components
   have one pair verified a round, the one with the most similar bitmaps, and last
   all the others. The components are therefore exactly those of all links, although
   a group of m copies costs about m pairs, not m * m.

``jaccard_links`` and ``link_counts`` give the links themselves: step 4 takes the
pairs inside components too, all that bitmaps and sizes let through, in salted
blocks. Their cost is that of the links, m * m / 2 for m different near copies.

Nulls and empty texts have the empty set and link with nothing. Rows that
repeat a doc_id are rows of their own. A null doc_id takes part in the join but
is never the name of a component that has another member. Columns beside doc_id
and text are ignored. Hashes have 64 bits: two n-grams or two sets are taken as
equal when their hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .screen import Screen, cut, parts, row_key, split, without
from .textkit import chunks, set_key, shingles, signed, words

#: Fragments of the order in which overlaps are counted.
OVERLAP_FRAGMENTS = 4
#: Leaders of a block that its members are verified against.
LEADERS = 3
#: Rounds in which two components have one pair verified, before all of the rest.
BEST_ROUNDS = 2
#: Members of a block from which on a pair comes from the first of its common
#: blocks only, not from each.
LARGE_BLOCK = 64
#: Members of a cell of a block, where all pairs of a block are verified.
CELL = 256
#: Longs of a parity bitmap.
BITMAP_LONGS = 16


def differing(bits_a: Column, bits_b: Column) -> Column:
    """Number of bits in which two bitmaps differ."""
    return sum((F.bit_count(bits_a[i].bitwiseXOR(bits_b[i])) for i in range(1, BITMAP_LONGS)), F.bit_count(bits_a[0].bitwiseXOR(bits_b[0])))


class Threshold:
    """100 * |x & y| >= percent * |x | y|, in integers."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent = percent

    def least(self, n: int) -> int:
        """Overlap that any link of a set of n needs."""
        return -(-self.percent * n // 100)

    def extra(self, n: int) -> int:
        """n-grams that linked sets share in their prefixes, at least (before min with the partner's)."""
        return 1 + n * (100 - self.percent) // 125

    def prefix(self, n: int) -> int:
        return min(n, n - self.least(n) + self.extra(n))

    def least_sql(self, n: str) -> str:
        return f"(({self.percent} * {n} + 99) DIV 100)"

    def needed_sql(self, n: str) -> str:
        """Shared prefix n-grams that a set of n has with any partner, at least."""
        return f"(1 + {self.least_sql(n)} * {100 - self.percent} DIV 125)"

    def may_link(self, na: Column, nb: Column, bits_a: Column, bits_b: Column) -> Column:
        """False if sizes or bitmaps rule a link out. Differing bits are at most
        the n-grams that only one set has, na + nb - 2 * overlap."""
        both = na + nb
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * self.percent) & ((both - differing(bits_a, bits_b)) * (100 + self.percent) >= both * (2 * self.percent))


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, _, data, at in chunks(column):
        hashes, own = words(data, at)
        yield from enumerate(shingles(hashes, own, n), first)


def classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, sig, bits, key): size, key and parity bitmap of every
    row's set, and the row's own key."""

    def run(batches):
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            sigs = np.zeros(batch.num_rows, np.int64)
            bits = np.zeros((batch.num_rows, BITMAP_LONGS), np.int64)
            for i, own in _sets(batch.column(1), n):
                if len(own):
                    sizes[i], sigs[i] = len(own), set_key(own)
                    odd = np.bincount(((own >> np.uint64(20)) & np.uint64(64 * BITMAP_LONGS - 1)).astype(np.int64), minlength=64 * BITMAP_LONGS) & 1
                    bits[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BITMAP_LONGS)
            lists = pa.ListArray.from_arrays(at, pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sigs), lists, batch.column(2)], names=["doc_id", "n_shingles", "sig", "bits", "key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key()).mapInArrow(run, "doc_id long, n_shingles long, sig long, bits array<long>, key long")


def _fragment(grams: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.searchsorted(pivots, grams, "right")


def _pack(values: np.ndarray) -> bytes:
    """Ascending integers as byte planes of their steps: high planes are all but
    constant, and shuffle compression takes them away."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, steps.itemsize).T).tobytes()


def _unpack(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    return np.add.accumulate(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


#: Bits of a hash that a fragment compares; a false match only lets a class
#: through to the exact count.
_KEPT_BITS = np.uint64(0xFFFFFFFFFFFF0000)


def _index(docs: DataFrame, n: int, rule: Threshold) -> DataFrame:
    """(gram, sig, n): the blocking keys of every class that may have a link."""
    fragments = parts(docs, 8 << 20)
    share = min(1.0, 1 - rule.percent / 100 + (100 - rule.percent) / 125 + 0.02)
    low = max(1, fragments - max(1, fragments // 16))
    pivots = np.array([int(share * i / low * 2**64) for i in range(1, low)] + [int((share + (1 - share) * i / (fragments - low + 1)) * (2**64 - 1)) for i in range(fragments - low + 1)], dtype=np.uint64)[: fragments - 1]

    def spread(batches):
        names = ["fragment", "grams", "member", "sigs", "sizes"]
        for batch in batches:
            seen: set[int] = set()
            grams, members, sigs, sizes = [], [], [], []
            for _, own in _sets(batch.column(0), n):
                if not len(own) or (key := set_key(own)) in seen:
                    continue
                seen.add(key)
                prefix = own[: rule.prefix(len(own))]
                grams.append(prefix)
                members.append(np.full(len(prefix), len(sigs), np.int32))
                sigs.append(key)
                sizes.append(len(own))
            if not grams:
                continue
            gram, member = np.concatenate(grams) & _KEPT_BITS, np.concatenate(members)
            order = np.argsort(gram, kind="stable")
            gram, member = gram[order], member[order]
            sig, size = np.array(sigs, np.int64), np.array(sizes, np.int64)
            cutoff = np.concatenate(([0], np.searchsorted(gram, pivots, "left"), [len(gram)]))
            rows: list[list] = [[] for _ in names]
            for f, (first, end) in enumerate(zip(cutoff[:-1].tolist(), cutoff[1:].tolist(), strict=True)):
                if end > first:
                    here, own = np.unique(member[first:end], return_inverse=True)
                    kind = np.uint16 if len(here) < 1 << 16 else np.uint32
                    planes = np.ascontiguousarray(own.astype(kind).view(np.uint8).reshape(len(own), -1).T).tobytes()
                    for row, value in zip(rows, (f, _pack(gram[first:end]), planes, sig[here].tobytes(), size[here].astype(np.int32).tobytes()), strict=True):
                        row.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=names)

    def count(table: pa.Table) -> pa.Table:
        grams, sigs, sizes = [], [], []
        for gram, member, sig, size in zip(*(table.column(c).to_pylist() for c in ("grams", "member", "sigs", "sizes")), strict=True):
            gram = _unpack(gram, np.uint64)
            width = len(member) // len(gram)
            member = np.ascontiguousarray(np.frombuffer(member, np.uint8).reshape(width, -1).T).view(f"u{width}").ravel()
            grams.append(gram)
            sigs.append(np.frombuffer(sig, np.int64)[member])
            sizes.append(np.frombuffer(size, np.int32)[member])
        gram, sig, size = np.concatenate(grams), np.concatenate(sigs), np.concatenate(sizes)
        order = np.lexsort((sig, gram))
        gram, sig, size = gram[order], sig[order], size[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])
        gram, sig, size = gram[new], sig[new], size[new]
        start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        df = np.repeat(np.diff(np.append(start, len(gram))), np.diff(np.append(start, len(gram))))
        keep = df > 1
        return pa.table({"gram": signed(gram[keep]), "sig": sig[keep], "n": size[keep].astype(np.int64), "df": df[keep].astype(np.int64)})

    shared = (
        docs.select(F.col("text").cast("string")).mapInArrow(spread, "fragment int, grams binary, member binary, sigs binary, sizes binary")
        .groupBy("fragment").applyInArrow(count, "gram long, sig long, n long, df long")
    )
    own = Window.partitionBy("sig")
    ranked = shared.withColumn("shared", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "gram")))
    return ranked.where(f"rank <= shared - {rule.needed_sql('n')} + 1").select("gram", "sig", "n")


def _pieces(docs: DataFrame, screen: Screen, n: int) -> DataFrame:
    """(sig, fragment, grams): the sets of the classes to verify, cut into
    fragments of the order. Only rows whose key passes the screen are cut."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(screen.may_hold(batch.column(1).to_numpy(zero_copy_only=False))))
            sigs: list[int] = []
            grams: list[np.ndarray] = []
            held = 0
            for _, own in _sets(batch.column(0), n):
                if len(own) and (key := set_key(own)) not in seen:
                    seen.add(key)
                    sigs.append(key)
                    grams.append(own)
                    held += len(own)
                if held > 1 << 20:
                    yield emit(sigs, grams)
                    sigs, grams, held = [], [], 0
            if sigs:
                yield emit(sigs, grams)

    def emit(sigs, grams):
        edges = np.array([(i << 64) // OVERLAP_FRAGMENTS for i in range(1, OVERLAP_FRAGMENTS)], np.uint64)
        ends = np.cumsum([len(g) for g in grams])
        at = np.concatenate([[0], *(np.append(np.searchsorted(g, edges), len(g)) + end - len(g) for g, end in zip(grams, ends, strict=True))])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(np.concatenate(grams))))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(sigs, np.int64), OVERLAP_FRAGMENTS)), pa.array(np.tile(np.arange(OVERLAP_FRAGMENTS, dtype=np.int32), len(sigs))), lists], names=["sig", "fragment", "grams"])

    keyed = docs.select(F.col("text").cast("string"), row_key().alias("k"))
    return keyed.mapInArrow(run, "sig long, fragment int, grams array<long>")


def _links(pairs: DataFrame, pieces: DataFrame, rule: Threshold) -> DataFrame:
    """Those pairs (a, b, na, nb) that are links, by the sum of partial overlaps."""
    left = pieces.select(F.col("sig").alias("b"), "fragment", F.col("grams").alias("gb"))
    right = pieces.select(F.col("sig").alias("a"), "fragment", F.col("grams").alias("ga"))
    partial = (
        pairs.join(left, "b").join(right, ["a", "fragment"])
        .select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("part"))
    )
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return total.where(f"100 * both >= {rule.percent} * (na + nb - both)").select("a", "b", "na", "nb", "both")


def _prepared(docs: DataFrame, n: int, rule: Threshold) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows' sets, their classes by name, the index of the classes that may
    have a link, and the bitmaps and pieces of these."""
    own = cut(classes(docs, n))
    names = own.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.min("key").alias("key"), F.first("bits").alias("bits"))

    index = cut(_index(docs, n, rule))
    met = index.groupBy("gram").agg(F.count("*").alias("met")).where("met > 1")
    index = cut(index.join(met, "gram").withColumn("keys", F.count("*").over(Window.partitionBy("sig")) / F.col("n")))
    nodes = cut(names.join(index.select("sig").distinct(), "sig", "left_semi"))
    pieces = cut(_pieces(docs, Screen.of(nodes, "key"), n))
    if pieces.count() > OVERLAP_FRAGMENTS * pieces.select("sig").distinct().count():  # rows repeat
        pieces = cut(pieces.dropDuplicates(["sig", "fragment"]))
    return own.drop("bits"), names.select("sig", "class_id"), index, nodes.select("sig", "bits"), pieces


def _all_links(index: DataFrame, bits: DataFrame, pieces: DataFrame, rule: Threshold) -> DataFrame:
    """(a, b, na, nb, both): every link between different sets, once. A block is
    dealt by the members' hashes into cells of about ``CELL`` members; each pair of
    cells meets in a partition key of its own, so no block is one task."""
    large = F.col("met") > LARGE_BLOCK
    blocks = index.where(large).groupBy("sig").agg(F.collect_list("gram").alias("large"))
    cells = F.ceil(F.col("met") / CELL).cast("int")
    full = index.join(bits, "sig").join(blocks, "sig", "left").withColumn("large", F.when(large, F.col("large")))
    full = full.withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("sig"), "cells").cast("int"))
    side = lambda x: [F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}"), F.col("large").alias(f"l{x}")]
    one = full.select("gram", F.col("cell").alias("i"), F.explode(F.sequence("cell", F.col("cells") - 1)).alias("j"), *side("a"))
    two = full.select("gram", F.explode(F.sequence(F.lit(0), "cell")).alias("i"), F.col("cell").alias("j"), *side("b"))
    first = F.col("la").isNull() | (F.array_min(F.array_intersect("la", "lb")) == F.col("gram"))
    met = one.join(two, ["gram", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    met = met.where(rule.may_link(F.col("na"), F.col("nb"), F.col("xa"), F.col("xb")) & first)
    p, q = F.struct(F.col("a").alias("s"), F.col("na").alias("n")), F.struct(F.col("b").alias("s"), F.col("nb").alias("n"))
    pairs = met.select(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).distinct()
    pairs = pairs.select(F.col("p.s").alias("a"), F.col("q.s").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb"))
    return _links(cut(pairs), pieces, rule)


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(class_a, class_b, a, b, n_a, n_b, overlap): every link between different
    sets, once, inside a component too. a and b are the sets' keys, class_a and
    class_b the least doc_ids with them."""
    rule = Threshold(percent)
    _, names, index, bits, pieces = _prepared(docs, n, rule)
    found = _all_links(index, bits, pieces, rule)
    name = lambda x: names.select(F.col("sig").alias(x), F.col("class_id").alias(f"class_{x}"))
    return found.join(name("a"), "a").join(name("b"), "b").select("class_a", "class_b", "a", "b", F.col("na").alias("n_a"), F.col("nb").alias("n_b"), F.col("both").alias("overlap"))


def link_counts(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, n_copies, n_links): for each row the number
    of other rows with its set and of other sets that it links to. Both are 0, and
    class_id the row's own doc_id, if its set is empty."""
    rule = Threshold(percent)
    own, names, index, bits, pieces = _prepared(docs, n, rule)
    found = cut(_all_links(index, bits, pieces, rule))
    ends = found.select(F.col("a").alias("sig")).unionAll(found.select(F.col("b").alias("sig"))).groupBy("sig").agg(F.count("*").alias("n_links"))
    copies = own.where("n_shingles > 0").groupBy("sig").agg((F.count("*") - 1).alias("n_copies"))
    out = own.join(names.join(copies, "sig").join(ends, "sig", "left"), "sig", "left")
    has = F.col("n_shingles") > 0
    count = lambda c: F.when(has, F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    return out.select("doc_id", "n_shingles", F.when(has, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), count("n_copies"), count("n_links"))


def _merge_roots(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(sig, root) of every class that a link has reached, after the links found.
    Only the components that these links touch are contracted again."""
    ends = found.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    if roots is None:
        return cut(connected_components(found).withColumnRenamed("node", "sig"))
    at = lambda x: roots.select(F.col("sig").alias(x), F.col("root").alias(f"r{x}"))
    edges = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("__to"))
    every = roots.unionByName(ends.join(roots, "sig", "left_anti").withColumn("root", F.col("sig")))
    return cut(every.join(moved, "root", "left").select("sig", F.coalesce("__to", "root").alias("root")))


def _leader_pairs(index: DataFrame, bits: DataFrame, rule: Threshold) -> DataFrame:
    """(a, b, na, nb): each member of a block with the block's leaders. The first is
    the member with most shared n-grams for its size: of near copies that is one with
    few changes, to which most others link. The others are drawn."""
    order = [-F.col("keys"), *(F.xxhash64("sig", F.lit(i)) for i in range(1, LEADERS))]
    lead = index.groupBy("gram").agg(*(F.min(F.struct(o.alias("o"), "sig", "n")).alias(f"x{i}") for i, o in enumerate(order)))
    lead = lead.select("gram", F.array_distinct(F.array(*(F.struct(F.col(f"x{i}.sig").alias("s"), F.col(f"x{i}.n").alias("n")) for i in range(LEADERS)))).alias("leads"))
    mine = F.struct(F.col("sig").alias("s"), "n")
    met = index.join(lead, "gram").select(mine.alias("m"), F.explode("leads").alias("l")).where("m.s <> l.s")
    pairs = met.select(F.least("m", "l").alias("p"), F.greatest("m", "l").alias("q")).distinct()
    pairs = pairs.select(F.col("p.s").alias("a"), F.col("q.s").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb"))
    pairs = pairs.join(bits.select(F.col("sig").alias("a"), F.col("bits").alias("xa")), "a").join(bits.select(F.col("sig").alias("b"), F.col("bits").alias("xb")), "b")
    return pairs.where(rule.may_link(F.col("na"), F.col("nb"), F.col("xa"), F.col("xb"))).select("a", "b", "na", "nb")


def _candidates(index: DataFrame, roots: DataFrame | None, bits: DataFrame, rule: Threshold) -> DataFrame:
    """(a, b, na, nb): the pairs of different components that share a block and that
    sizes and bitmaps let through. In a block the members of its largest component
    meet only the others."""
    at = index.withColumn("root", F.col("sig")) if roots is None else index.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    # one row for each block of several components, with the largest of these
    tops = at.groupBy("gram", "root").agg(F.count("*").alias("c")).groupBy("gram").agg(F.count("*").alias("k"), F.max(F.struct("c", "root"))["root"].alias("top")).where("k > 1")
    at = cut(at.join(tops.drop("k"), "gram"))
    large = F.col("met") > LARGE_BLOCK
    blocks = at.where(large).groupBy("sig").agg(F.collect_list("gram").alias("large"))
    full = at.join(bits, "sig").join(blocks, "sig", "left").withColumn("large", F.when(large, F.col("large")))
    side = lambda x: [F.col("gram").alias(f"g{x}"), F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"), F.col("bits").alias(f"x{x}"), F.col("large").alias(f"l{x}"), (F.col("root") == F.col("top")).alias(f"t{x}")]
    one, two = full.where("root <> top").select(*side("a")), full.select(*side("b"))
    first = F.col("la").isNull() | (F.array_min(F.array_intersect("la", "lb")) == F.col("ga"))
    once = F.col("tb") | (F.col("a") < F.col("b"))
    met = one.join(two, (F.col("ga") == F.col("gb")) & once & (F.col("ra") != F.col("rb")) & rule.may_link(F.col("na"), F.col("nb"), F.col("xa"), F.col("xb")) & first)
    p, q = F.struct(F.col("a").alias("s"), F.col("na").alias("n")), F.struct(F.col("b").alias("s"), F.col("nb").alias("n"))
    pairs = met.select(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).distinct()
    return pairs.select(F.col("p.s").alias("a"), F.col("q.s").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb"))


def _roots(index: DataFrame, bits: DataFrame, pieces: DataFrame, rule: Threshold) -> DataFrame | None:
    """(sig, root) of the classes that have a link, with the least key of their
    component.

    First the members of each block are verified against its leaders. Of all pairs
    that two components then still have, that with the most similar bitmaps is
    verified; if it is a link, the others need not be. After ``BEST_ROUNDS`` such
    rounds all of what is left are verified."""
    pairs = cut(_leader_pairs(index, bits, rule))
    found = cut(_links(pairs, pieces, rule).select("a", "b"))
    roots = None if found.isEmpty() else _merge_roots(None, found)
    rest = _candidates(index, roots, bits, rule).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    side = lambda x: bits.select(F.col("sig").alias(x), F.col("bits").alias(f"x{x}"))
    rest = cut(rest.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", (differing(F.col("xa"), F.col("xb")) / (F.col("na") + F.col("nb"))).alias("far")))
    for step in range(BEST_ROUNDS + 1):
        at = lambda x: roots.select(F.col("sig").alias(x), F.col("root").alias(f"r{x}"))  # noqa: E731, B023
        live = rest.withColumns({"ra": F.col("a"), "rb": F.col("b")}) if roots is None else rest.join(at("a"), "a", "left").join(at("b"), "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
        live = cut(live.where("ra <> rb"))
        pairs = live.select("a", "b", "na", "nb")
        if step < BEST_ROUNDS:
            nearest = F.min(F.struct("far", "a", "b", "na", "nb")).alias("x")
            pairs = cut(live.groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(nearest).select("x.a", "x.b", "x.na", "x.nb"))
        if pairs.isEmpty():
            break
        found = cut(_links(pairs, pieces, rule).select("a", "b"))
        if not found.isEmpty():
            roots = _merge_roots(roots, found)
        rest = live.drop("ra", "rb").join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    return roots


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of jaccard_components with key, which names the row, and root,
    which names the component, also where doc_id is null or repeated."""
    rule = Threshold(percent)
    own, names, index, bits, pieces = _prepared(docs, n, rule)
    roots = _roots(index, bits, pieces, rule)
    named = names.withColumn("root", F.col("sig")) if roots is None else names.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    heads = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(heads, "root")
    out = own.join(named.select("sig", "root", "class_id", "component_id"), "sig", "left")
    mine = lambda c: F.when(F.col("n_shingles") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return out.select("doc_id", "n_shingles", mine("component_id"), mine("class_id"), "key", "root")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): components of the links
    100 * |x & y| >= percent * |x | y| between the rows' n-word shingle sets.
    class_id is the least doc_id with the same set, component_id the least one
    that links reach; both are the row's own doc_id if its set is empty."""
    return _grouped(docs, n, percent).drop("key", "root")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one row of each component: that of the least doc_id, a
    null only if all are. Of rows with one doc_id in a component, the least by the
    hash of the text stays, of copies with one text the least by the hash of the
    row. Rows without words stay."""
    keys = _grouped(docs, n, percent).where("n_shingles > 0").groupBy("key", "root", "doc_id").agg(F.count("*").alias("c"))
    keys = cut(keys)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "c")
    heads = cut(keys.groupBy("root").agg(F.min(order).alias("h")).select(F.col("h.key").alias("__k"), F.col("h.c").alias("c")))
    others = keys.select(F.col("key").alias("__k")).join(heads, "__k", "left_anti")
    twins = heads.where("c > 1").select("__k")
    if twins.isEmpty():
        return without(docs, row_key(), cut(others))
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    column = lambda name: F.col("`" + name.replace("`", "``") + "`")
    some, _ = split(docs, row_key(), Screen.of(twins, "__k"))
    one = some.groupBy("__k").agg(F.min_by(F.struct(*(column(c) for c in docs.columns)), F.xxhash64(*(column(c) for c in plain))).alias("__row"))
    one = one.join(twins, "__k", "left_semi").select("__row.*")
    return without(docs, row_key(), cut(others.unionAll(twins))).unionAll(one)


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Contract: 4-word shingles, 100 * overlap >= 85 * union, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, n=4, percent=85).select("doc_id", "n_shingles", "component_id", "class_id")
