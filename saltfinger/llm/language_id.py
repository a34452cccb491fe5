"""Language identification by character language models (operator 9).

One interpolated Kneser-Ney model of character 5-grams per language. Training
counts come from a bounded sample of labelled rows: at most ``sample_rows`` whole
texts of at most ``sample_chars`` characters per language, those of least hash.
All models live in shared sorted hash arrays, an array for each order, with the
log probability under every language beside each hash, so that a character costs
one binary search. n-grams that no language has seen back off order by order.

A text gets the language of the lowest cross-entropy per character. Its score is
the posterior over languages at a temperature fitted on a part of the sample
that the counts leave out. The same part calibrates rejection: a text is rejected if its
cross-entropy lies further above its language's mean than chance allows for its
length, or if it has no letter. The bound is that language's own, ``REJECT_MARGIN``
times the deviation that all but ``FALSE_REJECTIONS`` of its calibration texts stay
within (``reject_z`` at least); texts that another language fits better are taken
for mislabelled and do not lift it. ``Models.false_rejections`` is the share of
calibration texts that the bounds reject.

The arrays are dense in languages: some 20 bytes for each n-gram and language, for
corpora of dozens of languages.

Only letters count, lower-cased; everything else is a word break. Null texts and
texts without letters are ``und`` with score 0 and are rejected, and so are all
texts if there is no labelled row to learn from. Whole texts are scored. Rows
that repeat a doc_id are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textkit import chunks, mix

ORDER = 5
#: Share of a language's calibration texts that may lie beyond its own quantile, and
#: the margin put on that for texts that were not seen.
FALSE_REJECTIONS, REJECT_MARGIN = 0.01, 1.5
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LETTERS: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 0."""
    if "table" not in _LETTERS:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                table[c] = ord(s.lower()[0])
        _LETTERS["table"] = table
    return _LETTERS["table"]


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, start of each row, letters of each row): ORDER - 1 breaks come
    before each row's symbols, and runs of breaks inside are one."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
    sym = _letters()[points]
    keep = sym != 0
    letters = np.concatenate(([0], np.cumsum(keep)))[begins]
    inner = keep.copy()
    inner[1:] |= keep[:-1]
    starts = begins[:-1][begins[:-1] < begins[1:]]
    inner[starts] = keep[starts]
    place = np.concatenate(([0], np.cumsum(inner)))[begins]
    rows = len(at) - 1
    out = np.zeros(int(place[-1]) + rows * (ORDER - 1), np.uint32)
    shift = np.repeat(np.arange(1, rows + 1) * (ORDER - 1), np.diff(place))
    out[np.arange(int(place[-1])) + shift] = sym[inner]
    return out, place + np.arange(rows + 1) * (ORDER - 1), np.diff(letters)


def _grams(sym: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each position from ORDER - 1 on."""
    code = mix(sym.astype(np.uint64) + np.uint64(1))
    m = len(sym) - ORDER + 1
    h = np.zeros(max(m, 0), np.uint64)
    for j in range(n):
        a = ORDER - n + j
        h = h * _STEP + code[a : a + m]
    return mix(h)


class Models:
    """Kneser-Ney models of several languages over shared hash arrays."""

    def __init__(self, langs: list[str], samples: dict[str, list[str]]):
        self.langs = langs
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        per = [self._counts(samples[lang]) for lang in langs]
        size = 1 + len({c for p in per for c in p["symbols"]})
        uniform = np.full(len(langs), 1.0 / size)
        lower_keys, lower = np.empty(0, np.uint64), np.empty((0, len(langs)))
        lower_unseen = uniform
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([p[n]["key"] for p in per]))
            contexts = np.unique(np.concatenate([p[n]["context"] for p in per]))
            p_direct = np.zeros((len(keys), len(langs)))
            gamma = np.ones((len(contexts), len(langs)))
            for i, p in enumerate(per):
                own = p[n]
                at = np.searchsorted(contexts, own["ctx_keys"])
                gamma[at, i] = own["discount"] * own["ctx_types"] / own["ctx_total"]
                here = np.searchsorted(own["ctx_keys"], own["context"])
                p_direct[np.searchsorted(keys, own["key"]), i] = (own["count"] - own["discount"]) / own["ctx_total"][here]
            # context and shorter n-gram of each key, from the language that has it
            ctx, short = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for p in per:
                at = np.searchsorted(keys, p[n]["key"])
                ctx[at], short[at] = p[n]["context"], p[n]["short"]
            below = np.tile(lower_unseen, (len(keys), 1)) if n == 1 else lower[np.searchsorted(lower_keys, short)]
            prob = p_direct + gamma[np.searchsorted(contexts, ctx)] * below
            self.keys.append(keys)
            self.logp.append(np.log(prob).astype(np.float32))
            self.contexts.append(contexts)
            self.backoff.append(np.log(gamma).astype(np.float32))
            lower_keys, lower = keys, prob
        self.unseen = np.log(uniform).astype(np.float32)
        self.temperature, self.mean, self.between, self.within = 1.0, np.zeros(len(langs)), np.ones(len(langs)), np.ones(len(langs))
        self.reject_z = np.full(len(langs), np.inf)
        self.false_rejections = 0.0

    @staticmethod
    def _counts(texts: list[str]) -> dict:
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        sym, starts, _ = symbols(data, at)
        m = len(sym) - ORDER + 1
        valid = np.ones(max(m, 0), bool)  # windows that end on a row's own symbol
        for s in starts[:-1].tolist():
            valid[max(0, s - ORDER + 1) : s] = False
        hashes = {n: _grams(sym, n)[valid] for n in range(ORDER + 1)}
        shifted = {n: _grams(np.concatenate((np.zeros(1, np.uint32), sym)), n)[:-1][valid] for n in range(ORDER)}
        out: dict = {"symbols": set(np.unique(sym).tolist())}
        for n in range(1, ORDER + 1):
            if n == ORDER:
                key, first, count = np.unique(hashes[n], return_index=True, return_counts=True)
            else:  # continuation counts: distinct symbols before the n-gram
                _, longer = np.unique(hashes[n + 1], return_index=True)
                key, first, count = np.unique(hashes[n][longer], return_index=True, return_counts=True)
                first = longer[first]
            context = shifted[n - 1][first]
            ctx_keys, which, types = np.unique(context, return_inverse=True, return_counts=True)
            n1, n2 = int((count == 1).sum()), int((count == 2).sum())
            out[n] = {
                "key": key, "count": count, "context": context, "short": hashes[n - 1][first], "ctx_keys": ctx_keys, "ctx_types": types,
                "ctx_total": np.bincount(which, count).astype(float), "discount": min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5)),
            }
        return out

    def entropies(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per symbol, symbols, letters) of each row; nats per language."""
        sym, starts, letters = symbols(data, at)
        rows, k = len(at) - 1, len(self.langs)
        n = np.diff(starts) - (ORDER - 1)
        if len(sym) < ORDER:
            return np.zeros((rows, k)), np.zeros(rows, np.int64), letters
        log = self._log(sym)
        # windows that end on the breaks before a row belong to no row
        sums = np.zeros((rows, k))
        first = starts[:-1]
        some = np.flatnonzero(n > 0)
        if len(some):
            edges = np.empty(2 * len(some), np.int64)
            edges[0::2], edges[1::2] = first[some], first[some] + n[some]
            edges = np.minimum(edges, len(log))
            total = np.add.reduceat(np.concatenate((log, np.zeros((1, k), np.float32))), edges, axis=0, dtype=np.float64)[0::2]
            sums[some] = total
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def _log(self, sym: np.ndarray) -> np.ndarray:
        h = _grams(sym, ORDER)
        at = np.minimum(np.searchsorted(self.keys[-1], h), len(self.keys[-1]) - 1)
        miss = np.flatnonzero(self.keys[-1][at] != h)
        log = self.logp[-1][at]
        if len(miss):
            log[miss] = 0
            before = np.concatenate((np.zeros(1, np.uint32), sym))
            for n in range(ORDER, 0, -1):
                if n < ORDER:
                    h = _grams(sym, n)[miss]
                    at = np.minimum(np.searchsorted(self.keys[n - 1], h), len(self.keys[n - 1]) - 1)
                    hit = self.keys[n - 1][at] == h
                    log[miss[hit]] += self.logp[n - 1][at[hit]]
                    miss = miss[~hit]
                    if not len(miss):
                        break
                c = _grams(before, n - 1)[:-1][miss]
                at = np.minimum(np.searchsorted(self.contexts[n - 1], c), len(self.contexts[n - 1]) - 1)
                known = self.contexts[n - 1][at] == c
                log[miss[known]] += self.backoff[n - 1][at[known]]
            if len(miss):
                log[miss] += self.unseen
        return log

    def calibrate(self, texts: list[str], truth: list[int], reject_z: float) -> None:
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        nats, n, letters = self.entropies(data, at)
        right = np.array(truth)
        use = letters > 0
        nats, n, right = nats[use], n[use], right[use]
        if len(n):
            def loss(t):
                z = -nats * n[:, None] / t
                z -= z.max(axis=1, keepdims=True)
                return -(z[np.arange(len(n)), right] - np.log(np.exp(z).sum(axis=1))).mean()

            self.temperature = float(min((2.0**i for i in range(11)), key=loss))
        for i in range(len(self.langs)):
            own = right == i
            x, m = nats[own, i], n[own]
            if len(x) > 1:
                self.mean[i] = np.average(x, weights=m)
                self.within[i] = max(1.0, float(np.median((x - self.mean[i]) ** 2 * m)))
                self.between[i] = max(0.01, float(np.median((x[m > 500] - self.mean[i]) ** 2)) if (m > 500).any() else 0.01)
        best = nats.argmin(axis=1) if len(n) else np.empty(0, np.int64)
        z = self._z(nats, n, best)
        for i in range(len(self.langs)):
            own = z[(right == i) & (best == i)]
            self.reject_z[i] = max(reject_z, REJECT_MARGIN * float(np.quantile(own, 1 - FALSE_REJECTIONS))) if len(own) else reject_z
        self.false_rejections = float((z > self.reject_z[best]).mean()) if len(n) else 0.0

    def _z(self, nats, n, best):
        return (nats[np.arange(len(n)), best] - self.mean[best]) / np.sqrt(self.between[best] + self.within[best] / np.maximum(n, 1))

    def predict(self, data: np.ndarray, at: np.ndarray):
        """(best language or -1, score, rejected, nats) of each row."""
        nats, n, letters = self.entropies(data, at)
        best = nats.argmin(axis=1)
        rows = np.arange(len(n))
        z = -(nats - nats[rows, best][:, None]) * n[:, None] / self.temperature
        score = 1 / np.exp(z).sum(axis=1)
        rejected = (letters == 0) | (self._z(nats, n, best) > self.reject_z[best])
        none = letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), rejected, np.where(none, 0.0, nats[rows, best])


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = 400, sample_chars: int = 20_000, reject_z: float = 8.0) -> Models | None:
    """Models from the rows of docs that have a lang and are not held out. The
    sample is bounded by sample_rows * sample_chars characters a language: of a text
    that is longer than sample_chars its beginning is learned from."""
    labelled = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    labelled = labelled.withColumn("text", F.left("text", F.lit(sample_chars))).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    drawn = F.xxhash64("doc_id", F.lit("language sample"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return None
    # the least hashes: first about three times as many rows as asked for, then exactly
    share = F.lit(None).cast("double")
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (3.0 * sample_rows + 50) / count))).otherwise(share)
    near = labelled.withColumn("__d", drawn).where(F.col("__d") / float(2**63) < share * 2 - 1)
    rows = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("__d", "text"))), 1, sample_rows).alias("own")).collect()
    langs = sorted(r["lang"] for r in rows)
    train: dict[str, list[str]] = {}
    spare: list[tuple[str, int]] = []
    for r in sorted(rows, key=lambda r: r["lang"]):
        texts = [x["text"] for x in r["own"]]
        kept = [t for j, t in enumerate(texts) if j % 5 or len(texts) < 5]
        train[r["lang"]] = kept
        spare += [(t, langs.index(r["lang"])) for j, t in enumerate(texts) if len(texts) < 5 or j % 5 == 0]
    models = Models(langs, train)
    models.calibrate([t for t, _ in spare], [i for _, i in spare], reject_z)
    return models


_OUT = "lang_pred string, score double, rejected boolean, nats double"


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """docs with lang_pred, score, rejected and nats (per character). Columns of
    docs with one of these names give way."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "rejected", "nats")
    names = docs.columns
    held = spark.sparkContext.broadcast(models)

    def run(batches):
        model = held.value
        labels = np.array([*(model.langs if model else []), "und"], dtype=object)
        for batch in batches:
            best, score, rejected, nats = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool), np.zeros(batch.num_rows)
            if model:
                for a, z, data, at in chunks(batch.column("__text"), 1 << 20):
                    best[a:z], score[a:z], rejected[a:z], nats[a:z] = model.predict(data, at)
            own = batch.columns[: len(names)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(labels[best], pa.string()), pa.array(score), pa.array(rejected), pa.array(nats)], names=[*names, "lang_pred", "score", "rejected", "nats"])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(_OUT).fields])
    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(run, schema)


def known(docs: DataFrame, models: Models | None) -> DataFrame:
    """The rows of docs that the models do not reject, with docs' own columns."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        model = held.value
        for batch in batches:
            rejected = np.ones(batch.num_rows, bool)
            if model:
                for a, z, data, at in chunks(batch.column(batch.num_columns - 1), 1 << 20):
                    rejected[a:z] = model.predict(data, at)[2]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(~rejected))

    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(run, docs.schema)


def op9_query(spark, sf_dir: str) -> DataFrame:
    """Contract: doc_id, held_out, lang_pred, score (and rejected) of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "nats")
