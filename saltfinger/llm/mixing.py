"""Mixing sources to target weights by iterative proportional fitting (operator 7).

Documents fall into cells (source, language, topic). Topics are word clusters fitted
to the corpus: every document's hashed word shares, whose means and covariances
Spark sums over all documents, are split by the sign of their leading principal
components. One aggregation gives the tokens of each cell; raking multiplies the cells by a factor for each source,
language and topic in turn until all three marginals are met. A cell's documents
are then kept with a probability in proportion to raked over present tokens, so
that the expected mixture is the raked one; whether a document is kept depends on
its doc_id and the seed alone.

The cell table has a row for each combination of values, not of documents. Up to
``LOCAL_CELLS`` cells it is raked in the driver; beyond that each sweep is a
Spark aggregation and join, with the same factors and the same end: the marginals
are met within 1e-9, or 200 sweeps are done. Target shares are Spark tables; only
the driver's path, whose cells bound them, collects them. Nulls in source or lang are a
value of their own. Texts that are null or have no word have no tokens and the topic
"none"; they get the probability of their cell, 0 if the whole cell is empty. Rows
that repeat a doc_id stay or go together unless their cells differ; so do rows
without doc_id, which have one draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .screen import cut
from .textkit import chunks, words

#: Cells that the driver rakes at most (about 100 bytes each).
LOCAL_CELLS = 200_000
DIMENSIONS = ("source", "lang", "topic")


#: Buckets of hashed words, and principal components that topics are split by.
BUCKETS, AXES = 64, 3


def _shares(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, words of each row, shares of their hashed words)."""
    for first, end, data, at in chunks(column):
        hashes, own = words(data, at)
        tokens = np.diff(own)
        place = np.repeat(np.arange(end - first), tokens) * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        counts = np.bincount(place, minlength=(end - first) * BUCKETS).reshape(-1, BUCKETS)
        yield first, end, tokens, counts / np.maximum(tokens, 1)[:, None]


class Topics:
    """Word clusters: the signs of the components of a text's hashed word shares."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    def of(self, tokens: np.ndarray, shares: np.ndarray) -> np.ndarray:
        signs = (shares - self.mean) @ self.axes > 0
        return np.where(tokens > 0, signs @ (1 << np.arange(self.axes.shape[1])), -1)


def fit_topics(docs: DataFrame, axes: int = AXES) -> Topics:
    """Topics from the word shares of all rows of docs that have words. A task sums
    its rows; only these sums are shuffled, by their place in the matrix."""
    size = BUCKETS + 1
    upper = np.triu_indices(size)

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for _, _, tokens, shares in _shares(batch.column(0)):
                own = np.concatenate([np.ones((len(tokens), 1)), shares], axis=1)[tokens > 0]
                total += own.T @ own
        if total[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], names=["at", "value"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((size, size))
    at = sums["at"].to_numpy()
    total[upper[0][at], upper[1][at]] = sums["value"].to_numpy()
    total = np.maximum(total, total.T)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    spread = total[1:, 1:] / n - np.outer(mean, mean)
    # sums come in any order: what is below the rounding of the input is dropped
    _, vectors = np.linalg.eigh(np.round(spread, 9))
    lead = vectors[:, ::-1][:, :axes]
    lead = lead * np.where(lead[np.abs(lead).argmax(axis=0), np.arange(lead.shape[1])] < 0, -1.0, 1.0)
    return Topics(np.round(mean, 9), np.round(lead, 6))


def with_cells(docs: DataFrame, topics: Topics, columns: list[str] | None = None) -> DataFrame:
    """docs (or these columns of it) with __source, __lang, __topic and __tokens."""
    names = docs.columns if columns is None else columns
    keyed = docs.withColumns({"__source": F.col("source").cast("string"), "__lang": F.col("lang").cast("string"), "__text": F.col("text").cast("string")})
    # a text among the columns goes to Python once
    once = "text" in names and docs.schema["text"].dataType == StringType()
    keyed = keyed.select(*(n for n in names if not (once and n == "text")), "__source", "__lang", "__text")
    held = docs.sparkSession.sparkContext.broadcast(topics)

    def run(batches):
        for batch in batches:
            tokens, topic = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, -1)
            for first, end, own, shares in _shares(batch.column(batch.num_columns - 1)):
                tokens[first:end], topic[first:end] = own, held.value.of(own, shares)
            topics_of = pa.array(["none", *(f"t{i}" for i in range(1 << held.value.axes.shape[1]))]).take(pa.array(topic + 1))
            kept = batch if once else batch.select(batch.schema.names[:-1])
            yield pa.RecordBatch.from_arrays([*kept.columns, topics_of, pa.array(tokens)], names=[*kept.schema.names, "__topic", "__tokens"])

    made = (keyed if once else keyed.drop("__text")).schema
    out = keyed.mapInArrow(run, StructType([*made, StructField("__topic", StringType()), StructField("__tokens", LongType())]))
    return out.select(*(F.col("__text").alias(n) if once and n == "text" else n for n in names), "__source", "__lang", "__topic", "__tokens")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(__v, __share): target shares of a dimension, its present shares to a power."""
    there = F.col("__t") > 0
    own = cells.groupBy(F.col(dimension).alias("__v")).agg(F.sum("tokens").alias("__t"))
    own = cut(own.select("__v", F.when(there, F.pow(F.col("__t").cast("double"), F.lit(float(power)))).otherwise(0.0).alias("__w")))
    total = own.agg(F.sum("__w")).first()[0]
    return own.select("__v", (F.col("__w") / F.lit(float(total or 1))).alias("__share"))


def rake(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], sweeps: int = 200, within: float = 1e-9) -> np.ndarray:
    """Cell weights with the target marginals, by iterative proportional fitting.
    Targets of values without tokens are spread over the others."""
    weight = tokens.astype(float)
    if not weight.sum():
        return weight
    weight = weight / weight.sum()
    goals = []
    for code, target in zip(codes, targets, strict=True):
        goal = np.where(np.bincount(code, tokens, len(target)) > 0, target, 0)
        goals.append(goal / goal.sum() if goal.sum() else np.bincount(code, weight, len(target)))
    for _ in range(sweeps):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, weight, len(goal))
            factor = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
            off = max(off, np.abs(now - goal).max())
            weight = weight * factor[code]
        if off < within:
            break
    return weight


def _rake_in_spark(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, within: float = 1e-9) -> DataFrame:
    """The same sweeps as joins, for cell tables beyond the driver's bound."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    goals = {}
    for d in DIMENSIONS:  # targets of values with tokens, made to sum to 1
        there = cells.groupBy(d).agg(F.sum("tokens").alias("__t")).where("__t > 0")
        goal = cut(targets[d].join(there, F.col(d).eqNullSafe(F.col("__v")), "left_semi"))
        share = goal.agg(F.sum("__share")).first()[0]
        goals[d] = goal.select("__v", (F.col("__share") / F.lit(share)).alias("__share")) if share else None
        if not share and total:  # nothing asked for: the dimension keeps its shares
            goals[d] = there.select(F.col(d).alias("__v"), (F.col("__t") / F.lit(float(total))).alias("__share"))
        goals[d] = cut(goals[d]) if goals[d] is not None else None
    for _ in range(sweeps if total else 0):
        off = 0.0
        for d, goal in goals.items():
            marginal = now.groupBy(d).agg(F.sum("weight").alias("__m"))
            both = marginal.join(goal, F.col(d).eqNullSafe(F.col("__v")), "left").withColumn("__g", F.coalesce("__share", F.lit(0.0)))
            factor = cut(both.select(F.col(d).alias("__v"), F.when(F.col("__m") > 0, F.col("__g") / F.col("__m")).otherwise(0.0).alias("__f"), F.abs(F.col("__m") - F.col("__g")).alias("__off")))
            off = max(off, factor.agg(F.max("__off")).first()[0])
            now = cut(now.join(factor.drop("__off"), F.col(d).eqNullSafe(F.col("__v"))).withColumn("weight", F.col("weight") * F.col("__f")).drop("__v", "__f"))
        if off < within:
            break
    return now


def scale_for(ratio: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The c for which sum(min(1, c * ratio) * tokens) is budget * sum(tokens)."""
    order = np.argsort(-ratio, kind="stable")
    r, t = ratio[order], tokens[order].astype(float)
    whole = np.concatenate(([0.0], np.cumsum(t)))  # tokens of the cells kept whole
    rest = np.append(np.cumsum((r * t)[::-1])[::-1], 0.0)
    for i in range(len(r)):
        if r[i] <= 0:
            break
        c = (budget * whole[-1] - whole[i]) / rest[i]
        if c * r[i] <= 1:
            return max(c, 0.0)
    return float("inf") if len(r) else 0.0


def probabilities(docs: DataFrame, targets: dict[str, dict] | None = None, power: float = 0.5, budget: float = 0.5, sweeps: int = 200, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """(source, lang, topic, tokens, weight, p) of each cell. targets gives shares
    by value for source, lang and topic; a dimension that it leaves out gets its
    present shares to ``power``. p is in proportion to raked over present tokens,
    such that ``budget`` of all tokens is expected to be kept; cells that cannot
    give more than they have are kept whole. Beyond ``local_cells`` cells the
    factor is found by a few Spark sums."""
    spark = docs.sparkSession
    cells = docs.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("tokens"))
    cells = cut(cells)
    asked = lambda d: spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], "__v string, __share double")
    shares = {d: asked(d) if (targets or {}).get(d) else tempered(cells, d, power) for d in DIMENSIONS}
    schema = "source string, lang string, topic string, tokens long, weight double, p double"
    if cells.count() > local_cells:
        raked = cut(_rake_in_spark(cells, shares, sweeps).withColumn("__r", F.try_divide("weight", "tokens")))
        # cells that cannot give more than they have are kept whole; each round
        # gives the others what is left of the budget, until no cell is added
        c, whole = 0.0, -1
        while True:
            full = F.coalesce("__r", F.lit(0.0)) * F.lit(c) >= 1
            r = raked.agg(F.sum("tokens"), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)), F.count_if(full)).first()
            if r[3] == whole or not r[2]:
                break
            c, whole = max((budget * r[0] - r[1]) / r[2], c), r[3]
        return raked.select("source", "lang", "topic", "tokens", "weight", F.least(F.lit(1.0), F.coalesce("__r", F.lit(0.0)) * F.lit(c)).alias("p"))
    rows = cells.toArrow()
    tokens = np.array(rows["tokens"].to_pylist(), np.int64)
    codes, goals = [], []
    for d in DIMENSIONS:
        own = rows[d].to_pylist()
        values = list(dict.fromkeys(own))
        at = {v: i for i, v in enumerate(values)}
        codes.append(np.array([at[v] for v in own], np.int64))
        # asked values that no cell has do not matter: at most one row for each cell comes
        there = cells.select(F.col(d).alias("__c")).distinct()
        share = shares[d].join(there, F.col("__v").eqNullSafe(F.col("__c")), "left_semi").toArrow()
        share = dict(zip(share["__v"].to_pylist(), share["__share"].to_pylist(), strict=True))
        goals.append(np.array([share.get(v, 0.0) for v in values]))
    weight = rake(codes, tokens, goals, sweeps)
    ratio = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    c = scale_for(ratio, tokens, budget)
    p = np.minimum(1.0, np.where(ratio > 0, ratio * min(c, 1e300), 0.0))
    out = [(*(rows[d][i].as_py() for d in DIMENSIONS), int(tokens[i]), float(weight[i]), float(p[i])) for i in range(len(tokens))]
    return F.broadcast(spark.createDataFrame(out, schema))


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, power: float = 0.5, budget: float = 0.5, seed: int = 0, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """The kept rows of docs, with topic, tokens and p; columns of docs with one
    of these names give way."""
    docs = docs.drop("topic", "tokens", "p")
    names = docs.columns
    topics = fit_topics(docs)
    p = probabilities(with_cells(docs, topics, []), targets, power, budget, local_cells=local_cells)
    p = p.select(*(F.col(d).alias(f"__c_{d}") for d in DIMENSIONS), "p")
    match = [F.col(f"__{d}").eqNullSafe(F.col(f"__c_{d}")) for d in DIMENSIONS]
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1) / float(2**63)
    kept = with_cells(docs, topics).join(p, match[0] & match[1] & match[2]).where(drawn < F.col("p"))
    return kept.select(*names, F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), "p")


def op7_query(spark, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered source, language and topic marginals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sample(docs).select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 9).alias("p"))
