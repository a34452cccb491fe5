"""Time alignment: interpolation of one series onto another, gap filling, union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import real


def _lines(series: DataFrame, keys: Sequence[str], time: str, variable: str) -> DataFrame:
    """(keys, time, line): each valid point with the slope to the next one, the
    last with that from the one before."""
    order = Window.partitionBy(*keys).orderBy(time)
    points = series.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("double").alias(time), real(variable).alias("v")).where("v IS NOT NULL")
    rise = lambda a, ta, b, tb: F.try_divide(b - a, tb - ta)
    on = rise(F.col("v"), F.col(time), F.lead("v").over(order), F.lead(time).over(order))
    back = rise(F.lag("v").over(order), F.lag(time).over(order), F.col("v"), F.col(time))
    slope = F.when(F.lead(time).over(order).isNull(), F.coalesce(back, F.lit(0.0))).otherwise(F.coalesce(on, F.lit(0.0)))
    first, last = F.lag(time).over(order).isNull(), F.lead(time).over(order).isNull()
    return points.select(*keys, time, F.struct(F.col(time).alias("t"), "v", slope.alias("slope"), first.alias("first"), last.alias("last")).alias("line"))


def interpolate(samples: DataFrame, series: DataFrame, variables: Sequence[str], keys: Sequence[str] = (), time: str = "t", extrapolate: bool = True, names: Sequence[str] | None = None) -> DataFrame:
    """samples with each variable of series at their times, by linear
    interpolation between the nearest valid points; beyond the ends by the line
    of the two last ones, or null. Missing values of series are skipped.

    Both sides go through one sort by time in each key; the bracket of a sample is
    the line of the last point before it, else of the first point after it.
    """
    names = names or variables
    own = samples.select("*", F.lit(None).cast("int").alias("__var"), F.lit(None).cast("struct<t:double,v:double,slope:double,first:boolean,last:boolean>").alias("__line"))
    both = own.withColumn("__t", F.col(time).cast("double"))
    for n, v in enumerate(variables):
        lines = _lines(series, keys, time, v).select(*keys, F.col(time).alias("__t"), F.lit(n).alias("__var"), F.col("line").alias("__line"))
        both = both.unionByName(lines, allowMissingColumns=True)
    part = Window.partitionBy(*keys)
    back = part.orderBy("__t", F.asc_nulls_last("__var")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = part.orderBy("__t", F.asc_nulls_last("__var")).rowsBetween(0, Window.unboundedFollowing)
    out = []
    for n, name in enumerate(names):
        mine = F.when(F.col("__var") == n, F.col("__line"))
        line = F.coalesce(F.last(mine, ignorenulls=True).over(back), F.first(mine, ignorenulls=True).over(ahead))
        out.append((name, line))
    found = both.select("*", *(line.alias(f"__at_{name}") for name, line in out)).where("__var IS NULL")
    for name in names:
        line, t = F.col(f"__at_{name}"), F.col("__t")
        inside = F.lit(True) if extrapolate else ~((t < line["t"]) | (line["last"] & (t > line["t"])))
        found = found.withColumn(name, F.when(inside, line["v"] + (t - line["t"]) * line["slope"]))
    return found.select(*samples.columns, *names)


def fill_gaps(series: DataFrame, variables: Sequence[str], keys: Sequence[str] = (), time: str = "t") -> DataFrame:
    """series without rows that have no time, missing values interpolated."""
    rest = [c for c in series.columns if c not in variables]
    timed = series.where(F.col(time).isNotNull())
    filled = interpolate(timed.select(*rest, *(F.col(v).alias(f"__own_{v}") for v in variables)), timed, variables, keys, time)
    return filled.select(*rest, *(F.coalesce(real(f"__own_{v}"), F.col(v)).alias(v) for v in variables)).select(series.columns)


def epoch_of(units: Column) -> Column:
    """Epoch seconds of 'seconds since <date>[.fraction]'; null for other texts."""
    stamp = F.regexp_extract(units, r"^\s*seconds since (\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1)
    return F.when(stamp != "", F.unix_micros(F.to_timestamp(F.concat(F.replace(stamp, F.lit("T"), F.lit(" ")), F.lit("+00:00")))) / 1e6)


def concatenate(tables: DataFrame, order: Sequence[str], epoch: str, time: str = "t", index: str = "i") -> DataFrame:
    """Samples of many files as one series: absolute times, and an index over
    (order, index). Offsets come from the counts of the files before, so no
    single task sorts all samples."""
    sizes = tables.groupBy(*order).agg(F.count("*").alias("__n"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*order, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))  # a row for each file
    inside = Window.partitionBy(*order).orderBy(index)
    return tables.withColumn("__r", F.row_number().over(inside) - 1).join(offsets, list(order)).withColumns({time: F.col(time) + F.col(epoch), index: F.col("__o") + F.col("__r")}).drop("__o", "__r")


def near(points: DataFrame, spans: DataFrame, variables: Sequence[str], keys: Sequence[str], time: str = "t", bucket: float = 3600.0) -> DataFrame:
    """(keys, time, variables): of one series the points that a key's span first to
    last needs for interpolation and for extrapolation: all in its buckets of time,
    and the two nearest valid ones before and after, of each variable on its own.

    The join is on buckets. What lies outside comes from a table with a row for
    each bucket that has points, so no task sorts the series itself.
    """
    valid = None
    for v in variables:
        own = points.where(F.col(time).isNotNull() & real(v).isNotNull()).select(F.lit(v).alias("__var"), F.col(time).cast("double").alias("t"), real(v).alias("v"))
        valid = own if valid is None else valid.unionAll(own)
    valid = valid.withColumn("__b", F.floor(F.col("t") / bucket).cast("long"))
    low, high = (F.floor(F.col(c) / bucket).cast("long") for c in ("first", "last"))
    asked = spans.select(*keys, low.alias("__low"), high.alias("__high"))
    inside = valid.join(asked.withColumn("__b", F.explode(F.sequence("__low", "__high"))), "__b").select(*keys, "__var", "t", "v")

    held = F.array_sort(F.collect_list(F.struct("t", "v")))
    ends = valid.groupBy("__var", "__b").agg(F.slice(held, 1, 2).alias("head"), F.slice(F.reverse(held), 1, 2).alias("tail"))
    order, kind = Window.partitionBy("__var").orderBy("__b"), "array<struct<t:double,v:double>>"
    two = lambda here, next_: F.slice(F.concat(here, F.coalesce(next_, F.array().cast(kind))), 1, 2)
    rows = ends.select("__var", "__b", two(F.col("tail"), F.lag("tail").over(order)).alias("before"), two(F.col("head"), F.lead("head").over(order)).alias("after"))
    names = F.explode(F.array(*(F.lit(v) for v in variables))).alias("__var")
    outside = None
    for edge, side in (("__low", "before"), ("__high", "after")):
        marks = asked.select(names, F.col(edge).alias("__b"), F.lit(None).cast(kind).alias(side), F.lit(True).alias("__mark")).distinct()
        mixed = rows.select("__var", "__b", side, F.lit(False).alias("__mark")).unionAll(marks)
        # a span's own bucket does not answer for it: its points are inside
        ordered = Window.partitionBy("__var").orderBy("__b", F.desc("__mark") if side == "before" else F.asc("__mark"))
        frame = ordered.rowsBetween(Window.unboundedPreceding, -1) if side == "before" else ordered.rowsBetween(1, Window.unboundedFollowing)
        take = F.last if side == "before" else F.first
        found = mixed.withColumn("__near", take(side, ignorenulls=True).over(frame)).where("__mark")
        found = found.select("__var", F.col("__b").alias(edge), F.explode("__near").alias("p")).join(asked, edge).select(*keys, "__var", "p.t", "p.v")
        outside = found if outside is None else outside.unionAll(found)
    every = inside.unionAll(outside)
    return every.select(*keys, F.col("t").alias(time), *(F.when(F.col("__var") == v, F.col("v")).alias(v) for v in variables))


def without_prefixed(stems: DataFrame, stem: str, names: DataFrame, name: str) -> DataFrame:
    """The rows of stems that no name begins with. The prefixes of the names make it
    an equi-join."""
    known = names.select(F.col(name).alias("__name")).where("__name IS NOT NULL").distinct()
    prefixes = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("__name")), lambda n: F.left("__name", n))).alias(stem)).distinct()
    return stems.join(prefixes, stem, "left_anti")
