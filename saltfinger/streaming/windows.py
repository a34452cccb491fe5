"""Structured Streaming forms of the window operators, beyond the batch jobs.

Samples arrive with an event time. Blocks are tumbling windows, dissipation
windows are sliding ones, and stretches without a gap are session windows; late
samples count up to the watermark. Windows align to the epoch, not to a profile's
first sample, so results differ from the batch operators at a profile's ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels
from ..operators.windows import real


def block_means(samples: DataFrame, keys: Sequence[str], values: Sequence[str], seconds: float, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Means of tumbling windows."""
    own = samples.withWatermark(time, late).groupBy(*keys, F.window(time, f"{int(seconds * 1e6)} microseconds"))
    return own.agg(F.count("*").alias("n"), *(F.avg(real(v)).alias(v) for v in values)).select(*keys, F.col("window.start").alias("start"), "n", *values)


def sliding_means(samples: DataFrame, keys: Sequence[str], values: Sequence[str], seconds: float, step: float, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Means of overlapping windows, ``step`` seconds apart."""
    span = F.window(time, f"{int(seconds * 1e6)} microseconds", f"{int(step * 1e6)} microseconds")
    return samples.withWatermark(time, late).groupBy(*keys, span).agg(F.count("*").alias("n"), *(F.avg(real(v)).alias(v) for v in values)).select(*keys, F.col("window.start").alias("start"), "n", *values)


def stretches(samples: DataFrame, keys: Sequence[str], pressure: str, gap: str = "5 seconds", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Stretches without a gap in time: bounds, samples, pressure range."""
    own = samples.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap))
    return own.agg(F.count("*").alias("n"), F.min(real(pressure)).alias("shallowest"), F.max(real(pressure)).alias("deepest")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "shallowest", "deepest")


def low_pass(samples: DataFrame, key: str, value: str, fs: float, cutoff: float, time: str = "ts") -> DataFrame:
    """Causal first-order low pass whose filter state is kept between batches.
    Samples of a batch are taken in time order; a sample older than an earlier
    batch's last is filtered after it."""
    sos = kernels.butter1("low", cutoff, fs)
    kind = dict(samples.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(frames)).sort_values(time)
        past = np.array(state.get).reshape(1, 2) if state.exists else np.zeros((1, 2))
        y, past = kernels.sosfilt(sos, own[value].to_numpy(float), past)
        state.update((float(past[0, 0]), float(past[0, 1])))
        yield pd.DataFrame({key: k[0], time: own[time].to_numpy(), value: own[value].to_numpy(), "filtered": y})

    return samples.select(key, time, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {time} timestamp, {value} double, filtered double", "z0 double, z1 double", "append", GroupStateTimeout.NoTimeout)
