"""Quality flags of dissipation windows and the combination of two probes.

Flags: 0 unknown, 1 good, 2 questionable, 4 bad, 9 missing; -1 stands for a value
that binning has to forget. NaN never counts as greater than a threshold.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import real


def degrees_of_freedom(n_fft: Column, n_diss: Column) -> Column:
    return 1.9 * (2 * F.floor(n_diss / n_fft) - 1)


def _over(x: Column, good: float, bad: float) -> Column:
    return F.when(x > bad, F.lit(4)).when(x > good, F.lit(2)).otherwise(F.lit(1))


def compose_flag(eps: Column, fm: Column | None, slow: Column, despiked: Column | None, fm_limits: tuple[float, float] = (1.5, 2.5), despike_limits: tuple[float, float] = (0.1, 0.2)) -> Column:
    """Worst of the speed, misfit and despiking flags; 9 where eps is missing."""
    parts = [F.when(F.coalesce(slow, F.lit(False)), F.lit(2)).otherwise(F.lit(1))]
    for x, limits in ((fm, fm_limits), (despiked, despike_limits)):
        if x is not None:
            parts.append(_over(real(x), *limits))
    worst = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return F.when(real(eps).isNull(), F.lit(9)).otherwise(worst).cast("tinyint")


def mask_low_quality(df: DataFrame, pairs: Mapping[str, str], questionable: float = 1e-7, bad: float = 1e-9) -> DataFrame:
    """df with eps missing and flag -1 where a doubtful estimate is too high to be
    kept: flag 2 over ``questionable``, flag 4 over ``bad``. pairs: eps -> flag."""
    out = df
    for eps, flag in pairs.items():
        drop = F.coalesce(((F.col(flag) == 2) & (real(eps) > questionable)) | ((F.col(flag) == 4) & (real(eps) > bad)), F.lit(False))
        out = out.withColumns({eps: F.when(~drop, real(eps)), flag: F.when(drop, F.lit(-1)).otherwise(F.col(flag))})
    return out


def restore_missing(flag: Column) -> Column:
    """Flags after binning: missing or -1 is 9."""
    return F.when(flag.isNull() | (flag < 0), F.lit(9)).otherwise(flag).cast("tinyint")


def combine_pair(eps1: Column, eps2: Column, qc1: Column, qc2: Column) -> tuple[Column, Column]:
    """(eps, flag) of two probes: their mean if within a factor of ten, else the
    lower one; the one that is there; the worse flag of both, or the survivor's."""
    a, b = real(eps1), real(eps2)
    both = a.isNotNull() & b.isNotNull()
    eps = F.when(both & (F.greatest(a, b) <= 10 * F.least(a, b)), (a + b) / 2).when(both, F.least(a, b)).otherwise(F.coalesce(a, b))
    flag = F.when(both, F.greatest(qc1, qc2)).when(a.isNotNull(), qc1).when(b.isNotNull(), qc2).otherwise(F.lit(9))
    return eps, flag.cast("tinyint")
