"""Local-level Kalman smoothing with EM (L9): the recursions run over the slots of many packed series side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import grid as G, kernels

#: Series smoothed side by side; fewer where their grids are long (``kernels.CELLS``).
BLOCK = 256


def smooth(grid: DataFrame, n_iter: int = 10, value="y", out="curve") -> DataFrame:
    """Random walk plus noise. EM starts at unit variances and the first value and updates both
    variances and the initial state ``n_iter`` times; a last pass gives the smoothed means.
    NULL or non-finite values are not expected on a grid."""
    block = BLOCK
    series = G.packed(grid, ["g", value], ["k_last"])
    return G.unpacked(series, lambda lines: kernels.local_level_lines(lines, n_iter, block), value, out)
