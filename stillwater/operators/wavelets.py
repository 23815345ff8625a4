"""Wavelet denoising (L6): every series' grid, packed to one row, is taken through all bands in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import shuffle_partitions
from . import grid as G, kernels

#: Tasks per shuffle partition. Packed series unpack to a hundred times the shuffled bytes of a grid, so partitions
#: must not be merged by their size, which would leave all of a small table in one task.
SPREAD = 4


def denoise(grid: DataFrame, name="db4", level=None, threshold=None, deepest=5, value="y", out="curve") -> DataFrame:
    """Soft thresholding of all detail bands with ``threshold``, or the universal one from
    the exact median size of the finest band. Grids too short for a band stay as they are.
    NULL or non-finite values are not expected on a grid."""
    width = len(kernels.WAVELET_TAPS[name])

    def bands(y):
        if level is not None and 2 * y.size < width - 1:  # a grid shorter than half a filter stays as it is
            return y
        return kernels.wavelet_denoise(y, name, level, threshold, deepest)

    series = G.packed(grid, ["g", value], ["k_last"])
    return G.unpacked(series, lambda lines: [bands(y) for y in lines], value, out, SPREAD * shuffle_partitions(grid.sparkSession))
