"""Arrow UDFs over window columns (``ARRAY<DOUBLE>``), and their SQL registration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrid.functions import kernels


def _struct(names) -> T.StructType:
    return T.StructType([T.StructField(name, T.DoubleType()) for name in names])


def _apply(column: pa.Array, width: int, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Run ``kernel`` on the windows of a batch, those of one length together; null gives NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    out = np.full((len(column), width), np.nan)
    for length in np.unique(lengths):
        if length == 0:
            continue
        rows = np.flatnonzero(lengths == length)
        out[rows] = kernel(flat[starts[rows][:, None] + np.arange(length)])
    return out


def _struct_udf(names, kernel) -> Callable[[Column], Column]:
    @F.arrow_udf(_struct(names))
    def run(column: pa.Array) -> pa.Array:
        values = _apply(column, len(names), kernel)
        return pa.StructArray.from_arrays(
            [pa.array(np.ascontiguousarray(values[:, n])) for n in range(len(names))], names=list(names)
        )
    return run


def freq_udf(fs: float, fft_size: int | None = 1024):
    return _struct_udf(kernels.FREQ_NAMES, lambda x: kernels.freq_features(x, fs, fft_size))


def describe_udf(fs: float, fft_size: int | None = 1024):
    """All 21 features of one channel window in one pass."""
    names = (
        *[f"time_{name}" for name in kernels.TIME_NAMES],
        *[f"freq_{name}" for name in kernels.FREQ_NAMES],
        *[f"wpd_{name}" for name in kernels.WPD_NAMES],
    )
    return _struct_udf(names, lambda x: np.hstack([
        kernels.time_features(x), kernels.freq_features(x, fs, fft_size), kernels.packet_energies(x),
    ]))


def packet_udf():
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(column: pa.Array) -> pa.Array:
        values = _apply(column, 8, kernels.packet_energies)
        return pa.ListArray.from_arrays(np.arange(0, 8 * len(values) + 1, 8, dtype=np.int32), values.ravel())
    return run


def dwt_udf():
    return _struct_udf(("node0", "node1"), kernels.dwt_energies)


def periodogram_udf(fs: float, low_hz: float = 2.5):
    return _struct_udf(("energy", "low"), lambda x: kernels.periodogram_sums(x, fs, low_hz))


def serving_udf(fs: float):
    """The serving features of one channel window in one pass."""
    return _struct_udf(kernels.SERVING_NAMES, lambda x: kernels.serving_features(x, fs))


def spectrogram_udf(n_fft: int, overlap: float):
    """Takes the channel windows as arguments; gives decibels as frequency-major nested arrays.

    Windows of one length are transformed together, whatever else their Arrow batch holds. A row with a null or
    empty channel, or with channels of different lengths, has no spectrogram (null).
    """
    @F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def run(*columns: pa.Array) -> pa.Array:
        count = len(columns[0])
        lengths = np.stack([c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in columns])
        size = np.where((lengths == lengths[0]).all(axis=0), lengths[0], 0)
        bins, frames = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
        blocks = []
        for length in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == length)
            at = pa.array(rows)
            batch = np.stack([c.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) for c in columns], axis=1)
            db = kernels.spectrogram_db(batch, n_fft, overlap)
            bins[rows], frames[rows] = db.shape[1:]
            blocks.append((rows, db.reshape(len(rows), -1)))
        starts = np.concatenate([[0], np.cumsum(bins * frames)])
        flat = np.empty(starts[-1])
        for rows, db in blocks:
            flat[starts[rows][:, None] + np.arange(db.shape[1])] = db
        inner = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.repeat(frames, bins))]).astype(np.int32)), pa.array(flat))
        outer = pa.array(np.concatenate([[0], np.cumsum(bins)]).astype(np.int32))
        return pa.ListArray.from_arrays(outer, inner, mask=pa.array(size == 0))
    return run


def register(spark: SparkSession, fs: float = 10.0, fft_size: int = 1024, n_fft: int = 256, overlap: float = 0.75) -> None:
    """Make the window functions callable from SQL."""
    spark.udf.register("window_freq_features", freq_udf(fs, fft_size))
    spark.udf.register("window_features", describe_udf(fs, fft_size))
    spark.udf.register("window_packet_energies", packet_udf())
    spark.udf.register("window_dwt_energies", dwt_udf())
    spark.udf.register("window_periodogram", periodogram_udf(fs))
    spark.udf.register("window_spectrogram_db", spectrogram_udf(n_fft, overlap))
