"""Resampling, filtering and windowing of recordings of any length."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.functions import kernels
from tremorgrid.operators.ordered import dense_index, null_safe_join, spread, with_halo
from tremorgrid.operators.quality import seconds_between, unpivot_channels
from tremorgrid.session import cut

PIECE_ROWS = 1 << 16
SPLINE_HALO = 64
#: Rows shared by neighbouring pieces of wide recordings: enough for ``SPLINE_HALO`` samples of a channel with holes.
WIDE_HALO = 256
WINDOW_PIECE_ROWS = 4096


def dedupe_samples(long: DataFrame) -> DataFrame:
    """One finite value per (file, channel, ts): the first in sample order."""
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")) & F.col("ts").isNotNull()
    return (
        long.where(finite).groupBy("file", "channel", "ts")
        .agg(F.min_by("x", "i").alias("x"), F.min("i").alias("i"))
    )


def _extent(valid: DataFrame, start: DataFrame) -> DataFrame:
    """Per channel: the last time in seconds, failing where there are fewer than 4 distinct times."""
    enough = F.count(F.lit(1)) >= 4
    message = F.concat(F.lit("not enough samples to interpolate in "), F.coalesce(F.col("file").cast("string"), F.lit("null")))
    ends = valid.groupBy("file", "channel").agg(F.max("ts").alias("_end"), enough.alias("_enough"))
    return cut(
        null_safe_join(ends, start, ["file"])
        .select("file", "channel", "_start",
                F.when(F.col("_enough"), seconds_between(F.col("_end"), F.col("_start")))
                .otherwise(F.raise_error(message).cast("double")).alias("_seconds"))
    )


def recording_start(long: DataFrame) -> DataFrame:
    """The time of the first row of each recording."""
    return cut(long.groupBy("file").agg(F.min_by("ts", "i").alias("_start")))


def grid_size(seconds, fs: float):
    """Number of grid points before the end; a guard keeps an end that falls on a point out."""
    return F.greatest(F.ceil(seconds * F.lit(float(fs)) - F.lit(1e-9)), F.lit(0)).cast("bigint")


def resample_grid(long: DataFrame, fs: float) -> DataFrame:
    """The output times of each (file, channel): ``k`` and ``seconds`` = k / fs."""
    extent = _extent(dedupe_samples(long), recording_start(long))
    sized = extent.withColumn("_n", grid_size(F.col("_seconds"), fs)).where("_n > 0")
    # A long recording is expanded from blocks, so that no single row becomes its whole grid.
    blocks = sized.select(
        "file", "channel", "_n", F.explode(F.expr(f"sequence(0, (_n - 1) div {PIECE_ROWS})")).alias("_block")
    ).repartition("file", "channel", "_block")
    spread = F.expr(
        f"sequence(_block * {PIECE_ROWS}, least((_block + 1) * {PIECE_ROWS}, _n) - 1)"
    )
    return blocks.select("file", "channel", F.explode(spread).alias("k")).withColumn(
        "seconds", F.col("k") / F.lit(float(fs))
    )


def resample_cubic(long: DataFrame, fs: float, rows: int = PIECE_ROWS) -> DataFrame:
    """Not-a-knot cubic spline of every channel on an even grid: ``file, channel, k, ts, x``.

    Pieces of ``rows`` samples are solved with 64 neighbours on either side. The influence of a
    sample on the spline at least halves with every sample in between, so pieces agree with one
    solve of the whole recording to double precision.
    """
    start = recording_start(long)
    keys = ["file", "channel"]
    valid = cut(dedupe_samples(long).select(*keys, "ts", "x"))
    extent = _extent(valid, start)
    numbered = dense_index(valid, keys, ["ts"], "_n")
    timed = null_safe_join(numbered, extent, keys).withColumn("_t", seconds_between(F.col("ts"), F.col("_start")))
    pieces = with_halo(timed, "_n", before=SPLINE_HALO, after=SPLINE_HALO, rows=rows)
    pieces = pieces.withColumn("_size", grid_size(F.col("_seconds"), fs))
    types = {field.name: field.dataType.simpleString() for field in long.schema.fields}

    def interpolate(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        t, y, core = pdf["_t"].to_numpy(), pdf["x"].to_numpy(), pdf["_core"].to_numpy()
        if not core.any():
            return pd.DataFrame()
        inside = np.flatnonzero(core)
        size, final = int(pdf["_size"].iloc[0]), inside[-1] + 1 == len(t)
        # A piece owns the grid points from its first sample to the next piece's first sample.
        begin = 0 if key[2] == 0 else _grid_from(t[inside[0]], fs)
        end = size if final else min(size, _grid_from(t[inside[-1] + 1], fs))
        if end <= begin:
            return pd.DataFrame()
        k = np.arange(begin, end)
        out = pd.DataFrame({"k": k, "x": kernels.cubic_spline(t, y, k / fs)})
        out.insert(0, "channel", key[1])
        out.insert(0, "file", key[0])
        return out

    spline = spread(pieces, "file", "channel", "_chunk").groupBy("file", "channel", "_chunk").applyInPandas(
        interpolate, f"file {types['file']}, channel string, k bigint, x double"
    )
    micros = F.unix_micros("_start") + F.round(F.col("k") * F.lit(1e6 / fs)).cast("bigint")
    return null_safe_join(spline, start, ["file"]).select("file", "channel", "k", F.timestamp_micros(micros).alias("ts"), "x")


def _grid_from(seconds: float, fs: float) -> int:
    """The first grid point at or after ``seconds``."""
    k = math.ceil(seconds * fs - 1)
    while k / fs < seconds:
        k += 1
    return k


def resample_recordings(long: DataFrame, fs: float, channels: list[str]) -> DataFrame:
    """``resample_cubic`` in wide form: ``file, i, ts`` and one column per channel."""
    return resample_cubic(long, fs).groupBy("file", F.col("k").alias("i")).agg(
        F.min("ts").alias("ts"),
        *[F.max(F.when(F.col("channel") == channel, F.col("x"))).alias(channel) for channel in channels],
    )


def resample_wide(
    recordings: DataFrame, fs: float, channels: list[str], rows: int = PIECE_ROWS, halo: int = WIDE_HALO
) -> DataFrame:
    """What ``resample_recordings`` gives of the unpivoted channels, at the grid points that all channels reach.

    Rows stay wide: the times of a recording are numbered once, and a piece is solved for every channel with the
    samples that this channel has in it. A recording in which some piece border lacks ``SPLINE_HALO`` samples of a
    channel within ``halo`` rows (long runs without values) goes channel by channel instead.
    """
    rows, names = max(rows, halo), [f"_c{n}" for n in range(len(channels))]

    def usable(name: str):
        x = F.col(f"`{name}`").cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    start = recording_start(recordings)
    samples = recordings.select("file", "i", "ts", *[usable(c).alias(n) for c, n in zip(channels, names)])
    known = samples.where(F.col("ts").isNotNull() & F.coalesce(*names).isNotNull())
    timed = known.groupBy("file", "ts").agg(*[
        F.min_by(n, F.when(F.col(n).isNotNull(), F.col("i"))).alias(n) for n in names])
    numbered = dense_index(timed, ["file"], ["ts"], "_n")
    files = cut(_wide_extent(numbered, start, names, rows, halo))
    whole = files.where("_whole and not _thin").select(
        "file", "_start", grid_size(F.col("_seconds"), fs).alias("_size"))
    ready = null_safe_join(numbered, whole, ["file"]).select(
        "file", "_n", "_size", seconds_between(F.col("ts"), F.col("_start")).alias("_t"), *names)
    pieces = with_halo(ready, "_n", before=halo, after=halo, rows=rows)
    kind = recordings.schema["file"].dataType.simpleString()

    def interpolate(key: tuple[pa.Scalar, ...], piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("_n")
        t, inside = piece["_t"].to_numpy(), np.flatnonzero(piece["_core"].to_numpy())
        size, begin, end = piece["_size"][0].as_py(), 0, 0
        if len(inside) and size:
            # A piece owns the grid points from its first time to the next piece's first time.
            begin = 0 if key[1].as_py() == 0 else _grid_from(t[inside[0]], fs)
            end = size if inside[-1] + 1 == len(t) else min(size, _grid_from(t[inside[-1] + 1], fs))
        k = np.arange(begin, max(begin, end))
        out = {"file": pa.repeat(key[0], len(k)), "i": pa.array(k, pa.int64())}
        for name in names:
            y = piece[name].to_numpy()
            there = ~np.isnan(y)
            out[name] = pa.array(kernels.cubic_spline(t[there], y[there], k / fs) if len(k) else [], pa.float64())
        return pa.table(out)

    spline = spread(pieces, "file", "_chunk").groupBy("file", "_chunk").applyInArrow(
        interpolate, f"file {kind}, i bigint, " + ", ".join(f"{n} double" for n in names))
    micros = F.unix_micros("_start") + F.round(F.col("i") * F.lit(1e6 / fs)).cast("bigint")
    even = null_safe_join(spline, whole.drop("_size"), ["file"]).select(
        "file", "i", F.timestamp_micros(micros).alias("ts"), *[F.col(n).alias(c) for c, n in zip(channels, names)])
    thin = files.where("_thin")
    if not thin.isEmpty():
        apart = null_safe_join(recordings, thin.select("file"), ["file"], "left_semi")
        even = even.unionByName(resample_recordings(unpivot_channels(apart, list(channels)), fs, list(channels)))
    return even.na.drop("any", subset=list(channels))


def _wide_extent(numbered: DataFrame, start: DataFrame, names: list[str], rows: int, halo: int) -> DataFrame:
    """Per recording: start, the least last time of a channel in seconds, whether every channel has samples
    (``_whole``) and whether a border of pieces lacks samples (``_thin``). Fewer than 4 times of a channel are an error."""
    at = F.col("_n") % rows
    parts = numbered.groupBy("file", F.expr(f"_n div {rows}").alias("_chunk")).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(n).alias(f"{n}_n") for n in names],
        *[F.max(F.when(F.col(n).isNotNull(), F.col("ts"))).alias(f"{n}_end") for n in names],
        F.least(*[F.count_if(F.col(n).isNotNull() & (at < halo)) for n in names], F.lit(SPLINE_HALO)).alias("_head"),
        F.least(*[F.count_if(F.col(n).isNotNull() & (at >= rows - halo)) for n in names], F.lit(SPLINE_HALO)).alias("_tail"))
    thin = ((F.col("_chunk") > 0) & (F.col("_rows") >= halo) & (F.col("_head") < SPLINE_HALO)) | (
        (F.col("_rows") == rows) & (F.col("_tail") < SPLINE_HALO))
    found = parts.groupBy("file").agg(
        F.max(thin).alias("_thin"),
        *[F.sum(f"{n}_n").alias(f"{n}_n") for n in names], *[F.max(f"{n}_end").alias(f"{n}_end") for n in names])
    message = F.concat(F.lit("not enough samples to interpolate in "), F.coalesce(F.col("file").cast("string"), F.lit("null")))
    few = F.least(*[F.when(F.col(f"{n}_n") > 0, F.col(f"{n}_n")) for n in names], F.lit(4)) < 4
    seconds = F.least(*[seconds_between(F.col(f"{n}_end"), F.col("_start")) for n in names], F.lit(float("inf")))
    return null_safe_join(found, start, ["file"]).select(
        "file", "_start", "_thin", (F.least(*[F.col(f"{n}_n") for n in names], F.lit(1)) > 0).alias("_whole"),
        F.when(few, F.raise_error(message).cast("double")).otherwise(
            F.when(F.col("_start").isNotNull(), seconds)).alias("_seconds"))


def bandpass_filter(
    df: DataFrame,
    fs: float,
    channels: list[str],
    method: str = "bandpass",
    cutoff_hz=None,
    order: int = 4,
    rows: int = PIECE_ROWS,
) -> DataFrame:
    """Zero-phase Butterworth band-pass of the channel columns; other columns stay as they are.

    The filter's memory fades below 1e-12 within ``memory`` samples, so pieces with that many
    neighbours give what filtering the whole recording gives.
    """
    if method.lower() != "bandpass" or not cutoff_hz:
        return df
    b, a, poles = kernels.butter_bandpass(fs, cutoff_hz, order)
    memory = int(math.ceil(math.log(1e-12) / math.log(float(np.abs(poles).max()))))
    response = kernels.impulse_response(b, a, memory)
    pad = 3 * max(len(a), len(b))
    halo = max(memory, pad + 1)

    columns = df.columns

    def run(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("i")
        core = np.flatnonzero(piece["_core"].to_numpy())
        out = piece.select(columns).take(pa.array(core))
        if not len(core):  # copies alone, past the end of the recording
            return out
        x = np.column_stack([piece[c].to_numpy().astype(float) for c in channels])
        x = kernels.zero_phase(x, response, pad)[core]
        for n, channel in enumerate(channels):
            at = columns.index(channel)
            kind = out.schema.field(at).type
            out = out.set_column(at, channel, pa.array(x[:, n], pa.float64(), from_pandas=True).cast(kind))
        return out

    pieces = with_halo(df, "i", before=halo, after=halo, rows=max(rows, 4 * halo))
    return spread(pieces, "file", "_chunk").groupBy("file", "_chunk").applyInArrow(run, df.schema)


def hop_of(size: int, overlap: float) -> int:
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    return max(1, int(size * (1 - overlap)))


def window_signal(
    df: DataFrame, columns: list[str], size: int, overlap: float = 0.5, keys: list[str] | None = None
) -> DataFrame:
    """Full windows of ``size`` samples: keys, ``window_index``, ``window_offset``, one array per column.

    Rows travel once, in pieces that hold every window starting in them; windows are sliced out of
    the piece in the JVM. A piece is bounded, however long the recording.
    """
    keys = keys or ["file"]
    step = hop_of(size, overlap)
    rows = step * math.ceil(max(WINDOW_PIECE_ROWS, size) / step)
    pieces = with_halo(df.select(*keys, "i", *columns), "i", after=size - step, rows=rows)
    packed = pieces.groupBy(*keys, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("i", *columns))).alias("_s")
    )
    count = f"least((size(_s) - {size}) div {step} + 1, {rows // step})"
    sliced = ", ".join(
        f"'{column}', slice(_s.`{column}`, j * {step} + 1, {size})" for column in columns
    )
    windows = packed.where(f"size(_s) >= {size}").select(*keys, F.explode(F.expr(
        f"transform(sequence(0, {count} - 1), j -> named_struct("
        f"'window_index', _chunk * {rows // step} + j, {sliced}))"
    )).alias("_w"))
    return windows.select(
        *keys, "_w.window_index", (F.col("_w.window_index") * step).alias("window_offset"),
        *[F.col(f"_w.`{column}`").alias(column) for column in columns],
    )


def window_standardize(df: DataFrame, columns: list[str], method: str = "per_window_standardization") -> DataFrame:
    """Mean-subtract, or z-score, each window array."""
    for column in columns:
        name = f"`{column}`"
        mean = f"aggregate({name}, 0D, (s, v) -> s + v) / size({name})"
        df = df.withColumn("_mean", F.expr(mean))
        if method == "mean_subtraction":
            df = df.withColumn(column, F.expr(f"transform({name}, v -> v - _mean)")).drop("_mean")
            continue
        spread = f"sqrt(aggregate({name}, 0D, (s, v) -> s + (v - _mean) * (v - _mean)) / size({name}))"
        df = df.withColumn("_std", F.expr(spread)).withColumn(
            column, F.expr(f"transform({name}, v -> if(_std > 0, (v - _mean) / _std, 0D))")
        ).drop("_mean", "_std")
    return df


def stft_spectrogram(df: DataFrame, channels: list[str], n_fft: int, overlap: float, name: str = "spectrogram") -> DataFrame:
    from tremorgrid.functions.vectorized import spectrogram_udf

    return df.withColumn(name, spectrogram_udf(n_fft, overlap)(*[F.col(f"`{c}`") for c in channels]))


def spectrogram_cells(df: DataFrame, keys: list[str], name: str = "spectrogram") -> DataFrame:
    """Long form of spectrograms: one row per (frequency bin, time bin)."""
    bins = df.select(*keys, F.posexplode(name).alias("freq_bin", "_row"))
    return bins.select(*keys, "freq_bin", F.posexplode("_row").alias("time_bin", "db"))

