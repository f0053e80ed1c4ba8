"""Registered queries: windows, signal transforms and features."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from tremorgrid.functions import kernels
from tremorgrid.operators import features, signals
from tremorgrid.operators.metrics import dataset_summary
from tremorgrid.plans import fixtures as fx
from tremorgrid.plans.recordings import window_dataset, window_features
from tremorgrid.plans.registry import query
from tremorgrid.settings import SignalConfig

HOURLY = 1.0 / 3600
SIZE, STEP = 20, 10
SPEC_FFT, SPEC_OVERLAP = 16, 0.5


def _round(df, digits: int, columns):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# Resampling.

SQL_GRID = fx.SQL_LONG + f""",
extent AS (SELECT file, channel, min(us) AS t0, (max(us) - arg_min(us, i)) / 1e6 AS seconds, count(DISTINCT us) AS n
           FROM rec_long GROUP BY ALL),
grid AS (SELECT file, channel, unnest(range(greatest(ceil(seconds / 3600.0::DOUBLE - 1e-9), 0)::BIGINT)) AS k FROM extent)"""


@query("sig1_dedupe_samples", f"""WITH {fx.SQL_GAPS},
repeated AS (SELECT file, channel, i, ts, us, x FROM rec_long
             UNION ALL SELECT file, channel, i + 1000000, ts, us, x + 1 FROM rec_long WHERE i % 3 = 0)
SELECT file, channel, us, round(x, 6) AS x FROM repeated WHERE x IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY file, channel, us ORDER BY i) = 1""")
def dedupe_samples(spark, sf_dir):
    long = fx.rec_long(spark, sf_dir, gaps=True)
    again = long.where("i % 3 = 0").withColumn("i", F.col("i") + 1_000_000).withColumn("x", F.col("x") + 1)
    return signals.dedupe_samples(long.unionByName(again)).select(
        "file", "channel", F.unix_micros("ts").alias("us"), F.round("x", 6).alias("x"))


def _spline_sql() -> str:
    """Not-a-knot spline by elimination down each recording and substitution back up it."""
    return fx.SQL_LONG + """,
p AS (SELECT file, i, (us - min(us) OVER f) / 1e6 / 3600 AS t, x, count(*) OVER f AS n FROM rec_long WINDOW f AS (PARTITION BY file)),
h AS (SELECT *, lead(t) OVER w - t AS h, (lead(x) OVER w - x) / (lead(t) OVER w - t) AS s,
             t - lag(t) OVER w AS hp, (x - lag(x) OVER w) / (t - lag(t) OVER w) AS sp,
             lead(t, 2) OVER w - lead(t) OVER w AS hn, lag(t) OVER w - lag(t, 2) OVER w AS hpp
      FROM p WINDOW w AS (PARTITION BY file ORDER BY i)),
eq AS (SELECT file, i, n, 6 * (s - sp) AS d,
              CASE WHEN i = 1 THEN 0 WHEN i = n - 2 THEN hp - h * h / hp ELSE hp END AS a,
              2 * (hp + h) + CASE WHEN i = 1 THEN hp * (hp + h) / h ELSE 0 END
                           + CASE WHEN i = n - 2 THEN h * (hp + h) / hp ELSE 0 END AS b,
              CASE WHEN i = n - 2 THEN 0 WHEN i = 1 THEN h - hp * hp / h ELSE h END AS c
       FROM h WHERE i BETWEEN 1 AND n - 2),
down AS (
  SELECT file, i, n, c / b AS cc, d / b AS dd FROM eq WHERE i = 1
  UNION ALL
  SELECT e.file, e.i, e.n, e.c / (e.b - e.a * q.cc), (e.d - e.a * q.dd) / (e.b - e.a * q.cc)
  FROM down q JOIN eq e ON e.file = q.file AND e.i = q.i + 1),
up AS (
  SELECT file, i, dd AS m FROM down WHERE i = n - 2
  UNION ALL
  SELECT q.file, q.i, q.dd - q.cc * u.m FROM up u JOIN down q ON q.file = u.file AND q.i = u.i - 1),
edge AS (
  SELECT h.file, h.i, ((h.h + h.hn) * u1.m - h.h * u2.m) / h.hn AS m FROM h
  JOIN up u1 ON u1.file = h.file AND u1.i = 1 JOIN up u2 ON u2.file = h.file AND u2.i = 2 WHERE h.i = 0
  UNION ALL
  SELECT h.file, h.i, ((h.hp + h.hpp) * u1.m - h.hp * u2.m) / h.hpp FROM h
  JOIN up u1 ON u1.file = h.file AND u1.i = h.n - 2 JOIN up u2 ON u2.file = h.file AND u2.i = h.n - 3 WHERE h.i = h.n - 1),
m AS (SELECT * FROM up UNION ALL SELECT * FROM edge),
piece AS (SELECT h.file, h.t, h.t + h.h AS t1, h.h, h.x, h.x + h.s * h.h AS x1, m0.m AS m0, m1.m AS m1
          FROM h JOIN m m0 ON m0.file = h.file AND m0.i = h.i JOIN m m1 ON m1.file = h.file AND m1.i = h.i + 1),
points AS (SELECT file, unnest(range(greatest(ceil(max(t) - 1e-9), 0)::BIGINT)) AS k FROM p GROUP BY file),
spline AS (
  SELECT q.file, q.k, (m0 * pow(t1 - k, 3) + m1 * pow(k - t, 3)) / (6 * h)
         + (x / h - m0 * h / 6) * (t1 - k) + (x1 / h - m1 * h / 6) * (k - t) AS x
  FROM points q ASOF JOIN piece g ON q.file = g.file AND q.k >= g.t)"""


@query("sig2_resample_cubic", f"""WITH RECURSIVE {_spline_sql()}
SELECT file, 'value' AS channel, k, round(x, 2) + 0.0 AS x FROM spline""")
def resample_cubic(spark, sf_dir):
    out = signals.resample_cubic(fx.rec_long(spark, sf_dir), HOURLY)
    return _round(out.select("file", "channel", "k", "x"), 2, ["x"])


@query("sig3_resample_grid", f"WITH {SQL_GRID} SELECT file, channel, k, round(k / (1.0::DOUBLE / 3600), 3) AS seconds FROM grid")
def resample_grid(spark, sf_dir):
    return signals.resample_grid(fx.rec_long(spark, sf_dir), HOURLY).withColumn("seconds", F.round("seconds", 3))


# Filtering: the filter as a difference equation, stepped through each recording both ways.

BAND, ORDER = (1.0, 4.0), 4


@query("sig4_butter_bandpass")
def butter_response(spark, sf_dir):
    """Gain of the designed filter at the mean step rate of every recording, and at the band edges."""
    b, a, _ = kernels.butter_bandpass(fx.RATE, BAND, ORDER)
    rate = fx.rec_wide(spark, sf_dir).groupBy("file").agg(F.avg("ax").alias("mean"))

    def part(values, angle, trig):
        return sum((F.lit(float(v)) * trig(angle * n) for n, v in enumerate(values)), F.lit(0.0))

    angle = 2 * 3.141592653589793 * F.col("mean") * 5 / fx.RATE
    top = F.hypot(part(b, angle, F.cos), part(b, angle, F.sin))
    bottom = F.hypot(part(a, angle, F.cos), part(a, angle, F.sin))
    return rate.select("file", F.round(top / bottom, 6).alias("gain"))


def _filter_sql() -> str:
    """Forward-backward filtering of channel ax, one sample of every recording per recursion step.

    The state is that of the transposed difference equation; it starts in the steady state of the
    first value, and the signal is continued by odd reflection at both ends.
    """
    b, a, _ = kernels.butter_bandpass(fx.RATE, BAND, ORDER)
    b, a = [float(v) for v in b], [float(v) for v in a]
    order, pad = len(b) - 1, 3 * len(b)
    gain = sum(b) / sum(a)
    steady = [sum(b[k] - a[k] * gain for k in range(n, order + 1)) for n in range(1, order + 1)]

    def sweep(source: str, out: str) -> str:
        first = ", ".join(f"{v!r}::DOUBLE * x" for v in steady)
        after = ", ".join(
            f"{b[k]!r}::DOUBLE * x - {a[k]!r}::DOUBLE * y" + (f" + z[{k + 1}]" if k < order else "")
            for k in range(1, order + 1))
        return f"""{out} AS (
  SELECT file, p, y, [{after}] AS z
  FROM (SELECT file, p, x, z, {b[0]!r}::DOUBLE * x + z[1] AS y FROM (SELECT file, p, x, [{first}] AS z FROM {source} WHERE p = 0))
  UNION ALL
  SELECT file, p, y, [{after}] AS z
  FROM (SELECT s.file, s.p, s.x, r.z, {b[0]!r}::DOUBLE * s.x + r.z[1] AS y
        FROM {out} r JOIN {source} s ON s.file = r.file AND s.p = r.p + 1))"""

    return f"""WITH RECURSIVE {fx.SQL_WIDE},
sized AS (SELECT file, i, ax, count(*) OVER f AS n, first_value(ax) OVER o AS x0, last_value(ax) OVER o AS x1 FROM rec_wide
          WINDOW f AS (PARTITION BY file), o AS (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
padded AS (SELECT file, i + {pad} AS p, ax AS x, n FROM sized
           UNION ALL SELECT file, {pad} - i, 2 * x0 - ax, n FROM sized WHERE i BETWEEN 1 AND {pad}
           UNION ALL SELECT file, {pad} + 2 * (n - 1) - i, 2 * x1 - ax, n FROM sized WHERE i BETWEEN n - 1 - {pad} AND n - 2),
{sweep("padded", "forth")},
turned AS (SELECT f.file, n + {2 * pad} - 1 - f.p AS p, y AS x, n FROM forth f JOIN (SELECT DISTINCT file, n FROM sized) USING (file)),
{sweep("turned", "back")}
SELECT b.file, n + {pad} - 1 - b.p AS i, round(y, 6) + 0.0 AS ax FROM back b JOIN (SELECT DISTINCT file, n FROM sized) USING (file)
WHERE n + {pad} - 1 - b.p BETWEEN 0 AND n - 1"""


@query("sig5_bandpass_filter", _filter_sql())
def bandpass_filter(spark, sf_dir):
    out = signals.bandpass_filter(
        fx.rec_wide(spark, sf_dir), fx.RATE, fx.WIDE_CHANNELS, "bandpass", BAND, ORDER)
    return _round(out.select("file", "i", "ax"), 6, ["ax"])


# Windows.

@query("sig6_window_signal", f"""WITH {fx.SQL_WIDE}, {fx.sql_windows('rec_wide', ['ax', 'wz'], SIZE, STEP)}
SELECT file, window_index, min(n) + window_index * {STEP} AS window_offset,
       window_index * {STEP} + max(n) + 1 AS window_end, count(*) AS samples,
       round(sum(ax * (n + 1)), 9) AS ax_sum, round(sum(wz * (n + 1)), 9) AS wz_sum FROM win GROUP BY file, window_index""")
def window_signal(spark, sf_dir):
    def weighted(c):
        terms = f"transform({c}, (v, n) -> v * (n + 1))"
        return F.round(F.expr(f"aggregate({terms}, 0D, (s, v) -> s + v)"), 9)

    w = signals.window_signal(fx.rec_wide(spark, sf_dir), ["ax", "wz"], SIZE, 0.5)
    return w.select(
        "file", "window_index", "window_offset", (F.col("window_offset") + F.size("ax")).alias("window_end"),
        F.size("ax").cast("bigint").alias("samples"), weighted("ax").alias("ax_sum"), weighted("wz").alias("wz_sum"))


SQL_WIN6 = f"{fx.SQL_WIDE}, {fx.sql_windows('rec_wide', fx.WIDE_CHANNELS, SIZE, STEP)}"

SPEC_CONFIG = SignalConfig(
    target_sampling_rate_hz=fx.RATE, window_size_samples=SIZE, window_overlap=0.5, filtering_method="bandpass",
    filter_cutoff_hz=BAND, stft_window_size=SPEC_FFT, stft_overlap=SPEC_OVERLAP)


def labelled_wide(spark, sf_dir):
    kind = F.when(F.col("file") % 3 == 0, "good").when(F.col("file") % 3 == 1, "moderate").otherwise("bad")
    return fx.rec_wide(spark, sf_dir).withColumn("label", kind)


@query("sig7_window_dataset", f"""WITH {fx.SQL_WIDE},
files AS (SELECT file, count(*) - 1 AS n, dense_rank() OVER (ORDER BY file) - 1 AS group_id FROM rec_wide GROUP BY file),
wins AS (SELECT file, group_id, unnest(range((n - {SIZE}) // {STEP} + 1)) AS window_index FROM files WHERE n >= {SIZE})
SELECT file, group_id, window_index, window_index * {STEP} AS window_offset, CAST(file % 3 AS INT) AS y,
       {SPEC_FFT // 2 + 1} AS freq_bins, 2 AS time_bins FROM wins""")
def window_dataset_query(spark, sf_dir):
    out = window_dataset(labelled_wide(spark, sf_dir), SPEC_CONFIG, fx.WIDE_CHANNELS)
    return out.select("file", "group_id", "window_index", "window_offset", "y",
                      F.size("spectrogram").alias("freq_bins"), F.size(F.col("spectrogram")[0]).alias("time_bins"))


def _spectrogram_sql(source: str, size: int, channels: list[str], n_fft: int, hop: int) -> str:
    total = max(size, n_fft)
    frames = (total + (-(total - n_fft) % hop) - n_fft) // hop + 1
    weight = sum(0.5 - 0.5 * math.cos(2 * math.pi * n / n_fft) for n in range(n_fft))
    angle = f"2 * pi() * ((n - t * {hop}) * f % {n_fft}) / {n_fft}"
    hann = f"(0.5 - 0.5 * cos(2 * pi() * (n - t * {hop}) / {n_fft}))"
    parts = ",\n         ".join(
        f"sqrt(pow(sum({c} * {hann} * cos({angle})), 2) + pow(sum({c} * {hann} * sin({angle})), 2)) / {weight!r} AS m_{c}"
        for c in channels)
    mean = "(" + " + ".join(f"m_{c}" for c in channels) + f") / {len(channels)}"
    return f"""cells AS (
  SELECT file, window_index, f AS freq_bin, t AS time_bin, {parts}
  FROM {source}, range({frames}) frame(t), range({n_fft // 2 + 1}) bin(f)
  WHERE n >= t * {hop} AND n < t * {hop} + {n_fft} GROUP BY ALL),
spec AS (SELECT file, window_index, CAST(freq_bin AS INT) AS freq_bin, CAST(time_bin AS INT) AS time_bin,
                20 * log10(greatest({mean}, 1e-12)) AS db FROM cells)"""


@query("sig8_stft_spectrogram", f"""WITH {SQL_WIN6}, {_spectrogram_sql('win', SIZE, fx.WIDE_CHANNELS, SPEC_FFT, 8)}
SELECT file, window_index, freq_bin, time_bin, round(db, 5) + 0.0 AS db FROM spec""")
def stft_spectrogram(spark, sf_dir):
    out = signals.stft_spectrogram(fx.wide_windows(spark, sf_dir), fx.WIDE_CHANNELS, SPEC_FFT, SPEC_OVERLAP)
    return _round(signals.spectrogram_cells(out, ["file", "window_index"]), 5, ["db"])


@query("sig9_window_standardize", f"""WITH {SQL_WIN6},
z AS (SELECT file, window_index, n, (ax - avg(ax) OVER w) / stddev_pop(ax) OVER w AS z, ay - avg(ay) OVER w AS centred
      FROM win WINDOW w AS (PARTITION BY file, window_index))
SELECT file, window_index, CAST(n AS INT) AS n, round(coalesce(z, 0), 6) + 0.0 AS z, round(centred, 10) + 0.0 AS centred FROM z""")
def window_standardize(spark, sf_dir):
    w = fx.wide_windows(spark, sf_dir, channels=["ax", "ay"]).drop("window_offset")
    w = signals.window_standardize(w, ["ax"])
    w = signals.window_standardize(w, ["ay"], "mean_subtraction")
    cells = w.select("file", "window_index", F.posexplode(F.arrays_zip("ax", "ay")).alias("n", "_v"))
    out = cells.select("file", "window_index", "n", F.col("_v.ax").alias("z"), F.col("_v.ay").alias("centred"))
    return _round(_round(out, 6, ["z"]), 10, ["centred"])


# Features.

SQL_TIME = """SELECT {key}, window_index, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
       round(sqrt(avg(x * x)), 6) AS rms, round(avg(abs(x - mu)), 6) AS mad,
       round(CASE WHEN stddev_pop(x) < 1e-7 THEN 0 ELSE skewness(x) END, 6) + 0.0 AS skewness,
       round(CASE WHEN stddev_pop(x) < 1e-7 THEN 0 ELSE kurtosis(x) END, 6) + 0.0 AS kurtosis,
       round(max(abs(x)) / (sqrt(avg(x * x)) + 1e-12), 6) AS crest_factor
FROM (SELECT *, avg(x) OVER (PARTITION BY {key}, window_index) AS mu FROM win) GROUP BY ALL"""


@query("fea1_time_features", f"WITH {fx.SQL_LONG}, {fx.sql_windows('rec_long', ['x'], SIZE, STEP)} " + SQL_TIME.format(key="file"))
def time_features(spark, sf_dir):
    windows = signals.window_signal(fx.rec_single(spark, sf_dir), ["x"], SIZE, 0.5)
    out = features.time_features(windows.select("file", "window_index", "x"), "x").drop("x")
    return _round(out, 6, kernels.TIME_NAMES)


SQL_SAMPLES = fx.SQL_VECTORS + """,
samples AS (SELECT file, window_index, unnest(range(64)) AS n, unnest(samples) AS x FROM vectors)"""


def _dft_sql(source: str, size: int, keys: str = "file, window_index", column: str = "x") -> str:
    return f"""spectrum AS (
  SELECT {keys}, k, sqrt(pow(sum({column} * cos(2 * pi() * (k * n % {size}) / {size})), 2)
                       + pow(sum({column} * sin(2 * pi() * (k * n % {size}) / {size})), 2)) AS m
  FROM {source}, range({size // 2 + 1}) bin(k) GROUP BY ALL)"""


def _freq_select(size: int, fs: float, keys: str = "file, window_index", prefix: str = "") -> str:
    def band(name, condition):
        return (f"coalesce(CASE WHEN count(*) FILTER ({condition}) < 2 THEN 0 ELSE sum(m) FILTER ({condition}) "
                f"- (arg_min(m, k) FILTER ({condition}) + arg_max(m, k) FILTER ({condition})) / 2 END, 0) AS {prefix}{name}")
    return f"""SELECT {keys}, sum(m * m) AS {prefix}spectral_energy,
  (arg_max(k, round(m, 10)) * {fs} / {size})::DOUBLE AS {prefix}peak_frequency, sum(m * k) / sum(m) * {fs} / {size} AS {prefix}spectral_centroid,
  {band('band_power_low', f'6 * k < {size}')}, {band('band_power_mid', f'6 * k >= {size} AND 3 * k < {size}')},
  {band('band_power_high', f'3 * k >= {size}')} FROM spectrum GROUP BY ALL"""


SQL_FREQ_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in kernels.FREQ_NAMES)


@query("fea2_freq_features", f"""WITH {SQL_SAMPLES},
tapered AS (SELECT file, window_index, n, x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS x FROM samples),
{_dft_sql('tapered', 64)}, freq AS ({_freq_select(64, 10.0)})
SELECT file, window_index, {SQL_FREQ_ROUNDED} FROM freq""")
def freq_features(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select("file", "window_index", "samples")
    return _round(features.freq_features(v, "samples", fx.RATE).drop("samples"), 6, kernels.FREQ_NAMES)


SQL_TAPS = "taps(j, lo, hi) AS (VALUES " + ", ".join(
    f"({j}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)"
    for j, (lo, hi) in enumerate(zip(kernels.DB4_LOW.tolist(), kernels.DB4_HIGH.tolist()))) + ")"


def _wavelet_sql(source: str, size: int, keys: str, packets: bool) -> str:
    """Three analysis levels as joins; ``packets`` splits both halves, else only the approximation."""
    out, length = [f"l0 AS (SELECT {keys}, '' AS path, n, x FROM {source})"], size
    for level in range(1, 4):
        half = (length + 7) // 2
        m = f"((2 * k + 1 - j + {8 * length}) % {2 * length})"
        at = f"CASE WHEN {m} < {length} THEN {m} ELSE {2 * length - 1} - {m} END"
        rows = "" if packets or level == 1 else "WHERE path NOT LIKE '%d%'"
        out.append(f"""p{level} AS (SELECT {keys}, path, k AS n, sum(lo * x) AS a, sum(hi * x) AS d
  FROM (SELECT * FROM l{level - 1} {rows}) JOIN (SELECT k, j, lo, hi, {at} AS src FROM range({half}) r(k), taps) ON n = src GROUP BY ALL),
l{level} AS (SELECT {keys}, path || 'a' AS path, n, a AS x FROM p{level}
       UNION ALL SELECT {keys}, path || 'd', n, d FROM p{level})""")
        length = half
    out.append(f"energy AS (SELECT {keys}, path, sum(x * x) AS e FROM l3 GROUP BY ALL)")
    return SQL_TAPS + ", " + ",\n".join(out)


NODES = [a + b + c for a in "ad" for b in "ad" for c in "ad"]


@query("fea3_wpd_energy", f"""WITH {SQL_SAMPLES}, {_wavelet_sql('samples', 64, 'file, window_index', True)}
SELECT file, window_index, """ + ", ".join(
    f"round(max(e) FILTER (path = '{p}'), 6) AS node{n}" for n, p in enumerate(NODES)) + " FROM energy GROUP BY ALL")
def wpd_energy(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select("file", "window_index", "samples")
    out = features.wpd_energy(v, "samples", "e")
    return out.select("file", "window_index", *[F.round(F.col("e")[n], 6).alias(f"node{n}") for n in range(8)])


def _digits(feature: str) -> int:
    """Digits that keep exact decimals off a rounding tie and large sums within double precision."""
    return 12 if feature.endswith(("time_mean", "time_mad")) else 8 if "time_" in feature else 5


def _describe_sql() -> str:
    """All features of all six channels, in long form by channel and pivoted by name."""
    stacked = "stacked AS (" + " UNION ALL ".join(
        f"SELECT file, window_index, '{c}' AS channel, n, {c} AS x FROM win" for c in fx.WIDE_CHANNELS) + ")"
    keys = "file, window_index, channel"
    time = f"""mu AS (SELECT *, avg(x) OVER (PARTITION BY {keys}) AS mu FROM stacked),
times AS (SELECT {keys}, avg(x) AS time_mean, stddev_pop(x) AS time_std, sqrt(avg(x * x)) AS time_rms,
       avg(abs(x - mu)) AS time_mad, CASE WHEN stddev_pop(x) < 1e-7 THEN 0 ELSE skewness(x) END AS time_skewness,
       CASE WHEN stddev_pop(x) < 1e-7 THEN 0 ELSE kurtosis(x) END AS time_kurtosis,
       max(abs(x)) / (sqrt(avg(x * x)) + 1e-12) AS time_crest_factor FROM mu GROUP BY ALL)"""
    taper = f"tapered AS (SELECT {keys}, n, x * (0.5 - 0.5 * cos(2 * pi() * n / {SIZE - 1})) AS x FROM stacked)"
    nodes = ", ".join(f"max(e) FILTER (path = '{p}') AS wpd_wpd_energy_lvl3_node{n}" for n, p in enumerate(NODES))
    names = [f"time_{n}" for n in kernels.TIME_NAMES] + [f"freq_{n}" for n in kernels.FREQ_NAMES] + [
        f"wpd_{n}" for n in kernels.WPD_NAMES]
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("freq_spectral_centroid",))
    columns = ", ".join(
        f"round(max({n}) FILTER (channel = '{c}'), {_digits(n)}) + 0.0 AS {c}_{n}" for c in fx.WIDE_CHANNELS for n in names)
    return f"""WITH {SQL_WIN6}, {stacked}, {time}, {taper}, {_dft_sql('tapered', SIZE, keys)},
freqs AS ({_freq_select(SIZE, 10.0, keys, 'freq_')}),
{_wavelet_sql('stacked', SIZE, keys, True)},
waves AS (SELECT {keys}, {nodes} FROM energy GROUP BY ALL),
joined AS (SELECT *, ({finite}) AS usable FROM times JOIN freqs USING ({keys}) JOIN waves USING ({keys}))
SELECT file, window_index, {columns} FROM joined GROUP BY ALL HAVING bool_and(usable)"""


@query("fea4_describe_windows", _describe_sql())
def describe_windows(spark, sf_dir):
    windows = fx.wide_windows(spark, sf_dir).drop("window_offset")
    out = features.clean_features(features.describe_windows(windows, fx.RATE, fx.WIDE_CHANNELS, SIZE))
    return out.withColumns({
        c: F.round(c, _digits(c)) + F.lit(0.0) for c in out.columns if c not in ("file", "window_index")})


@query("fea4_window_features")
def window_features_query(spark, sf_dir):
    """The whole feature job: resample, window, describe."""
    config = SignalConfig(target_sampling_rate_hz=fx.RATE, window_size_samples=SIZE, stft_window_size=SIZE)
    out = window_features(labelled_wide(spark, sf_dir), config, fx.WIDE_CHANNELS)
    return _round(out, 4, [c for c in out.columns if c not in features.META_COLUMNS])


SQL_TOP_TIME = """SELECT file, window_index, round(sqrt(avg(x * x)), 6) AS rms, round(avg(x), 6) AS mean,
  round(stddev_pop(x), 6) AS std, round(median(abs(x - mid)), 6) AS mad,
  round(CASE WHEN stddev_pop(x) < 1e-7 THEN 0 ELSE avg(pow(x - mu, 3)) / pow(stddev_pop(x), 3) END, 6) + 0.0 AS skewness,
  round(CASE WHEN avg(x * x) > 0 THEN max(abs(x)) / sqrt(avg(x * x)) ELSE 0 END, 6) AS crest_factor
FROM (SELECT *, avg(x) OVER w AS mu, median(x) OVER w AS mid FROM {source} WINDOW w AS (PARTITION BY file, window_index)) GROUP BY ALL"""


@query("fea5_top20_time", f"WITH {SQL_SAMPLES} " + SQL_TOP_TIME.format(source="samples"))
def top20_time(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select("file", "window_index", "samples")
    out = features.top20_time(v, "samples").drop("samples")
    return _round(out, 6, ["rms", "mean", "std", "mad", "skewness", "crest_factor"])


def _periodogram_sql(source: str, size: int, fs: float) -> str:
    last = size // 2 if size % 2 == 0 else size
    return f"""centred AS (SELECT file, window_index, n, x - avg(x) OVER (PARTITION BY file, window_index) AS x FROM {source}),
{_dft_sql('centred', size)},
psd AS (SELECT file, window_index, k, m * m / ({fs} * {size}) * CASE WHEN k = 0 OR k = {last} THEN 1 ELSE 2 END AS p FROM spectrum),
power AS (SELECT file, window_index, sum(p) AS spectral_energy, sum(p) FILTER (k * {fs} / {size} < 2.5) AS band_power_low
          FROM psd GROUP BY ALL)"""


@query("fea6_top20_periodogram", f"""WITH {SQL_SAMPLES}, {_periodogram_sql('samples', 64, 10.0)}
SELECT file, window_index, round(spectral_energy, 8) AS spectral_energy, round(band_power_low, 8) AS band_power_low FROM power""")
def top20_periodogram(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select("file", "window_index", "samples")
    out = features.top20_periodogram(v, "samples", fx.RATE).drop("samples")
    return _round(out, 8, ["spectral_energy", "band_power_low"])


@query("fea7_top20_dwt", f"""WITH {SQL_SAMPLES}, {_wavelet_sql('samples', 64, 'file, window_index', False)}
SELECT file, window_index, round(max(e) FILTER (path = 'aaa'), 6) AS node0, round(max(e) FILTER (path = 'aad'), 6) AS node1,
       0.0::DOUBLE AS node4 FROM energy GROUP BY ALL""")
def top20_dwt(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).select("file", "window_index", "samples")
    return _round(features.top20_dwt(v, "samples").drop("samples"), 6, ["node0", "node1"])


def _top20_sql() -> str:
    parts, joins = [], []
    for name, c in (("acceleration_yg", "ay"), ("acceleration_zg", "az"), ("angular_velocity_ydps", "wy")):
        source = f"s_{c} AS (SELECT file, window_index, n, {c} AS x FROM win)"
        time = f"t_{c} AS ({re.sub(r', [0-9]+\)( [+] 0.0)? AS', ') AS', SQL_TOP_TIME).replace('round(', '(').format(source=f's_{c}')})"
        parts += [source, time]
        joins.append(f"t_{c}")
        if c != "wy":
            for cte in (_periodogram_sql(f"s_{c}", SIZE, 10.0), _wavelet_sql(f"s_{c}", SIZE, "file, window_index", False)):
                names = ("centred", "spectrum", "psd", "power", "taps", "l0", "l1", "l2", "l3", "p1", "p2", "p3", "energy")
                for n in names:
                    cte = re.sub(rf"\b{n}\b", f"{n}_{c}", cte)
                parts.append(cte)
            parts.append(f"w_{c} AS (SELECT file, window_index, max(e) FILTER (path = 'aaa') AS node0, "
                         f"max(e) FILTER (path = 'aad') AS node1 FROM energy_{c} GROUP BY ALL)")
            joins += [f"power_{c}", f"w_{c}"]
    channel = {"acceleration_yg": "ay", "acceleration_zg": "az", "angular_velocity_ydps": "wy"}
    columns = []
    for feature in features.TOP20:
        if feature.endswith("node4"):
            columns.append(f"0.0::DOUBLE AS {feature}")
            continue
        prefix = next(p for p in channel if feature.startswith(p))
        rest = feature[len(prefix) + 1:]
        table = {"time": "t", "freq": "power", "wpd": "w"}[rest.split("_")[0]]
        name = rest.replace("wpd_wpd_energy_lvl3_", "").replace("time_", "").replace("freq_", "")
        columns.append(f"round({table}_{channel[prefix]}.{name}, {_digits(feature)}) + 0.0 AS {feature}")
    first, *others = joins
    tables = first + "".join(f" JOIN {j} USING (file, window_index)" for j in others)
    return f"WITH {SQL_WIN6}, {', '.join(parts)} SELECT file, window_index, {', '.join(columns)} FROM {tables}"


@query("fea8_top20_vector", _top20_sql())
def top20_vector(spark, sf_dir):
    windows = fx.wide_windows(spark, sf_dir, channels=["ay", "az", "wy"]).drop("window_offset")
    out = features.top20_vector(features.top20_features(windows, fx.RATE, "ay", "az", "wy"))
    return out.select("file", "window_index", *[
        (F.round(F.col("features")[n], _digits(name)) + F.lit(0.0)).alias(name) for n, name in enumerate(features.TOP20)])


@query("agg2_dataset_summary", f"""WITH {SQL_WIN6}, wins AS (SELECT DISTINCT file, window_index FROM win),
labelled AS (SELECT *, CASE file % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'moderate' ELSE 'bad' END AS label FROM wins)
SELECT 'samples' AS fact, '' AS item, count(*) AS value FROM labelled
UNION ALL SELECT 'label_distribution', label, count(*) FROM labelled GROUP BY label
UNION ALL SELECT 'group_counts', CAST(file AS VARCHAR), count(*) FROM labelled GROUP BY file
UNION ALL SELECT 'spectrogram_freq_bins', '', {SPEC_FFT // 2 + 1}
UNION ALL SELECT 'spectrogram_time_bins', '', 2""")
def dataset_summary_query(spark, sf_dir):
    windows = signals.stft_spectrogram(fx.wide_windows(spark, sf_dir), fx.WIDE_CHANNELS, SPEC_FFT, SPEC_OVERLAP)
    kind = F.when(F.col("file") % 3 == 0, "good").when(F.col("file") % 3 == 1, "moderate").otherwise("bad")
    return dataset_summary(windows.withColumn("label", kind), "spectrogram")
