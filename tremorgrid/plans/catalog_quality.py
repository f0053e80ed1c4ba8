"""Registered queries: sampling and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorgrid.operators import quality
from tremorgrid.plans import fixtures as fx
from tremorgrid.plans.registry import query
from tremorgrid.session import cut

FLAT_TOLERANCE, FLAT_MIN, DRIFT = 5.0, 2, 1e-6

SQL_SAMPLING = fx.SQL_LONG + """,
steps AS (SELECT file, (us - lag(us) OVER (PARTITION BY file ORDER BY i)) / 1e6 AS dt FROM rec_long),
positive AS (SELECT file, dt, 1.0 / dt AS fs FROM steps WHERE dt > 0),
spread AS (SELECT file, avg(dt) AS dt_mean, stddev_pop(dt) AS dt_std, avg(fs) AS fs_mean,
                  stddev_pop(fs) AS fs_std, median(fs) AS fs_median FROM positive GROUP BY file),
extent AS (SELECT file, count(*) AS samples, (arg_max(us, i) - arg_min(us, i)) / 1e6 AS duration_seconds
           FROM rec_long GROUP BY file),
sampling AS (SELECT * FROM extent LEFT JOIN spread USING (file))"""


def _sampling(spark, sf_dir):
    return fx.stored(spark, sf_dir, "sampling", lambda: cut(quality.sampling_metrics(fx.rec_single(spark, sf_dir))))


@query("qlt1_sampling_metrics", f"""WITH {SQL_SAMPLING}
SELECT file, samples, round(duration_seconds, 6) AS duration_seconds, round(dt_mean, 5) AS dt_mean,
       round(dt_std, 5) AS dt_std, round(fs_mean, 10) AS fs_mean, round(fs_std, 10) AS fs_std,
       round(fs_median, 12) AS fs_median FROM sampling""")
def sampling_metrics(spark, sf_dir):
    digits = {"duration_seconds": 6, "dt_mean": 5, "dt_std": 5, "fs_mean": 10, "fs_std": 10, "fs_median": 12}
    return quality.sampling_metrics(fx.rec_single(spark, sf_dir)).select(
        "file", "samples", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("qlt2_aggregate_sampling", f"""WITH {SQL_SAMPLING}
SELECT count(*) AS dataset_count, round(avg(fs_mean), 10) AS avg_sampling_frequency_hz,
       round(avg(fs_std), 10) AS std_sampling_frequency_hz, round(avg(dt_mean), 5) AS avg_dt_seconds FROM sampling""")
def aggregate_sampling(spark, sf_dir):
    out = quality.aggregate_sampling(_sampling(spark, sf_dir))
    return out.select(
        "dataset_count", F.round("avg_sampling_frequency_hz", 10).alias("avg_sampling_frequency_hz"),
        F.round("std_sampling_frequency_hz", 10).alias("std_sampling_frequency_hz"),
        F.round("avg_dt_seconds", 5).alias("avg_dt_seconds"))


def _in_hours(metrics):
    # The devices report hours apart; rates per hour keep three decimals meaningful.
    return metrics.withColumn("fs_median", F.col("fs_median") * 3600)


@query("qlt3_target_sampling_rate", f"""WITH {SQL_SAMPLING}
SELECT round_even(median(fs_median * 3600), 3) AS target_sampling_rate_hz FROM sampling""")
def target_sampling_rate(spark, sf_dir):
    return quality.target_sampling_rate(_in_hours(_sampling(spark, sf_dir)))


SQL_CONFIG = f"""WITH {SQL_SAMPLING},
rate AS (SELECT round_even(median(fs_median * 3600), 3) * 100 AS fs FROM sampling)
SELECT round(fs, 6) AS target_sampling_rate_hz, CAST(trunc(fs) AS INT) AS window_size_samples,
       CAST(0.5 AS DOUBLE) AS window_overlap, 'bandpass' AS filtering_method, CAST(4 AS INT) AS filter_order,
       CAST(1.0 AS DOUBLE) AS low_cutoff, round_even(least(fs / 2 - 1, CAST(500 AS DOUBLE)), 3) AS high_cutoff,
       'per_window_standardization' AS normalization, 'mean_subtraction' AS detrending, 'hann' AS stft_window,
       CAST(least(trunc(fs), 256) AS INT) AS stft_window_size, CAST(0.75 AS DOUBLE) AS stft_overlap FROM rate"""


def config_columns(config):
    return config.select(
        F.round("target_sampling_rate_hz", 6).alias("target_sampling_rate_hz"), "window_size_samples",
        "window_overlap", "filtering_method", "filter_order", F.col("filter_cutoff_hz")[0].alias("low_cutoff"),
        F.col("filter_cutoff_hz")[1].alias("high_cutoff"), "normalization", "detrending", "stft_window",
        "stft_window_size", "stft_overlap")


def config_frame(spark, sf_dir):
    rate = quality.target_sampling_rate(_in_hours(_sampling(spark, sf_dir))).select(
        (F.col("target_sampling_rate_hz") * 100).alias("target_sampling_rate_hz"))
    return quality.build_config(rate, low_cutoff_hz=1.0)


@query("qlt4_build_config", SQL_CONFIG)
def build_config(spark, sf_dir):
    return config_columns(config_frame(spark, sf_dir))


@query("qlt5_missing_stats", f"""WITH {fx.SQL_GAPS}
SELECT file, channel, count(*) FILTER (x IS NULL) AS missing_count,
       round(count(*) FILTER (x IS NULL) / count(*), 9) AS missing_ratio FROM rec_long GROUP BY ALL""")
def missing_stats(spark, sf_dir):
    return quality.missing_stats(fx.rec_long(spark, sf_dir, gaps=True)).withColumn(
        "missing_ratio", F.round("missing_ratio", 9))


SQL_OUTLIERS = """centre AS (SELECT file, channel, median(x) AS med FROM rec_long GROUP BY ALL),
away AS (SELECT file, channel, x, abs(x - med) AS away FROM rec_long JOIN centre USING (file, channel)),
scale AS (SELECT file, channel, median(away) AS mad FROM away GROUP BY ALL),
outliers AS (
  SELECT file, channel, count(*) FILTER (mad > 0 AND 0.6745::DOUBLE * away / mad > 3.5) AS outlier_count,
         count(*) FILTER (mad > 0 AND 0.6745::DOUBLE * away / mad > 3.5) / count(*) AS outlier_ratio
  FROM away JOIN scale USING (file, channel) GROUP BY ALL)"""


@query("qlt6_mad_outliers", f"""WITH {fx.SQL_GAPS}, {SQL_OUTLIERS}
SELECT file, channel, outlier_count, round(outlier_ratio, 9) AS outlier_ratio FROM outliers""")
def mad_outliers(spark, sf_dir):
    return quality.mad_outliers(fx.rec_long(spark, sf_dir, gaps=True)).withColumn(
        "outlier_ratio", F.round("outlier_ratio", 9))


SQL_FLAT = f"""filled AS (
  SELECT file, channel, i, coalesce(
    last_value(x IGNORE NULLS) OVER (PARTITION BY file, channel ORDER BY i ROWS UNBOUNDED PRECEDING),
    first_value(x IGNORE NULLS) OVER (PARTITION BY file, channel ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x
  FROM rec_long),
diffs AS (SELECT *, coalesce(abs(x - lag(x) OVER (PARTITION BY file, channel ORDER BY i)) < {FLAT_TOLERANCE}, false) AS flat FROM filled),
islands AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY file, channel ORDER BY i) AS run FROM diffs),
runs AS (SELECT file, channel, run, count(*) FILTER (flat) AS n FROM islands GROUP BY ALL),
flats AS (SELECT file, channel, count(*) FILTER (n >= {FLAT_MIN}) AS flatline_segments,
                 coalesce(max(n + 1) FILTER (n >= {FLAT_MIN}), 0) AS flatline_longest_samples
          FROM runs GROUP BY ALL)"""


@query("qlt7_flatline_runs", f"""WITH {fx.SQL_GAPS}, {SQL_FLAT}
SELECT * FROM flats""")
def flatline_runs(spark, sf_dir):
    return quality.flatline_runs(fx.rec_long(spark, sf_dir, gaps=True), FLAT_TOLERANCE, FLAT_MIN)


SQL_DRIFT = f"""timed AS (
  SELECT file, channel, x, (us - min(us) OVER (PARTITION BY file)) / 1e6 AS t FROM rec_long),
drift AS (SELECT file, channel, regr_slope(x, t) AS slope FROM timed WHERE x IS NOT NULL GROUP BY ALL)"""


@query("qlt8_drift_slope", f"""WITH {fx.SQL_GAPS}, {SQL_DRIFT}
SELECT file, channel, round(slope, 14) AS drift_slope_per_sec, abs(slope) > {DRIFT} AS drift_flag FROM drift""")
def drift_slope(spark, sf_dir):
    return quality.drift_slope(fx.rec_long(spark, sf_dir, gaps=True), DRIFT).withColumn(
        "drift_slope_per_sec", F.round("drift_slope_per_sec", 14))


SQL_REPORT = f"""WITH {fx.SQL_GAPS}, {SQL_OUTLIERS}, {SQL_FLAT}, {SQL_DRIFT},
missing AS (SELECT file, channel, count(*) FILTER (x IS NULL) AS missing_count,
                   count(*) FILTER (x IS NULL) / count(*) AS missing_ratio FROM rec_long GROUP BY ALL),
report AS (
  SELECT file, channel, missing_count, round(missing_ratio, 9) AS missing_ratio, outlier_count,
         round(outlier_ratio, 9) AS outlier_ratio, flatline_segments, flatline_longest_samples,
         round(slope, 14) AS drift_slope_per_sec, abs(slope) > {DRIFT} AS drift_flag
  FROM missing JOIN outliers USING (file, channel) JOIN flats USING (file, channel) JOIN drift USING (file, channel))"""


def _report(spark, sf_dir):
    limits = quality.QualityThresholds(flat_min_diffs=FLAT_MIN, flat_tolerance=FLAT_TOLERANCE, drift_slope=DRIFT)
    return quality.quality_report(fx.rec_long(spark, sf_dir, gaps=True), limits)


@query("qlt9_quality_report", SQL_REPORT + " SELECT * FROM report")
def quality_report(spark, sf_dir):
    digits = {"missing_ratio": 9, "outlier_ratio": 9, "drift_slope_per_sec": 14}
    return _report(spark, sf_dir).withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("qlt10_quality_flags", SQL_REPORT + """
SELECT 'missing_data' AS flag, concat(file, '::', channel) AS item FROM report WHERE missing_count > 0
UNION ALL SELECT 'outliers', concat(file, '::', channel) FROM report WHERE outlier_count > 0
UNION ALL SELECT 'flatlines', concat(file, '::', channel) FROM report WHERE flatline_segments > 0
UNION ALL SELECT 'drift', concat(file, '::', channel) FROM report WHERE drift_flag""")
def quality_flags(spark, sf_dir):
    return quality.quality_flags(_report(spark, sf_dir))
