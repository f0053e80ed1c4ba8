import random

import pytest
from pyspark.sql import functions as F

from tremorgrid.operators import quality


def long_table(spark, values, name="f"):
    rows = [(name, "c", n, v) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "file string, channel string, i bigint, x double")
    return df.withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("i") * 100_000))


def brute_runs(values, tolerance, least):
    filled, last = [], next((v for v in values if v is not None), None)
    for v in values:
        last = v if v is not None else last
        filled.append(last)
    runs, current = [], 0
    for a, b in zip(filled, filled[1:]):
        if a is not None and abs(a - b) < tolerance:
            current += 1
        else:
            runs.append(current)
            current = 0
    runs = [r for r in [*runs, current] if r >= least]
    return len(runs), max(runs) + 1 if runs else 0


@pytest.mark.parametrize("options", [{}, {"rows": 4}, {"rows": 50}])
@pytest.mark.parametrize("seed", [1, 2])
def test_flat_runs(spark, options, seed):
    rng = random.Random(seed)
    values = [None, None] + [rng.choice([None, 1.0, 1.0, 1.00001, 2.0]) for _ in range(120)]
    row = quality.flatline_runs(long_table(spark, values), 1e-3, 3, **options).first()
    assert (row.flatline_segments, row.flatline_longest_samples) == brute_runs(values, 1e-3, 3)


def test_a_channel_without_values_is_not_flat(spark):
    row = quality.flatline_runs(long_table(spark, [None] * 80), 1e-4, 60).first()
    assert (row.flatline_segments, row.flatline_longest_samples) == (0, 0)


@pytest.mark.parametrize("options", [{}, {"slots": 4, "ranked": 5}])
def test_outliers(spark, options):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(200)] + [50.0, -40.0, None, None]
    frame = long_table(spark, values).unionByName(long_table(spark, [3.0] * 9 + [8.0], "constant")).unionByName(
        long_table(spark, [None] * 3, "empty")).unionByName(long_table(spark, [1.0, 2.0, 90.0, 1.0, 2.0], None)).unionByName(
        long_table(spark, [float("inf")] * 4 + [1.0], "infinite"))
    got = {r.file: (r.outlier_count, r.outlier_ratio) for r in quality.mad_outliers(frame, **options).collect()}
    assert got["f"][0] >= 2 and got["f"][1] == got["f"][0] / 204
    assert got["constant"] == (0, 0.0) and got["empty"] == (0, 0.0)
    assert got[None] == (1, 0.2) and got["infinite"] == (0, 0.0)


def test_report_keeps_rows_without_a_file(spark):
    report = quality.quality_report(long_table(spark, [1.0, 2.0, None, 4.0], None)).collect()
    assert len(report) == 1 and report[0].missing_count == 1


def test_drift_and_missing(spark):
    frame = long_table(spark, [n * 0.05 if n % 4 else None for n in range(40)])
    drift = quality.drift_slope(frame).first()
    assert abs(drift.drift_slope_per_sec - 0.5) < 1e-9 and drift.drift_flag
    assert quality.missing_stats(frame).first().missing_count == 10
    assert quality.drift_slope(long_table(spark, [1.0, None])).first().drift_slope_per_sec == 0.0


def test_report_flags(spark):
    report = quality.quality_report(long_table(spark, [1.0] * 80 + [None]))
    flags = {(r.flag, r.item) for r in quality.quality_flags(report).collect()}
    assert flags == {("missing_data", "f::c"), ("flatlines", "f::c")}


def test_sampling_needs_a_positive_step(spark):
    frame = long_table(spark, [1.0, 2.0]).select("file", "i", F.lit(None).cast("timestamp").alias("ts"))
    with pytest.raises(Exception, match="no positive sampling step"):
        quality.sampling_metrics(frame).collect()
    assert quality.sampling_metrics(frame, strict=False).first().dt_mean is None


def test_config_edges(spark):
    rate = spark.createDataFrame([(10.0,)], "target_sampling_rate_hz double")
    row = quality.build_config(rate, window_seconds=2.0, low_cutoff_hz=1.0).first()
    assert row.window_size_samples == 20 and list(row.filter_cutoff_hz) == [1.0, 4.0] and row.stft_window_size == 20
    slow = spark.createDataFrame([(2.0,)], "target_sampling_rate_hz double")
    assert list(quality.build_config(slow, low_cutoff_hz=1.0, upper_cutoff="floored").first().filter_cutoff_hz) == [1.0, 1.0]
    none = quality.build_config(rate).first()
    assert none.filtering_method == "none" and none.filter_cutoff_hz is None
