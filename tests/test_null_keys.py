"""Recordings without a name are recordings like others; windows of several lengths share an Arrow batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tremorgrid.operators import signals, splits

START = datetime(2024, 1, 1)


def test_recordings_without_a_name_are_resampled_alike(spark):
    rows = [(file, "ax", n, START + timedelta(milliseconds=130 * n), float(n * n % 17)) for file in ("a", None) for n in range(60)]
    long = spark.createDataFrame(rows, "file string, channel string, i bigint, ts timestamp, x double")
    grid = {r.file: r["count"] for r in signals.resample_grid(long, 10.0).groupBy("file").count().collect()}
    assert grid["a"] == grid[None] > 0
    even = signals.resample_cubic(long, 10.0, rows=16).collect()
    values = {f: sorted((r.k, r.ts, r.x) for r in even if r.file == f) for f in ("a", None)}
    assert values["a"] == values[None] and len(values["a"]) == grid["a"]


def test_groups_without_a_name_are_split(spark):
    rows = [(file, n) for file, many in (("a", 5), ("b", 3), (None, 4), ("c", 2)) for n in range(many)]
    df = spark.createDataFrame(rows, "file string, n int")
    folds = splits.group_kfold(df, 2)
    assert folds.count() == len(rows) and folds.where("file is null").select("fold").distinct().count() == 1
    held = splits.group_holdout(df, 0.5)
    assert held.count() == len(rows) and held.where("file is null").select("holdout").distinct().count() == 1


def test_windows_of_several_lengths_in_one_batch(spark):
    rows = [(n, None if n == 4 else [float(k * n % 7) for k in range(20 if n % 2 else 18)]) for n in range(8)]
    rows.append((8, []))
    df = spark.createDataFrame(rows, "n int, ax array<double>").coalesce(1)
    mixed = {r.n: r.s for r in signals.stft_spectrogram(df, ["ax"], 8, 0.5, "s").collect()}
    assert mixed[4] is None and mixed[8] is None
    for length in (18, 20):
        alone = signals.stft_spectrogram(df.where(F.size("ax") == length), ["ax"], 8, 0.5, "s").collect()
        assert alone and all(mixed[r.n] == r.s for r in alone)
