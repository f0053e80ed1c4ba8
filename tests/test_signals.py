import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorgrid.operators import features, quality, signals
from tremorgrid.plans.recordings import verify_recordings, window_dataset, window_features
from tremorgrid.settings import QualityThresholds, SignalConfig


def recording(spark, count, rate=10.0, channels=("a", "b"), name="Good 1.csv", jitter=0.0, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(count) / rate + jitter * rng.uniform(0, 0.4 / rate, count)
    rows = [(name, n, float(t[n]), *[float(np.sin(t[n] * (c + 1)) + 0.1 * rng.normal()) for c in range(len(channels))])
            for n in range(count)]
    df = spark.createDataFrame(rows, "file string, i bigint, t double, " + ", ".join(f"{c} double" for c in channels))
    micros = (F.lit(1_700_000_000_000_000) + F.round(F.col("t") * 1e6)).cast("bigint")
    return df.withColumn("ts", F.timestamp_micros(micros)).drop("t").withColumn("label", F.lit("good"))


def test_grid_leaves_out_the_end(spark):
    long = quality.unpivot_channels(recording(spark, 814), ["a"])
    assert signals.resample_grid(long, 10.0).count() == 813
    assert signals.resample_cubic(long, 10.0).count() == 813


@pytest.mark.parametrize("jitter", [0.0, 1.0])
def test_resampling_in_pieces_equals_one_piece(spark, jitter):
    long = quality.unpivot_channels(recording(spark, 900, jitter=jitter), ["a"])
    whole = {r.k: r.x for r in signals.resample_cubic(long, 12.5).collect()}
    pieces = {r.k: r.x for r in signals.resample_cubic(long, 12.5, rows=150).collect()}
    assert whole.keys() == pieces.keys()
    assert max(abs(whole[k] - pieces[k]) for k in whole) < 1e-10


@pytest.mark.parametrize("long_run", [False, True])
def test_wide_resampling_equals_each_channel_on_its_own(spark, long_run):
    """Scattered holes, repeated times, channels that end early, a file without one channel, a null file; with
    ``long_run``, a channel without values for longer than pieces share rows."""
    names = [("Good 1.csv", 900, 1.0), ("Bad 2.csv", 40, 0.0), (None, 700, 1.0)]
    df = None
    for n, (name, count, jitter) in enumerate(names):
        part = recording(spark, count, jitter=jitter, name=name or "none", seed=n).withColumn("file", F.lit(name))
        df = part if df is None else df.unionByName(part)
    i = F.col("i")
    df = df.withColumn("a", F.when(i % 13 == 5, None).when(i % 17 == 4, float("nan")).otherwise(F.col("a")))
    df = df.withColumn("b", F.when((i % 11 == 3) | (i > 850), None).when(i == 20, float("inf")).otherwise(F.col("b")))
    if long_run:
        df = df.withColumn("b", F.when(F.col("file").eqNullSafe("Good 1.csv") & i.between(200, 620), None).otherwise(F.col("b")))
    again = df.where("i % 7 = 0").withColumn("i", i + 10_000).withColumn("a", F.lit(99.0))  # later at the same time
    none = recording(spark, 50, name="Moderate 3.csv").withColumn("b", F.lit(None).cast("double"))
    df = df.unionByName(again).unionByName(none)
    apart = signals.resample_recordings(quality.unpivot_channels(df, ["a", "b"]), 12.5, ["a", "b"]).na.drop("any", subset=["a", "b"])
    want = {(r.file, r.i): r for r in apart.collect()}
    got = {(r.file, r.i): r for r in signals.resample_wide(df, 12.5, ["a", "b"], rows=300).collect()}
    assert want.keys() == got.keys() and len(want) > 1500
    assert all(want[k].ts == got[k].ts for k in want)
    assert max(abs(want[k][c] - got[k][c]) for k in want for c in "ab") < 1e-9


def test_wide_resampling_needs_four_samples(spark):
    with pytest.raises(Exception, match="not enough samples"):
        signals.resample_wide(recording(spark, 3), 10.0, ["a"]).collect()


def test_resampling_needs_four_samples(spark):
    long = quality.unpivot_channels(recording(spark, 3), ["a"])
    with pytest.raises(Exception, match="not enough samples"):
        signals.resample_cubic(long, 10.0).collect()


def test_filtering_in_pieces_equals_one_piece(spark):
    df = recording(spark, 3000).select("file", "i", "ts", "a", "b")
    whole = signals.bandpass_filter(df, 10.0, ["a", "b"], "bandpass", (1.0, 4.0))
    pieces = signals.bandpass_filter(df, 10.0, ["a", "b"], "bandpass", (1.0, 4.0), rows=10)
    joined = whole.alias("w").join(pieces.alias("p"), ["file", "i"])
    row = joined.agg(F.count(F.lit(1)), F.max(F.abs(F.col("w.a") - F.col("p.a"))), F.max(F.abs(F.col("w.b") - F.col("p.b")))).first()
    assert row[0] == 3000 and row[1] < 1e-9 and row[2] < 1e-9


def test_no_filter_is_the_identity(spark):
    df = recording(spark, 30)
    assert signals.bandpass_filter(df, 10.0, ["a"], "none", (1.0, 4.0)) is df
    assert signals.bandpass_filter(df, 10.0, ["a"], "bandpass", None) is df


@pytest.mark.parametrize("count,size,overlap,expected", [
    (813, 20, 0.5, 80), (19, 20, 0.5, 0), (20, 20, 0.5, 1), (9000, 20, 0.9, 8981), (100, 7, 0.0, 14)])
def test_window_counts_and_places(spark, count, size, overlap, expected):
    df = recording(spark, count, channels=("a",)).withColumn("a", F.col("i").cast("double"))
    got = signals.window_signal(df, ["a"], size, overlap).collect()
    assert len(got) == expected
    for row in got:
        assert row.a == [float(row.window_offset + n) for n in range(size)]
    assert sorted(row.window_index for row in got) == list(range(expected))


def test_overlap_must_be_a_fraction(spark):
    with pytest.raises(ValueError):
        signals.window_signal(recording(spark, 30), ["a"], 10, 1.0)


def test_features_of_one_channel_agree_between_the_two_paths(spark):
    windows = signals.window_signal(recording(spark, 200), ["a", "b"], 20, 0.5)
    described = features.describe_windows(windows, 10.0, ["a", "b"])
    direct = features.time_features(windows, "a", "t_")
    both = described.join(direct.drop("a", "b", "window_offset"), ["file", "window_index"])
    names = ("mean", "std", "rms", "mad", "skewness", "kurtosis", "crest_factor")
    worst = both.agg(*[F.max(F.abs(F.col(f"a_time_{n}") - F.col(f"t_{n}"))) for n in names]).first()
    assert max(worst) < 1e-9
    assert len([c for c in described.columns if c.startswith(("a_", "b_"))]) == 42


def test_udfs_run_once_per_channel_in_one_pass(spark):
    windows = signals.window_signal(recording(spark, 200), ["a", "b"], 20, 0.5)
    plan = features.describe_windows(windows, 10.0, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_clean_features_without_a_complete_row(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("inf"), None), (3, 2.0, None)], "window_index int, a double, b double")
    assert [tuple(r) for r in features.clean_features(df).orderBy("window_index").collect()] == [(1, 1.0), (3, 2.0)]


def test_batch_jobs(spark):
    channels = ["a", "b"]
    df = recording(spark, 300, channels=channels).unionByName(recording(spark, 260, channels=channels, name="Bad 2.csv", seed=5).withColumn("label", F.lit("bad")))
    checks = verify_recordings(df, channels, QualityThresholds())
    assert checks["sampling"].count() == 2 and checks["quality"].count() == 4
    row = checks["config"].first()
    assert row.target_sampling_rate_hz == 10.0 and list(row.filter_cutoff_hz) == [1.0, 4.0]
    config = SignalConfig(10.0, 20, 0.5, "bandpass", 4, (1.0, 4.0), stft_window_size=16, stft_overlap=0.5)
    assert window_features(df, config, channels).count() == 28 + 24
    data = window_dataset(df, config, channels, binary=True)
    assert {(r.file, r.group_id, r.y) for r in data.select("file", "group_id", "y").distinct().collect()} == {
        ("Bad 2.csv", 0, 1), ("Good 1.csv", 1, 0)}
