import json

import pytest
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import encode_label
from tremorgrid.settings import CHANNELS, TIMESTAMP_COLUMN, SignalConfig, slug
from tremorgrid.sources import recordings

HEADER = ",".join([TIMESTAMP_COLUMN, "Device", *CHANNELS])


def write_csv(folder, name, lines, header=HEADER):
    (folder / name).write_text("﻿" + "\n".join([header, *lines]) + "\n", encoding="utf-8")


def line(second, values="1, 2,3,4,5,6"):
    return f" 2024-01-01 00:00:{second:06.3f} ,dev, {values}"


@pytest.fixture
def folder(tmp_path):
    write_csv(tmp_path, "Good data__1.csv", [line(n / 10) for n in range(30)])
    write_csv(tmp_path, "Bad data+2.csv", [line(0), line(0.1, "x, 2,3,4,5,6"), "never,dev,1,2,3,4,5,6", line(0.2)])
    return tmp_path


def test_recordings(spark, folder):
    df = recordings.read_recordings(spark, str(folder))
    assert df.columns == ["file", "label", "i", "ts", *CHANNELS]
    good = df.where("label = 'good'").orderBy("i").collect()
    assert [r.i for r in good] == list(range(30)) and {r.file for r in good} == {"Good data__1.csv"}
    assert [r.ts.microsecond // 100_000 for r in good[:3]] == [0, 1, 2]
    bad = df.where("label = 'bad'").orderBy("i").collect()
    assert {r.file for r in bad} == {"Bad data+2.csv"}
    assert [r[CHANNELS[0]] for r in bad] == [1.0, None, 1.0, 1.0] and bad[2].ts is None


def test_recordings_that_cannot_be_read(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        recordings.read_recordings(spark, str(folder), pattern="*.tsv")
    with pytest.raises(FileNotFoundError):
        recordings.read_recordings(spark, str(tmp_path / "absent"))
    other = tmp_path / "other"
    other.mkdir()
    write_csv(other, "x.csv", ["1,2"], header=f"{TIMESTAMP_COLUMN},{CHANNELS[0]}")
    with pytest.raises(ValueError, match="Angular velocity"):
        recordings.read_recordings(spark, str(other))
    assert recordings.read_recordings(spark, str(other), channels=CHANNELS[:1]).count() == 1


def test_config_is_stored_or_derived(spark, folder, tmp_path):
    path = str(tmp_path / "config")
    good = recordings.read_recordings(spark, str(folder), pattern="Good*")
    derived = recordings.read_or_derive_config(spark, path, good)
    assert derived.target_sampling_rate_hz == 10.0 and derived.filter_cutoff_hz == (1.0, 4.0)
    config = SignalConfig(12.5, 25)
    recordings.write_config(spark, config, path)
    assert recordings.read_or_derive_config(spark, path, good) == config
    assert SignalConfig.from_dict(json.loads(config.to_json())) == config


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_feature_matrix(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", "Good", 0, 1.5), ("b", "bad", 1, 2.5)], "file string, label string, window_index bigint, f double")
    path = str(tmp_path / "features")
    recordings.write_feature_matrix(df, path, fmt)
    back = recordings.read_feature_matrix(spark, path, fmt, binary=True).orderBy("file").collect()
    assert [(r.file, r.window_index, r.f, r.label_id) for r in back] == [("a", 0, 1.5, 0), ("b", 1, 2.5, 1)]
    recordings.write_feature_matrix(df.drop("file"), path, fmt)
    with pytest.raises(ValueError, match="file"):
        recordings.read_feature_matrix(spark, path, fmt)


def test_unknown_labels(spark):
    df = spark.createDataFrame([("good",), ("odd",)], "label string")
    codes = df.select(encode_label(F.col("label"), lenient=True), encode_label(F.col("label"), True, True)).collect()
    assert [tuple(r) for r in codes] == [(0, 0), (-1, 0)]
    with pytest.raises(Exception, match="odd"):
        df.select(encode_label(F.col("label"))).collect()


def test_slugs():
    assert slug(CHANNELS[0]) == "acceleration_xg" and slug(CHANNELS[4]) == "angular_velocity_ydps"


def test_text_and_json_reports(spark, tmp_path):
    recordings.write_text_report(spark.createDataFrame([("# a\n\nb",)], "value string"), str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("part*")) == "# a\n\nb\n"
    recordings.write_json_report(spark.createDataFrame([(1, None)], "n int, x double"), str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part*"))) == {"n": 1, "x": None}


def test_each_file_has_its_own_header(spark, tmp_path):
    """Other orders, extra columns, quoted cells, blank lines and another encoding give the same rows."""
    plain, mixed = tmp_path / "plain", tmp_path / "mixed"
    plain.mkdir(), mixed.mkdir()
    rows = [[f"2024-01-01 00:00:{n / 10:06.3f}", *[f"{n * 7 + c}" for c in range(len(CHANNELS))]] for n in range(400)]
    names = [TIMESTAMP_COLUMN, *CHANNELS]
    orders = [list(range(7)), [6, 5, 4, 3, 2, 1, 0], [3, 0, 6, 1, 5, 2, 4]]
    for number, order in enumerate(orders):
        own = rows[number * 100:]
        write_csv(plain, f"bad {number}.csv", [",".join(r) for r in own], ",".join(names))
        lines = [",".join([f'"note, {k}"', *[r[c] for c in order], "more"]) for k, r in enumerate(own)]
        lines.insert(5, "")
        write_csv(mixed, f"bad {number}.csv", lines, ",".join(["Extra", *[names[c] for c in order], "Last"]))
    want = sorted(map(tuple, recordings.read_recordings(spark, str(plain)).collect()))
    assert len(want) == 400 + 300 + 200
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # several splits to a file
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = recordings.read_recordings(spark, str(mixed))
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    write_csv(mixed, "good.csv", ["1,2"], f"{TIMESTAMP_COLUMN},{CHANNELS[0]}")
    with pytest.raises(ValueError, match="good.csv is missing"):
        recordings.read_recordings(spark, str(mixed))


def test_times_that_cannot_be_read(spark, tmp_path):
    write_csv(tmp_path, "good.csv", [line(0), line(0.1)])
    write_csv(tmp_path, "bad.csv", ["never,dev,1,2,3,4,5,6", "nor,dev,1,2,3,4,5,6"])
    with pytest.raises(Exception, match="no readable time in bad.csv"):
        recordings.read_recordings(spark, str(tmp_path)).collect()
    lenient = recordings.read_recordings(spark, str(tmp_path), require_times=False)
    assert lenient.count() == 4
    from tremorgrid.operators import quality

    with pytest.raises(Exception, match="no readable time in bad.csv"):
        quality.sampling_metrics(lenient).collect()


def test_lines_are_written_once(spark, tmp_path):
    """Several splits to a file, lines numbered through them, and one intermediate copy of the lines."""
    from tremorgrid import session

    for number in range(2):
        write_csv(tmp_path, f"good {number}.csv", [line(n / 10) if n % 9 else "" for n in range(300)])
    before, known = spark.conf.get("spark.sql.files.maxPartitionBytes"), set(session.tables(spark))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = recordings.read_recordings(spark, str(tmp_path)).orderBy("file", "i").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = 300 - len(range(0, 300, 9))
    assert [(r.file, r.i) for r in got] == [(f"good {f}.csv", i) for f in range(2) for i in range(kept)]
    for number in range(2):
        times = [r.ts for r in got if r.file == f"good {number}.csv"]
        assert times == sorted(times)
    written = [p for p in session.tables(spark) if p not in known]
    assert sum("value" in spark.read.parquet(p).columns for p in written) == 1
