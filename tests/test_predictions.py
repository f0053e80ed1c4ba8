import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tremorgrid.functions import expressions as ex
from tremorgrid.operators import joins, metrics, splits, votes
from tremorgrid.operators.frames import frame_chunks
from tremorgrid.plans import catalog_predictions, reports

START = datetime(2024, 1, 1)


def packets(spark, seed, count=160, devices=2):
    rng, rows = random.Random(seed), []
    for device in range(devices):
        for n in range(count):
            rows.append((device, START + timedelta(seconds=n), n, rng.choice(["accel", "gyro", "accel", "angle"]), float(n)))
    return rows, spark.createDataFrame(rows, "device_id bigint, ts timestamp, seq bigint, type string, v double")


@pytest.mark.parametrize("pieces", [5, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_fresh_pairs(spark, seed, pieces):
    rows, df = packets(spark, seed)
    expected, pending = [], {}
    for device, _, n, kind, v in rows:
        if kind == "angle":
            continue
        held = pending.setdefault(device, {})
        held[kind] = v
        if len(held) == 2:
            expected.append((device, n, held["accel"], held["gyro"]))
            pending[device] = {}
    got = joins.pair_fresh(df, ["v"], rows=pieces).orderBy("device_id", "seq").collect()
    assert [(r.device_id, r.seq, r.a_v, r.w_v) for r in got] == expected


@pytest.mark.parametrize("pieces", [5, 1000])
def test_carried_pairs(spark, pieces):
    rows, df = packets(spark, 3)
    expected, latest = [], {}
    for device, _, n, kind, v in rows:
        if kind == "accel":
            latest[device] = v
        elif kind == "gyro" and device in latest:
            expected.append((device, n, latest[device], v))
    got = joins.pair_carry_forward(df, ["v"], rows=pieces).orderBy("device_id", "seq").collect()
    assert [(r.device_id, r.seq, r.a_v, r.w_v) for r in got] == expected


@pytest.mark.parametrize("pieces", [6, 1000])
def test_buffers_and_streaks_across_pieces(spark, pieces):
    rows = [(1, START + timedelta(seconds=n), n, n % 7 not in (0, 3)) for n in range(60)]
    df = joins.ensure_index(spark.createDataFrame(rows, "device_id bigint, ts timestamp, seq bigint, is_fault boolean"))
    got = votes.rolling_buffer(df, ["seq"], 5, rows=pieces).orderBy("seq").collect()
    assert [[e.seq for e in r.buffer] for r in got] == [list(range(n - 4, n + 1)) for n in range(4, 60)]
    streak = {r.seq: r.streak for r in votes.consecutive_faults(df).collect()}
    assert streak == {n: n >= 2 and all(rows[n - k][3] for k in range(3)) for n in range(60)}


def frame(kind, values, good=True):
    body = bytes([0x55, kind]) + b"".join(v.to_bytes(2, "little", signed=True) for v in values)
    return body + bytes([(sum(body) + (0 if good else 1)) & 0xFF])


def dirty_stream(seed):
    """A byte stream with garbage between frames, cut into chunks at random, and its frames."""
    rng = random.Random(seed)
    stream = b""
    for n in range(60):
        stream += bytes(rng.choice([0x55, 0x00, 0xAA, 0x51]) for _ in range(rng.choice([0, 0, 1, 3])))
        stream += frame(rng.choice([0x51, 0x52, 0x53]), [rng.randint(-32768, 32767) for _ in range(4)], rng.random() > 0.2)
    chunks, rest, seq = [], stream, 0
    while rest:
        size = rng.choice([0, 1, 2, 5, 11, 30])
        chunks.append((1, seq, bytearray(rest[:size])))
        rest, seq = rest[size:], seq + 1
    expected, at = [], 0
    while True:
        at = stream.find(0x55, at)
        if at < 0 or at + 11 > len(stream):
            break
        expected.append((len(expected), at, stream[at:at + 11]))
        at += 11
    return chunks, expected


def test_frames_in_a_dirty_stream(spark):
    chunks, expected = dirty_stream(5)
    df = spark.createDataFrame(chunks, "device_id bigint, seq bigint, chunk binary")
    got = frame_chunks(df).orderBy("frame_no").collect()
    assert [(r.frame_no, r.offset, bytes(r.frame)) for r in got] == expected


def test_decoding(spark):
    frames = [frame(0x51, [2048, -2048, 0, 2512]), frame(0x52, [16384, 0, -32768, -100]), frame(0x53, [1, 2, 3, 4]),
              frame(0x51, [1, 2, 3, 4], good=False), b"\x55\x51"]
    df = spark.createDataFrame([(n, bytearray(f)) for n, f in enumerate(frames)], "seq int, frame binary")
    first, second = ex.decode_frames(df).orderBy("seq").collect()
    assert (first.type, round(first.x, 9), round(first.x_g, 9), first.temp) == ("accel", 9.8, 1.0, 25.12)
    assert (second.type, second.x, second.z, second.temp, second.x_g) == ("gyro", 1000.0, -2000.0, -1.0, None)


def test_a_frame_is_taken_apart_once(spark):
    """Random frames as Python reads them; each is turned into numbers once, not again in every filter and column."""
    rng = random.Random(4)
    rows = [(n, bytearray(frame(rng.choice([0x51, 0x52]), [rng.randint(-32768, 32767) for _ in range(4)], good=n % 7 > 0)))
            for n in range(200)]
    out = ex.decode_frames(spark.createDataFrame(rows, "seq int, frame binary"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("conv(") == 2
    got = {r.seq: (r.type, r.x, r.y, r.z, r.temp) for r in out.collect()}
    for n, data in rows:
        _, kind, *v, _ = struct.unpack("<BBhhhhB", data)
        scale = 16 * 9.8 / 32768 if kind == 0x51 else 2000 / 32768
        assert got.get(n) == ((("accel", "gyro")[kind - 0x51], *[pytest.approx(x * scale, rel=1e-12) for x in v[:3]], v[3] / 100)
                              if n % 7 else None)


def test_decoding_does_not_order_events(spark, tmp_path):
    rows = [(n, 3 if n % 2 else None, START, "view", None if n == 4 else n / 8, "{}") for n in range(40)]
    spark.createDataFrame(
        rows, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    out = catalog_predictions.decode_frames(spark, str(tmp_path))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.seq for r in out.collect()} == {n for n in range(40) if n % 5 != 4 and n % 17}


def prediction(**models):
    return {name: {"label": label, "confidence": c, "probs": None} for name, (label, c) in models.items()}


@pytest.mark.parametrize("models,ml,present,tied", [
    ({}, None, False, False),
    ({"cnn1d": ("Faulty", 0.9)}, None, True, True),
    ({"cnn1d": ("Faulty", 0.9), "lstm": ("Good", 0.8)}, None, False, True),
    ({"cnn1d": ("Faulty", 0.7), "lstm": ("Good", 0.8)}, None, False, False),
    ({"cnn1d": ("Faulty", 0.7), "lstm": ("Good", 0.7)}, None, False, False),
    ({"cnn1d": ("Faulty", 0.7), "lstm": ("Good", 0.8)}, ("Faulty", 0.1), False, True),
    ({"cnn1d": ("Faulty", 0.7), "lstm": ("Unknown", 0.8)}, None, False, False),
])
def test_votes(spark, models, ml, present, tied):
    schema = "predictions map<string, struct<label string, confidence double, probs array<double>>>, l string, c double"
    df = spark.createDataFrame([(prediction(**models), *(ml or (None, None)))], schema)
    row = df.select(votes.majority_present(F.col("predictions")).alias("p"),
                    votes.vote_with_confidence(F.col("predictions"), F.col("l"), F.col("c")).alias("t")).first()
    assert (row.p, row.t) == (present, tied)


def test_metrics_of_a_published_confusion_matrix(spark):
    cells = [(0, 0, 106), (0, 1, 4), (0, 2, 6), (1, 0, 2), (1, 1, 66), (1, 2, 9), (2, 0, 5), (2, 1, 1), (2, 2, 130)]
    report = {r.label: r for r in metrics.classification_report(
        spark.createDataFrame(cells, "y_true int, y_pred int, n bigint")).collect()}
    assert round(report["accuracy"].f1, 5) == 0.91793 and round(report["macro avg"].f1, 5) == 0.91431
    assert report["weighted avg"].support == 329


def test_metrics_at_the_edges(spark):
    same = spark.createDataFrame([(1, 1)] * 4, "u int, v int")
    assert metrics.adjusted_rand_index(same, "u", "v").first()[0] == 1.0
    assert metrics.normalized_mutual_info(same, "u", "v").first()[0] == 1.0
    histogram = metrics.true_class_prob_histogram(
        spark.createDataFrame([(0, [0.5, 0.5])] * 3, "y_true int, probs array<double>"))
    assert histogram.agg(F.sum("n"), F.count("n")).first()[:] == (3, 20)


def test_empty_report(spark):
    dl = spark.createDataFrame([], "ts timestamp, seq bigint, is_fault int, " + ", ".join(
        f"{m}_label string, {m}_confidence double" for m in ex.MODELS))
    ml = spark.createDataFrame([(START, 1, "Good", 0.5, 2.0)], "ts timestamp, seq bigint, label string, confidence double, total_time_ms double")
    summary, faults, text = reports.period_report(dl, ml, "2024-01-01 00:00:00", "2024-01-02 00:00:00", 24)
    assert set(summary.first().asDict().values()) == {0} and faults.count() == 0
    assert "No faults detected" in text.first().value


def test_group_folds(spark):
    rng = random.Random(2)
    sizes = {f"f{n}": rng.choice([1, 2, 2, 3, 5, 8, 40]) for n in range(60)} | {"hot": 400}
    df = spark.createDataFrame([(name, n) for name, size in sizes.items() for n in range(size)], "file string, n int")
    folded = splits.group_kfold(df, 4)
    assert folded.count() == sum(sizes.values())
    assert folded.groupBy("file").agg(F.countDistinct("fold").alias("c")).where("c > 1").count() == 0
    loads = [0] * 4
    for size in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    got = {r.fold: r.n for r in folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [got.get(k, 0) for k in range(4)] == loads
    with pytest.raises(ValueError):
        splits.group_kfold(df.where("file = 'hot'"), 4)


def test_other_splits(spark):
    df = spark.createDataFrame([(f"f{n % 11}", n, n % 3) for n in range(330)], "file string, id int, label int")
    held = splits.group_holdout(df, 0.25).where("holdout")
    assert held.select("file").distinct().count() == 3 and held.count() == 90
    folds = splits.stratified_kfold(df, 5, "label", ["id"]).groupBy("label", "fold").count().collect()
    assert len(folds) == 15 and {r["count"] for r in folds} == {22}
    share = splits.random_split(df, 0.8, ["id"]).where("train").count()
    assert 230 < share < 298
