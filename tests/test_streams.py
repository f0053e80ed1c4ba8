from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tremorgrid.operators import joins, votes
from tremorgrid.operators.ordered import reindex
from tremorgrid.streaming import predictions as sp
from tremorgrid.streaming import windows as sw

START = datetime(2024, 1, 1)


def stream_of(spark, df, folder, parts):
    """The rows in ``parts`` files, one micro-batch each, in time order."""
    rows = df.orderBy("ts").collect()
    size = -(-len(rows) // parts)
    for n in range(parts):
        chunk = spark.createDataFrame(rows[n * size:(n + 1) * size], df.schema)
        chunk.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def finish(spark, stream, folder):
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(folder / "checkpoint")).trigger(
        availableNow=True).start(str(folder / "out"))
    run.awaitTermination()
    assert len(run.recentProgress) > 1
    return spark.read.schema(stream.schema).parquet(str(folder / "out"))


@pytest.fixture(scope="module")
def packets(spark):
    rows = [(d, START + timedelta(seconds=n * 2 + d), n, ["accel", "gyro", "gyro", "accel", "angle"][n * (d + 3) % 5], float(n), n / 2)
            for d in range(2) for n in range(120)]
    return spark.createDataFrame(rows, "device_id bigint, ts timestamp, seq bigint, type string, v0 double, v1 double")


@pytest.mark.parametrize("pairing,every", [("latest", None), ("fresh", None), ("latest", 30.0)])
def test_windows_equal_the_batch(spark, packets, tmp_path, pairing, every):
    values = ["v0", "v1"]
    got = finish(spark, sw.stream_windows(stream_of(spark, packets, tmp_path / "in", 3), values, pairing, 6, every), tmp_path)
    names = [f"{s}_{v}" for s in "aw" for v in values]
    if pairing == "latest":
        pairs = reindex(joins.pair_carry_forward(packets, values), ["device_id"], "i", F.lit(True), "j")
    else:
        pairs = joins.pair_fresh(packets, values)
        pairs = pairs.drop("j").join(joins.ensure_index(pairs.drop("j")).withColumnRenamed("i", "j"), [c for c in pairs.columns if c != "j"])
    full = votes.rolling_buffer(pairs, names, 6, index="j")
    if every:
        full = votes.throttle(full, every, index="j")
    expected = {(r.device_id, r.seq): [[e[n] for e in r.buffer] for n in names] for r in full.collect()}
    assert expected and {(r.device_id, r.seq): [list(r[n]) for n in names] for r in got.collect()} == expected


def predictions(spark):
    def label(x):
        return "Faulty" if x else "Good"

    rows = [(d, START + timedelta(seconds=n * 3 + d), n, label(n % 5), 0.9, None if n % 4 == 0 else label(n % 3), None if n % 4 == 0 else 0.6,
             label(n % 7 > 2), 0.75) for d in range(2) for n in range(90)]
    return spark.createDataFrame(
        rows, "device_id bigint, ts timestamp, seq bigint, cnn1d_label string, cnn1d_confidence double, "
        "lstm_label string, lstm_confidence double, cnn2d_label string, cnn2d_confidence double")


def test_alerts_equal_the_batch(spark, tmp_path):
    from tremorgrid.functions.expressions import predictions_map

    dl = predictions(spark)
    got = finish(spark, sp.stream_alerts(stream_of(spark, dl, tmp_path / "in", 3), 3, 40.0), tmp_path)
    flagged = predictions_map(dl).withColumn("is_fault", votes.majority_present(F.col("predictions")))
    batch = votes.cooldown(votes.consecutive_faults(flagged), F.col("streak"), 40.0)
    expected = {(r.device_id, r.seq) for r in batch.collect()}
    assert expected and {(r.device_id, r.seq) for r in got.collect()} == expected
    assert got.where(~F.col("message").contains("3 consecutive fault")).count() == 0


def test_votes_equal_the_batch(spark, tmp_path):
    from tremorgrid.functions.expressions import predictions_map

    dl = predictions(spark)
    ml = dl.where("seq % 2 = 0").select(
        "device_id", F.timestamp_micros(F.unix_micros("ts") - F.col("seq") % 4 * 1_000_000).alias("ts"), "seq",
        F.when(F.col("seq") % 3 == 0, "Faulty").otherwise("Good").alias("label"), F.lit(0.8).alias("confidence"))
    stream = sp.stream_vote(stream_of(spark, dl, tmp_path / "dl", 1), stream_of(spark, ml, tmp_path / "ml", 1))
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True).start(str(tmp_path / "o"))
    run.awaitTermination()
    got = {(r.device_id, r.seq): (r.ml_label, r.is_fault) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    attached = joins.asof_ml_vote(predictions_map(dl), ml)
    batch = attached.withColumn("f", votes.vote_with_confidence(F.col("predictions"), F.col("ml_label"), F.col("ml_confidence")))
    assert got == {(r.device_id, r.seq): (r.ml_label, r.f) for r in batch.collect()}
    assert {label for label, _ in got.values()} == {None, "Good", "Faulty"}


def test_late_rows_are_processed_when_they_come(spark, packets, tmp_path):
    late = packets.where("seq < 5").withColumn("seq", F.col("seq") + 1000)
    (tmp_path / "in").mkdir()
    packets.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows = sw.stream_windows(stream, ["v0"], "latest", 6)

    def run():
        query = windows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(
            availableNow=True).start(str(tmp_path / "o"))
        query.awaitTermination()
        return spark.read.schema(windows.schema).parquet(str(tmp_path / "o"))

    before = run().count()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    after = run()
    gyro = late.where("type = 'gyro'").count()
    assert before > 0 and gyro > 0 and after.count() == before + gyro
    assert after.where("seq >= 1000").count() == gyro


def test_recent_rows_of_several_batches(spark, packets, tmp_path):
    rows = packets.select("device_id", "ts", "seq", "v0")
    written = finish(spark, sp.stream_recent(stream_of(spark, rows, tmp_path / "in", 4), ["v0"], 7), tmp_path)
    assert written.select("version").distinct().count() > 2
    got = sp.latest_version(written)
    assert {(r.device_id, r.seq, r.recency) for r in got.collect()} == {
        (d, 119 - n, n + 1) for d in range(2) for n in range(7)}


def test_frames_across_batches_equal_the_batch(spark, tmp_path):
    """Chunks cut at random over five micro-batches, for several devices, one of which sends no chunk in the first."""
    from tests.test_predictions import dirty_stream
    from tremorgrid.operators.frames import frame_chunks
    from tremorgrid.streaming.frames import stream_frames

    rows, expected = [], {}
    for device in (1, 2, 3):
        chunks, expected[device] = dirty_stream(device)
        late = len(chunks) // 2 if device == 3 else 0
        rows += [(device, START + timedelta(seconds=late + seq), seq, chunk) for _, seq, chunk in chunks]
    df = spark.createDataFrame(rows, "device_id bigint, ts timestamp, seq bigint, chunk binary")
    got = finish(spark, stream_frames(stream_of(spark, df, tmp_path / "in", 5)), tmp_path)
    for device in expected:
        mine = got.where(F.col("device_id") == device).orderBy("frame_no").collect()
        assert [(r.frame_no, r.offset, bytes(r.frame)) for r in mine] == expected[device]
    batch = {tuple(map(repr, r)) for r in frame_chunks(df.drop("ts")).collect()}
    assert {tuple(map(repr, r)) for r in got.collect()} == batch


@pytest.fixture(scope="module")
def networks(spark):
    """Three fitted pipelines and their numbers, by what they read."""
    from tremorgrid.operators import models, signals

    rows = [(n, [float((n * 7 + k * k) % 11) for k in range(8)], [float((n * 3 + k) % 5) for k in range(8)], n % 3) for n in range(60)]
    table = signals.stft_spectrogram(spark.createDataFrame(
        rows, "seq int, a_v0 array<double>, w_v0 array<double>, label_id int"), ["a_v0", "w_v0"], 4, 0.5)
    out = {}
    for kind in ("time", "spec", "hybrid"):
        ready = models.flatten_windows(table, kind, ["a_v0", "w_v0"])
        fitted = models.neural_network(models.vector_size(ready), [5], 3, maxIter=15).fit(ready)
        out[kind] = fitted, models.network_of(fitted), ready
    return out


@pytest.mark.parametrize("kind", ["time", "spec", "hybrid"])
def test_network_numbers_equal_the_pipeline(networks, kind):
    from pyspark.ml.functions import vector_to_array

    from tremorgrid.operators.models import network_probabilities

    fitted, network, ready = networks[kind]
    both = fitted.transform(ready).select(
        vector_to_array("probability").alias("p"), network_probabilities(network)(vector_to_array("features")).alias("q"))
    for row in both.collect():
        assert row.q == pytest.approx(row.p, abs=1e-9)


def test_models_on_one_stream_equal_the_batch(spark, packets, networks, tmp_path):
    """Throttled windows over four micro-batches, three networks and one that cannot take these windows."""
    values, names = ["v0"], ["a_v0", "w_v0"]
    used = {kind: (kind, networks[kind][1]) for kind in networks}
    odd = packets.withColumn("v0", F.when(F.col("seq") == 52, float("nan")).otherwise(F.col("v0")))
    windows = sw.stream_windows(stream_of(spark, odd, tmp_path / "in", 4), values, size=8, every_seconds=9.0)
    live = finish(spark, sw.multi_model_inference(windows, {**used, "broken": ("time", networks["spec"][1])}, names, 4), tmp_path)
    pairs = reindex(joins.pair_carry_forward(odd, values), ["device_id"], "i", F.lit(True), "j")
    full = votes.throttle(votes.rolling_buffer(pairs, names, 8, index="j"), 9.0, index="j")
    table = full.select("device_id", "ts", "seq", *[F.col(f"buffer.{n}").alias(n) for n in names])
    batch = sw.multi_model_inference(table, used, names, 4)
    read = lambda df: {(r.device_id, r.seq): r.predictions for r in df.collect()}
    got, want = read(live), read(batch)
    assert got.keys() == want.keys() and len(got) > 10
    for key, models in want.items():
        assert models.keys() == got[key].keys() == set(used)
        for name, result in models.items():
            assert got[key][name].label == result.label in ("Good", "Faulty", "Unknown")
            assert got[key][name].probs == pytest.approx(result.probs, abs=1e-12)
            assert result.confidence == max(result.probs)
    assert table.count() > len(want)  # windows with a missing value have no prediction


def test_only_changed_totals_are_written(spark, tmp_path):
    rows = [(d, START + timedelta(seconds=n), n, "gyro") for n in range(40) for d in ((0, 1, 2) if n < 10 else (n % 2,))]
    df = spark.createDataFrame(rows, "device_id bigint, ts timestamp, seq bigint, type string")
    counts = sp.stream_packet_counts(stream_of(spark, df, tmp_path / "in", 4))
    sp.write_changes(counts, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "o"))
    per_batch = {r["version"]: r["count"] for r in changes.groupBy("version").count().collect()}
    assert max(per_batch.values()) == 3 and per_batch[max(per_batch)] == 2
    latest = sp.latest_totals(changes, ["device_id"])
    want = {d: sum(r[0] == d for r in rows) for d in range(3)}
    assert {r.device_id: r.raw_packets for r in latest.collect()} == want
    again = changes.where("version = 1").drop("version").collect()  # a repeated batch replaces its own rows
    spark.createDataFrame(again, counts.schema).write.mode("overwrite").parquet(str(tmp_path / "o" / "version=1"))
    assert {r.device_id: r.raw_packets for r in sp.latest_totals(
        spark.read.parquet(str(tmp_path / "o")), ["device_id"]).collect()} == want


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_many_devices_share_groups(spark, tmp_path, kind):
    """The state has a row per bucket and not per device; every device, the null one too, keeps its own memory."""
    from tremorgrid.streaming.state import BUCKETS

    devices = [None, *range(BUCKETS + 200)]
    rows = [(d, START + timedelta(seconds=n), (1 << 60) + n, ["accel", "gyro"][n % 2], float((d or 0) * 10 + n)) for d in devices for n in range(8)]
    df = spark.createDataFrame(rows, "device_id bigint, ts timestamp, seq bigint, type string, v0 double")
    df = df.withColumn("device_id", F.col("device_id").cast(kind))
    windows = sw.stream_windows(stream_of(spark, df, tmp_path / "in", 2), ["v0"], size=3)
    run = windows.withColumn("sum", F.aggregate("a_v0", F.lit(0.0), lambda a, x: a + x)).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    run.awaitTermination()
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= BUCKETS
    got = {(r.device_id, r.seq - (1 << 60)): r.sum for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    named = {None: None} | {d: d if kind == "bigint" else str(d) for d in devices[1:]}
    assert got == {(named[d], n): 3.0 * ((d or 0) * 10) + 3 * (n - 3) for d in devices for n in (5, 7)}


def test_a_stream_begins_with_few_state_partitions(spark, packets, tmp_path):
    """A session's 200 partitions would be 200 tasks in every micro-batch, however few its rows."""
    from tremorgrid.streaming.state import STATE_PARTITIONS, begin

    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        windows = sw.stream_windows(stream_of(spark, packets, tmp_path / "in", 2), ["v0", "v1"], size=6)
        writer = windows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        run = begin(writer, spark, str(tmp_path / "o"))
        run.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
    many = run.lastProgress["stateOperators"][0]["numShufflePartitions"]
    assert many == max(STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism)
    per_device = {r.device_id: r["count"] for r in spark.read.parquet(str(tmp_path / "o")).groupBy("device_id").count().collect()}
    assert set(per_device) == {0, 1} and min(per_device.values()) > 6


def test_files_of_a_micro_batch_grow_with_the_table(spark, packets, monkeypatch):
    """More files a part, and still one part a micro-batch."""
    from tremorgrid.plans import catalog_streams as cs

    monkeypatch.setattr(cs, "FILE_ROWS", 40)
    cuts = cs.time_cuts(packets)
    rows = cs.finish(spark, cs.as_stream(spark, packets, cuts).withColumn("file", F.col("_metadata.file_path")))
    ts = F.unix_micros("ts")
    part = sum(F.when(ts >= c, 1).otherwise(0) for c in cuts)
    files = {r.part: r.files for r in rows.groupBy(part.alias("part")).agg(F.countDistinct("file").alias("files")).collect()}
    assert files == dict.fromkeys(range(cs.BATCHES), packets.count() // 40)
    assert rows.groupBy("file").agg(F.countDistinct(part).alias("n")).where("n > 1").count() == 0
