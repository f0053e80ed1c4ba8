"""Registered queries: expressions, packets, joins, votes, streaks, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorgrid.functions import expressions as ex
from tremorgrid.operators import features, joins, metrics, votes
from tremorgrid.operators.frames import frame_chunks
from tremorgrid.operators.ordered import previous, reindex
from tremorgrid.plans import fixtures as fx
from tremorgrid.plans import reports
from tremorgrid.plans.registry import query
from tremorgrid.session import cut

VALUES = ["v0", "v1", "v2"]


def us(name: str = "ts"):
    return F.unix_micros(name).alias("us")


# Expressions.

@query("src3_coerce_channels", """SELECT event_id AS seq,
  round(TRY_CAST(trim(CASE WHEN event_id % 7 = 0 THEN event_type WHEN event_id % 11 = 0 THEN '' ELSE concat('  ', CAST(value AS VARCHAR), ' ') END) AS DOUBLE), 6) AS x
  FROM events""")
def coerce_channels(spark, sf_dir):
    cell = F.when(F.col("seq") % 7 == 0, F.col("event_type")).when(F.col("seq") % 11 == 0, "").otherwise(
        F.concat(F.lit("  "), F.col("value").cast("string"), F.lit(" ")))
    return fx.events(spark, sf_dir).select("seq", F.round(ex.coerce_number(cell), 6).alias("x"))


@query("exp1_label_from_name", f"""WITH {fx.SQL_SERIES},
named AS (SELECT seq, CASE WHEN seq % 10 = 0 THEN concat('run_', device_id, '.csv') WHEN seq % 10 = 1 THEN upper(file) ELSE file END AS file FROM series)
SELECT seq, CASE WHEN contains(lower(file), 'good') THEN 'good' WHEN contains(lower(file), 'moderate') THEN 'moderate'
                 WHEN contains(lower(file), 'bad') THEN 'bad' ELSE 'unknown' END AS label FROM named""")
def label_from_name(spark, sf_dir):
    file = fx.file_name(F.col("device_id"))
    named = F.when(F.col("seq") % 10 == 0, F.concat(F.lit("run_"), F.col("device_id"), F.lit(".csv"))).when(
        F.col("seq") % 10 == 1, F.upper(file)).otherwise(file)
    return fx.events(spark, sf_dir).select("seq", ex.label_from_name(named).alias("label"))


@query("exp2_encode_label", """WITH named AS (SELECT event_id AS seq, CASE user_id % 4 WHEN 0 THEN 'Good' WHEN 1 THEN 'moderate' WHEN 2 THEN 'BAD' ELSE 'unknown' END AS label FROM events)
SELECT seq, CAST(CASE lower(label) WHEN 'good' THEN 0 WHEN 'moderate' THEN 1 WHEN 'bad' THEN 2 ELSE -1 END AS INT) AS code,
       CAST(CASE WHEN lower(label) IN ('moderate', 'bad') THEN 1 ELSE 0 END AS INT) AS binary_code FROM named""")
def encode_label(spark, sf_dir):
    d = F.col("device_id") % 4
    label = F.when(d == 0, "Good").when(d == 1, "moderate").when(d == 2, "BAD").otherwise("unknown")
    return fx.events(spark, sf_dir).select(
        "seq", ex.encode_label(label, lenient=True).alias("code"),
        ex.encode_label(label, binary=True, lenient=True).alias("binary_code"))


@query("exp3_channel_slug", """WITH named AS (SELECT event_id AS seq, concat(CASE event_id % 2 WHEN 0 THEN 'Acceleration ' ELSE 'Angular velocity ' END,
  upper(event_type), CASE event_id % 2 WHEN 0 THEN '(g)' ELSE '(°/s)' END) AS channel FROM events)
SELECT seq, replace(replace(replace(replace(replace(replace(lower(channel), '(°/s)', 'dps'), '(g)', 'g'), ' ', '_'), '(', ''), ')', ''), '/', '_') AS slug FROM named""")
def channel_slug(spark, sf_dir):
    even = F.col("seq") % 2 == 0
    channel = F.concat(F.when(even, "Acceleration ").otherwise("Angular velocity "), F.upper("event_type"),
                       F.when(even, "(g)").otherwise("(°/s)"))
    return fx.events(spark, sf_dir).select("seq", ex.channel_slug(channel).alias("slug"))


@query("exp4_parse_chip_time", """SELECT event_id AS seq, CASE WHEN event_id % 9 = 0 THEN NULL ELSE epoch_us(ts) END AS us FROM events""")
def parse_chip_time(spark, sf_dir):
    text = F.when(F.col("seq") % 9 == 0, "not a time").otherwise(
        F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("  ")))
    return fx.events(spark, sf_dir).select("seq", F.unix_micros(ex.parse_time(text)).alias("us"))


def _swapped(value):
    """The two low bytes of a number, exchanged."""
    return F.shiftleft(value.bitwiseAND(255), 8) + F.shiftright(value, 8).bitwiseAND(255)


def _frames(spark, sf_dir, rows=None):
    """Events as 11-byte frames; every 17th has a wrong checksum, every 5th type is neither."""
    n = F.col("seq")
    q = (F.col("value") * 100).cast("int").cast("bigint")
    kind = F.when(n % 5 == 4, 0x53).when(n % 2 == 0, ex.ACCEL_TYPE).otherwise(ex.GYRO_TYPE).cast("bigint")
    values = (q, F.expr("cast(value * 100 as int) div 2"), -q, F.lit(2500).cast("bigint"))
    named = {f"_v{k}": _swapped(v) for k, v in enumerate(values)}
    v = [F.col(c) for c in named]
    total = sum((x.bitwiseAND(255) + F.shiftright(x, 8) for x in v), kind + 0x55)
    check = (total + F.when(n % 17 == 0, 1).otherwise(0)).bitwiseAND(255)
    lead = F.shiftleft(F.lit(0x55).cast("bigint"), 40) + F.shiftleft(kind, 32) + F.shiftleft(v[0], 16) + v[1]
    rest = F.shiftleft(v[2], 24) + F.shiftleft(v[3], 8) + check
    whole = F.unhex(F.concat(F.hex(lead), F.lpad(F.hex(rest), 10, "0")))
    return (fx.series(spark, sf_dir) if rows is None else rows).withColumns(named).withColumn("frame", whole).drop(*named)


SQL_FRAMES = fx.SQL_SERIES + """, frames AS (
  SELECT device_id, seq, i, CASE WHEN seq % 5 = 4 THEN 'angle' WHEN seq % 2 = 0 THEN 'accel' ELSE 'gyro' END AS type,
    ((trunc(value * 100)::BIGINT + 32768) % 65536 + 65536) % 65536 - 32768 AS q0,
    ((trunc(value * 100)::BIGINT // 2 + 32768) % 65536 + 65536) % 65536 - 32768 AS q1,
    ((-trunc(value * 100)::BIGINT + 32768) % 65536 + 65536) % 65536 - 32768 AS q2 FROM series),
scaled AS (SELECT *, CASE type WHEN 'accel' THEN 16.0::DOUBLE * 9.8 / 32768 ELSE 2000.0::DOUBLE / 32768 END AS s FROM frames),
decoded AS (SELECT device_id, seq, i, type, round(q0 * s, 9) + 0.0 AS x, round(q1 * s, 9) + 0.0 AS y, round(q2 * s, 9) + 0.0 AS z,
    25.0::DOUBLE AS temp, CASE type WHEN 'accel' THEN round(q0 * s / 9.8::DOUBLE, 9) + 0.0 END AS x_g
  FROM scaled WHERE type <> 'angle' AND seq % 17 <> 0)"""


def _decoded(df):
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("x", "y", "z", "x_g")})


@query("exp5_decode_frames", f"WITH {SQL_FRAMES} SELECT device_id, seq, type, x, y, z, temp, x_g FROM decoded")
def decode_frames(spark, sf_dir):
    """A frame is decoded by itself, so the events are not put in order."""
    out = ex.decode_frames(_frames(spark, sf_dir, fx.events(spark, sf_dir)).select("device_id", "seq", "frame"))
    return _decoded(out).select("device_id", "seq", "type", "x", "y", "z", "temp", "x_g")


@query("exp6_frame_chunks", f"""WITH {SQL_FRAMES},
placed AS (SELECT device_id, i AS frame_no, seq, sum(11 + seq % 3) OVER (PARTITION BY device_id ORDER BY i) - 11 AS "offset" FROM frames)
SELECT p.device_id, p.frame_no, CAST(p."offset" AS BIGINT) AS "offset", type, x, y, z FROM placed p JOIN decoded d USING (device_id, seq)""")
def frame_chunks_query(spark, sf_dir):
    """Each frame follows up to two stray bytes and is cut after its fourth byte."""
    junk = F.unhex(F.repeat(F.lit("AA"), (F.col("seq") % 3).cast("int")))
    whole = _frames(spark, sf_dir).withColumn("_run", F.concat(junk, "frame"))
    chunks = whole.select("device_id", F.explode(F.array(
        F.struct((F.col("i") * 2).alias("seq"), F.substring("_run", 1, 4).alias("chunk")),
        F.struct((F.col("i") * 2 + 1).alias("seq"), F.expr("substring(_run, 5)").alias("chunk")))).alias("_c"))
    return decoded_frames(frame_chunks(chunks.select("device_id", "_c.seq", "_c.chunk")))


def decoded_frames(framed):
    return _decoded(ex.decode_frames(framed)).select("device_id", "frame_no", "offset", "type", "x", "y", "z")


SQL_STREAM_FRAMES = f"""WITH {SQL_FRAMES},
placed AS (SELECT device_id, i AS frame_no, seq, sum(11 + seq % 3) OVER (PARTITION BY device_id ORDER BY i) - 11 AS "offset",
                  max(i) OVER (PARTITION BY device_id) AS last FROM frames)
SELECT p.device_id, p.frame_no, CAST(p."offset" AS BIGINT) AS "offset", type, x, y, z FROM placed p JOIN decoded d USING (device_id, seq)
WHERE p.frame_no < last"""


def shifted_chunks(spark, sf_dir):
    """One chunk per event: the end of the frame before, up to two stray bytes, and the first four of this one."""
    junk = F.unhex(F.repeat(F.lit("AA"), (F.col("seq") % 3).cast("int")))
    head = F.concat(junk, F.substring("frame", 1, 4))
    placed = previous(_frames(spark, sf_dir), ["device_id"], "i", {"_before": F.expr("substring(frame, 5)")})
    return placed.select("device_id", "ts", "seq", F.concat(F.coalesce("_before", F.unhex(F.lit(""))), head).alias("chunk"))


@query("exp7_filter_packets", f"WITH {fx.SQL_PACKETS} SELECT device_id, seq, type FROM packets WHERE type IN ('accel', 'gyro')")
def filter_packets(spark, sf_dir):
    return ex.filter_packets(fx.packets(spark, sf_dir)).select("device_id", "seq", "type")


@query("exp8_nth_packet", f"""WITH {fx.SQL_PACKETS}, numbered AS (
  SELECT device_id, seq, type, row_number() OVER (PARTITION BY device_id, type ORDER BY i) - 1 AS nth FROM packets WHERE type <> 'angle')
SELECT * FROM numbered WHERE nth % 3 = 0""")
def nth_packet(spark, sf_dir):
    return votes.nth_packet(fx.packets(spark, sf_dir), 3).select("device_id", "seq", "type", "nth")


@query("exp9_clean_features", """SELECT event_id AS window_index, round(value, 6) AS f1, round(value / (1 + event_id % 5), 6) AS f3
FROM events WHERE event_id % 13 <> 0 AND event_id % 6 <> 0""")
def clean_features(spark, sf_dir):
    """Feature f2 is missing everywhere; some f1 are null and some f3 infinite."""
    n, v = F.col("seq"), F.col("value")
    raw = fx.events(spark, sf_dir).select(
        n.alias("window_index"), F.when(n % 13 == 0, None).otherwise(F.round(v, 6)).alias("f1"),
        F.lit(None).cast("double").alias("f2"),
        F.when(n % 6 == 0, float("inf")).otherwise(F.round(v / (1 + n % 5), 6)).alias("f3"))
    return features.clean_features(raw)


@query("exp10_split_meta_features", f"WITH {fx.SQL_VECTORS} SELECT file, window_index, samples[1] AS f1, samples[3] AS f3 FROM vectors")
def split_meta(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    wide = v.select(*[F.col("samples")[k].alias(f"f{k + 1}") for k in range(4)], "file", "window_index")
    return features.split_meta_features(wide, ["f1", "f3"])[0]


@query("exp11_top_class", f"""WITH {fx.SQL_EVAL}
SELECT seq, model, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS class, round(list_max(probs), 9) AS confidence,
  CASE list_position(probs, list_max(probs)) WHEN 1 THEN 'Good' WHEN 2 THEN 'Faulty' ELSE 'Unknown' END AS label,
  round(probs[y_pred + 1], 9) AS stated_confidence, CASE y_pred WHEN 0 THEN 'Good' ELSE 'Faulty' END AS stated_label FROM evals""")
def top_class(spark, sf_dir):
    df = fx.evaluations(spark, sf_dir)
    top, stated = ex.top_class(F.col("probs")), ex.predicted_class(F.col("y_pred"), F.col("probs"))
    return df.select("seq", "model", top["class"].alias("class"), F.round(top["confidence"], 9).alias("confidence"),
                     top["label"].alias("label"), F.round(stated["confidence"], 9).alias("stated_confidence"),
                     stated["label"].alias("stated_label"))


@query("exp12_flatten_predictions", f"""WITH {fx.SQL_DL}
SELECT device_id, seq, cnn1d_label, round(cnn1d_confidence, 6) AS cnn1d_confidence, lstm_label, round(lstm_confidence, 6) AS lstm_confidence,
       cnn2d_label, round(cnn2d_confidence, 6) AS cnn2d_confidence, printf('%s (%.2f)', cnn1d_label, cnn1d_confidence) AS text FROM dl""")
def flatten_predictions(spark, sf_dir):
    wide = ex.flatten_predictions(fx.dl_map(spark, sf_dir)).drop("i", "ts")
    text = ex.prediction_text(F.col("cnn1d_label"), F.col("cnn1d_confidence"))
    return wide.withColumn("text", text).withColumns({f"{m}_confidence": F.round(f"{m}_confidence", 6) for m in ex.MODELS})


@query("exp12_explode_predictions", f"""WITH {fx.SQL_DL},
each AS (SELECT device_id, seq, 'cnn1d' AS model, cnn1d_label AS label, cnn1d_confidence AS confidence FROM dl
         UNION ALL SELECT device_id, seq, 'lstm', lstm_label, lstm_confidence FROM dl WHERE lstm_label IS NOT NULL
         UNION ALL SELECT device_id, seq, 'cnn2d', cnn2d_label, cnn2d_confidence FROM dl)
SELECT device_id, seq, model, label, round(confidence, 6) AS confidence FROM each""")
def explode_predictions(spark, sf_dir):
    out = ex.explode_predictions(fx.dl_map(spark, sf_dir)).drop("i", "ts")
    return out.withColumn("confidence", F.round("confidence", 6))


SQL_ALERT_TEXT = """concat('⚠️ **FAULT DETECTED** ⚠️', chr(10), chr(10), '**3 consecutive fault predictions detected!**', chr(10), chr(10),
    '**Time**: ', strftime({at}, '%Y-%m-%d %H:%M:%S'), chr(10), chr(10), '**Model Results**:', chr(10),
    printf('  • CNN1D: %s (%.1f%%)', cnn1d_label, cnn1d_confidence * 100), chr(10),
    CASE WHEN lstm_label IS NULL THEN '' ELSE concat(printf('  • LSTM: %s (%.1f%%)', lstm_label, lstm_confidence * 100), chr(10)) END,
    printf('  • CNN2D: %s (%.1f%%)', cnn2d_label, cnn2d_confidence * 100),
    {ml}chr(10), chr(10), '**Recommendation**: Inspect equipment immediately.', chr(10))"""


@query("exp13_alert_message", f"WITH {fx.SQL_DL} SELECT device_id, seq, " + SQL_ALERT_TEXT.format(
    at="ts", ml="CASE WHEN seq % 3 = 0 THEN concat(chr(10), '  • ML (RF-20): Faulty (75.0%) - 2.5ms') ELSE '' END, ") + " AS message FROM votes WHERE faults * 2 > present")
def alert_message(spark, sf_dir):
    df = fx.dl_map(spark, sf_dir).where(votes.majority_present(F.col("predictions")))
    extra = F.when(F.col("seq") % 3 == 0, F.struct(
        F.lit("Faulty").alias("label"), F.lit(0.75).alias("confidence"), F.lit(2.5).alias("total_ms")))
    return df.select("device_id", "seq", ex.alert_message(F.col("predictions"), F.col("ts"), 3, extra).alias("message"))


# Joins.

SQL_PAIRS = """paired AS (
  SELECT *, last_value(CASE WHEN type = 'accel' THEN seq END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY i) AS aseq FROM packets),
pairs AS (SELECT g.device_id, g.ts, g.us, g.seq, g.i, a.v0 AS a_v0, a.v1 AS a_v1, a.v2 AS a_v2, g.v0 AS w_v0, g.v1 AS w_v1, g.v2 AS w_v2
          FROM paired g JOIN packets a ON a.seq = g.aseq WHERE g.type = 'gyro')"""


@query("join1_pair_carry_forward", f"WITH {fx.SQL_PACKETS}, {SQL_PAIRS} SELECT device_id, seq, a_v0, a_v2, w_v0, w_v1 FROM pairs")
def pair_carry_forward(spark, sf_dir):
    return joins.pair_carry_forward(fx.packets(spark, sf_dir), VALUES).select(
        "device_id", "seq", "a_v0", "a_v2", "w_v0", "w_v1")


# One packet of every device per step: what is pending, and whether this packet completed a pair.
SQL_FRESH = """sensor AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY i) - 1 AS j FROM packets WHERE type <> 'angle'),
walk AS (
  SELECT device_id, j, seq, us, CASE WHEN type = 'accel' THEN v0 END AS pa, CASE WHEN type = 'gyro' THEN v0 END AS pw, false AS done,
         NULL::DOUBLE AS a, NULL::DOUBLE AS w FROM sensor WHERE j = 0
  UNION ALL
  SELECT device_id, j, seq, us, CASE WHEN na IS NOT NULL AND nw IS NOT NULL THEN NULL ELSE na END,
         CASE WHEN na IS NOT NULL AND nw IS NOT NULL THEN NULL ELSE nw END, na IS NOT NULL AND nw IS NOT NULL, na, nw
  FROM (SELECT s.device_id, s.j, s.seq, s.us, CASE WHEN s.type = 'accel' THEN s.v0 ELSE k.pa END AS na,
               CASE WHEN s.type = 'gyro' THEN s.v0 ELSE k.pw END AS nw
        FROM walk k JOIN sensor s ON s.device_id = k.device_id AND s.j = k.j + 1))"""


@query("join2_pair_fresh", f"WITH RECURSIVE {fx.SQL_PACKETS}, {SQL_FRESH} SELECT device_id, seq, a AS a_v0, w AS w_v0 FROM walk WHERE done")
def pair_fresh(spark, sf_dir):
    return joins.pair_fresh(fx.packets(spark, sf_dir), VALUES).select("device_id", "seq", "a_v0", "w_v0")


def _asof_sql(window_us: int) -> str:
    return f"""latest AS (
  SELECT v.*, CASE WHEN v.us - m.us < {window_us} THEN m.label END AS ml_label,
         CASE WHEN v.us - m.us < {window_us} THEN m.confidence END AS ml_confidence,
         CASE WHEN v.us - m.us < {window_us} THEN m.total_time_ms END AS ml_total_time_ms
  FROM votes v ASOF LEFT JOIN ml m ON v.device_id = m.device_id AND v.us >= m.us)"""


@query("join3_asof_ml_vote", f"WITH {fx.SQL_DL}, {fx.SQL_ML}, {_asof_sql(2_000_000)} SELECT device_id, seq, ml_label, round(ml_confidence, 6) AS ml_confidence FROM latest")
def asof_ml_vote(spark, sf_dir):
    out = joins.asof_ml_vote(fx.dl_wide(spark, sf_dir), fx.ml(spark, sf_dir))
    return out.select("device_id", "seq", "ml_label", F.round("ml_confidence", 6).alias("ml_confidence"))


@query("join4_recent_ml_for_alert", f"""WITH {fx.SQL_DL}, {fx.SQL_ML}, {_asof_sql(2_500_000)}
SELECT device_id, seq, ml_label, ml_total_time_ms FROM latest WHERE faults * 2 > present""")
def recent_ml_for_alert(spark, sf_dir):
    alerts = fx.dl_map(spark, sf_dir).where(votes.majority_present(F.col("predictions"))).select("device_id", "ts", "seq", "i")
    out = joins.recent_ml_for_alert(alerts, fx.ml(spark, sf_dir), ["label", "confidence", "total_time_ms"], 2.5)
    return out.select("device_id", "seq", "ml_label", "ml_total_time_ms")


SQL_REPEATED = fx.SQL_ML + """, repeated AS (SELECT * FROM ml UNION ALL
  SELECT device_id, us, seq + 1000000, CASE label WHEN 'Good' THEN 'Faulty' ELSE 'Good' END, confidence, total_time_ms FROM ml WHERE seq % 20 = 0),
labels AS (SELECT us, arg_min(label, seq) AS ml_label FROM repeated GROUP BY us)"""


@query("join5_ml_label_by_timestamp", f"""WITH {fx.SQL_DL}, {SQL_REPEATED}
SELECT device_id, seq, coalesce(ml_label, 'N/A') AS ml_label FROM dl LEFT JOIN labels USING (us)""")
def ml_label_by_timestamp(spark, sf_dir):
    out = joins.ml_label_by_timestamp(fx.dl_wide(spark, sf_dir), fx.ml_repeated(spark, sf_dir))
    return out.select("device_id", "seq", "ml_label")


@query("join6_group_ids", f"WITH {fx.SQL_SERIES} SELECT file, i, dense_rank() OVER (ORDER BY file) - 1 AS group_id FROM series")
def group_ids(spark, sf_dir):
    return joins.group_ids(fx.rec_single(spark, sf_dir).select("file", "i"))


# Votes.

@query("vote1_majority_three", f"WITH {fx.SQL_DL} SELECT device_id, seq, faults > 1.5 AS is_fault FROM votes")
def majority_three(spark, sf_dir):
    labels = [F.col(f"{m}_label") for m in ex.MODELS]
    return fx.dl_wide(spark, sf_dir).select("device_id", "seq", votes.majority_three(labels).alias("is_fault"))


@query("vote2_majority_present", f"WITH {fx.SQL_DL} SELECT device_id, seq, faults * 2 > present AS is_fault FROM votes")
def majority_present(spark, sf_dir):
    return fx.dl_map(spark, sf_dir).select("device_id", "seq", votes.majority_present(F.col("predictions")).alias("is_fault"))


SQL_VOTED = f"""{fx.SQL_DL}, {fx.SQL_ML}, {_asof_sql(2_000_000)},
ballots AS (
  SELECT device_id, seq, unnest([cnn1d_label, lstm_label, cnn2d_label, ml_label]) AS label,
         unnest([cnn1d_confidence, lstm_confidence, cnn2d_confidence, ml_confidence]) AS confidence FROM latest),
tally AS (SELECT device_id, seq, count(*) FILTER (label = 'Faulty') AS f, count(*) FILTER (label = 'Good') AS g,
                 coalesce(avg(confidence) FILTER (label = 'Faulty'), 0) AS fc, coalesce(avg(confidence) FILTER (label = 'Good'), 0) AS gc
          FROM ballots GROUP BY ALL),
voted AS (SELECT device_id, seq, CASE WHEN f <> g THEN f > g ELSE round(fc - gc, 9) > 0 END AS is_fault FROM tally)"""


def voted(spark, sf_dir):
    attached = joins.asof_ml_vote(fx.dl_map(spark, sf_dir), fx.ml(spark, sf_dir))
    return attached.withColumn(
        "is_fault", votes.vote_with_confidence(F.col("predictions"), F.col("ml_label"), F.col("ml_confidence")))


@query("vote3_vote_with_confidence", f"WITH {SQL_VOTED} SELECT * FROM voted")
def vote_with_confidence(spark, sf_dir):
    return voted(spark, sf_dir).select("device_id", "seq", "is_fault")


@query("vote4_agreement", f"""WITH {fx.SQL_DL}
SELECT device_id, seq, cnn1d_label IS NOT DISTINCT FROM lstm_label AND lstm_label IS NOT DISTINCT FROM cnn2d_label AS agreed FROM dl""")
def agreement(spark, sf_dir):
    return fx.dl_wide(spark, sf_dir).select("device_id", "seq", votes.agreement(votes.model_labels()).alias("agreed"))


# Rolling state.

@query("win1_rolling_buffer", f"""WITH {fx.SQL_PACKETS}, {SQL_PAIRS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY i) - 1 AS j FROM pairs),
rolled AS (SELECT device_id, seq, j, sum(a_v0 * (j + 1)) OVER w AS weighted, sum(w_v0) OVER w AS total
           FROM numbered WINDOW w AS (PARTITION BY device_id ORDER BY j ROWS 19 PRECEDING))
SELECT device_id, seq, round(weighted, 6) AS weighted, round(total, 6) AS total FROM rolled WHERE j >= 19""")
def rolling_buffer(spark, sf_dir):
    out = rolling_pairs(spark, sf_dir)
    weighted = F.aggregate("buffer", F.lit(0.0), lambda s, e: s + e["a_v0"] * (e["j"] + 1))
    total = F.aggregate("buffer", F.lit(0.0), lambda s, e: s + e["w_v0"])
    return out.select("device_id", "seq", F.round(weighted, 6).alias("weighted"), F.round(total, 6).alias("total"))


def rolling_pairs(spark, sf_dir):


    pairs = joins.pair_carry_forward(fx.packets(spark, sf_dir), VALUES)
    numbered = fx.stored(spark, sf_dir, "pairs", lambda: cut(reindex(pairs, joins.DEVICE, "i", F.lit(True), "j")))
    return votes.rolling_buffer(numbered, ["j", *[f"{s}_{v}" for s in "aw" for v in VALUES]], index="j")


def flagged(spark, sf_dir):
    return fx.dl_map(spark, sf_dir).withColumn("is_fault", votes.majority_present(F.col("predictions")))


SQL_STREAK = """streaks AS (
  SELECT *, min(CASE WHEN faults * 2 > present THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY i ROWS 2 PRECEDING) = 1 AND i >= 2 AS streak FROM votes)"""


@query("win2_consecutive_faults", f"WITH {fx.SQL_DL}, {SQL_STREAK} SELECT device_id, seq, streak FROM streaks")
def consecutive_faults(spark, sf_dir):
    return votes.consecutive_faults(flagged(spark, sf_dir)).select("device_id", "seq", "streak")


def _greedy_sql(gap_us: int) -> str:
    """Each step finds, for every device, the first candidate far enough after the last one taken."""
    return f"""taken AS (
  SELECT device_id, min(us) AS us FROM candidates GROUP BY device_id
  UNION ALL
  SELECT t.device_id, min(c.us) FROM taken t JOIN candidates c ON c.device_id = t.device_id AND c.us >= t.us + {gap_us} GROUP BY t.device_id, t.us)"""


COOLDOWN_SECONDS, THROTTLE_SECONDS = 86_400, 43_200


@query("win3_cooldown", f"""WITH RECURSIVE {fx.SQL_DL}, {SQL_STREAK}, candidates AS (SELECT device_id, us FROM streaks WHERE streak),
{_greedy_sql(COOLDOWN_SECONDS * 1_000_000)} SELECT device_id, us FROM taken""")
def cooldown(spark, sf_dir):
    candidates = votes.consecutive_faults(flagged(spark, sf_dir))
    return votes.cooldown(candidates, F.col("streak"), COOLDOWN_SECONDS).select("device_id", us())


@query("win4_throttle", f"""WITH RECURSIVE {fx.SQL_PACKETS}, {SQL_PAIRS},
numbered AS (SELECT device_id, us, row_number() OVER (PARTITION BY device_id ORDER BY i) - 1 AS j FROM pairs),
candidates AS (SELECT device_id, us FROM numbered WHERE j >= 19),
{_greedy_sql(THROTTLE_SECONDS * 1_000_000 + 1)} SELECT device_id, us FROM taken""")
def throttle(spark, sf_dir):
    full = rolling_pairs(spark, sf_dir).select("device_id", "ts", "seq", "j")
    return votes.throttle(full, THROTTLE_SECONDS, index="j").select("device_id", us())


@query("top2_recent_predictions", f"""WITH {fx.SQL_DL}
SELECT device_id, seq, recency FROM (SELECT device_id, seq, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) AS recency FROM dl)
WHERE recency <= 5""")
def recent_predictions(spark, sf_dir):
    out = votes.recent_rows(fx.dl_wide(spark, sf_dir), 5)
    return out.select("device_id", "seq", F.col("recency").cast("bigint").alias("recency"))


@query("agg3_stream_counts", f"""WITH {fx.SQL_PACKETS}
SELECT device_id, count(*) AS raw_packets, count(*) FILTER (type = 'accel') AS accel_packets, count(*) FILTER (type = 'gyro') AS gyro_packets,
       0::BIGINT AS predictions FROM packets GROUP BY device_id""")
def stream_counts(spark, sf_dir):
    return metrics.stream_counts(fx.packets(spark, sf_dir))


@query("agg4_running_fault_rate", f"""WITH {fx.SQL_DL}, running AS (
  SELECT device_id, seq, count(*) OVER w AS predictions, CAST(sum((faults > 1.5)::INT) OVER w AS BIGINT) AS faults
  FROM votes WINDOW w AS (PARTITION BY device_id ORDER BY i))
SELECT *, round(faults / predictions * 100, 6) AS fault_rate FROM running""")
def running_fault_rate(spark, sf_dir):
    out = votes.running_fault_rate(fx.dl_log(spark, sf_dir).withColumn("is_fault", F.col("is_fault") == 1))
    return out.select("device_id", "seq", F.col("predictions").cast("bigint").alias("predictions"),
                      F.col("faults").cast("bigint").alias("faults"), F.round("fault_rate", 6).alias("fault_rate"))


# Reports.

SQL_SUMMARY = """l AS (SELECT count(*) AS total_predictions, CAST(count(*) FILTER (faults > 1.5) AS BIGINT) AS fault_count,
    round(count(*) FILTER (faults > 1.5) / count(*) * 100, 2) AS fault_rate, count(*) FILTER (faults <= 1.5) AS good_count,
    round(count(*) FILTER (cnn1d_label IS NOT DISTINCT FROM lstm_label AND lstm_label IS NOT DISTINCT FROM cnn2d_label) / count(*) * 100, 2) AS agreement_rate,
    round(avg(cnn1d_confidence), 3) AS cnn1d_avg_confidence, round(avg(lstm_confidence), 3) AS lstm_avg_confidence,
    round(avg(cnn2d_confidence), 3) AS cnn2d_avg_confidence FROM votes),
r AS (SELECT count(*) AS ml_total_predictions, round(avg(confidence), 3) AS ml_avg_confidence, round(avg(total_time_ms), 2) AS ml_avg_time_ms FROM ml)"""


@query("agg1_report_summary", f"WITH {fx.SQL_DL}, {fx.SQL_ML}, {SQL_SUMMARY} SELECT * FROM l, r")
def report_summary(spark, sf_dir):
    return reports.report_summary(fx.dl_log(spark, sf_dir), fx.ml(spark, sf_dir))


SQL_FAULTS = f"""{fx.SQL_DL}, {SQL_REPEATED},
newest AS (SELECT * FROM votes WHERE faults > 1.5 ORDER BY ts DESC, seq DESC LIMIT 10),
recent AS (SELECT n.*, coalesce(l.ml_label, 'N/A') AS ml_label FROM newest n LEFT JOIN labels l USING (us))"""


@query("top1_recent_faults", f"WITH {SQL_FAULTS} SELECT us, seq, cnn1d_label, lstm_label, cnn2d_label, ml_label FROM recent")
def recent_faults(spark, sf_dir):
    out = reports.recent_faults(fx.dl_log(spark, sf_dir), fx.ml_repeated(spark, sf_dir))
    return out.select(us(), "seq", "cnn1d_label", "lstm_label", "cnn2d_label", "ml_label")


SQL_FAULT_TEXTS = f"""{SQL_FAULTS},
lines AS (SELECT row_number() OVER (ORDER BY ts DESC, seq DESC) AS r, * FROM recent),
texts AS (SELECT r, concat(chr(10), '**', r, '. ', strftime(ts, '%Y-%m-%d %H:%M:%S'), '**', chr(10), '  - CNN1D: ', cnn1d_label, chr(10),
    '  - LSTM: ', coalesce(lstm_label, 'None'), chr(10), '  - CNN2D: ', cnn2d_label, chr(10),
    CASE WHEN ml_label = 'N/A' THEN '' ELSE concat('  - ML (RF-20): ', ml_label, chr(10)) END) AS t FROM lines)"""


@query("exp14_report_text", f"WITH {SQL_FAULT_TEXTS} SELECT string_agg(t, '' ORDER BY r) AS faults FROM texts")
def report_text(spark, sf_dir):
    dl, ml = fx.dl_log(spark, sf_dir), fx.ml_repeated(spark, sf_dir)
    text = reports.report_text(reports.report_summary(dl, ml), reports.recent_faults(dl, ml), "start", "end", 24)
    listed = F.substring_index(F.substring_index("value", "## Recent Fault Detections\n\n", -1), reports.FOOTER, 1)
    return text.select(listed.alias("faults"))


@query("exp14_report_whole", f"""WITH {SQL_FAULT_TEXTS}, {SQL_SUMMARY}
SELECT concat('# Condition Report', chr(10), chr(10), '**Report Period**: start to end', chr(10), '**Duration**: 24 hours', chr(10), chr(10),
  '---', chr(10), chr(10), '## Summary Statistics', chr(10), chr(10), '- **Total Predictions**: ', total_predictions, chr(10),
  '- **Fault Detections**: ', fault_count, ' (', fault_rate, '%)', chr(10),
  '- **Good Detections**: ', good_count, printf(' (%.2f%%)', 100 - fault_rate), chr(10),
  '- **Model Agreement Rate**: ', agreement_rate, '%', chr(10), chr(10), '---', chr(10), chr(10),
  '## Model Performance', chr(10), chr(10), '### Deep Learning Models', chr(10), '| Model | Avg Confidence |', chr(10),
  '|-------|----------------|', chr(10), printf('| CNN1D | %.1f%% |', cnn1d_avg_confidence * 100), chr(10),
  printf('| LSTM  | %.1f%% |', lstm_avg_confidence * 100), chr(10), printf('| CNN2D | %.1f%% |', cnn2d_avg_confidence * 100), chr(10), chr(10),
  '### Machine Learning Model (RF-20)', chr(10), '- **Total Predictions**: ', ml_total_predictions, chr(10),
  printf('- **Avg Confidence**: %.1f%%', ml_avg_confidence * 100), chr(10), printf('- **Avg Inference Time**: %.2fms', ml_avg_time_ms),
  chr(10), chr(10), '---', chr(10), chr(10), '## Recent Fault Detections', chr(10), chr(10),
  (SELECT string_agg(t, '' ORDER BY r) FROM texts), chr(10), '---', chr(10), chr(10), '*Generated by tremorgrid*') AS report FROM l, r""")
def report_whole(spark, sf_dir):
    """The whole rendered report."""
    dl = fx.dl_log(spark, sf_dir)
    faults = reports.recent_faults(dl, fx.ml_repeated(spark, sf_dir))
    summary = reports.report_summary(dl, fx.ml(spark, sf_dir))
    return reports.report_text(summary, faults, "start", "end", 24).select(F.col("value").alias("report"))


