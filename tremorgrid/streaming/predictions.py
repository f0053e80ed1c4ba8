"""Votes, alerts, logs and monitors over prediction streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import MODELS, alert_message, predictions_map
from tremorgrid.operators.metrics import stream_counts
from tremorgrid.operators.ordered import null_safe_join
from tremorgrid.operators.votes import majority_present, vote_with_confidence
from tremorgrid.sources.logs import append_log, dl_log_rows, ml_log_rows
from tremorgrid.streaming.state import Rows, begin, stateful, walk

_WIDE = [f"{m}_{part}" for m in MODELS for part in ("label", "confidence")]
_WIDE_SCHEMA = ", ".join(f"{c} {'string' if c.endswith('label') else 'double'}" for c in _WIDE)


def stream_vote(dl: DataFrame, ml: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Vote on each multi-model prediction together with the latest single-model one if recent.

    Both streams are one union, so "latest" means what it means in a table; the vote itself is an
    expression evaluated in the JVM.
    """
    left = dl.select("device_id", "ts", "seq", F.lit(1).alias("_side"), *_WIDE,
                     F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"))
    right = ml.select("device_id", "ts", "seq", F.lit(0).alias("_side"),
                      *[F.lit(None).cast("string" if c.endswith("label") else "double").alias(c) for c in _WIDE],
                      "label", "confidence")

    def step(memory: dict, rows: Rows) -> dict | None:
        micros, is_ml = rows["_us"], rows["_side"] == 0
        at = np.maximum.accumulate(np.where(is_ml, np.arange(len(is_ml)), -1))
        old = memory.get("ml") or [None, None, None]
        mine = np.flatnonzero(~is_ml)
        source = at[mine]
        times = np.where(source >= 0, micros[np.maximum(source, 0)], old[0] if old[0] is not None else -(1 << 60))
        recent = micros[mine] - times < seconds * 1e6
        label, confidence = rows["label"], rows["confidence"]
        if at[-1] >= 0:
            memory["ml"] = [int(micros[at[-1]]), label[at[-1]], float(confidence[at[-1]])]
        return {**{c: rows[c][mine] for c in ("ts", "seq", *_WIDE)}, "ml_label": [
            (label[s] if s >= 0 else old[1]) if ok else None for s, ok in zip(source, recent)],
            "ml_confidence": np.array(
                [(confidence[s] if s >= 0 else old[2]) if ok else np.nan for s, ok in zip(source, recent)], dtype=float)}

    schema = f"ts timestamp, seq bigint, {_WIDE_SCHEMA}, ml_label string, ml_confidence double"
    joined = predictions_map(stateful(left.unionByName(right), step, schema, order=("_us", "_side", "seq")))
    ml_confidence = F.when(F.col("ml_label").isNotNull(), F.col("ml_confidence"))
    return joined.withColumn("ml_confidence", ml_confidence).withColumn(
        "is_fault", vote_with_confidence(F.col("predictions"), F.col("ml_label"), ml_confidence))


_ML = {"ml_label": "string", "ml_confidence": "double", "ml_total_time_ms": "double"}


def stream_alerts(
    dl: DataFrame, threshold: int = 3, cooldown_seconds: float = 300.0, ml: DataFrame | None = None,
    ml_seconds: float = 5.0,
) -> DataFrame:
    """Alerts after ``threshold`` consecutive faults, at most one per cooldown; the streak goes on.

    With ``ml``, single-model predictions in one union with the others, an alert also tells the latest one
    if it is less than ``ml_seconds`` older.
    """
    gap = max(1, round(cooldown_seconds * 1_000_000))
    voted = predictions_map(dl.select("device_id", "ts", "seq", *_WIDE, *[F.col(c).alias(f"_{c}") for c in _WIDE]))
    rows = voted.select(
        "device_id", "ts", "seq", F.lit(1).alias("_side"), majority_present(F.col("predictions")).alias("is_fault"),
        *[F.col(f"_{c}").alias(c) for c in _WIDE], *[F.lit(None).cast(t).alias(c) for c, t in _ML.items()])
    if ml is not None:
        rows = rows.unionByName(ml.select(
            "device_id", "ts", "seq", F.lit(0).alias("_side"), F.lit(False).alias("is_fault"),
            *[F.lit(None).cast("string" if c.endswith("label") else "double").alias(c) for c in _WIDE],
            *[F.col(c.removeprefix("ml_")).alias(c) for c in _ML]))

    def step(memory: dict, rows: Rows) -> dict | None:
        micros, is_ml = rows["_us"], rows["_side"] == 0
        at = np.maximum.accumulate(np.where(is_ml, np.arange(len(is_ml)), -1))
        old = memory.get("ml")
        told = lambda n: [rows[c][n] for c in _ML]
        if at[-1] >= 0:
            label, *numbers = told(at[-1])
            memory["ml"] = [int(micros[at[-1]]), label, *map(float, numbers)]
        mine = np.flatnonzero(~is_ml)
        if not len(mine):
            return None
        fault = rows["is_fault"][mine].astype(bool)
        n = np.arange(len(fault))
        broken = np.maximum.accumulate(np.where(fault, -1, n))
        streak = np.where(broken >= 0, n - broken, n + 1 + memory.get("streak", 0))
        memory["streak"] = int(min(streak[-1], threshold))
        candidates = mine[fault & (streak >= threshold)]
        taken, memory["alerted"] = walk(micros[candidates], memory.get("alerted"), gap)
        if not taken:
            return None
        chosen = candidates[taken]
        latest = [(int(micros[at[c]]), *told(at[c])) if at[c] >= 0 else old for c in chosen]
        recent = [m[1:] if m and micros[c] - m[0] < ml_seconds * 1e6 else (None, None, None) for m, c in zip(latest, chosen)]
        out = {c: rows[c][chosen] for c in ("ts", "seq", *_WIDE)}
        for k, (name, kind) in enumerate(_ML.items()):
            values = [m[k] for m in recent]
            out[name] = values if kind == "string" else np.array(values, dtype=float)
        return out

    schema = f"ts timestamp, seq bigint, {_WIDE_SCHEMA}, " + ", ".join(f"{c} {t}" for c, t in _ML.items())
    alerts = predictions_map(stateful(rows, step, schema, order=("_us", "_side", "seq")))
    told = F.when(F.col("ml_label").isNotNull(), F.struct(
        F.col("ml_label").alias("label"), F.col("ml_confidence").alias("confidence"),
        F.col("ml_total_time_ms").alias("total_ms")))
    return alerts.withColumn("message", alert_message(F.col("predictions"), F.col("ts"), threshold, told)).drop(*_ML)


def stream_log(dl: DataFrame, ml: DataFrame, directory: str, checkpoints: str) -> list:
    """Start one logging query per topic; each appends to a date-partitioned table exactly once."""
    return [
        append_log(dl_log_rows(dl), f"{directory}/predictions", f"{checkpoints}/predictions"),
        append_log(ml_log_rows(ml), f"{directory}/ml_predictions", f"{checkpoints}/ml_predictions"),
    ]


def stream_packet_counts(packets: DataFrame) -> DataFrame:
    return stream_counts(packets)


def stream_fault_totals(voted: DataFrame, fault: str = "is_fault") -> DataFrame:
    """Predictions, faults and fault rate of each device so far (update or complete mode)."""
    faults = F.count_if(F.col(fault))
    return voted.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("predictions"), faults.alias("faults"),
        (faults / F.count(F.lit(1)) * 100).alias("fault_rate"))


def write_changes(totals: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps running totals as a table of changes: what each micro-batch changed, with its number.

    Rows written grow with the devices a micro-batch touches and not with all devices there are. A batch that is
    repeated replaces its own rows and changes nothing else. ``latest_totals`` reads the totals back.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    writer = totals.writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True)
    return begin(writer, totals.sparkSession)


def latest_totals(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that ``write_changes`` wrote, each key's last; combined on the map side."""
    others = [c for c in changes.columns if c not in (*keys, "version")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def latest_version(recent: DataFrame) -> DataFrame:
    """Of the rows that ``stream_recent`` wrote, those of each device's last micro-batch."""
    last = recent.groupBy("device_id").agg(F.max("version").alias("_last"))
    return null_safe_join(recent, last, ["device_id"]).where("version = _last").drop("_last", "version")


def stream_recent(rows: DataFrame, values: list[str], keep: int = 200) -> DataFrame:
    """The newest ``keep`` rows of each device after each micro-batch, newest first, with ``recency``.

    ``version`` counts the micro-batches of a device; ``latest_version`` picks the last one.
    """
    def step(memory: dict, batch: Rows) -> dict:
        new = [[int(t), int(s), *map(float, v)] for t, s, *v in zip(batch["_us"], batch["seq"], *(batch[v] for v in values))]
        memory["rows"] = ((memory.get("rows") or []) + new)[-keep:]
        memory["batch"] = memory.get("batch", 0) + 1
        times, seqs, *numbers = zip(*memory["rows"][::-1])
        return {"ts": np.array(times, dtype="datetime64[us]"), "seq": np.array(seqs),
                **{v: np.array(n, dtype=float) for v, n in zip(values, numbers)},
                "recency": np.arange(1, len(times) + 1), "version": np.full(len(times), memory["batch"])}

    schema = "ts timestamp, seq bigint, " + ", ".join(f"{v} double" for v in values) + ", recency bigint, version bigint"
    return stateful(rows.select("device_id", "ts", "seq", *values), step, schema)
