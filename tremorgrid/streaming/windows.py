"""Packets to rolling windows to predictions, as streaming queries."""

from __future__ import annotations

import base64

import numpy as np
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import top_class
from tremorgrid.operators.features import top20_features
from tremorgrid.operators.models import Network, network_probabilities, score_windows
from tremorgrid.operators.signals import stft_spectrogram
from tremorgrid.streaming.state import Rows, stateful, walk


def _carry_forward(memory: dict, accel: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (latest acceleration, gyro) and the rows that complete them."""
    at = np.maximum.accumulate(np.where(accel, np.arange(len(accel)), -1))
    old = np.array(memory.get("accel") or [np.nan] * values.shape[1])
    known = (at >= 0) | (memory.get("accel") is not None)
    rows = np.flatnonzero(~accel & known)
    left = np.where((at[rows] >= 0)[:, None], values[np.maximum(at[rows], 0)], old)
    if at[-1] >= 0:
        memory["accel"] = values[at[-1]].tolist()
    return np.hstack([left, values[rows]]), rows


def _fresh(memory: dict, accel: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of one acceleration and one gyro packet, each used once, and the completing rows.

    A pending packet of the batch before stands in front; pairs are complete at odd distances from
    the last repeated type.
    """
    carried = memory.get("pending")
    if carried:
        accel = np.concatenate([[carried[0]], accel]).astype(bool)
        values = np.vstack([carried[1], values])
    j = np.arange(len(accel))
    repeat = np.concatenate([[True], accel[1:] == accel[:-1]])
    odd = (j - np.maximum.accumulate(np.where(repeat, j, 0))) % 2 == 1
    rows = np.flatnonzero(odd)
    mine, before = values[rows], values[rows - 1]
    is_accel = accel[rows][:, None]
    samples = np.hstack([np.where(is_accel, mine, before), np.where(is_accel, before, mine)])
    memory["pending"] = None if odd[-1] else [bool(accel[-1]), values[-1].tolist()]
    return samples, rows - (1 if carried else 0)


def stream_windows(
    packets: DataFrame, values: list[str], pairing: str = "latest", size: int = 20, every_seconds: float | None = None
) -> DataFrame:
    """Every full window of the last ``size`` samples of a device, one array column per channel.

    ``pairing`` is "latest" (each gyro packet with the latest acceleration) or "fresh" (each packet
    used once). With ``every_seconds`` a window is given only that long after the last one.
    """
    pair = {"latest": _carry_forward, "fresh": _fresh}[pairing]
    names = [f"a_{v}" for v in values] + [f"w_{v}" for v in values]
    gap = None if every_seconds is None else round(every_seconds * 1_000_000) + 1

    def step(memory: dict, rows: Rows) -> dict | None:
        table = np.column_stack([rows[v].astype(float) for v in values])
        samples, at = pair(memory, rows["type"] == "accel", table)
        # The samples are kept as text of their bytes: writing and reading numbers digit by digit took half the time.
        held = np.frombuffer(base64.b64decode(memory.get("buffer", "")), dtype="<f8")
        joined = np.vstack([held.reshape(-1, len(names)), samples])
        kept = joined[-(size - 1):] if size > 1 else joined[:0]
        memory["buffer"] = base64.b64encode(kept.astype("<f8").tobytes()).decode()
        if len(joined) < size:
            return None
        windows = np.lib.stride_tricks.sliding_window_view(joined, size, axis=0)
        ends = at[len(at) - len(windows):]
        if gap is not None:
            taken, memory["emitted"] = walk(rows["_us"][ends], memory.get("emitted"), gap)
            chosen = np.array(taken, dtype=int)
            windows, ends = windows[chosen], ends[chosen]
        return {"ts": rows["ts"][ends], "seq": rows["seq"][ends],
                **{name: list(windows[:, n]) for n, name in enumerate(names)}}

    schema = "ts timestamp, seq bigint, " + ", ".join(f"{n} array<double>" for n in names)
    sensor = packets.where(F.col("type").isin("accel", "gyro")).select("device_id", "ts", "seq", "type", *values)
    return stateful(sensor, step, schema)


def stream_inference(windows: DataFrame, model: Model, fs: float, ay: str, az: str, wy: str) -> DataFrame:
    """Windows scored by a stored model on the 20 serving features: label, confidence and probabilities."""
    features = top20_features(windows.select("device_id", "ts", "seq", ay, az, wy), fs, ay, az, wy)
    scored = score_windows(features, model, stated=True)
    return scored.select(
        "device_id", "ts", "seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "label", "confidence",
        F.struct(F.col("probs")[0].alias("Good"), F.col("probs")[1].alias("Faulty")).alias("probabilities"),
    )


def multi_model_inference(
    windows: DataFrame, networks: dict[str, tuple[str, Network]], channels: list[str], n_fft: int = 1024,
    overlap: float = 0.5,
) -> DataFrame:
    """Windows, batch or streaming, scored by several networks in one pass: ``predictions`` is a map by model name of
    label, confidence and class probabilities.

    ``networks`` names for each model what it reads ("time": the samples channel after channel, "spec": the decibel
    spectrogram averaged over channels, "hybrid": both) and its network. All are columns of one plan, so the stream is
    read once and the spectrogram computed once. A model that cannot take a window (another input size, a value that
    is missing or not finite) is left out of that window's map and does not stop the others; a window that no
    model can take gives no row. Throttling is a matter of the windows (``every_seconds`` of ``stream_windows``).
    """
    kinds = {kind for kind, _ in networks.values()}
    samples = F.concat(*[F.col(f"`{c}`") for c in channels])
    cells = F.flatten("_spectrum")
    inputs = {"time": samples, "spec": cells, "hybrid": F.concat(samples, cells)}
    ready = stft_spectrogram(windows, channels, n_fft, overlap, "_spectrum") if kinds - {"time"} else windows
    ready = ready.withColumns({f"_in_{kind}": inputs[kind] for kind in sorted(kinds)})
    ready = ready.withColumns({
        f"_p_{name}": network_probabilities(network)(F.col(f"_in_{kind}")) for name, (kind, network) in networks.items()})
    entries = []
    for name in networks:
        probs = F.col(f"_p_{name}")
        best = top_class(probs)
        result = F.struct(best["label"].alias("label"), best["confidence"].alias("confidence"), probs.alias("probs"))
        entries.append(F.when(probs.isNotNull(), F.struct(F.lit(name).alias("key"), result.alias("value"))))
    present = F.array_compact(F.array(*entries))
    return ready.withColumn("predictions", F.map_from_entries(present)).where(F.size("predictions") > 0).select(
        *windows.columns, "predictions")
