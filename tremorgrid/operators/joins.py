"""Pairing packets and attaching the latest or matching prediction.

Packets and predictions have ``device_id, ts, seq``; ``(ts, seq)`` is unique within a device. Inputs
that carry a dense index ``i`` in that order are used as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.operators.ordered import (
    CHUNK_ROWS, carry_last, dense_index, indexed_table, null_safe_join, previous, reindex,
)
from tremorgrid.operators.quality import seconds_between
from tremorgrid.session import cut

DEVICE = ["device_id"]
ORDER = ["ts", "seq"]


def ensure_index(df: DataFrame) -> DataFrame:
    return df if "i" in df.columns else indexed_table(df, DEVICE, ORDER)


def pair_carry_forward(packets: DataFrame, values: list[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Every gyro packet with the latest acceleration before it, however old.

    Gives ``device_id, ts, seq, i`` and ``a_*``/``w_*`` columns; gyro packets before any
    acceleration give nothing.
    """
    reading = F.struct(*values)
    carried = carry_last(
        ensure_index(packets), DEVICE, "i", {"_accel": F.when(F.col("type") == "accel", reading)}, rows=rows
    )
    return carried.where("type = 'gyro' and _accel is not null").select(
        "device_id", "ts", "seq", "i",
        *[F.col(f"_accel.{v}").alias(f"a_{v}") for v in values], *[F.col(v).alias(f"w_{v}") for v in values],
    )


def pair_fresh(packets: DataFrame, values: list[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Pairs of one acceleration and one gyro packet, each used once, the latest pending ones.

    Among the sensor packets of a device, number j. A packet of the same type as the one before it
    always leaves a packet pending; a packet of the other type completes a pair when one is pending
    and is itself left pending otherwise. So since the last repeat (or the start) at j0, pairs are
    complete at j0+1, j0+3, …, each from the packet and its predecessor.
    """
    wanted = F.col("type").isin("accel", "gyro")
    sensor = cut(reindex(ensure_index(packets), DEVICE, "i", wanted, "j", rows))
    before = previous(sensor, DEVICE, "j", {
        "_type": F.col("type"), **{f"_b_{v}": F.col(v) for v in values},
    }, rows=rows)
    repeat = F.col("_type").isNull() | (F.col("_type") == F.col("type"))
    marked = carry_last(before, DEVICE, "j", {"_from": F.when(repeat, F.col("j"))}, rows=rows)
    pairs = marked.where((F.col("j") - F.col("_from")) % 2 == 1)
    accel = F.col("type") == "accel"
    return pairs.select(
        "device_id", "ts", "seq", "j",
        *[F.when(accel, F.col(v)).otherwise(F.col(f"_b_{v}")).alias(f"a_{v}") for v in values],
        *[F.when(accel, F.col(f"_b_{v}")).otherwise(F.col(v)).alias(f"w_{v}") for v in values],
    )


def latest_within(
    left: DataFrame, right: DataFrame, values: list[str], seconds: float, prefix: str = "ml_"
) -> DataFrame:
    """Attach the latest right row at or before each left row, if less than ``seconds`` older.

    At equal times the right row counts as earlier. Unmatched rows keep nulls.
    """
    kept = [c for c in left.columns if c not in ("device_id", "ts", "seq")]
    rows = left.select("device_id", "ts", "seq", F.lit(1).alias("_side"), F.struct(*kept).alias("_left"),
                       F.lit(None).alias("_right"))
    other = right.select("device_id", "ts", "seq", F.lit(0).alias("_side"), F.lit(None).alias("_left"),
                         F.struct("ts", *values).alias("_right"))
    indexed = cut(dense_index(rows.unionByName(other), DEVICE, ["ts", "_side", "seq"], "_i"))
    carried = carry_last(indexed, DEVICE, "_i", {"_latest": F.col("_right")}).where("_side = 1")
    recent = seconds_between(F.col("ts"), F.col("_latest.ts")) < seconds
    return carried.select(
        "device_id", "ts", "seq", *[F.col(f"_left.{c}").alias(c) for c in kept],
        *[F.when(recent, F.col(f"_latest.{v}")).alias(f"{prefix}{v}") for v in values],
    )


def asof_ml_vote(dl: DataFrame, ml: DataFrame, seconds: float = 2.0) -> DataFrame:
    return latest_within(dl, ml, ["label", "confidence"], seconds)


def recent_ml_for_alert(alerts: DataFrame, ml: DataFrame, values: list[str], seconds: float = 5.0) -> DataFrame:
    return latest_within(alerts, ml, values, seconds)


def ml_label_by_timestamp(dl: DataFrame, ml: DataFrame, on: list[str] | None = None, row_id: str = "seq") -> DataFrame:
    """Left join on the exact timestamp; of duplicates the smallest row id counts, absent is ``N/A``."""
    on = on or ["ts"]
    labels = ml.groupBy(*on).agg(F.min_by("label", row_id).alias("ml_label"))
    return dl.join(labels, on, "left").withColumn("ml_label", F.coalesce("ml_label", F.lit("N/A")))


def group_ids(df: DataFrame, column: str = "file", name: str = "group_id") -> DataFrame:
    """Dense integer id of each recording, in sorted order."""
    ids = cut(dense_index(df.select(column).distinct(), [], [column], name))
    return null_safe_join(df, ids, [column])


