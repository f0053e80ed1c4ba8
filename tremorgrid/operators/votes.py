"""Ensemble votes over model predictions (map of model to ``{label, confidence}``), and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import FAULT, MODELS
from tremorgrid.operators.greedy import select_spaced
from tremorgrid.operators.joins import DEVICE, ensure_index
from tremorgrid.operators.ordered import CHUNK_ROWS, reindex, running_sum, with_halo
from tremorgrid.session import cut


def majority_three(labels: list[Column]) -> Column:
    """Fault when more than half of the fixed model slots say so; an absent model does not."""
    votes = sum((F.when(label == FAULT, 1).otherwise(0) for label in labels[1:]),
                F.when(labels[0] == FAULT, 1).otherwise(0))
    return votes > len(labels) / 2


def majority_present(predictions: Column) -> Column:
    """Fault when more than half of the models present say so; none present is no fault."""
    faults = F.size(F.map_filter(predictions, lambda _, r: r["label"] == FAULT))
    return faults * 2 > F.size(predictions)


def vote_with_confidence(predictions: Column, ml_label: Column, ml_confidence: Column) -> Column:
    """Vote of all models with the recent single model; a tie goes to the higher mean confidence."""
    results = F.map_values(predictions)
    votes = F.when(ml_label.isNotNull(), F.array_append(
        F.transform(results, lambda r: F.struct(r["label"].alias("label"), r["confidence"].alias("confidence"))),
        F.struct(ml_label.alias("label"), ml_confidence.alias("confidence")),
    )).otherwise(
        F.transform(results, lambda r: F.struct(r["label"].alias("label"), r["confidence"].alias("confidence")))
    )

    def side(name: str) -> tuple[Column, Column]:
        mine = F.filter(votes, lambda v: v["label"] == name)
        total = F.aggregate(mine, F.lit(0.0), lambda s, v: s + v["confidence"])
        return F.size(mine), F.when(F.size(mine) > 0, total / F.size(mine)).otherwise(0.0)

    (faulty, faulty_mean), (good, good_mean) = side(FAULT), side("Good")
    # A label that is neither is never a fault.
    known = F.forall(votes, lambda v: v["label"].isin(FAULT, "Good"))
    return F.when(~known, False).when(faulty != good, faulty > good).otherwise(faulty_mean > good_mean)


def agreement(labels: Column) -> Column:
    """Whether all labels of an array are equal; null is a label of its own."""
    return F.size(F.array_distinct(labels)) == 1


def model_labels(models=MODELS) -> Column:
    return F.array(*[F.col(f"{m}_label") for m in models])


def running_fault_rate(df: DataFrame, fault: str = "is_fault") -> DataFrame:
    """Totals so far per device after each prediction."""
    counted = running_sum(ensure_index(df), DEVICE, "i", {
        "predictions": F.lit(1), "faults": F.when(F.col(fault), 1).otherwise(0),
    })
    return counted.withColumn("fault_rate", F.col("faults") / F.col("predictions") * 100)


def rolling_buffer(df: DataFrame, columns: list[str], size: int = 20, index: str = "i", rows: int = CHUNK_ROWS) -> DataFrame:
    """The last ``size`` samples at every row that has that many: ``buffer``, an array of structs."""
    latest = Window.partitionBy(*DEVICE, "_chunk").orderBy(index).rowsBetween(-(size - 1), 0)
    return (
        with_halo(df, index, before=size - 1, rows=rows)
        .withColumn("buffer", F.collect_list(F.struct(*columns)).over(latest))
        .where(F.col("_core") & (F.col(index) >= size - 1))
        .drop("_chunk", "_core")
    )


def consecutive_faults(df: DataFrame, fault: str = "is_fault", count: int = 3, name: str = "streak") -> DataFrame:
    """Whether the last ``count`` predictions of the device exist and are all faults."""
    latest = Window.partitionBy(*DEVICE, "_chunk").orderBy("i").rowsBetween(-(count - 1), 0)
    all_faults = F.min(F.col(fault).cast("int")).over(latest) == 1
    return (
        with_halo(ensure_index(df), "i", before=count - 1)
        .withColumn(name, all_faults & (F.col("i") >= count - 1))
        .where("_core").drop("_chunk", "_core")
    )


def spaced_in_time(df: DataFrame, seconds: float, strict: bool = False, index: str = "i", **pieces) -> DataFrame:
    """Rows taken by a walk in time: at least ``seconds`` after the last one taken, or more if strict."""
    gap = max(1, round(seconds * 1_000_000) + (1 if strict else 0))
    timed = df.withColumn("_at", F.unix_micros("ts"))
    return select_spaced(timed, DEVICE, index, "_at", gap, **pieces).drop("_at")


def cooldown(df: DataFrame, candidate: Column, seconds: float = 300.0, **pieces) -> DataFrame:
    """Of the candidate rows, those not within ``seconds`` of the last one let through."""
    candidates = cut(reindex(ensure_index(df), DEVICE, "i", candidate, "i"))
    return spaced_in_time(candidates, seconds, **pieces)


def throttle(df: DataFrame, seconds: float = 1.0, index: str = "i", **pieces) -> DataFrame:
    """Rows more than ``seconds`` after the last one let through."""
    return spaced_in_time(df, seconds, strict=True, index=index, **pieces)


def nth_packet(packets: DataFrame, every: int) -> DataFrame:
    """The first and then every ``every``-th packet of each type."""
    kept = None
    for kind in ("accel", "gyro"):
        numbered = reindex(ensure_index(packets), DEVICE, "i", F.col("type") == kind, "nth")
        chosen = numbered.where(F.col("nth") % every == 0)
        kept = chosen if kept is None else kept.unionByName(chosen)
    return kept


def recent_rows(df: DataFrame, keep: int, partition: str = "device_id") -> DataFrame:
    """The newest ``keep`` rows of each device; Spark limits each map task's rows before the shuffle."""
    newest = Window.partitionBy(partition).orderBy(F.desc("ts"), F.desc("seq"))
    return df.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= keep)
