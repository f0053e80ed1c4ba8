"""The period report over the prediction logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import MODELS
from tremorgrid.operators.joins import ml_label_by_timestamp
from tremorgrid.operators.votes import agreement, model_labels
from tremorgrid.session import cut
from tremorgrid.sources.logs import scan_log_range


def report_summary(dl: DataFrame, ml: DataFrame) -> DataFrame:
    """One row of totals, rates and mean confidences; all zero for an empty period."""
    total = F.count(F.lit(1))
    faults = F.coalesce(F.sum(F.col("is_fault").cast("int")), F.lit(0))
    agreed = F.coalesce(F.sum(agreement(model_labels()).cast("int")), F.lit(0))

    def rate(part):
        return F.when(total > 0, F.round(part / total * 100, 2)).otherwise(0.0)

    def mean(column, digits):
        return F.coalesce(F.round(F.avg(column), digits), F.lit(0.0))

    left = dl.agg(
        total.alias("total_predictions"), faults.alias("fault_count"), rate(faults).alias("fault_rate"),
        (total - faults).alias("good_count"), rate(agreed).alias("agreement_rate"),
        *[mean(f"{m}_confidence", 3).alias(f"{m}_avg_confidence") for m in MODELS],
    )
    right = ml.agg(
        total.alias("ml_total_predictions"), mean("confidence", 3).alias("ml_avg_confidence"),
        mean("total_time_ms", 2).alias("ml_avg_time_ms"),
    )
    # Two one-row tables, joined on a constant.
    joined = left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k").drop("_k")
    ml_columns = ("ml_total_predictions", "ml_avg_confidence", "ml_avg_time_ms")
    empty = F.col("total_predictions") == 0  # no multi-model row: the whole report is zero
    return joined.select(
        *[c for c in joined.columns if c not in ml_columns],
        F.when(empty, 0).otherwise(F.col(ml_columns[0])).cast("bigint").alias(ml_columns[0]),
        *[F.when(empty, 0.0).otherwise(F.col(c)).alias(c) for c in ml_columns[1:]],
    )


def recent_faults(dl: DataFrame, ml: DataFrame, keep: int = 10) -> DataFrame:
    """The newest faults with their labels; the exact-time label join sees only those few rows."""
    newest = dl.where("is_fault = 1").orderBy(F.desc("ts"), F.desc("seq")).limit(keep)
    newest = cut(newest.select("ts", "seq", *[f"{m}_label" for m in MODELS]))
    matching = ml.join(F.broadcast(newest.select("ts").distinct()), "ts", "left_semi")
    return ml_label_by_timestamp(newest, matching)


#: The closing rule and footer of a report.
FOOTER = "\n---\n\n*Generated by tremorgrid*"


def report_text(summary: DataFrame, faults: DataFrame, start: str, end: str, hours: int) -> DataFrame:
    """The report as one row of Markdown; ``faults`` are at most a handful of rows."""
    def line(label: str, column: str):
        return F.concat(F.lit(f"  - {label}: "), F.coalesce(F.col(column), F.lit("None")), F.lit("\n"))

    described = F.concat(
        F.lit("**"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("**\n"),
        line("CNN1D", "cnn1d_label"), line("LSTM", "lstm_label"), line("CNN2D", "cnn2d_label"),
        F.when(F.col("ml_label") == "N/A", "").otherwise(line("ML (RF-20)", "ml_label")),
    )
    listed = faults.agg(F.sort_array(F.collect_list(
        F.struct((-F.unix_micros("ts")).alias("o"), (-F.col("seq")).alias("s"), described.alias("t"))
    )).alias("rows"))
    numbered = listed.select(F.when(F.size("rows") == 0, "\n✅ No faults detected during this period.\n").otherwise(
        F.array_join(F.expr("transform(rows, (r, n) -> concat('\n**', n + 1, '. ', substring(r.t, 3)))"), "")
    ).alias("faults"))
    one = summary.withColumn("_k", F.lit(1)).join(numbered.withColumn("_k", F.lit(1)), "_k")

    def percent(column):
        return F.format_string("%.1f%%", F.col(column) * 100)

    return one.select(F.concat(
        F.lit(f"# Condition Report\n\n**Report Period**: {start} to {end}\n**Duration**: {hours} hours\n\n---\n\n"
              "## Summary Statistics\n\n- **Total Predictions**: "), F.col("total_predictions").cast("string"),
        F.lit("\n- **Fault Detections**: "), F.format_string("%d (%s%%)", "fault_count", F.col("fault_rate").cast("string")),
        F.lit("\n- **Good Detections**: "), F.format_string("%d (%.2f%%)", F.col("good_count"), 100 - F.col("fault_rate")),
        F.lit("\n- **Model Agreement Rate**: "), F.col("agreement_rate").cast("string"), F.lit("%\n\n---\n\n"),
        F.lit("## Model Performance\n\n### Deep Learning Models\n| Model | Avg Confidence |\n|-------|----------------|\n| CNN1D | "),
        percent("cnn1d_avg_confidence"), F.lit(" |\n| LSTM  | "), percent("lstm_avg_confidence"),
        F.lit(" |\n| CNN2D | "), percent("cnn2d_avg_confidence"),
        F.lit(" |\n\n### Machine Learning Model (RF-20)\n- **Total Predictions**: "),
        F.col("ml_total_predictions").cast("string"), F.lit("\n- **Avg Confidence**: "), percent("ml_avg_confidence"),
        F.lit("\n- **Avg Inference Time**: "), F.format_string("%.2fms", "ml_avg_time_ms"),
        F.lit("\n\n---\n\n## Recent Fault Detections\n\n"), F.col("faults"), F.lit(FOOTER),
    ).alias("value"))


def period_report(dl_log: DataFrame, ml_log: DataFrame, start: str, end: str, hours: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary row, recent faults and rendered text of the log rows between two times."""
    dl = scan_log_range(dl_log, start, end, newest_first=False)
    ml = scan_log_range(ml_log, start, end, newest_first=False)
    summary, faults = cut(report_summary(dl, ml)), cut(recent_faults(dl, ml))
    return summary, faults, report_text(summary, faults, start, end, hours)
