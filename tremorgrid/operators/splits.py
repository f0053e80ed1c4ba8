"""Train/test splits that keep recordings together, stratify, or divide at random; all repeatable."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorgrid.operators.ordered import dense_index, null_safe_join
from tremorgrid.session import cut


def hashed(columns: list[str], seed: int) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def _quotas(folds: int):
    """How many groups of each size every fold receives when the lightest fold always takes the next.

    Taking the ``m`` groups of size ``s`` one by one picks the m smallest of the loads
    ``load + j * s``; they are counted, not stepped through.
    """
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        loads = np.zeros(folds, dtype=np.int64)
        bounds = []
        pdf = pdf.sort_values("n", ascending=False)
        for size, many in zip(pdf["n"].to_numpy(), pdf["m"].to_numpy()):
            def taken(level):
                return np.where(loads <= level, (level - loads) // size + 1, 0)
            low, high = int(loads.min()), int(loads.min() + size * many)
            while low < high:
                middle = (low + high) // 2
                if taken(middle).sum() >= many:
                    high = middle
                else:
                    low = middle + 1
            quota = taken(low - 1)
            at_level = np.flatnonzero(taken(low) > quota)
            quota[at_level[: int(many - quota.sum())]] += 1
            loads += quota * size
            bounds.append(np.cumsum(quota).tolist())
        return pd.DataFrame({"n": pdf["n"].to_numpy(), "_bounds": bounds})
    return build


def group_kfold(df: DataFrame, folds: int = 5, group: str = "file") -> DataFrame:
    """Add ``fold``: no group in two folds, largest groups first to the lightest fold.

    Only the histogram of group sizes (at most the root of twice the row count) meets in one task;
    groups of one size are numbered by the distributed index and dealt out by the quotas.
    """
    sizes = cut(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    if sizes.limit(folds).count() < folds:
        raise ValueError(f"cannot make {folds} folds of fewer groups")
    histogram = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    quotas = cut(histogram.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        _quotas(folds), "n bigint, _bounds array<bigint>"))
    ranked = dense_index(sizes, ["n"], [group], "_rank").join(quotas, "n")
    assigned = cut(ranked.select(group, F.expr("size(filter(_bounds, b -> b <= _rank))").alias("fold")))
    return null_safe_join(df, assigned, [group])


def group_holdout(df: DataFrame, fraction: float, seed: int = 42, group: str = "file") -> DataFrame:
    """Add ``holdout``: true for ceil(fraction x groups) groups chosen by hash."""
    groups = cut(df.select(group).distinct().withColumn("_hash", hashed([group], seed)))
    held = math.ceil(fraction * groups.count())
    ranked = cut(dense_index(groups, [], ["_hash", group], "_rank"))
    return null_safe_join(df, ranked.select(group, (F.col("_rank") < held).alias("holdout")), [group])


def stratified_kfold(df: DataFrame, folds: int, label: str, row_id: list[str], seed: int = 42) -> DataFrame:
    """Add ``fold``: rows of each class dealt out in hash order."""
    mixed = df.withColumn("_hash", hashed(row_id, seed))
    ranked = dense_index(mixed, [label], ["_hash", *row_id], "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_hash", "_rank")


def random_split(df: DataFrame, train_fraction: float, row_id: list[str], seed: int = 42) -> DataFrame:
    """Add ``train``: a stable function of the row id, so no row changes sides between runs or engines.

    The first eight digits of an MD5 sum stand for a number below 2^32.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in row_id]))
    bound = int(train_fraction * (1 << 32))
    whole = F.lit(bound >= 1 << 32)
    return df.withColumn("train", whole | (F.substring(digest, 1, 8) < F.lit(f"{min(bound, (1 << 32) - 1):08x}")))
