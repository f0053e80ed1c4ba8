"""Mixing sources to target weights: copies of documents chosen by balanced sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorgrid.llm.common import running_start
from tremorgrid.session import cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
#: Most rows of a block; a source has as many blocks as it needs.
BLOCK_ROWS = 50_000
_NEAR_ZERO = 1e-9


def word_count(text: Column | str) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    Weights repeat over the sources in code point order, null last. The mix has ``share`` times all words. A target
    stops at ``cap`` times its source's size; what is over goes to the others by weight, until none is above. Sources
    reach their stop in the order of stop / weight, so the share of the rest is found by running sums in that order.
    The table has one row per source, and only it is ordered as a whole.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("stop", cap * F.col("source_size"))
    rows = rows.withColumn("key", F.when(F.col("weight") > 0, F.col("stop") / F.col("weight"))
                           .otherwise(F.lit(float("inf"))))
    order = Window.orderBy("key", F.col("source").isNull(), "source")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything)
    stopped = F.coalesce(F.sum("stop").over(earlier), F.lit(0.0))
    weighing = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    rows = rows.withColumn("level", F.when(weighing > 0, (share * total - stopped) / weighing).otherwise(0.0))
    # The level only matters up to the first source below its stop; behind it every source has that level.
    free = F.when(F.col("level") < F.col("key"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("source", "source_size", F.least(
        F.col("stop"), F.coalesce(level * F.col("weight"), F.col("stop"))).alias("target"))


def flight(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The flight phase of the cube method: chances moved to 0 or 1, all but at most two.

    The sum of the chances and the sum of chance times size stay as they are. Three open units at a time move along the
    null space of these two constraints, which is the cross product of (1, 1, 1) and their sizes, until one of them
    arrives and the next unit takes its place. Up or down is drawn with the odds of the two step lengths, which keeps
    every unit's chance; draws are seeded by the number of units, so a rerun gives the same choice.
    """
    p, sizes = chance.tolist(), size.tolist()
    low, high = _NEAR_ZERO, 1 - _NEAR_ZERO
    draws = np.random.default_rng(len(p)).random(len(p) + 1).tolist()
    window: list[int] = []
    for unit in range(len(p)):
        if not low < p[unit] < high:
            continue
        window.append(unit)
        if len(window) < 3:
            continue
        a, b, c = window
        direction = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if direction == (0, 0, 0):
            direction = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for w, u in zip(window, direction):
            if u > 0:
                up, down = min(up, (1 - p[w]) / u), min(down, p[w] / u)
            elif u < 0:
                up, down = min(up, -p[w] / u), min(down, (p[w] - 1) / u)
        move = up if draws[unit] * (up + down) < down else -down
        for w, u in zip(window, direction):
            p[w] = min(1.0, max(0.0, p[w] + move * u))
        window = [w for w in window if low < p[w] < high]
    return np.array(p, dtype=np.float64)


def numbered_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` with ``block``: open rows numbered by (source, order_key, size, row_tag) and cut every ``block_rows`` rows.

    Rows of one source and block are never more than that, also where many rows share id and text. ``rows`` must come
    from a written table. Rows that only differ in their tag are alike, so a rerun makes the same mix.
    """
    placed = running_start(rows.withColumn("one", F.lit(1).cast("long")), ["source", "order_key", "size", "row_tag"], "one")
    return placed.withColumn("block", F.floor(F.col("start") / block_rows)).drop("one", "start")


def _fly(pdf):
    pdf = pdf.sort_values(["order_key", "size", "row_tag"], kind="stable").reset_index(drop=True)
    pdf["chance"] = flight(pdf["chance"].to_numpy(), pdf["size"].to_numpy(dtype=np.float64))
    return pdf


def _land(pdf):
    """The few units left of one source: the choice whose words, then count, are nearest to what they should be."""
    pdf = _fly(pdf)
    chance, size = pdf["chance"].to_numpy(), pdf["size"].to_numpy(dtype=np.float64)
    open_ = np.flatnonzero((chance > _NEAR_ZERO) & (chance < 1 - _NEAR_ZERO))
    if len(open_):
        want, count = (chance[open_] * size[open_]).sum(), chance[open_].sum()
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        off = np.abs(choices @ size[open_] - want)
        best = np.lexsort((np.abs(choices.sum(axis=1) - count), off))[0]
        chance[open_] = choices[best]
    pdf["chance"] = np.round(chance)
    return pdf


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
                id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                block_rows: int = BLOCK_ROWS, tag: str | None = None) -> DataFrame:
    """How many words of each row the mix takes: doc_id, size, source_size, target, taken, copies, row_tag.

    A source with target / size = c + f (f below 1) takes every document c times and once more with probability f. These
    extra copies are chosen by the cube method, balanced on the number of documents and of words: each source is split
    into blocks of consecutive rows by hash (a hot source or key has many), each block flies until at most two documents are open,
    the open ones of all blocks fly again source by source in blocks, and at most two documents per source are left to
    land, where the nearest of four choices is taken. Nothing depends on the partitioning: reruns agree.

    Null text has size 0; a null id or source is an ordinary key (null sources last); repeated rows are rows of their
    own; a source without words has target 0 and keeps nothing; an empty table gives no rows. ``tag`` names a unique row
    number that ``docs`` already has.
    """
    number = F.col(tag) if tag else F.monotonically_increasing_id()
    thin = cut(docs.select(number.alias("row_tag"), F.col(id_column).cast("long").alias("doc_id"),
                           F.col(source_column).cast("string").alias("source"),
                           word_count(F.col(text_column)).alias("size"),
                           F.xxhash64(F.col(id_column), F.col(text_column)).alias("order_key")))
    sources = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sources, weights, share, cap)
                  .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                              .otherwise(0.0)))
    near = F.floor(F.col("rate") + 1e-12)
    rows = thin.join(targets.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s").select(
        "row_tag", "doc_id", "source", "size", "order_key", "source_size", "target", near.alias("base"),
        F.greatest(F.col("rate") - near, F.lit(0.0)).alias("chance"))
    rows = cut(rows)
    thin_kind = "source string, block long, row_tag long, size long, order_key long, chance double"
    open_rows = rows.filter("chance > 0 and size > 0").select("source", "row_tag", "size", "order_key", "chance")
    flown = cut(numbered_blocks(open_rows, block_rows).groupBy("source", "block").applyInPandas(_fly, thin_kind))
    still = f"chance > {_NEAR_ZERO} and chance < {1 - _NEAR_ZERO}"
    left = flown.filter(still)
    while True:
        # Two open rows a block, so each round divides the rows of a source by half a block's rows.
        counts = cut(left.groupBy("source").count())
        if counts.filter(F.col("count") > block_rows).limit(1).count() == 0:
            break
        blocks = numbered_blocks(left.drop("block"), block_rows)
        again = cut(blocks.groupBy("source", "block").applyInPandas(_fly, thin_kind))
        flown = flown.filter(f"not ({still})").unionByName(again.filter(f"not ({still})"))
        left = again.filter(still)
    landed = left.groupBy("source").applyInPandas(_land, thin_kind)
    chosen = (flown.filter(f"not ({still})").unionByName(landed)
              .select("row_tag", F.round("chance").cast("long").alias("extra")).filter("extra = 1"))
    copies = (F.col("base") + F.coalesce("extra", F.lit(0))).cast("long")
    return (rows.join(chosen, "row_tag", "left").withColumn("copies", copies)
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                    "copies", "row_tag"))
