"""Exact duplicates, with the frequent texts taken out by a heavy-hitter sketch before anything is shuffled by text."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorgrid.session import cut

#: Texts that the sketch follows; one that makes up more than about a 500th of the rows is sure to be among them.
TRACKED = 2048
WINNERS = 256


def normalised(text: Column | str) -> Column:
    """Null as empty, ASCII capitals as small letters; every other character stays."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     winners: int = WINNERS, tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A Misra-Gries sketch (Spark's ``approx_top_k``, which merges partial sketches) names at most ``winners`` candidate
    digests. Their exact counts and winning rows are aggregated on the map side, and this table, bounded by ``winners``
    rows, is broadcast: rows of frequent texts never move. What is left has no text in more than about N / tracked rows
    and is grouped by an ordinary shuffle of digests. The sketch decides only which way a row goes, never the result.

    The row with the largest id stays. Null text counts as empty. A null id is below every other id; of several rows
    with the winning id (repeated rows) exactly one has ``kept``; ``keep_id`` is null only where a whole group has no
    id. Other columns are not read. An empty table gives an empty result.
    """
    thin = cut(docs.select(F.col(id_column).cast("long").alias("doc_id"),
                           F.sha2(normalised(F.col(text_column)), 256).alias("text_sha256"))
               .withColumn("tag", F.monotonically_increasing_id()))
    sketch = thin.agg(F.expr(f"approx_top_k(text_sha256, {winners}, {max(tracked, winners)})").alias("found"))
    candidates = sketch.select(F.explode("found.item").alias("text_sha256"))
    best = [F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "tag")).alias("best")]
    heavy = cut(thin.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(*best)
                .filter("group_size > 1"))
    marked = thin.join(F.broadcast(heavy), "text_sha256", "left")
    light = marked.filter("group_size is null").drop("group_size", "best")
    rest = light.join(light.groupBy("text_sha256").agg(*best), "text_sha256")
    return (marked.filter("group_size is not null").unionByName(rest)
            .select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                    (F.col("tag") == F.col("best.tag")).alias("kept"), "text_sha256"))
