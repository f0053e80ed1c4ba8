"""Cutting frames out of byte streams that arrive in arbitrary chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import FRAME_BYTES, HEADER
from tremorgrid.operators.greedy import select_spaced
from tremorgrid.operators.ordered import dense_index, null_safe_join, reindex, running_sum, with_halo
from tremorgrid.session import cut


def frame_chunks(df: DataFrame, device: str = "device_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Frames of each device's byte stream: device, ``frame_no``, stream ``offset``, ``frame``.

    A frame starts at the first header byte at or after the end of the frame before it, whether or
    not its checksum holds; bytes in between are skipped. That is a walk over header positions with a
    minimum distance of one frame length. A frame may span chunks.
    """
    keys = [device]
    chunks = cut(dense_index(
        df.where(F.length(chunk) > 0).select(device, order, F.col(chunk).alias("_bytes")), keys, [order], "_c"
    ))
    placed = running_sum(chunks, keys, "_c", {"_end": F.length("_bytes")}).withColumn(
        "_from", F.col("_end") - F.length("_bytes")
    )
    reach = FRAME_BYTES - 1  # every chunk holds a byte, so this many chunks hold the rest of a frame
    ahead = Window.partitionBy(device, "_chunk").orderBy("_c").rowsBetween(1, reach)
    tail = F.array_join(F.collect_list(F.hex(F.substring("_bytes", 1, reach))).over(ahead), "")
    joined = with_halo(placed, "_c", after=reach).select(
        device, "_c", "_from", "_bytes", "_core", F.unhex(F.substring(tail, 1, 2 * reach)).alias("_tail")
    ).where("_core")
    header = f"X'{HEADER:02X}'"
    starts = cut(joined.select(
        device, "_from",
        F.concat("_bytes", F.coalesce("_tail", F.unhex(F.lit("")))).alias("_run"),
        F.explode(F.expr(
            f"filter(sequence(1, length(_bytes)), p -> substring(_bytes, p, 1) = {header})"
        )).alias("_at"),
    ).select(
        device, (F.col("_from") + F.col("_at") - 1).cast("bigint").alias("offset"),
        F.expr(f"substring(_run, _at, {FRAME_BYTES})").alias("frame"),
    ).where(F.length("frame") == FRAME_BYTES))
    candidates = cut(dense_index(starts, keys, ["offset"], "_h"))
    taken = select_spaced(candidates, keys, "_h", "offset", FRAME_BYTES)
    numbered = null_safe_join(candidates, taken.select(device, "_h", F.lit(True).alias("_taken")), [device, "_h"], "left")
    return reindex(numbered, keys, "_h", F.coalesce("_taken", F.lit(False)), "frame_no").select(
        device, "frame_no", "offset", "frame"
    )
