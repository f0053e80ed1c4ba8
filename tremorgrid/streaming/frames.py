"""Cutting frames out of the byte streams of devices as they arrive."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.functions.expressions import FRAME_BYTES, HEADER
from tremorgrid.streaming.state import Rows, stateful


def cut_frames(data: bytes, start: int) -> tuple[list[tuple[int, bytes]], int]:
    """Frames (offset, bytes) in ``data``, which begins at offset ``start`` of its stream, and how much of it is used up.

    What is left over begins with a header byte that lacks the rest of its frame, or is empty.
    """
    found, at = [], data.find(HEADER)
    while 0 <= at <= len(data) - FRAME_BYTES:
        found.append((start + at, data[at:at + FRAME_BYTES]))
        at = data.find(HEADER, at + FRAME_BYTES)
    return found, len(data) if at < 0 else at


def stream_frames(chunks: DataFrame, device: str = "device_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Frames of each device's byte stream across micro-batches: device, ``frame_no``, ``offset``, ``frame``.

    The streaming form of ``frame_chunks``, with the same rows for the same bytes. Between micro-batches a device keeps
    the bytes of an unfinished frame (at most one byte less than a frame), their offset in its stream and the number of
    the next frame. Chunks of a device are taken in ``order`` within a micro-batch and must not
    arrive in an earlier one than chunks that come before them; null and empty chunks add nothing.
    """
    def step(memory: dict, rows: Rows) -> dict | None:
        start, number = memory.get("start", 0), memory.get("frame_no", 0)
        data = bytes.fromhex(memory.get("tail", "")) + b"".join(bytes(c) for c in rows[chunk] if c is not None)
        found, used = cut_frames(data, start)
        memory.update(tail=data[used:].hex(), start=start + used, frame_no=number + len(found))
        return {"frame_no": np.arange(number, number + len(found)), "offset": [at for at, _ in found],
                "frame": [frame for _, frame in found]}

    return stateful(chunks.select(device, order, F.col(chunk)), step, "frame_no bigint, offset bigint, frame binary",
                    key=device, order=(order,))
