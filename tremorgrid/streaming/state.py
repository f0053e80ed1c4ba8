"""Keyed streaming state: reading it, keeping order, and attaching it to a stream.

A device's rows within a micro-batch are put in (ts, seq) order; micro-batches count in the order of
their arrival, so a row that comes late is processed when it comes and none is dropped. State per device
is bounded by the buffer sizes, and the rows of a micro-batch by the source's rate limit
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). State is kept as long as the checkpoint.

Devices are dealt to ``BUCKETS`` buckets by a hash and a bucket is one group of the stateful operator, since a group's
call, its frames and its state cost milliseconds and a device's step only a fraction of one. A bucket's state holds the
memories of its devices and is written again when one of them sends rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE_SCHEMA = "memories string"
#: Groups that the devices of a stream are dealt to; fixed for the life of a checkpoint.
BUCKETS = 1024

#: Partitions that a stream's state lies in, where tasks that run at once do not ask for more.
STATE_PARTITIONS = 16

Rows = dict[str, np.ndarray]


def begin(writer: DataStreamWriter, spark: SparkSession, path: str | None = None) -> StreamingQuery:
    """Start a stream with its state in ``STATE_PARTITIONS`` partitions, or two for each task that can run at once.

    A micro-batch runs a task on every partition of the state, and a task of ``stateful`` took about a second or more
    however few its rows (most seem to start a Python process of their own). The setting is the session's own, ``spark.sql.shuffle.partitions``, where that is
    lower; it is the started stream's alone, and a checkpoint keeps the number it began with.
    """
    name = "spark.sql.shuffle.partitions"
    asked = spark.conf.get(name)
    spark.conf.set(name, str(min(int(asked), max(STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism))))
    try:
        return writer.start(path)  # the stream takes a copy of the session's settings
    finally:
        spark.conf.set(name, asked)


def _micros(column: pd.Series) -> np.ndarray:
    return column.to_numpy().astype("datetime64[us]").astype(np.int64)


def _put_together(parts: list[dict], column: str):
    """One column of several devices' results; arrays stay arrays, so that times and numbers keep their types."""
    pieces = [part[column] for part in parts]
    if all(isinstance(piece, np.ndarray) for piece in pieces):
        return np.concatenate(pieces)
    return [value for piece in pieces for value in piece]


def stateful(
    df: DataFrame, step: Callable[[dict, Rows], dict | None], schema: str, key: str = "device_id",
    order: tuple[str, ...] = ("_us", "seq"), buckets: int = BUCKETS,
) -> DataFrame:
    """Run ``step(memory, rows)`` per device and micro-batch on the device's rows in ``order``.

    ``rows`` holds an array per column of ``df``, and the microseconds of ``ts``, if there is one, as ``_us``. ``memory``
    is a JSON-compatible dict that the step changes in place; the step returns the columns of ``schema`` or None. The
    result has ``key`` in front of them. Null keys are one device.
    """
    columns = [c for c in df.columns if c != key]

    def run(keys: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memories = dict(json.loads(state.get[0])) if state.exists else {}
        rows = pd.concat(list(frames), ignore_index=True)
        device, names = pd.factorize(rows["_key"])  # -1 stands for the null key
        rows["_device"] = device
        if "ts" in columns:
            rows["_us"] = _micros(rows["ts"])
        rows = rows.sort_values(["_device", *order], kind="stable", ignore_index=True)
        device, names = rows["_device"].to_numpy(), names.tolist()
        arrays = {c: rows[c].to_numpy() for c in rows.columns if c not in ("_key", "_bucket", "_device")}
        edges = np.flatnonzero(np.diff(device)) + 1
        owners, parts = [], []
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(device)]):
            name = names[device[begin]] if device[begin] >= 0 else None
            memory = memories.setdefault(name, {})
            out = step(memory, {c: values[begin:end] for c, values in arrays.items()})
            size = 0 if out is None else len(next(iter(out.values())))
            if size:
                owners += [name] * size
                parts.append(out)
        state.update((json.dumps(list(memories.items())),))
        if parts:
            yield pd.DataFrame({"_key": pd.Series(owners, dtype=object), "_spare": 0,
                                **{c: _put_together(parts, c) for c in parts[0]}})

    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket"),
                      F.col(key).cast("string").alias("_key"), *columns)
    out = dealt.groupBy("_bucket").applyInPandasWithState(
        run, f"_key string, _spare int, {schema}", STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    # The spare column is dropped by a projection, without which rows of this operator cannot enter an Arrow function.
    return out.select(F.col("_key").cast(df.schema[key].dataType).alias(key), *out.columns[2:])


def walk(micros: np.ndarray, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """Positions taken when each is at least ``gap`` after the one before, and the last time taken."""
    taken, at = [], 0 if last is None else int(np.searchsorted(micros, last + gap))
    while at < len(micros):
        taken.append(at)
        last = int(micros[at])
        at = int(np.searchsorted(micros, last + gap))
    return taken, last
