"""Greedy selection with a minimum distance: alerts with a cooldown, throttled windows, frame starts.

Walking a series in order, a row is taken when its position is at least ``gap`` after the last row
taken. The walk is sequential, but a piece of the series acts on the walk as a step function: given
the earliest position allowed, it fixes the last position taken. Pieces are summarised as such
functions in parallel, the functions are composed in groups until few are left, and the states found
at the top are handed down again. No task ever holds more than one piece of rows or one group of
functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.operators.ordered import CHUNK_ROWS, chunk_of, null_safe_join, spread
from tremorgrid.session import cut

FAN_IN = 256
_OPEN = np.iinfo(np.int64).min // 2  # earlier than any position


def _last_taken(positions: np.ndarray, gap: int) -> np.ndarray:
    """For each start, the last position taken by a walk that takes that start."""
    count = len(positions)
    follow = np.searchsorted(positions, positions + gap, side="left")
    follow = np.where(follow == count, np.arange(count), follow)
    while True:
        further = follow[follow]
        if np.array_equal(further, follow):
            return positions[follow]
        follow = further


def _merge_equal(enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last_of_run = np.append(leave[1:] != leave[:-1], True)
    return enter[last_of_run], leave[last_of_run]


def _summarise(gap: int):
    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        positions = np.unique(pdf["_p"].to_numpy())
        leave = _last_taken(positions, gap)
        reach = np.searchsorted(positions, positions[0] + gap, side="left") + 1
        enter, leave = _merge_equal(positions[:reach], leave[:reach])
        return _rows(key, {"_base": positions[0], "_enter": enter, "_leave": leave})
    return build


def _rows(key, columns: dict) -> pd.DataFrame:
    count = max(np.size(values) for values in columns.values())
    frame = {f"_k{n}": [value] * count for n, value in enumerate(key)}
    frame.update({name: np.broadcast_to(values, count).astype(np.int64) for name, values in columns.items()})
    return pd.DataFrame(frame)


def _pieces(pdf: pd.DataFrame):
    for node, part in pdf.sort_values(["_node", "_enter"]).groupby("_node", sort=True):
        yield node, part["_enter"].to_numpy(), part["_leave"].to_numpy(), int(part["_base"].iloc[0])


def _compose(gap: int):
    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = list(_pieces(pdf))
        base = pieces[0][3]
        entries = np.unique(np.concatenate([piece[1] for piece in pieces]))
        entries = entries[: np.searchsorted(entries, base + gap, side="left") + 1]
        allowed, leave = entries.copy(), np.full(len(entries), _OPEN)
        for _, enter, out, _ in pieces:
            at = np.searchsorted(enter, allowed, side="left")
            hit = at < len(enter)
            leave[hit] = out[at[hit]]
            allowed[hit] = leave[hit] + gap
        entries, leave = _merge_equal(entries, leave)
        return _rows(key, {"_base": base, "_enter": entries, "_leave": leave})
    return build


def _hand_down(gap: int):
    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        allowed, nodes, states = int(pdf["_allowed"].iloc[0]), [], []
        for node, enter, leave, _ in _pieces(pdf):
            nodes.append(node)
            states.append(allowed)
            at = np.searchsorted(enter, allowed, side="left")
            if at < len(enter):
                allowed = int(leave[at]) + gap
        return _rows(key[:-1], {"_node": np.array(nodes), "_allowed": np.array(states)})
    return build


def _walk(gap: int):
    def build(key: tuple[pa.Scalar, ...], piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("_i")
        positions = piece["_p"].to_numpy()
        follow = np.searchsorted(positions, positions + gap, side="left")
        at = int(np.searchsorted(positions, piece["_allowed"][0].as_py(), side="left"))
        taken = []
        while at < len(positions):
            taken.append(at)
            at = int(follow[at])
        columns = {f"_k{n}": pa.repeat(value, len(taken)) for n, value in enumerate(key[:-1])}
        return pa.table({**columns, "_i": piece["_i"].take(pa.array(taken, pa.int64()))})
    return build


def select_spaced(
    df: DataFrame,
    keys: list[str],
    index: str,
    position: str,
    gap: int,
    rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """The rows of ``df`` that a walk with minimum distance ``gap`` (at least 1) takes in each series.

    ``index`` is the dense index of the series and ``position`` a BIGINT that never falls along it.
    """
    if gap < 1:
        raise ValueError("gap must be at least 1")
    named = [F.col(key).alias(f"_k{n}") for n, key in enumerate(keys)]
    ids = [f"_k{n}" for n in range(len(keys))]
    types = {key: df.schema[key].dataType.simpleString() for key in keys}
    id_schema = "".join(f"_k{n} {types[key]}, " for n, key in enumerate(keys))
    points = cut(df.select(*named, F.col(index).cast("bigint").alias("_i"), F.col(position).alias("_p"),
                           chunk_of(index, rows).cast("bigint").alias("_node")))
    summary_schema = id_schema + "_node bigint, _base bigint, _enter bigint, _leave bigint"
    state_schema = id_schema + "_node bigint, _allowed bigint"

    def grouped(function, frame, schema):
        # The group key carries the node; results name it as the last key column.
        renamed = schema.replace("_node bigint", f"_k{len(keys)} bigint", 1)
        out = frame.applyInPandas(function, renamed)
        return out.withColumnRenamed(f"_k{len(keys)}", "_node")

    # A series of one piece enters it open; only longer ones need their pieces summarised.
    ends = cut(points.groupBy(*ids).agg(F.max("_node").alias("_top")).where("_top > 0"))
    top = ends.agg(F.max("_top")).first()[0]
    if top is None:
        ready = points.withColumn("_allowed", F.lit(int(_OPEN)))
    else:
        long = null_safe_join(points, ends, ids, "left_semi") if ids else points
        levels = [cut(grouped(_summarise(gap), spread(long, *ids, "_node").groupBy(*ids, "_node"), summary_schema))]
        while top >= fan_in:
            parent = F.expr(f"_node div {fan_in}").alias("_parent")
            levels.append(cut(grouped(
                _compose(gap), levels[-1].withColumn("_parent", parent).groupBy(*ids, "_parent"), summary_schema
            )))
            top //= fan_in
        state = None
        for level in reversed(levels):
            if state is None:
                entered = level.withColumn("_allowed", F.lit(int(_OPEN))).withColumn("_parent", F.lit(0))
            else:
                parents = state.withColumnRenamed("_node", "_parent")
                entered = null_safe_join(
                    level.withColumn("_parent", F.expr(f"_node div {fan_in}")), parents, [*ids, "_parent"])
            state = cut(entered.groupBy(*ids, "_parent").applyInPandas(_hand_down(gap), state_schema))
        ready = null_safe_join(points, state, [*ids, "_node"], "left").withColumn(
            "_allowed", F.coalesce("_allowed", F.lit(int(_OPEN))))
    taken = spread(ready, *ids, "_node").groupBy(*ids, "_node").applyInArrow(_walk(gap), id_schema + "_i bigint")
    back = taken.select(*[F.col(f"_k{n}").alias(key) for n, key in enumerate(keys)], F.col("_i").alias(index))
    return null_safe_join(df, back, [*keys, index], "left_semi")
