"""Ordered work on series of any length.

A window function partitioned by the series key puts a whole series into one task, which fails as
soon as one series holds a large share of the rows. The operators here give the same results with
bounded tasks, by one plan for every size: ``dense_index`` numbers the rows of every series by a
range-partitioned sort, and the others work on pieces of ``CHUNK_ROWS`` consecutive rows, passing what
crosses a piece boundary either as copied neighbour rows (``with_halo``) or as one summary row per
piece (``carry_last``, ``running_sum``).

A null key is a key like any other: tables meet on ``key_of`` structs, which compare nulls as equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorgrid.session import cut

CHUNK_ROWS = 1 << 18
#: Bits of a value that one pass of the median decides.
MEDIAN_BITS = 16
_ALL_BUT_SIGN = (1 << 63) - 1


def key_of(keys: list[str]) -> Column:
    """The key columns as one struct, equal where all columns are equal or both null."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which nulls equal nulls; the columns of ``right`` that are no keys are added."""
    named = right.select(*[F.col(key).alias(f"_r{n}") for n, key in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"_r{n}")) for n, key in enumerate(keys)])
    joined = left.join(named, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r{n}" for n in range(len(keys))])


def dense_index(df: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """Number the rows of each series 0, 1, 2, … by ``order``, which must be unique within a key.

    Rows are range-partitioned by (key, order), so a series that holds most of the data spreads over
    many tasks. The sorted rows are written once to the shared folder: partition bounds come from a
    sample and must not differ between the two scans that follow.
    """
    placed = cut(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_dx_part", F.spark_partition_id())
        .withColumn("_dx_pos", F.monotonically_increasing_id())
    )
    spans = placed.groupBy(key_of(keys).alias("_dx_key"), "_dx_part").agg(
        F.min("_dx_pos").alias("_dx_lo"), F.count(F.lit(1)).alias("_dx_rows")
    )
    before = Window.partitionBy("_dx_key").orderBy("_dx_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and partition, written so that Spark knows its size and does not shuffle the rows to join it.
    shifts = cut(spans.select(
        "_dx_key", "_dx_part", (F.coalesce(F.sum("_dx_rows").over(before), F.lit(0)) - F.col("_dx_lo")).alias("_dx_shift")
    ))
    return (
        placed.withColumn("_dx_key", key_of(keys)).join(shifts, ["_dx_key", "_dx_part"])
        .withColumn(name, F.col("_dx_pos") + F.col("_dx_shift"))
        .select(*df.columns, name)
    )


def indexed_table(df: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """``dense_index`` written to the shared folder, for tables that several operators read."""
    return cut(dense_index(df, keys, order, name))


def chunk_of(index: str, rows: int = CHUNK_ROWS) -> Column:
    return F.expr(f"{index} div {rows}")


def with_halo(
    df: DataFrame, index: str, before: int = 0, after: int = 0, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Assign rows to pieces, copying ``before``/``after`` neighbour rows into the adjoining pieces.

    Adds ``_chunk`` and ``_core``; every row is core in exactly one piece.
    """
    first = f"greatest({index} - {after}, 0) div {rows}"
    last = f"({index} + {before}) div {rows}"
    return df.withColumn("_chunk", F.explode(F.expr(f"sequence({first}, {last})"))).withColumn(
        "_core", F.expr(f"{index} div {rows} = _chunk")
    )


def _frame(keys: list[str], index: str, end: int) -> Window:
    return Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, end)


def carry_last(
    df: DataFrame,
    keys: list[str],
    index: str,
    columns: dict[str, Column],
    inclusive: bool = True,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For each new column, the latest non-null value of its expression at or before the row.

    ``inclusive=False`` looks only at earlier rows. Rows and summaries meet on (key, piece), by which
    the rows are partitioned already.
    """
    staged = df.withColumn("_dx_key", key_of(keys)).withColumn("_dx_chunk", chunk_of(index, rows))
    for name, expression in columns.items():
        staged = staged.withColumn(f"_dx_v_{name}", expression)
    summary = staged.groupBy("_dx_key", "_dx_chunk").agg(*[
        F.max_by(f"_dx_v_{name}", F.when(F.col(f"_dx_v_{name}").isNotNull(), F.col(index))).alias(f"_dx_v_{name}")
        for name in columns
    ])
    carried = summary.select("_dx_key", "_dx_chunk", *[
        F.last(f"_dx_v_{name}", ignorenulls=True).over(_frame(["_dx_key"], "_dx_chunk", -1)).alias(f"_dx_c_{name}")
        for name in columns
    ]).where(reduce(Column.__or__, [F.col(f"_dx_c_{name}").isNotNull() for name in columns]))
    local = _frame(["_dx_key", "_dx_chunk"], index, 0 if inclusive else -1)
    for name in columns:
        staged = staged.withColumn(f"_dx_l_{name}", F.last(f"_dx_v_{name}", ignorenulls=True).over(local))
    return staged.join(carried, ["_dx_key", "_dx_chunk"], "left").select(
        *df.columns,
        *[F.coalesce(f"_dx_l_{name}", f"_dx_c_{name}").alias(name) for name in columns],
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    index: str,
    columns: dict[str, Column],
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For each new column, the sum of its expression over the rows up to and including this one."""
    staged = df.withColumn("_dx_key", key_of(keys)).withColumn("_dx_chunk", chunk_of(index, rows))
    for name, expression in columns.items():
        staged = staged.withColumn(f"_dx_v_{name}", expression)
    summary = staged.groupBy("_dx_key", "_dx_chunk").agg(
        *[F.sum(f"_dx_v_{name}").alias(f"_dx_v_{name}") for name in columns]
    )
    carried = summary.select("_dx_key", "_dx_chunk", *[
        F.sum(f"_dx_v_{name}").over(_frame(["_dx_key"], "_dx_chunk", -1)).alias(f"_dx_c_{name}") for name in columns
    ]).where("_dx_chunk > 0")
    local = _frame(["_dx_key", "_dx_chunk"], index, 0)
    for name in columns:
        staged = staged.withColumn(f"_dx_l_{name}", F.sum(f"_dx_v_{name}").over(local))
    zero = F.lit(0)
    return staged.join(carried, ["_dx_key", "_dx_chunk"], "left").select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_dx_l_{name}"), zero) + F.coalesce(F.col(f"_dx_c_{name}"), zero)).alias(name)
            for name in columns
        ],
    )


def reindex(
    df: DataFrame, keys: list[str], index: str, keep: Column, name: str = "i", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Keep the rows that satisfy ``keep`` and number them densely, without sorting again."""
    counted = running_sum(df, keys, index, {"_seen": F.when(keep, 1).otherwise(0)}, rows)
    kept = counted.where(keep).withColumn("_seen", F.col("_seen").cast("bigint") - 1)
    return kept.select(
        *[column for column in df.columns if column != name], F.col("_seen").alias(name)
    )


def previous(
    df: DataFrame, keys: list[str], index: str, columns: dict[str, Column], offset: int = 1, rows: int = CHUNK_ROWS
) -> DataFrame:
    """For each new column, its expression on the row ``offset`` places earlier in the series."""
    haloed = with_halo(df, index, before=offset, rows=rows)
    over = Window.partitionBy(*keys, "_chunk").orderBy(index)
    staged = haloed.select(
        *df.columns, "_core",
        *[F.lag(expression, offset).over(over).alias(name) for name, expression in columns.items()],
    )
    return staged.where("_core").drop("_core")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` into the session's full number of shuffle partitions.

    For grouped Python work: partitions that are small in bytes, which Spark would merge, can hold
    much computing. The grouping that follows needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def median_of_sorted(array: Column | str) -> Column:
    """Median of an ascending array; null if it is empty."""
    array = F.col(array) if isinstance(array, str) else array
    n = F.size(array)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(array, low) + F.get(array, high)) / 2)


def ordered_bits(value: Column) -> Column:
    """A double as a 64-bit integer that sorts like it: the sign bit is flipped, or all other bits if it is set."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_ALL_BUT_SIGN))).otherwise(bits)


def value_of_bits(ordered: Column) -> Column:
    """The double that ``ordered_bits`` made the integer of."""
    bits = F.when(ordered < 0, ordered.bitwiseXOR(F.lit(_ALL_BUT_SIGN))).otherwise(ordered)
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def exact_median(
    df: DataFrame, keys: list[str], value: str, name: str = "median", width: int = MEDIAN_BITS,
) -> DataFrame:
    """Exact median of the non-null values of each key, as one row per key.

    A radix selection: values become order-preserving 64-bit integers, and each pass counts the values that share
    what is known of a middle one by their next ``width`` bits, for all keys at once. The counts show which slot
    holds each of the two middle ranks; after 64 bits the values are known. The number of passes does not depend on
    the data, each is a map-side aggregation to at most 2^width counts for a key and rank, and no row is shuffled. The integers are
    stored once, so that the passes read them and do not make them again.
    """
    x = F.when(F.col(value).cast("double") == 0, F.lit(0.0)).otherwise(F.col(value).cast("double"))  # -0.0 equals 0.0
    rows = cut(df.select(key_of(keys).alias("_key"), x.alias("_x")).where("_x is not null and not isnan(_x)").select(
        "_key", ordered_bits(F.col("_x")).alias("_bits")))
    state, known = None, 0
    while known < 64:
        step = min(width, 64 - known)
        after = 64 - known - step
        slot = F.shiftright("_bits", after)  # the known bits and the next ones
        if state is None:
            near = rows.select("_key", slot.alias("_slot"))
        else:
            met = state.select(F.col("_key").alias("_r_key"), F.col("_slot").alias("_r_slot")).distinct()
            near = rows.join(met, (F.col("_key") == F.col("_r_key")) & (
                F.shiftright("_bits", 64 - known) == F.col("_r_slot"))).select("_key", slot.alias("_slot"))
        counted = near.groupBy("_key", "_slot").agg(F.count(F.lit(1)).alias("_c"))
        state = cut(_next_slots(counted, state, step))
        known += step
    low, high = F.min("_x"), F.max("_x")
    middle = state.select("_key", value_of_bits(F.col("_slot")).alias("_x")).groupBy("_key").agg(F.when(low == high, low).otherwise((low + high) / 2).alias(name))
    return middle.select(*[F.col(f"_key.{key}").alias(key) for key in keys], name)


def _next_slots(counted: DataFrame, state: DataFrame | None, step: int) -> DataFrame:
    """For each key and middle rank (0 lower, 1 upper): the slot that holds it and its place there."""
    columns = ["_key", "_side", "_slot", "_place"]
    if state is None:
        every = Window.partitionBy("_key")
        upto = every.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
        ended = counted.withColumn("_end", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(every))
        sides = F.explode(F.array(*[F.struct(F.lit(n).alias("_side"), F.expr(rank).alias("_rank"))
                                    for n, rank in enumerate(("(_n - 1) div 2", "_n div 2"))]))
        placed = ended.select("*", sides.alias("_s")).select("*", "_s._side", "_s._rank")
    else:
        held = state.select("_key", "_side", F.col("_slot").alias("_before"), F.col("_place").alias("_rank"))
        upto = Window.partitionBy("_key", "_side").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("_before", F.shiftright("_slot", step)).join(held, ["_key", "_before"]).withColumn(
            "_end", F.sum("_c").over(upto))
    inside = placed.where("_rank >= _end - _c and _rank < _end")
    return inside.withColumn("_place", F.col("_rank") - (F.col("_end") - F.col("_c"))).select(*columns)
