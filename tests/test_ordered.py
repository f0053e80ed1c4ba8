import random
import statistics

import pytest
from pyspark.sql import functions as F

from tremorgrid.operators.greedy import select_spaced
from tremorgrid.operators.ordered import (
    carry_last, dense_index, exact_median, ordered_bits, previous, reindex, running_sum,
)
from tremorgrid.session import cut


def make_rows(seed=1):
    """Four series, one of which holds most of the rows and one of which has no key."""
    rng, rows = random.Random(seed), []
    for key, count in (("hot", 400), ("warm", 37), ("single", 1), (None, 23)):
        position = 0
        for n in range(count):
            position += rng.choice([0, 1, 2, 3, 7, 30])
            rows.append((key, position, n, rng.choice([None, 1.0, 2.0, rng.random()])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "k string, p bigint, s bigint, x double").repartition(5)
    return cut(dense_index(df, ["k"], ["p", "s"]))


def ordered(rows):
    out = []
    for key in sorted({row[0] for row in rows}, key=lambda k: (k is not None, k)):
        mine = sorted((row for row in rows if row[0] == key), key=lambda row: (row[1], row[2]))
        out += [(key, n, *row[1:]) for n, row in enumerate(mine)]
    return out


def collect(df, *columns):
    return [tuple(row[c] for c in columns) for row in df.orderBy("k", "i").collect()]


def test_index_of_a_range_partitioned_sort(table, rows):
    assert collect(table, "k", "i", "p", "s", "x") == ordered(rows)


def test_index_without_key(spark, rows):
    df = spark.createDataFrame([(row[0], row[2]) for row in rows], "k string, s bigint")
    got = dense_index(df, [], ["k", "s"]).orderBy("i").collect()
    assert [row.i for row in got] == list(range(len(rows)))
    assert [(row.k, row.s) for row in got] == sorted(
        ((row[0], row[2]) for row in rows), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("options", [{"rows": 7}, {"rows": 64}, {}])
def test_carry_last(table, rows, options, inclusive):
    got = carry_last(table, ["k"], "i", {"y": F.col("x")}, inclusive, **options)
    last, expected = {}, []
    for key, n, _, _, x in ordered(rows):
        before = last.get(key)
        if x is not None:
            last[key] = x
        expected.append((key, n, last.get(key) if inclusive else before))
    assert collect(got, "k", "i", "y") == expected


@pytest.mark.parametrize("options", [{"rows": 7}, {"rows": 64}, {}])
def test_running_sum(table, rows, options):
    total, expected = {}, []
    for key, n, _, s, _ in ordered(rows):
        total[key] = total.get(key, 0) + s
        expected.append((key, n, total[key]))
    assert collect(running_sum(table, ["k"], "i", {"y": F.col("s")}, **options), "k", "i", "y") == expected


def test_previous_and_reindex_across_pieces(table, rows):
    got = collect(previous(table, ["k"], "i", {"y": F.col("s")}, offset=3, rows=5), "k", "i", "y")
    known = {(key, n): s for key, n, _, s, _ in ordered(rows)}
    assert got == [(key, n, known.get((key, n - 3))) for key, n, *_ in ordered(rows)]
    kept = collect(reindex(table, ["k"], "i", F.col("s") % 3 == 0, "i", rows=5), "k", "i", "s")
    expected = []
    for key in (None, "hot", "single", "warm"):
        mine = [s for k, _, _, s, _ in ordered(rows) if k == key and s % 3 == 0]
        expected += [(key, n, s) for n, s in enumerate(mine)]
    assert kept == expected


@pytest.mark.parametrize("options", [{}, {"width": 11}, {"width": 32}])
def test_median_of_every_key(table, rows, options):
    got = {row.k: row.median for row in exact_median(table, ["k"], "x", **options).collect()}
    for key in ("hot", "warm", None):
        values = [row[3] for row in rows if row[0] == key and row[3] is not None]
        assert got[key] == statistics.median(values)
    everything = [row[3] for row in rows if row[3] is not None]
    assert exact_median(table, [], "x", **options).first()[0] == statistics.median(everything)


INF = float("inf")


@pytest.mark.parametrize("values", [
    [5.0] * 9, [1e308, -1e308, 3.0, 4.0], [1e-300, 2e-300, 1e300], [INF, 1.0, 2.0, 3.0], [INF, -INF, INF],
    [INF, *[n / 7 for n in range(200)]], [1e300, 1e150, *[n / 7 for n in range(200)]]])
def test_median_of_awkward_values(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "k int, x double")
    for options in ({}, {"width": 24}):
        assert exact_median(df, ["k"], "x", **options).first()["median"] == statistics.median(values)


def test_bits_sort_like_the_values(spark):
    values = [-INF, -1e308, -3.5, -1e-300, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0000000000000002, 1e308, INF]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(ordered_bits(F.col("x")).alias("b"))
    bits = [r.b for r in df.collect()]
    assert bits == sorted(bits) and len(set(bits)) == len(bits)
    same = spark.createDataFrame([(1, v) for v in (0.0, -0.0, -0.0, 0.0, 7.0)], "k int, x double")
    assert exact_median(same, ["k"], "x").first()["median"] == 0.0


def test_columns_with_the_names_of_steps_stay(spark):
    names = ["_pos", "_lo", "_rows", "_part", "_shift", "_key", "_chunk", "_v_y", "_c_y", "_l_y"]
    df = spark.createDataFrame([("a", n, *[n + k for k in range(len(names))]) for n in range(9)],
                               "k string, s bigint, " + ", ".join(f"{n} bigint" for n in names))
    out = running_sum(dense_index(df, ["k"], ["s"]), ["k"], "i", {"y": F.col("s")}, rows=4)
    out = carry_last(out, ["k"], "i", {"z": F.when(F.col("s") % 2 == 0, F.col("s"))}, rows=4)
    got = [tuple(r) for r in out.orderBy("i").collect()]
    assert got == [("a", n, *[n + k for k in range(len(names))], n, n * (n + 1) // 2, n - n % 2) for n in range(9)]


@pytest.mark.parametrize("gap", [1, 5, 60])
@pytest.mark.parametrize("pieces", [{"rows": 6, "fan_in": 3}, {"rows": 50, "fan_in": 256}, {}])
def test_spaced_selection(table, rows, gap, pieces):
    got = collect(select_spaced(table, ["k"], "i", "p", gap, **pieces), "k", "i")
    last, expected = {}, []
    for key, n, p, *_ in ordered(rows):
        if key not in last or p - last[key] >= gap:
            last[key] = p
            expected.append((key, n))
    assert got == expected


def test_spaced_selection_needs_a_gap(table):
    with pytest.raises(ValueError):
        select_spaced(table, ["k"], "i", "p", 0)


def test_series_of_one_piece_need_no_summaries(monkeypatch, table, rows):
    """Summaries are for series of several pieces; the others are walked at once."""
    from tremorgrid.operators import greedy

    want = collect(select_spaced(table, ["k"], "i", "p", 7, rows=16), "k", "i")
    monkeypatch.setattr(greedy, "_summarise", None)
    monkeypatch.setattr(greedy, "_hand_down", None)
    assert collect(select_spaced(table, ["k"], "i", "p", 7), "k", "i") == want
