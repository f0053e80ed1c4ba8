"""Repeated runs of lines: names of line sequences by prefix doubling, later copies removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorgrid.llm.common import free_name
from tremorgrid.session import cut

MIN_WORDS = 10
_BLANK = " \t\r\n\f\x0b"


def lines_of(text: Column | str) -> Column:
    """The text cut before every line that is not blank; a blank line goes with the line before it."""
    return F.split(F.coalesce(text, F.lit("")), F.lit("\\n(?=[^\\n]*[^ \\t\\r\\n\\f\\x0b])"))


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (with place) whose key occurs more than once, with ``first``, the smallest place that has the key.

    Counts and minima are combined on the map side; the join back only meets keys that repeat.
    """
    many = rows.groupBy(*key).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(many, key)


def repeated_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row_tag, line_no of the lines to delete, from lines (row_tag, order_id, line_no, one, two, words).

    The suffix array is built as its prefix-doubling names: the name of a run of 2^k lines is the place of its first
    copy, found from the names of its halves, so equal names are exactly the interval of suffixes that share so long a
    prefix, and the first copy is its smallest suffix. Suffixes that share theirs with no other leave a round for good.

    A maximal repeated run of at least ``min_words`` words is the union of the shortest runs of so many words that
    start or end at its lines. For each line these two are looked up: their name is the pair of the names of the two
    runs of 2^k lines that cover them. If an earlier copy exists, their lines are deleted.
    """
    known = _repeated(lines.withColumn("place", F.lit(0)), ["one", "two"]).drop("first", "place")
    ranged = known.repartitionByRange("order_id", "row_tag", "line_no").sortWithinPartitions(
        "order_id", "row_tag", "line_no")
    placed = cut(ranged.withColumn("place", F.monotonically_increasing_id()))
    names = [cut(_repeated(placed, ["one", "two"]).select("row_tag", "line_no", "place", F.col("first").alias("name")))]
    need = cut(_shortest_runs(placed, min_words))
    longest = need.agg(F.max("length")).first()[0] or 0
    while 2 ** len(names) <= longest:
        step = 2 ** (len(names) - 1)
        ahead = Window.partitionBy("row_tag").orderBy("line_no").rangeBetween(step, step)
        halves = names[-1].withColumn("half", F.first("name").over(ahead)).filter("half is not null")
        names.append(cut(_repeated(halves, ["name", "half"]).select(
            "row_tag", "line_no", "place", F.col("first").alias("name"))))
    found = None
    for k, named in enumerate(names):
        runs = need.filter((F.col("length") >= 2 ** k) & (F.col("length") < 2 ** (k + 1)))
        left = runs.join(named.select("row_tag", F.col("line_no").alias("start"), "place", "name"), ["row_tag", "start"])
        right = named.select("row_tag", (F.col("line_no") + 2 ** k).alias("stop"), F.col("name").alias("half"))
        both = left.withColumn("stop", F.col("start") + F.col("length")).join(right, ["row_tag", "stop"])
        later = _repeated(both, ["length", "name", "half"]).filter("first < place").select("row_tag", "start", "stop")
        found = later if found is None else found.unionByName(later)
    lines_out = F.explode(F.sequence("start", F.col("stop") - 1))
    return found.select("row_tag", lines_out.alias("line_no")).distinct()


def _shortest_runs(placed: DataFrame, min_words: int) -> DataFrame:
    """row_tag, start, length of the shortest runs with ``min_words`` words that start or end at a repeated line.

    Only runs of neighbouring repeated lines can repeat. Running sums of words within such a
    stretch and range frames over them give the ends and starts; every line has a word, so the sums grow strictly.
    """
    by_line = Window.partitionBy("row_tag").orderBy("line_no")
    upto = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.coalesce((F.col("line_no") - F.lag("line_no").over(by_line) > 1).cast("int"), F.lit(0))
    base = (placed.select("row_tag", "line_no", "words").withColumn("gap", gap)
            .withColumn("stretch", F.sum("gap").over(upto)).drop("gap"))
    own = Window.partitionBy("row_tag", "stretch")
    summed = base.withColumn("sum", F.sum("words").over(
        own.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    start = summed.withColumn("before", F.col("sum") - F.col("words"))
    ends = start.withColumn("reach", F.min("line_no").over(
        own.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing)))
    # A run that starts here ends at the line before the first one that has min_words words in front of it.
    last = F.max("line_no").over(own)
    total = F.max("sum").over(own)
    forward = ends.withColumn("stop", F.coalesce("reach", F.when(total - F.col("before") >= min_words, last + 1)))
    starts = start.withColumn("from_", F.max("line_no").over(
        own.orderBy("sum").rangeBetween(Window.unboundedPreceding, -min_words)))
    first = F.min("line_no").over(own)
    backward = starts.withColumn("start", F.coalesce(F.col("from_") + 1, F.when(F.col("sum") >= min_words, first)))
    one = forward.filter("stop is not null").select("row_tag", F.col("line_no").alias("start"), "stop")
    two = backward.filter("start is not null").select("row_tag", "start", (F.col("line_no") + 1).alias("stop"))
    return one.unionByName(two).distinct().select("row_tag", "start", (F.col("stop") - F.col("start")).alias("length"))


def _with_runs(docs: DataFrame, id_column: str, text_column: str, min_words: int) -> tuple[DataFrame, str, str]:
    """``docs`` with a row number and the runs [start, stop) of lines to delete (null: none), and their names."""
    tag, runs = free_name(docs, "row_tag"), free_name(docs, "removed_runs")
    kept = cut(docs.withColumn(tag, F.monotonically_increasing_id()))
    trimmed = F.btrim("line", F.lit(_BLANK))
    lines = cut(kept.select(F.col(tag).alias("row_tag"), F.col(id_column).cast("long").alias("order_id"),
                            F.posexplode(lines_of(F.col(text_column))).alias("line_no", "line"))
                .select("row_tag", "order_id", "line_no", F.xxhash64(trimmed).alias("one"), F.hash(trimmed).alias("two"),
                        F.regexp_count(trimmed, F.lit("[^ \\t\\r\\n\\f\\x0b]+")).alias("words"))
                .filter("words > 0"))
    gone = repeated_lines(lines, min_words)
    by_line = Window.partitionBy("row_tag").orderBy("line_no")
    island = gone.withColumn("island", F.col("line_no") - F.row_number().over(by_line))
    found = (island.groupBy("row_tag", "island").agg(F.min("line_no").alias("start"),
                                                     (F.max("line_no") + 1).alias("stop"))
             .groupBy("row_tag").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(runs))
             .withColumnRenamed("row_tag", tag))
    return kept.join(found.hint("merge"), tag, "left"), tag, runs  # the same plan for few runs as for many


def _without(text: Column, runs: Column) -> Column:
    """``text`` less the lines of ``runs``; slices between the runs are put together."""
    lines = lines_of(text)
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["stop"]))
    stops = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    parts = F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.when(runs.isNull(), text).otherwise(F.array_join(F.flatten(parts), "\n"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the texts; all columns and rows stay.

    A run is a series of consecutive lines with ``min_words`` words or more; it is repeated if the same lines stand
    earlier, in a document with a smaller id (null ids first, equal ids by row) or further up in the same one (the
    copies may overlap). Lines are compared without the white space around them; blank lines belong to the line before
    them and go with it. A text that loses all lines is empty. Null and empty texts, and texts without such runs, stay
    as they are; repeated rows are later copies like any other; an empty table stays empty.
    """
    rows, tag, runs = _with_runs(docs, id_column, text_column, min_words)
    return rows.withColumn(text_column, _without(F.col(text_column), F.col(runs))).select(*docs.columns)


def line_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, removed_lines, removed_runs (their number) and the text left of every row."""
    rows, _, runs = _with_runs(docs, id_column, text_column, min_words)
    sizes = F.aggregate(F.col(runs), F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return rows.select(
        F.col(id_column).cast("long").alias("doc_id"), F.size(lines_of(F.col(text_column))).cast("long").alias("n_lines"),
        F.coalesce(sizes, F.lit(0).cast("long")).alias("removed_lines"),
        F.coalesce(F.size(runs), F.lit(0)).cast("long").alias("removed_runs"),
        _without(F.col(text_column), F.col(runs)).alias("text"))
