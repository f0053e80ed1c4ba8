"""How sources of one language differ in their words: exact sparse count vectors, summed by group and compared.

A count vectorizer per language: the vocabulary of a language are the terms in at least ``min_df`` of its documents,
numbered by falling count, at most ``vocab_size`` of them (by default the greatest integer, so all). The vectorizer of
Spark ML collects its vocabulary on the driver and broadcasts it; here the vocabulary is a table, because it grows with
the corpus. Every document becomes a sparse vector of terms and counts in the task that reads it, and vectors are added
up by (language, source) on the spot, so only sums per group and term are shuffled, never documents.

Probabilities are whole numbers, 1 + floor(1,000,000,000 (count + 1) / (N + V)), and divergences are sums of
f(p, q) = floor((p - q)^2 / q). A pair of sources is evaluated sparsely. Terms that neither source has all add the same
amount; terms that one source has depend only on its count, so they go by the histogram of its counts; only terms that
both have are met one by one. All sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorgrid.operators.ordered import dense_index
from tremorgrid.session import cut

MIN_DF = 3
VOCAB_SIZE = (1 << 31) - 1
UNIT = 1_000_000_000
TOP_TERMS = 200
#: Sums that a task holds before it passes them on, and bytes of a text that are cut into terms at once.
HELD_TERMS = 200_000
SLICE_BYTES = 1 << 22

_SUMS = "lang string, source string, term string, count long, docs long"


def _letters() -> bytes:
    """Every byte that belongs to no term becomes a space, A-Z become a-z; bytes beyond ASCII stay."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_slices(body: bytes, table: bytes = _letters()):
    """The terms of a text in UTF-8, as lists of bounded length; a term is never cut."""
    spaced = body.translate(table)
    start = 0
    while start < len(spaced):
        stop = len(spaced)
        if stop - start > SLICE_BYTES:
            after = spaced.find(b" ", start + SLICE_BYTES)
            stop = len(spaced) if after < 0 else after
        yield spaced[start:stop].split()
        start = stop


def count_vector(body: bytes):
    """Terms of one document with their counts."""
    from collections import Counter

    vector = Counter()
    for terms in term_slices(body):
        vector.update(terms)
    return vector


def _readable(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                     F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def group_sums(docs: DataFrame) -> DataFrame:
    """Sum of the count vectors of each (lang, source): term, count and docs, the number of vectors with the term."""
    def added(batches):
        import pyarrow as pa
        from collections import Counter, defaultdict

        names = ["lang", "source", "term", "count", "docs"]
        counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0

        def passed_on():
            for (lang, source), terms in counts.items():
                own, keys = docs[lang, source], list(terms)
                for start in range(0, len(keys), 50_000):
                    some = keys[start:start + 50_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                        pa.array(some, pa.binary()).cast(pa.string()), pa.array([terms[t] for t in some], pa.int64()),
                        pa.array([own[t] for t in some], pa.int64())], names=names)

        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for n, group in enumerate(zip(langs, sources)):
                vector = count_vector(texts[n].as_py())
                sums = counts[group]
                before = len(sums)
                sums.update(vector)
                docs[group].update(vector.keys())
                held += len(sums) - before
                if held > HELD_TERMS:
                    yield from passed_on()
                    counts.clear()
                    docs.clear()
                    held = 0
        yield from passed_on()

    return _readable(docs).mapInArrow(added, _SUMS).groupBy("lang", "source", "term").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def vocabularies(sums: DataFrame, min_df: int = MIN_DF, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """The vocabulary of each language from ``group_sums``: lang, term, index (by falling count), count, docs."""
    found = sums.groupBy("lang", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= min_df).withColumn("_fewer", -F.col("count"))
    return dense_index(found, ["lang"], ["_fewer", "term"], "index").where(F.col("index") < vocab_size).select(
        "lang", "term", F.col("index").cast("int").alias("index"), "count", "docs")


def document_vectors(docs: DataFrame, vocabulary: DataFrame, row_id: str) -> DataFrame:
    """Sparse vector of each document: ``row_id``, lang, size of the vocabulary, indices (ascending), counts.

    ``row_id`` must be unique. Documents without a term of their vocabulary have empty arrays.
    """
    rows = cut(_readable(docs, F.col(row_id).alias("_row")))

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            for n in range(batch.num_rows):
                vector = count_vector(batch.column(2)[n].as_py())
                if vector:
                    yield pa.RecordBatch.from_arrays([
                        pa.repeat(batch.column(0)[n], len(vector)), pa.repeat(batch.column(1)[n], len(vector)),
                        pa.array(list(vector), pa.binary()).cast(pa.string()),
                        pa.array(list(vector.values()), pa.int64())], names=["_row", "lang", "term", "count"])

    kind = rows.schema["_row"].dataType.simpleString()
    found = rows.select("_row", "lang", "text").mapInArrow(cells, f"_row {kind}, lang string, term string, count long")
    placed = found.join(vocabulary.select("lang", "term", "index"), ["lang", "term"]).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("index", "count"))).alias("_cells"))  # at most the terms of one document
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    joined = rows.select("_row", "lang").join(placed, "_row", "left").join(sizes, "lang", "left")
    part = lambda name, kind: F.coalesce(F.col(f"_cells.{name}"), F.array().cast(f"array<{kind}>")).alias(f"{name}s")
    return joined.select(F.col("_row").alias(row_id), "lang", F.coalesce("size", F.lit(0)).alias("size"),
                         part("index", "int").alias("indices"), part("count", "bigint"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + terms)), exact; null for an empty vocabulary."""
    wide = lambda c: c.cast("decimal(19,0)")
    whole = F.call_function("div", wide(count + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + terms))
    return F.lit(1).cast("bigint") + F.when(total + terms > 0, whole)


def divergence(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def audit_sources(docs: DataFrame, min_df: int = MIN_DF, vocab_size: int = VOCAB_SIZE, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of each source from the others and its marked terms.

    Part ``pair``: every other source of the language, ranked by falling divergence. Part ``term``: the ``top`` terms
    that are more frequent in the source than in its language. Null text, lang and source are empty strings; repeated
    rows are documents of their own; sources without terms and languages without a vocabulary (value 0) have their
    pairs; ties go by item in UTF-8 order; an empty table gives an empty result. Long texts are cut into terms by
    slices. Other columns of ``docs`` are not read.
    """
    sums = cut(group_sums(docs))
    vocabulary = cut(vocabularies(sums, min_df, vocab_size))
    kept = cut(sums.join(vocabulary.select("lang", "term", F.col("count").alias("lang_count")), ["lang", "term"])
               .select("lang", "source", "term", "count", "lang_count"))
    groups = _readable(docs).groupBy("lang", "source").count().select("lang", "source")
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    whole = vocabulary.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    zero = F.lit(0).cast("bigint")
    sized = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "own_terms", "lang_total", "terms")])
    sized = cut(sized.withColumn("none", share(zero, F.col("total"), F.col("terms"))))
    postings = cut(kept.join(sized, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_count"), F.col("lang_total"), F.col("terms")).alias("q"), "none"))
    return _pair_rows(sized, postings).unionByName(_term_rows(postings, top))


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _term_rows(postings: DataFrame, top: int) -> DataFrame:
    """Spark keeps the first ``top`` of a group on the map side before it shuffles them for the rank."""
    marked = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    return _ranked(marked, "term").where(F.col("rank") <= top)


def _pair_rows(sized: DataFrame, postings: DataFrame) -> DataFrame:
    """Value of each pair: terms of both, terms of one by histograms, terms of neither by their number."""
    side = lambda name, terms, none: sized.select(
        "lang", F.col("source").alias(name), F.col("own_terms").alias(terms), F.col("none").alias(none))
    pairs = cut(side("source", "own_terms", "p0").join(side("item", "item_terms", "q0"), "lang").where(
        "source <> item").join(sized.select("lang", "source", "terms"), ["lang", "source"]))
    histogram = cut(postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("many")))
    by_own = pairs.select("lang", "source", "item", "q0").join(histogram, ["lang", "source"]).select(
        "lang", "source", "item", (divergence("p", "q0") * F.col("many")).alias("value"))
    by_item = pairs.select("lang", "source", "item", "p0").join(
        histogram.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "many"), ["lang", "item"]).select(
            "lang", "source", "item", (divergence("p0", "q") * F.col("many")).alias("value"))
    mine = postings.select("lang", "term", "source", "p", F.col("none").alias("p0"))
    others = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("q0"))
    both = mine.join(others, ["lang", "term"]).where("source <> item").select(
        "lang", "source", "item", (divergence("p", "q") - divergence("p", "q0") - divergence("p0", "q")
                                   + divergence("p0", "q0")).alias("value"))
    left = F.col("terms") - F.col("own_terms") - F.col("item_terms")
    rest = pairs.select("lang", "source", "item", F.when(F.col("terms") > 0, left * divergence("p0", "q0")).otherwise(
        F.lit(0).cast("bigint")).alias("value"))
    # Each part is added up before the parts meet, so a shuffle carries one row per pair and task.
    whole = rest.unionByName(by_own).unionByName(by_item).unionByName(both)
    return _ranked(whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
