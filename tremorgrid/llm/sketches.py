"""Threshold-scaled fingerprints of documents, mergeable, with containment between texts of very unequal length.

A text's shingles are runs of five words (white space separates words; a text of fewer words is one shingle). Each
shingle is hashed to 63 bits and every hash below ``FRACTION`` of the range is retained, so a fingerprint grows with its
text and two fingerprints can be compared or united whatever their lengths. A short text would keep too few, so the
``LEAST`` smallest hashes are retained as well. Both rules look only at hash values: the fingerprint of a union is the
union of fingerprints under the same rules, and two fingerprints are compared below the lower of the two bounds up to
which they are complete.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrid.session import cut

SHINGLE_WORDS = 5
#: One hash in this many is retained.
FRACTION = 16
LEAST = 64
BITS = 63
_TOP = (1 << BITS) - 1
WORDS_KEPT = 200_000
#: Words whose shingles are hashed at once; neighbouring slices share the words that cross them.
SLICE_WORDS = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)


class Sketcher:
    """Fingerprints of texts in one Python process; hashes of words are kept between texts."""

    def __init__(self, shingle: int = SHINGLE_WORDS, fraction: int = FRACTION, least: int = LEAST):
        self.shingle, self.bound, self.least = shingle, _TOP // fraction, least
        self.factors = [int(_ODD[i % len(_ODD)]) ^ (i // len(_ODD)) for i in range(shingle)]
        self.kept: dict[str, int] = {}

    def _words(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        kept = self.kept
        if len(kept) > WORDS_KEPT:
            kept.clear()
        for word in set(words).difference(kept):
            kept[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))

    def _hashes(self, words: np.ndarray) -> np.ndarray:
        """Hash of every run of words: a sum with an odd factor per place, mixed."""
        size = min(self.shingle, len(words))
        runs = len(words) - size + 1
        total = np.full(runs, size, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for place in range(size):
                part = words[place:place + runs] * np.uint64(self.factors[place] | 1)
                total = (total ^ (part >> np.uint64(29))) + part
            total ^= total >> np.uint64(31)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(27)
            total *= np.uint64(0x94D049BB133111EB)
            total ^= total >> np.uint64(32)
        return total >> np.uint64(64 - BITS)

    def retained(self, hashes: np.ndarray) -> np.ndarray:
        """Of these hashes the distinct ones that a fingerprint retains, ascending."""
        if len(hashes) > 4 * self.least:
            low = hashes[hashes <= self.bound]
            if len(low) >= 2 * self.least:
                low = np.unique(low)
                if len(low) >= self.least:
                    return low
        every = np.unique(hashes)
        return every[:max(self.least, int(np.searchsorted(every, self.bound, side="right")))]

    def sketch(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) <= SLICE_WORDS:
            return self.retained(self._hashes(self._words(words)))
        parts = [self.retained(self._hashes(self._words(words[i:i + SLICE_WORDS + self.shingle - 1])))
                 for i in range(0, len(words) - self.shingle + 1, SLICE_WORDS)]
        return self.retained(np.concatenate(parts))

    def complete_to(self, sketch: np.ndarray) -> int:
        """The bound up to which a fingerprint holds every hash of its text."""
        return _TOP if len(sketch) < self.least else max(self.bound, int(sketch[-1]))

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated share of common shingles among all of two texts; 1 for two texts without words."""
        both, either = self._counts(a, b)[:2]
        return both / either if either else float(len(a) == len(b) == 0)

    def containment(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated share of the shingles of ``a`` that ``b`` has; 1 where ``a`` has none."""
        both, _, own = self._counts(a, b)
        return both / own if own else float(not len(a))

    def _counts(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        bound = min(self.complete_to(a), self.complete_to(b))
        a, b = (x[:np.searchsorted(x, bound, side="right")] for x in (a, b))
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both, len(a) + len(b) - both, len(a)


def as_text(sketch: np.ndarray) -> str:
    """Ascending hashes as 16 hex digits each."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)


def sketch_texts(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text (null: empty) as ascending hashes.

    No row moves. Equal texts have equal fingerprints, and a text without words has an empty one. Repeated rows,
    empty tables and very long texts need no care: hashing goes by slices of a text's words.
    """
    @F.pandas_udf("array<bigint>")
    def fingerprint(texts):
        import pandas as pd

        sketcher = _sketcher()
        return pd.Series([sketcher.sketch(t or "").astype(np.int64) for t in texts])

    return df.withColumn(name, fingerprint(F.col(text)))


_SKETCHERS: dict[tuple, Sketcher] = {}


def _sketcher(*settings) -> Sketcher:
    if settings not in _SKETCHERS:
        _SKETCHERS[settings] = Sketcher(*settings)
    return _SKETCHERS[settings]


def complete_to(sketch: Column | str, fraction: int = FRACTION, least: int = LEAST) -> Column:
    """The bound up to which a fingerprint column holds every hash of its text."""
    sketch = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.size(sketch) < least, F.lit(_TOP)).otherwise(
        F.greatest(F.lit(_TOP // fraction), F.element_at(sketch, -1)))


def group_sketches(df: DataFrame, keys: list[str], sketch: str = "fingerprint") -> DataFrame:
    """Fingerprints of groups, one row per retained hash: ``keys``, ``hash``, and ``complete_to`` of the group.

    A group's fingerprint is complete up to the least bound of its members and holds their hashes up to there. Rows
    instead of arrays, since a group's fingerprint grows with the group; hashes are made distinct by map-side
    aggregation. Null keys are keys like others.
    """
    key = F.struct(*keys)
    bounds = cut(df.groupBy(key.alias("_key")).agg(F.min(complete_to(sketch)).alias("complete_to")))
    hashes = df.select(key.alias("_key"), F.explode(sketch).alias("hash")).distinct()
    return hashes.join(bounds, "_key").where("hash <= complete_to").select("_key.*", "hash", "complete_to")


def containment_in_groups(
    df: DataFrame, groups: DataFrame, keys: list[str], row_id: str = "doc_id", sketch: str = "fingerprint",
) -> DataFrame:
    """``row_id``, ``keys`` and ``containment``: the estimated share of a text's shingles that a group has, above 0.

    ``groups`` is a result of ``group_sketches``. Texts and groups meet on hashes, so only pairs that share one cost
    anything, however unequal their sizes.
    """
    own = cut(df.select(F.col(row_id).alias("_row"), F.col(sketch).alias("_own"), complete_to(sketch).alias("_to")))
    groups = cut(groups.select(F.struct(*keys).alias("_key"), "hash", "complete_to"))
    shared = own.select("_row", "_to", F.explode("_own").alias("hash")).join(groups, "hash").where(
        "hash <= least(_to, complete_to)").groupBy("_row", "_key").agg(
            F.count(F.lit(1)).alias("_both"), F.first("complete_to").alias("_group_to"))
    sized = shared.join(own, "_row")
    bound = F.least("_to", "_group_to")
    return sized.select(F.col("_row").alias(row_id), "_key.*",
                        (F.col("_both") / F.size(F.filter("_own", lambda h: h <= bound))).alias("containment"))


_MEASURED = [
    ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
    ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()),
]


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points from the start of ``following``, or all of it."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _compare(sketcher: Sketcher, text: str, own: np.ndarray, following: str, ahead: np.ndarray) -> tuple:
    import hashlib

    edited = edited_text(text, following)
    changed = own if edited == text else sketcher.sketch(edited)
    return (len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(changed),
            sketcher.likeness(own, changed), sketcher.likeness(own, ahead))


#: Bytes of text that a range of neighbouring documents holds on average.
RANGE_BYTES = 16 << 20


def _range_starts(thin: DataFrame, count: int) -> list[tuple]:
    """Keys (no id, falling id, tie, row) of the first rows of at most ``count`` ranges of about equal number of rows."""
    key = F.struct("none", "falling", "tie", "row")
    ranged = thin.repartitionByRange(count, "none", "falling", "tie", "row")
    firsts = ranged.groupBy(F.spark_partition_id().alias("range_no")).agg(F.min(key).alias("first"))
    return sorted(tuple(r["first"]) for r in firsts.collect())  # one key per range


def _labels(spark, count: int) -> list[int]:
    """A number for each of ``count`` ranges such that hash partitioning gives every range a task of its own."""
    wanted, tried = {}, 20 * count + 100
    while len(wanted) < count:
        number = F.col("id").cast("int")
        rows = spark.range(tried).select(number.alias("label"), F.pmod(F.hash(number), F.lit(count)).alias("task"))
        wanted = {r["task"]: r["label"] for r in rows.groupBy("task").agg(F.min("label").alias("label")).collect()}
        tried *= 2
    return [wanted[n] for n in range(count)]


def compare_neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and its successor: ``doc_id``, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Successors go by descending ``doc_id``, an integer (null last, equal ids by a hash of the text), and the last
    document's is the first. A thin table of keys gives the first document of every range of neighbours; texts are then
    dealt out by range once, and the first document of a range goes to the range before it as well, so that every
    task sees the successor of its last document. Repeated rows are documents of their own and spread over ranges by
    their place in the input, which must be the same on two reads, as it is for a table. Null texts are empty, one
    document is its own successor, an empty table gives an empty result, and further columns of ``df`` are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), *[T.StructField(n, t) for n, t in _MEASURED]])
    names = [f.name for f in schema.fields]
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "*", F.col("doc_id").isNull().alias("none"), (-F.coalesce("doc_id", F.lit(0)).cast("decimal(20,0)")).alias("falling"),
        F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    thin = cut(rows.select("none", "falling", "tie", "row", F.octet_length("text").alias("size")))
    count = (thin.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES + 1
    starts = _range_starts(thin, count)
    if not starts:
        return df.sparkSession.createDataFrame([], schema)
    last, labels = len(starts) - 1, _labels(df.sparkSession, len(starts))

    @F.pandas_udf("array<int>")
    def places(none, falling, tie, row):
        """The label of a row's range; for the first row of a range also, as -1 - label, that of the range before it."""
        from bisect import bisect_right

        import pandas as pd

        out = []
        for key in zip(none.tolist(), falling.tolist(), tie.tolist(), row.tolist()):
            at = bisect_right(starts, key) - 1
            out.append([labels[at], -1 - labels[at - 1 if at else last]] if key == starts[at] else [labels[at]])
        return pd.Series(out)

    placed = rows.select("*", F.explode(places("none", "falling", "tie", "row")).alias("at")).select(
        F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("range_no"), (F.col("at") < 0).alias("ahead"),
        "none", "falling", "tie", "row", "doc_id", "text")
    dealt = placed.repartition(last + 1, "range_no").sortWithinPartitions(
        "range_no", "ahead", "none", "falling", "tie", "row").select("range_no", "ahead", "doc_id", "text")

    def look_ahead(batches):
        import pyarrow as pa

        arrow, sketcher = to_arrow_schema(schema), _sketcher()
        held, out, size = None, [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in out], t.type) for n, t in enumerate(arrow)], names=names)

        for incoming in batches:
            for range_no, ahead, number, body in zip(*(c.to_pylist() for c in incoming.columns)):
                sketch = sketcher.sketch(body)
                if held is not None:
                    if held[0] != range_no:
                        raise RuntimeError("the rows lie in other places than when their ranges were found")
                    out.append((held[1], *_compare(sketcher, *held[2:], body, sketch)))
                    size += len(out[-1][3]) + len(out[-1][4])
                held = None if ahead else (range_no, number, body, sketch)
                if size > 4_000_000:
                    yield batch()
                    out, size = [], 0
        if held is not None:
            raise RuntimeError("the rows lie in other places than when their ranges were found")
        if out:
            yield batch()

    return dealt.mapInArrow(look_ahead, schema)
