"""Helpers that several operators share: row tags, registration, whole-word encoding, connected groups."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrid.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words whose ids a Python worker keeps; beyond it the store starts anew, which changes no result.
WORDS_KEPT = 400_000
_SEPARATED = 64


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage, with its SQL where there is one."""
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(df: DataFrame, tag: str = "row_tag") -> DataFrame:
    """``df`` written to the shared folder with a number that is unique for each row, repeated rows included."""
    return cut(df.withColumn(tag, F.monotonically_increasing_id()))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(texts: list[str], characters: int = 1_000_000):
    """Consecutive slices (start, stop) of ``texts`` with about ``characters`` characters each, at least one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > characters:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


class WordEncoder:
    """Token ids of whole texts, as the tokenizers library gives them, packed as little-endian integers.

    Both kinds of vocabulary cut texts at white space before anything else: ``spaced=False`` for one that lowers case
    and drops white space, ``spaced=True`` for a byte-level one where a space belongs to the word after it. The library
    therefore encodes each distinct word once, and texts are joined from words. A text whose spaces don't stand alone
    is encoded by the library as a whole in the byte-level case. ``width`` is the number of bytes of an id.
    """

    _ALONE = re.compile(r" \s")
    #: ASCII letters and a run of marks behind them: two pieces that the model of the library can take as they are.
    _PLAIN = re.compile(r"([A-Za-z]+)([.,;:!?]*)")

    def __init__(self, path: str, spaced: bool, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spaced = spaced
        self.width, self.kind = width, f"<u{width}"
        self.packed = [i.to_bytes(width, "little") for i in range(self.library.get_vocab_size())]
        self.kept: dict[str, bytes] = {}
        special = [x.content for x in self.library.get_added_tokens_decoder().values() if x.special]
        self.separator = special[-1] if special else None
        self.separator_id = self.library.token_to_id(self.separator) if special else None

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = self._ALONE.search if self.spaced else lambda text: None
        units = [None if whole(x) else x.split(" ") if self.spaced else x.replace("\n", " ").split(" ") for x in texts]
        found: set[str] = set()
        for own in units:
            found.update(own[1:] if self.spaced and own else own or ())
        kept = self.kept
        new = found.difference(kept)
        if len(kept) + len(new) > WORDS_KEPT:
            # Words that come back are worth keeping.
            self.kept = kept = {x: kept[x] for x in found if x in kept}
            if len(kept) + len(new) > WORDS_KEPT:
                kept.clear()
                new = found
        self._learn(new)
        if not self.spaced:
            return [b"".join([kept[u] for u in own]) for own in units]
        return [self._library(text) if own is None else self._library(own[0]) + b"".join([kept[u] for u in own[1:]])
                for text, own in zip(texts, units)]

    def _library(self, text: str) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in self.library.encode(text, add_special_tokens=False).ids]) if text else b""

    def _learn(self, words) -> None:
        """Ids of new words; in the byte-level case of each with the space before it."""
        import numpy as np

        kept, packed, tokenize = self.kept, self.packed, self.model.tokenize
        lead, plain = ("\u0120" if self.spaced else ""), self._PLAIN.fullmatch
        rest = []
        for word in words:
            simple = plain(word)
            if simple:
                body, marks = simple.groups()
                pieces = tokenize(lead + body if self.spaced else body.lower())
                if marks:
                    pieces += tokenize(marks)
                kept[word] = b"".join([packed[p.id] for p in pieces])
            elif self.separator is None or self.separator in word:
                kept[word] = self._library(" " + word if self.spaced else word)
            else:
                rest.append(word)
        groups = [rest[i:i + _SEPARATED] for i in range(0, len(rest), _SEPARATED)]
        space = " " if self.spaced else ""
        for start in range(0, len(groups), 256):
            some = groups[start:start + 256]
            joined = [self.separator.join([space + x for x in group]) for group in some]
            for group, encoding in zip(some, self.library.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(encoding.ids, dtype=self.kind)
                ends = np.append(np.flatnonzero(ids == self.separator_id), len(ids)) * self.width
                data, begin = ids.tobytes(), 0
                for word, end in zip(group, ends.tolist()):
                    kept[word] = data[begin:end]
                    begin = end + self.width


_ENCODERS: dict[tuple[str, bool, int], WordEncoder] = {}


def word_encoder(path: str, spaced: bool, width: int = 4) -> WordEncoder:
    """The encoder of this Python process for one vocabulary file."""
    key = (path, spaced, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def id_width(path: str, least: int = 0) -> int:
    """Bytes that hold every id of a vocabulary file, and ``least``: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(), least + 1) <= 1 << 16 else 4


def connected(members: DataFrame) -> DataFrame:
    """Groups of nodes that share hubs, directly or through others: columns node, label (smallest node of its group).

    ``members`` has columns node and hub (numbers, no nulls) and must be a written table. Each round hands the smallest
    label of a hub to its nodes and then follows label to label, so chains shorten by doubling. All is joins and
    map-side aggregations on thin rows; only the number of changed labels comes to the driver.
    """
    labels = cut(members.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        lowest = (members.join(labels, "node").groupBy("hub").agg(F.min("label").alias("low")))
        near = members.join(lowest, "hub").groupBy("node").agg(F.min("low").alias("near"))
        own = labels.join(near, "node").select("node", F.col("label").alias("old"), "near")
        ahead = labels.select(F.col("node").alias("near"), F.col("label").alias("jump"))
        moved = cut(own.join(ahead, "near", "left")
                    .select("node", "old", F.least("near", F.coalesce("jump", "near")).alias("label")))
        changed = moved.filter("old <> label").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def running_start(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """``df`` with ``start``: the sum of ``size`` over all rows before it in ``order``.

    ``df`` must be a written table and ``order`` must decide every tie. Rows are dealt out by ranges of the order and
    summed within each range; the totals of the ranges (one row per shuffle partition, which bounds the broadcast) are
    then added.
    """
    from pyspark.sql.types import StructType

    taken = StructType(list(df.schema.fields)).add("local", "long")

    def sums(batches):
        import pyarrow as pa

        total = 0
        for batch in batches:
            sizes = batch.column(size).to_numpy(zero_copy_only=False)
            ends = sizes.cumsum() + total
            total = int(ends[-1]) if len(ends) else total
            yield batch.append_column("local", pa.array(ends - sizes, pa.int64()))

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.mapInArrow(sums, taken).withColumn("range_no", F.spark_partition_id()))
    return placed.join(F.broadcast(range_starts(placed, size)), "range_no").withColumn(
        "start", F.col("local") + F.col("range_start")).drop("range_no", "range_start", "local")


def range_starts(placed: DataFrame, size: str) -> DataFrame:
    """range_no and range_start (sum of ``size`` in the ranges before it): one row per range."""
    from pyspark.sql.window import Window

    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range_no").agg(F.sum(size).alias("total"))
    return totals.select("range_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("range_start"))
