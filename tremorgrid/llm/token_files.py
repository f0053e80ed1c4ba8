"""Token files: ids of whole texts, compressed shard by shard with a grammar, readable at any document."""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrid.llm.common import id_width, range_starts, text_batches
from tremorgrid.llm.packing import END_ID

SHARD_IDS = 1 << 20
#: A rule is stored in twelve bytes and saves four at each place, so it pays from four places on.
LEAST_COUNT = 4
_MAGIC = b"TGRP0001"


class ByteLevelEncoder:
    """Ids of whole texts by a byte-level vocabulary, as the tokenizers library gives them, packed as ``width`` bytes each.

    Such a vocabulary cuts texts before a blank, so each distinct word with its blank is encoded once and kept. Words of
    letters, marks behind them and single line feeds between are put together from the ids of their letters and marks;
    other words go to the library. A text with white space behind a blank is encoded by the library as a whole. Words
    live in two generations of ``KEPT`` words: one that comes back is carried on, the others go; no result depends on it.
    """

    KEPT = 500_000
    _ALONE = re.compile(r" \s")
    #: Letters of the Latin blocks, and ASCII marks but for the apostrophe, which begins contractions.
    _SEGMENT = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)"
    _PLAIN, _BROKEN = re.compile(_SEGMENT), re.compile(f"{_SEGMENT}(?:\n{_SEGMENT})+")

    class _Words(dict):
        def __init__(self, make):
            super().__init__()
            self.make = make

        def __missing__(self, key):
            ids = self[key] = self.make(key)
            return ids

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.packed = [i.to_bytes(width, "little") for i in range(self.library.get_vocab_size())]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        #: The character that stands for each byte: itself where it can be seen, else the next one from 256 on.
        self.characters = {x: x for x in shown} | {x: 256 + i for i, x in enumerate(hidden)}
        special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        #: Marks that may stand behind ASCII letters without a look at more; none where a special text could be in such a word.
        simple = not any(re.fullmatch("[A-Za-z]*[^A-Za-z]?", x) for x in special)
        self.simple = {chr(x) for x in range(33, 127) if self._PLAIN.fullmatch("a" + chr(x)) and not chr(x).isalpha()} if simple else None
        self.blank = chr(self.characters[32])
        self.words, self.older = self._Words(self._word), {}
        self.marks = self._Words(self._pieces)
        self.line_feed = self._pieces("\n")

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self._ALONE.search(text):
                out.append(self._whole(text))
                continue
            if len(self.words) > self.KEPT:
                self.older, self.words = self.words, self._Words(self._word)
                self.marks.clear()
            first, *rest = text.split(" ")
            out.append(self._whole(first) + b"".join(map(self.words.__getitem__, rest)))
        return out

    def _whole(self, text: str) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in self.library.encode(text, add_special_tokens=False).ids]) if text else b""

    def _pieces(self, text: str) -> bytes:
        packed = self.packed
        shown = text.encode().decode("latin-1").translate(self.characters)  # a character for each byte
        return b"".join([packed[x.id] for x in self.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        known = self.older.get(word)
        if known is not None:
            return known
        if self.simple is not None and word.isascii():
            if word.isalpha():
                packed = self.packed  # ASCII letters stand for themselves
                return b"".join([packed[x.id] for x in self.tokenize(self.blank + word)])
            if word[-1:] in self.simple and word[:-1].isalpha():
                return self.words[word[:-1]] + self.marks[word[-1]]
        if not self.special(word):
            plain = self._PLAIN.fullmatch(word)
            if plain:
                letters, marks = plain.groups()
                return self.words[letters] + self.marks[marks] if marks else self._pieces(" " + letters)
            if "\n" in word and self._BROKEN.fullmatch(word):
                first, *others = word.split("\n")
                ids = [self.words[first]]
                for other in others:
                    letters, marks = self._PLAIN.fullmatch(other).groups()
                    ids += [self.line_feed, self.marks[letters], self.marks[marks] if marks else b""]
                return b"".join(ids)
        return self._whole(" " + word)


_ENCODERS: dict[tuple[str, int], ByteLevelEncoder] = {}


def byte_encoder(path: str, width: int) -> ByteLevelEncoder:
    """The encoder of this Python process for one vocabulary file."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = ByteLevelEncoder(path, width)
    return _ENCODERS[path, width]


def _overlapping(symbols: np.ndarray) -> np.ndarray:
    """Places of equal neighbours that overlap an earlier such pair: every second one of a run."""
    equal = np.flatnonzero(symbols[:-1] == symbols[1:])
    starts = np.append(True, np.diff(equal) > 1)[:len(equal)]
    return equal[(equal - equal[starts][np.cumsum(starts) - 1]) % 2 == 1]


def _by_pair(lefts: np.ndarray, rights: np.ndarray, at: np.ndarray, size: int,
             places: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as numbers in ascending order, each with its place; sorted as one number where pair and place fit into it."""
    bits, of_place = size.bit_length(), places.bit_length()
    if 2 * bits + of_place < 64:
        packed = np.sort((lefts << bits | rights) << of_place | at)
        pairs, at = packed >> of_place, packed & ((1 << of_place) - 1)
        return (pairs >> bits) << 32 | pairs & ((1 << bits) - 1), at
    pairs = lefts << 32 | rights
    order = np.argsort(pairs, kind="stable")
    return pairs[order], at[order]


def _compatible(lefts: np.ndarray, rights: np.ndarray, size: int) -> np.ndarray:
    """Which of the pairs, most frequent first, can be replaced at once: none may share a place with another.

    Each symbol is a left, a right or a twin (pair with itself) as in the first pair that has it; a pair is taken if
    both its symbols have their parts. The first pair always is.
    """
    rank = np.arange(len(lefts))
    part = np.full((3, size), len(lefts))
    twin = lefts == rights
    for row, symbols, which in ((0, lefts, ~twin), (1, rights, ~twin), (2, lefts, twin)):
        part[row][symbols[which][::-1]] = rank[which][::-1]
    as_left, as_right, as_twin = part
    return np.where(twin, as_twin[lefts] < np.minimum(as_left[lefts], as_right[lefts]),
                    (as_left[lefts] < np.minimum(as_right[lefts], as_twin[lefts]))
                    & (as_right[rights] < np.minimum(as_left[rights], as_twin[rights])))


def compress(ids: np.ndarray, vocabulary: int, barrier: int,
             least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs of symbols; rule r is the symbol ``vocabulary + r``) and symbol lengths that expand to ``ids``.

    Re-Pair, many pairs a round: each round replaces the frequent adjacent pairs that share no place, the most frequent
    first (see ``_compatible``), runs of one symbol from left to right, and rounds go on until no pair occurs ``least`` times. A
    pair can only become rarer, so a place is counted again only while its pair is frequent, or when one of its symbols
    is new. No pair goes on after ``barrier``, so a document behind it starts at a symbol of its own.
    """
    symbols = ids.astype(np.int32)
    rules, lengths = [], np.ones(vocabulary, np.int64)
    closing = np.zeros(vocabulary, bool)
    closing[barrier] = True
    alive = np.ones(len(symbols), bool)
    alive[-1:] = False
    while True:
        at = np.flatnonzero(alive)
        closed = closing[symbols[at]]
        alive[at[closed]] = False
        usable = alive.copy()
        usable[_overlapping(symbols)] = False
        at = np.flatnonzero(usable)
        if not len(at):
            break
        keys, at = _by_pair(symbols[at].astype(np.int64), symbols[at + 1].astype(np.int64), at, len(lengths), len(symbols))
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(begins, len(keys)))
        rare = np.repeat(counts < least, counts)
        alive[at[rare]] = False
        if counts.max() < least:
            break
        many = np.flatnonzero(counts >= least)
        many = many[np.argsort(-counts[many], kind="stable")]
        lefts, rights = keys[begins[many]] >> 32, keys[begins[many]] & 0xFFFFFFFF
        size = len(lengths)
        taken = np.sort(many[_compatible(lefts, rights, size)])
        number = np.full(len(counts), -1)
        number[taken] = np.arange(size, size + len(taken))
        number = np.repeat(number, counts)
        hit = number >= 0
        number, at = number[hit], at[hit]
        pairs = keys[begins[taken]]
        lefts, rights = pairs >> 32, pairs & 0xFFFFFFFF
        rules.append(np.column_stack((lefts, rights)))
        lengths = np.append(lengths, lengths[lefts] + lengths[rights])
        closing = np.append(closing, closing[rights])
        symbols[at] = number
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, alive = symbols[keep], alive[keep]
        # A place stands for the pair that begins there; that of a new symbol and the one before it are new.
        fresh = np.sort(at) - np.arange(len(at))
        alive[fresh] = True
        alive[fresh[fresh > 0] - 1] = True
        alive[-1:] = False
    found = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return symbols.astype("<u4"), found.astype("<u4"), lengths


class Shard:
    """A stored shard: rules, expansion lengths, symbols, and where documents begin."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not a token shard")
        vocabulary, n_rules, n_symbols, n_docs = np.frombuffer(data, "<u8", 4, 8).tolist()
        at = 40
        self.vocabulary = vocabulary
        self.rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(data, "<u4", n_rules, at)
        at += 4 * n_rules
        self.symbols = np.frombuffer(data, "<u4", n_symbols, at)
        at += 4 * n_symbols
        self.doc_ids = np.frombuffer(data, "<u8", n_docs, at)
        self.begins = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        self.sizes = np.frombuffer(data, "<u8", n_docs, at + 16 * n_docs).astype(np.int64)
        self.spans = np.concatenate((np.ones(vocabulary, np.int64), self.lengths.astype(np.int64)))

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the symbols [first, last): all symbols are opened once a level, each at its own place."""
        part = self.symbols[first:last].astype(np.int64)
        spans = self.spans[part]
        out = np.zeros(int(spans.sum()), "<u4")
        places = np.cumsum(spans) - spans
        while len(part):
            plain = part < self.vocabulary
            out[places[plain]] = part[plain]
            opened, places = self.rules[part[~plain] - self.vocabulary].astype(np.int64), places[~plain]
            places = np.concatenate((places, places + self.spans[opened[:, 0]]))
            part = np.concatenate((opened[:, 0], opened[:, 1]))
        return out

    def document(self, position: int, start: int = 0, length: int | None = None) -> np.ndarray:
        """Ids [start, start + length) of one document; only the symbols that cover them are expanded."""
        size = int(self.sizes[position])
        stop = size if length is None else min(size, start + length)
        begin = int(self.begins[position])
        end = int(self.begins[position + 1]) if position + 1 < len(self.begins) else len(self.symbols)
        ends = np.cumsum(self.spans[self.symbols[begin:end]])
        one, two = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[one - 1]) if one else 0
        return self.decode(begin + one, begin + min(two, end - begin))[start - before:stop - before]


def pack_shard(doc_ids: list[int | None], documents: list[bytes], width: int, vocabulary: int, barrier: int) -> bytes:
    """One shard as bytes: header, rules, expansion lengths, symbols, document index (id, first symbol, size).

    ``documents`` are ids of ``width`` bytes each; a null id is stored as 0 and named beside the shard.
    """
    ids = np.frombuffer(b"".join(documents), f"<u{width}")
    symbols, rules, lengths = compress(ids, vocabulary, barrier)
    sizes = np.array([len(x) // width for x in documents], dtype=np.int64)
    ends = np.cumsum(lengths[symbols])
    begins = np.searchsorted(ends, np.cumsum(sizes) - sizes, "right")
    named = np.array([0 if x is None else x for x in doc_ids], dtype=np.int64)
    head = np.array([vocabulary, len(rules), len(symbols), len(documents)], dtype="<u8")
    return b"".join([_MAGIC, head.tobytes(), rules.tobytes(), lengths[vocabulary:].astype("<u4").tobytes(),
                     symbols.tobytes(), named.tobytes(), begins.astype("<u8").tobytes(), sizes.astype("<u8").tobytes()])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS,
                      id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the ids of every row in ascending doc_id order (nulls first, repeated rows each) as compressed shards.

    Texts (null: empty) are dealt out by ranges of doc_id, then encoded and cut into shards of about ``shard_ids`` ids
    inside each range; a document is never split. Files are Parquet files under ``path``/shards with one shard per row,
    so Spark's committer answers for lost executors; ``path``/ranges has the ids before each range. An empty table
    makes no shards and reads back as no rows; a very long text is one document of one longer shard.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer, end_id)
    end = end_id.to_bytes(width, "little")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"),
                         F.monotonically_increasing_id().alias("row_tag"))

    def run(batches):
        import pyarrow as pa

        encoder = byte_encoder(tokenizer, width)
        vocabulary = max(encoder.library.get_vocab_size(), end_id + 1)
        names: list[int | None] = []
        parts: list[bytes] = []
        held = number = before = 0

        def shard():
            return pa.RecordBatch.from_pydict({
                "shard_no": pa.array([number], pa.int64()), "n_ids": pa.array([held], pa.int64()),
                "ids_before": pa.array([before], pa.int64()),
                "no_id": pa.array([[i for i, x in enumerate(names) if x is None]], pa.list_(pa.int32())),
                "data": pa.array([pack_shard(names, parts, width, vocabulary, end_id)], pa.binary())})

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
            for start, stop in text_batches(texts):
                for name, data in zip(ids[start:stop], encoder.encode(texts[start:stop])):
                    size = len(data) // width + 1
                    if held and held + size > shard_ids:
                        yield shard()
                        before += held
                        names, parts, held, number = [], [], 0, number + 1
                    names.append(name)
                    parts.append(data + end)
                    held += size
        if names:
            yield shard()

    ranged = source.repartitionByRange("doc_id", "row_tag").sortWithinPartitions("doc_id", "row_tag")
    shards = ranged.select("doc_id", "text").mapInArrow(run, "shard_no long, n_ids long, ids_before long, no_id array<int>, data binary")
    (shards.withColumn("range_no", F.spark_partition_id()).write.option("compression", "zstd")
     .parquet(f"{path}/shards"))
    range_starts(spark.read.parquet(f"{path}/shards"), "n_ids").write.parquet(f"{path}/ranges")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every stored document."""
    shards = spark.read.parquet(f"{path}/shards")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples():
                shard = Shard(bytes(row.data))
                ids = shard.decode()
                ends = np.cumsum(shard.sizes)
                names = pd.array(shard.doc_ids.astype(np.int64), dtype="Int64")
                names[list(row.no_id)] = pd.NA
                yield pd.DataFrame({
                    "range_no": row.range_no, "doc_id": names, "local": row.ids_before + ends - shard.sizes,
                    "n_tokens": shard.sizes,
                    "ids": [ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), shard.sizes.tolist())]})

    documents = shards.mapInPandas(run, "range_no int, doc_id long, local long, n_tokens long, ids binary")
    starts = F.broadcast(spark.read.parquet(f"{path}/ranges"))  # one row per range
    return documents.join(starts, "range_no").select(
        "doc_id", (F.col("local") + F.col("range_start")).alias("start"), "n_tokens", "ids")

