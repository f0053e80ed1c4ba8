"""Packing documents into fixed-length sequences along a space-filling curve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.llm.common import id_width, running_start, text_batches, word_encoder
from tremorgrid.session import cut

LENGTH = 4096
END_ID = 2
DIMENSIONS, BITS = 6, 10


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the splitmix finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signs(count: int, dimensions: int) -> np.ndarray:
    """The projection: +1 or -1 for each id and dimension, from bits of the id's hash."""
    bits = mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where((bits[:, None] >> np.arange(dimensions, dtype=np.uint64)) & np.uint64(1), 1, -1).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) with ``bits`` bits per coordinate, at most 63 in all.

    The published transpose form: coordinates are untwisted bit by bit from the top, Gray-decoded, and interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    twist = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        twist ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= twist
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level) & 1
    return key


def curve_keys(ids: list[np.ndarray], table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents: summed sign rows of their ids, scaled to unit length, cut into cells."""
    lengths = np.array([len(x) for x in ids])
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
    full = np.flatnonzero(lengths)
    vectors = np.zeros((len(ids), table.shape[1]), dtype=np.float64)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        for d in range(table.shape[1]):
            vectors[full, d] = np.add.reduceat(table[:, d][flat], starts, dtype=np.float64)
    norm = np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    cells = np.minimum(((unit + 1) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    return hilbert_key(cells, bits)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, width: int, id_column: str,
                     text_column: str) -> DataFrame:
    """doc_id, row_tag, n_tokens, curve_key, ids (little-endian, ``width`` bytes each) of every row, written."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"),
                         F.monotonically_increasing_id().alias("row_tag"))
    end = end_id.to_bytes(width, "little")

    def run(batches):
        import pyarrow as pa

        encoder = word_encoder(tokenizer, False, width)
        projection = signs(encoder.library.get_vocab_size(), DIMENSIONS)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for start, stop in text_batches(texts):
                ids = encoder.encode(texts[start:stop])
                own = batch.slice(start, stop - start)
                keys = curve_keys([np.frombuffer(x, dtype=f"<u{width}") for x in ids], projection)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": own.column("doc_id"), "row_tag": own.column("row_tag"),
                    "n_tokens": pa.array([len(x) // width + 1 for x in ids], pa.int64()),
                    "curve_key": pa.array(keys, pa.int64()), "ids": pa.array([x + end for x in ids], pa.binary())})

    return cut(source.mapInArrow(run, "doc_id long, row_tag long, n_tokens long, curve_key long, ids binary"))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Each document (null text: empty) is its ids and ``end_id``. Hashed id counts are projected to six dimensions by
    random signs and scaled to unit length; documents are ordered along the Hilbert curve through that space, so
    neighbours in a sequence are alike. Ties, as between copies, are decided by doc_id and then by row, so a hot key is
    spread over ranges like any other. The documents lie end to end on the curve and are cut every ``length`` ids: only
    the last sequence is short, whatever the sizes. Repeated rows are packed each; a null id stays null; an empty table
    gives no pieces.

    Ids are written once, thin rows are range-sorted, and one join brings the ids to their places.
    """
    width = id_width(tokenizer, end_id)
    encoded = encode_documents(docs, tokenizer, end_id, width, id_column, text_column)
    placed = running_start(encoded.select("doc_id", "row_tag", "n_tokens", "curve_key"),
                           ["curve_key", "doc_id", "row_tag"], "n_tokens")
    joined = encoded.select("row_tag", "ids").join(
        placed.select("row_tag", "doc_id", "n_tokens", "start").hint("merge"), "row_tag")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            begins = batch.column("start").to_numpy()
            first, last = begins // length, (begins + sizes - 1) // length
            row = np.repeat(np.arange(len(sizes)), last - first + 1)
            sequence = first[row] + np.arange(len(row)) - np.searchsorted(row, row)
            begin = np.maximum(sequence * length, begins[row])
            size = np.minimum((sequence + 1) * length, begins[row] + sizes[row]) - begin
            ids = [np.frombuffer(x.as_buffer(), dtype=f"<u{width}") for x in batch.column("ids")]
            pieces = [ids[r][a:a + n].astype("<u4").tobytes()
                      for r, a, n in zip(row.tolist(), (begin - begins[row]).tolist(), size.tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(row)), "start": pa.array(begin - begins[row]),
                "length": pa.array(size), "ids": pa.array(pieces, pa.binary()), "doc_tokens": pa.array(sizes[row]),
                "sequence_id": pa.array(sequence), "offset": pa.array(begin - sequence * length)})

    return joined.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, "
                                  "sequence_id long, offset long")
