"""Product codes of vectors by exact integer k-means, with tries over the distinct parts.

Components become integers, floor(scale * x), and vectors are cut into equal consecutive parts. Each part position has
a codebook that starts as that part of the vectors with the smallest ids; rounds of assignment and floored means follow.

Vectors are read once. Each block of at most ``BLOCK_ROWS`` of them gives one trie per part position: its distinct
parts in lexicographic order, level by level, with the number of vectors at each leaf, so repeated vectors cost nothing
from here on. A round walks every trie depth first. A node holds the squared distances of its prefix to all entries;
children add one component's distances to them, so a prefix that many parts share is measured once. A leaf takes the
least distance (ties: lower index) and adds its part, weighted, to that entry's sums. A walk yields one row per entry,
Spark adds these up, and only the sums of the codebooks (positions x entries) come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorgrid.llm.common import free_name
from tremorgrid.session import cut

BLOCK_ROWS = 1 << 14
#: Nodes whose distances are held at once for each level of a walk.
WALK_NODES = 1 << 12
#: Greatest size of a scaled component: distances of whole vectors of up to 512 components stay exact in 64 bits.
LIMIT = 1 << 26

_TRIE = "position int, vectors long, values array<binary>, children array<binary>, weights binary"
_SUMS = "position int, entry int, vectors long, sums array<long>"


def part_bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    """First and last component (exclusive) of each part; equal where ``parts`` divides ``dims``."""
    return [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(vectors.astype(np.float64) * scale)
    if whole.size and np.abs(whole).max() > LIMIT:
        raise ValueError(f"a component times {scale} is beyond {LIMIT}, past which sums of squares are not exact")
    return whole.astype(np.int64)


def build_trie(parts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Levels of the trie over the rows of ``parts``: values of the nodes, first child of each node (and, last, their
    number), the weight of each leaf, and the leaf of each row."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    rows = parts[order]
    opens = np.zeros(len(rows), dtype=bool)
    opens[:1] = True
    values, starts = [], []
    for d in range(parts.shape[1]):
        opens[1:] |= rows[1:, d] != rows[:-1, d]
        starts.append(np.flatnonzero(opens))
        values.append(rows[starts[-1], d])
    leaves = starts[-1] if starts else np.flatnonzero(opens)
    children = [np.append(np.searchsorted(starts[d + 1], starts[d]), len(starts[d + 1])) for d in range(len(starts) - 1)]
    leaf_of = np.empty(len(rows), dtype=np.int64)
    leaf_of[order] = np.searchsorted(leaves, np.arange(len(rows)), side="right") - 1
    return values, children, np.diff(np.append(leaves, len(rows))), leaf_of


def walk_trie(values: list[np.ndarray], children: list[np.ndarray], codebook: np.ndarray, visit) -> None:
    """Depth-first walk; calls ``visit(first leaf, paths, codes, distances)`` for the leaves in order.

    Nodes travel in runs of at most ``WALK_NODES`` neighbours with the prefix and the distances of each, so a walk
    holds at most one run of distances per level, however large the trie.
    """
    depth = len(values)

    def runs(level, low, high, paths, distances, counts):
        for start in range(low, high, WALK_NODES):
            stop = min(start + WALK_NODES, high)
            own = values[level][start:stop]
            parent = np.repeat(np.arange(len(counts)), counts)[start - low:stop - low]
            step = own[:, None] - codebook[None, :, level]
            yield start, stop, np.column_stack([paths[parent], own]), distances[parent] + step * step

    first = np.zeros((1, 0), dtype=np.int64), np.zeros((1, len(codebook)), dtype=np.int64)
    stack = [runs(0, 0, len(values[0]), *first, np.array([len(values[0])]))]
    while stack:
        run = next(stack[-1], None)
        if run is None:
            stack.pop()
            continue
        start, stop, paths, distances = run
        level = len(stack) - 1
        if level == depth - 1:
            codes = distances.argmin(axis=1)
            visit(start, paths, codes, distances[np.arange(len(codes)), codes])
            continue
        bounds = children[level][start:stop + 1]
        stack.append(runs(level + 1, int(bounds[0]), int(bounds[-1]), paths, distances, np.diff(bounds)))


def _blocks(batches, column: str):
    """Batches of rows joined to blocks of about ``BLOCK_ROWS``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _matrix(column, dims: int) -> np.ndarray:
    flat = pc.list_flatten(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _tries(scale: int, dims: int, bounds):
    def build(batches):
        for block in _blocks(batches, "vector"):
            whole = scaled(_matrix(block.column("vector"), dims), scale)
            for position, (low, high) in enumerate(bounds):
                if low == high:
                    continue
                values, children, weights, _ = build_trie(whole[:, low:high])
                yield pa.RecordBatch.from_pylist([{
                    "position": position, "vectors": len(whole), "values": [_packed(v) for v in values],
                    "children": [_packed(c) for c in children], "weights": _packed(weights),
                }], schema=_trie_schema())
    return build


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in 2 bytes each if all fit, else 4; the first byte tells which."""
    width = 2 if not len(numbers) or np.abs(numbers).max() < 1 << 15 else 4
    return bytes([width]) + numbers.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def _trie_schema():
    return pa.schema([("position", pa.int32()), ("vectors", pa.int64()), ("values", pa.list_(pa.binary())),
                      ("children", pa.list_(pa.binary())), ("weights", pa.binary())])


def _sum_schema():
    return pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("vectors", pa.int64()),
                      ("sums", pa.list_(pa.int64()))])


def _round(codebooks: list[np.ndarray]):
    """Sums and counts of every entry over the tries of a task."""
    def walk(batches):
        sums = [np.zeros_like(book) for book in codebooks]
        counts = [np.zeros(len(book), dtype=np.int64) for book in codebooks]
        for row in (part for batch in batches for n in range(batch.num_rows) for part in batch.slice(n, 1).to_pylist()):
            weights, position = _unpacked(row["weights"]), row["position"]

            def visit(start, paths, codes, _, weights=weights, position=position):
                own = weights[start:start + len(codes)]
                np.add.at(sums[position], codes, paths * own[:, None])
                np.add.at(counts[position], codes, own)

            walk_trie([_unpacked(v) for v in row["values"]], [_unpacked(c) for c in row["children"]],
                      codebooks[position], visit)
        yield pa.RecordBatch.from_pylist(
            [{"position": p, "entry": e, "vectors": int(counts[p][e]), "sums": sums[p][e].tolist()}
             for p in range(len(codebooks)) for e in range(len(codebooks[p])) if counts[p][e]], schema=_sum_schema())
    return walk


def _fit(tries: DataFrame, codebooks: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    dims = max(book.shape[1] for book in codebooks)
    for _ in range(rounds):
        added = tries.mapInArrow(_round(codebooks), _SUMS).groupBy("position", "entry").agg(
            F.sum("vectors").alias("vectors"),
            F.array(*[F.sum(F.get("sums", F.lit(d))) for d in range(dims)]).alias("sums"))
        codebooks = [book.copy() for book in codebooks]
        for row in added.collect():  # one row per entry of a codebook
            book = codebooks[row["position"]]
            book[row["entry"]] = np.array(row["sums"][:book.shape[1]], dtype=np.int64) // row["vectors"]
    return codebooks


def _coder(scale: int, dims: int, bounds, codebooks: list[np.ndarray], vector: str, schema: pa.Schema):
    """Codes and errors of the vectors of each block, by a walk of the block's own tries."""
    def code(batches):
        for block in _blocks(batches, vector):
            column = block.column(vector)
            fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
            usable = fits.to_numpy(zero_copy_only=False)
            whole = scaled(_matrix(column.filter(fits), dims), scale)
            codes = np.zeros((len(whole), len(bounds)), dtype=np.int64)
            error = np.zeros(len(whole), dtype=np.int64)
            for position, (low, high) in enumerate(bounds):
                if low == high or not len(whole):
                    continue
                values, children, weights, leaf_of = build_trie(whole[:, low:high])
                chosen, away = np.empty(len(weights), dtype=np.int64), np.empty(len(weights), dtype=np.int64)

                def visit(start, paths, best, distance, chosen=chosen, away=away):
                    chosen[start:start + len(best)] = best
                    away[start:start + len(best)] = distance

                walk_trie(values, children, codebooks[position], visit)
                codes[:, position] = chosen[leaf_of]
                error += away[leaf_of]
            at = np.cumsum(usable) - 1
            texts = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            out = block.drop_columns([vector])
            out = out.append_column("code", pa.array([texts[i] if ok else None for i, ok in zip(at, usable)], pa.string()))
            errors = [int(error[i]) if ok else None for i, ok in zip(at, usable)]
            yield from out.append_column("error", pa.array(errors, pa.int64())).cast(schema).to_batches()
    return code


def usable_vectors(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not null and holds neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad)


def code_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8,
    entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """Columns ``vec_id``, ``label``, ``code`` (two hex digits per part) and ``error`` of each usable vector, and the
    final codebooks (position, entry, component).

    Rows whose vector is null or holds null or non-finite components are left out. Codebooks start from the
    ``entries`` smallest ids; a null id comes last, equal ids are ordered by their vectors, and fewer vectors give
    fewer entries. The length of vectors is that of the first of these; a vector of another length has a null code
    and error and takes no part in the fit. Repeated rows count as often as they occur. An empty table gives an empty
    result and no codebooks; vectors without components have the code 00 in every part and no error. A component
    beyond ``LIMIT`` / ``scale`` is an error, because its sums would not be exact. Other columns of ``df``, whatever
    their names, are not read.
    """
    spark = df.sparkSession
    rows = usable_vectors(df.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
        F.transform(vector, lambda x: x.cast("double")).alias("vector")), "vector")
    first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    types = {f.name: f.dataType for f in rows.schema.fields}
    result = T.StructType([
        T.StructField("vec_id", types["vec_id"]), T.StructField("label", types["label"]),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first:
        return spark.createDataFrame([], result), []
    dims = len(first[0]["vector"])
    bounds = part_bounds(dims, parts)
    same = [r["vector"] for r in first if len(r["vector"]) == dims]
    start = scaled(np.array(same, dtype=float).reshape(len(same), dims), scale)
    codebooks = [start[:, low:high] for low, high in bounds]
    if dims:
        fitting = rows.where(F.size("vector") == dims).select("vector")
        tries = cut(fitting.mapInArrow(_tries(scale, dims, bounds), _TRIE))
        codebooks = _fit(tries, codebooks, rounds)
    from pyspark.sql.pandas.types import to_arrow_schema

    coded = rows.mapInArrow(
        _coder(scale, dims, bounds, codebooks, "vector", to_arrow_schema(result)), result)
    return coded, [book.tolist() for book in codebooks]


def decode_vectors(codes: DataFrame, codebooks: list[list[list[int]]], scale: int = 4096) -> DataFrame:
    """``codes`` with ``decoded``: the entries that each code names, end to end, divided by ``scale``; null for none."""
    books = F.lit([[[x / scale for x in entry] for entry in book] for book in codebooks])
    width = len(codebooks)
    position = F.sequence(F.lit(0), F.lit(width - 1))
    entry = lambda p: F.conv(F.substring(F.col("code"), p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("decoded", F.when(F.col("code").isNotNull(), F.flatten(
        F.transform(position, lambda p: F.get(F.get(books, p), entry(p))))))


def with_group_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """``codes`` with ``label_error``: the sum of ``error`` over rows of equal label, nulls together.

    Errors are added up before the shuffle, one row per label and task; the sums meet the rows by a join.
    """
    name = free_name(codes, "_group")
    key = F.struct(F.col(label).alias("label"))
    sums = codes.groupBy(key.alias(name)).agg(F.sum("error").alias("label_error"))
    return codes.withColumn(name, key).join(sums, name, "left").drop(name)
