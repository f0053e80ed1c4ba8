"""Exact top-k search by integer inner product with k-d trees, one per shard."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorgrid.session import cut

SHARD_ROWS = 8192
LEAF_ROWS = 256
#: Rows whose medians place the shards. Every row is placed and searched, so the sample only shapes the boxes.
FIT_ROWS = 20_000
_BOXES = 1024
#: Sums up to this size are exact in double precision.
_EXACT = float(1 << 53)
_LEAST = -np.iinfo(np.int64).max


class KDTree:
    """Leaves of a k-d tree by median splits along the widest side, each with its tight bounding box."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points = points
        self.leaves: list[np.ndarray] = []
        open_ = [np.arange(len(points))]
        while open_:
            rows = open_.pop()
            own = points[rows]
            sides = own.max(axis=0) - own.min(axis=0)
            axis = int(sides.argmax()) if sides.size else 0
            if len(rows) <= leaf_rows or not sides.any():
                self.leaves += [rows[i:i + leaf_rows] for i in range(0, len(rows), leaf_rows)]
                continue
            half = np.argpartition(own[:, axis], len(rows) // 2)
            open_ += [rows[half[:len(rows) // 2]], rows[half[len(rows) // 2:]]]
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return box_bounds(queries, self.low, self.high)


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that any point in each box can have: queries by boxes."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search_tree(tree: KDTree, ids: np.ndarray, tags: np.ndarray, queries: np.ndarray, query_tags: np.ndarray,
                floor: np.ndarray, k: int):
    """Best k candidates of the tree for each query: (query index, id, score), with score at least ``floor``.

    Each query takes the leaves in the order of their bounds and stops at the first bound below its kth score so far;
    queries that want the same leaf next are scored together. Equal bounds are still opened: ties go to smaller ids.
    """
    bounds = tree.bounds(queries).astype(np.int64)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    best_score = np.full((n, k), _LEAST)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.copy()
    active = np.arange(n)
    for turn in range(len(tree.leaves)):
        leaf = order[active, turn]
        go = bounds[active, leaf] >= kth[active]
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for some in np.split(by_leaf, edges):
            who, rows = active[some], tree.leaves[leaf[some[0]]]
            scores = (queries[who] @ tree.points[rows].T).astype(np.int64)
            scores[query_tags[who][:, None] == tags[rows][None, :]] = _LEAST
            all_scores = np.concatenate((best_score[who], scores), axis=1)
            all_ids = np.concatenate((best_id[who], np.broadcast_to(ids[rows], scores.shape)), axis=1)
            top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best_score[who] = np.take_along_axis(all_scores, top, axis=1)
            best_id[who] = np.take_along_axis(all_ids, top, axis=1)
            kth[who] = np.maximum(kth[who], best_score[who, k - 1])
    found = (best_score > _LEAST) & (best_score >= floor[:, None])
    where = np.nonzero(found)
    return where[0], best_id[found], best_score[found]


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """id, tag, dim, vector (floor(scale * x)) of the rows whose vector, all components finite, is given."""
    items = F.col(vector_column).cast("array<double>")
    whole = F.forall(items, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return cut(vectors.select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("tag"),
                              items.alias("x"))
               .filter("id is not null and x is not null").filter(whole).select(
                   "id", "tag", F.size("x").alias("dim"),
                   F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vector")))


def _splits(sample: list[list[int]], cells: int) -> list[tuple[int, float]]:
    """Axis and threshold of each inner node of a tree of medians with ``cells`` (a power of two) leaves, as a heap."""
    points = np.array(sample, dtype=np.float64)
    found: list[tuple[int, float]] = []
    parts = {1: np.arange(len(points))}
    for node in range(1, cells):
        rows = parts.pop(node)
        own = points[rows] if len(rows) else points
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        middle = float(np.median(own[:, axis]))
        found.append((axis, middle))
        parts[2 * node] = rows[points[rows, axis] < middle]
        parts[2 * node + 1] = rows[points[rows, axis] >= middle]
    return found


def _cell(splits: list[tuple[int, float]], cells: int):
    """The leaf that a row falls into; the tree is two literal arrays with an entry for every inner node."""
    axes = F.lit([a + 1 for a, _ in splits])
    middles = F.lit([m for _, m in splits])
    levels = F.sequence(F.lit(1), F.lit(cells.bit_length() - 1))
    return F.aggregate(levels, F.lit(1), lambda node, _: node * 2 + F.when(
        F.element_at("vector", F.element_at(axes, node)) >= F.element_at(middles, node), 1).otherwise(0))


def exact_top_k(vectors: DataFrame, k: int = 5, query_step: int = 50, scale: float = 256.0, id_column: str = "vec_id",
                vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Each query's k best candidates: query_id, rank, vec_id, score; queries are rows with id divisible by the step.

    Components are floor(scale * x); the score is their integer inner product; candidates are all rows but the query's
    own, ties go to the smaller id. Shards are cells of median splits fitted on a bounded sample, and a cell with too
    many rows (equal vectors, say) is split further by row number. A query first searches the shard with the best box
    bound; its kth score there then goes along to the other shards, and only shards whose box bound reaches it are
    searched. Each shard's tree is built once a pass, for all queries that come to it.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors are compared with those
    of the same length. Rows with one id are candidates each, and queries each. Scores must fit 64-bit integers.
    """
    rows = integer_vectors(vectors, id_column, vector_column, scale)
    spark = rows.sparkSession
    dims = [r["dim"] for r in rows.groupBy("dim").count().orderBy("dim").collect()]
    found = [_search(rows.filter(F.col("dim") == d), int(d), k, query_step, shard_rows, fit_rows) for d in dims]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _search(rows: DataFrame, dim: int, k: int, query_step: int, shard_rows: int, fit_rows: int) -> DataFrame:
    spark = rows.sparkSession
    count = rows.count()
    cells = 1
    while cells * shard_rows < count:
        cells *= 2
    cell = F.lit(1)
    if cells > 1 and dim:
        sample = rows.orderBy(F.xxhash64("tag")).limit(fit_rows).select("vector").collect()
        cell = _cell(_splits([r["vector"] for r in sample], cells), cells)
    placed = cut(rows.select("id", "tag", "vector", cell.alias("cell")))
    sizes = placed.groupBy("cell").count()
    part = F.pmod(F.xxhash64("tag"), F.ceil(F.col("count") / shard_rows))
    shards = cut(placed.join(sizes, "cell").select("id", "tag", "vector", (F.col("cell") * (1 << 32) + part).alias("shard")))
    boxes = cut(shards.groupBy("shard").applyInPandas(_box, "shard long, low array<long>, high array<long>"))
    n_boxes, is_query = boxes.count(), F.col("id") % query_step == 0
    chunks = max(1, -(-shards.filter(is_query).count() // shard_rows))
    queries = cut(shards.filter(is_query).select("id", "tag", "vector", F.lit(None).cast("long").alias("floor"),
                                                 F.lit(None).cast("long").alias("home"),
                                                 F.pmod(F.xxhash64("tag"), F.lit(chunks)).alias("chunk")))
    blocks = max(1, -(-n_boxes // _BOXES))
    homes = cut(_bounded(queries, boxes, chunks, blocks).groupBy("tag").agg(F.max_by("shard", F.struct("bound", "shard"))
                                                                         .alias("home")))
    pairs = queries.drop("home").join(homes, "tag").withColumn("shard", F.col("home"))
    first = cut(_searched(pairs, shards, chunks, k))
    floors = first.groupBy("query_tag").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(
        F.col("n") == k).select(F.col("query_tag").alias("tag"), "floor")
    known = cut(queries.drop("floor", "home").join(homes, "tag").join(floors, "tag", "left"))
    wanted = _bounded(known, boxes, chunks, blocks).select("tag", "shard")
    second = _searched(known.join(wanted, "tag"), shards, chunks, k)
    order = Window.partitionBy("query_tag").orderBy(F.col("score").desc(), "vec_id")
    return (first.unionByName(second).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _box(pdf):
    import pandas as pd

    points = np.stack(pdf["vector"].to_list()) if len(pdf["vector"].iloc[0]) else np.zeros((len(pdf), 0), np.int64)
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "low": [points.min(axis=0)], "high": [points.max(axis=0)]})


def _stack(column) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _exact_pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where products and sums are exact in them, else as 64-bit integers."""
    top = [float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0 for x in (a, b)]
    return (a.astype(np.float64), b.astype(np.float64)) if top[0] * top[1] * max(1, a.shape[1]) < _EXACT else (a, b)


def _bounded(queries: DataFrame, boxes: DataFrame, chunks: int, blocks: int) -> DataFrame:
    """tag, shard, bound. A query without a home gets its best shards; one with a home all others that reach its floor.

    Chunks of queries meet blocks of boxes; no row of either is repeated more often than there are blocks of the other.
    """
    left = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (boxes.withColumn("block", F.pmod(F.xxhash64("shard"), F.lit(blocks)).cast("int"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>"))))

    def run(some, own):
        import pandas as pd

        if not len(some) or not len(own):
            return pd.DataFrame({"tag": [], "shard": [], "bound": []}).astype("int64")
        points, low = _exact_pair(_stack(some["vector"]), _stack(own["low"]))
        same, high = _exact_pair(_stack(some["vector"]), _stack(own["high"]))
        if points.dtype != same.dtype:
            points, low, high = (x.astype(np.int64) for x in (points, low, high))
        bound = box_bounds(points, low, high).astype(np.int64)
        tags, shards = some["tag"].to_numpy(), own["shard"].to_numpy()
        if some["home"].isna().all():
            best = bound.argmax(axis=1)
            return pd.DataFrame({"tag": tags, "shard": shards[best], "bound": bound[np.arange(len(tags)), best]})
        floor = np.array([_LEAST if pd.isna(x) else int(x) for x in some["floor"]], dtype=np.int64)
        rows, columns = np.nonzero((bound >= floor[:, None])
                                   & (shards[None, :] != some["home"].to_numpy(dtype=np.int64)[:, None]))
        return pd.DataFrame({"tag": tags[rows], "shard": shards[columns], "bound": bound[rows, columns]})

    return (left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))
            .applyInPandas(run, "tag long, shard long, bound long"))


def _searched(pairs: DataFrame, shards: DataFrame, chunks: int, k: int) -> DataFrame:
    """query_tag, query_id, vec_id, score: the k best candidates of each shard for the queries that come to it."""
    right = shards.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")))

    def run(some, own):
        import pandas as pd

        if not len(some) or not len(own):
            return pd.DataFrame({"query_tag": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        points, queries = _exact_pair(_stack(own["vector"]), _stack(some["vector"]))
        floor = np.array([_LEAST if pd.isna(x) else int(x) for x in some["floor"]], dtype=np.int64)
        who, ids, scores = search_tree(KDTree(points), own["id"].to_numpy(), own["tag"].to_numpy(), queries,
                                       some["tag"].to_numpy(), floor, k)
        return pd.DataFrame({"query_tag": some["tag"].to_numpy()[who], "query_id": some["id"].to_numpy()[who],
                             "vec_id": ids, "score": scores})

    return (pairs.select("id", "tag", "vector", "floor", "shard", "chunk").groupBy("shard", "chunk")
            .cogroup(right.groupBy("shard", "chunk"))
            .applyInPandas(run, "query_tag long, query_id long, vec_id long, score long"))
