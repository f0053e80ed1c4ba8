"""Near-duplicate join on word n-grams: MinHash bands find candidates, whole n-gram sets decide."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorgrid.llm.common import connected, free_name, text_batches
from tremorgrid.llm.packing import mixed
from tremorgrid.session import cut

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.99999, 160
#: Bounds of one verification block: documents, and n-grams of all of them.
BLOCK_DOCS, BLOCK_GRAMS = 1024, 2_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Number of bands and rows per band: the most rows (fewest false candidates) that reach ``recall`` at the threshold.

    A pair of similarity s agrees in at least one of b bands of r rows with probability 1 - (1 - s^r)^b.
    """
    best = (hashes, 1)
    for rows in range(1, 33):
        miss = 1 - threshold ** rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss > 0 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def grams_of(texts: list[str], words: int) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text its sorted distinct n-gram hashes and a digest of its words.

    Words are the lower-cased text cut at white space. A text with fewer words has one n-gram of all of them; a text
    without words has none.
    """
    import hashlib

    from pandas.util import hash_array

    split = [t.lower().split() for t in texts]
    lengths = np.array([len(s) for s in split], dtype=np.int64)
    flat = hash_array(np.array([w for s in split for w in s] or [""], dtype=object), categorize=False).astype(np.uint64)
    sets, digests = [], []
    starts = np.cumsum(lengths) - lengths
    rolled = np.zeros(len(flat), dtype=np.uint64)
    for j in range(words):
        part = mixed(flat + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rolled[:len(flat) - j] += part[j:] if j else part
    rolled = mixed(rolled)
    for start, n in zip(starts.tolist(), lengths.tolist()):
        own = flat[start:start + n]
        digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
        if n == 0:
            sets.append(np.zeros(0, np.uint64))
        elif n < words:
            sets.append(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "<u8").astype(np.uint64))
        else:
            sets.append(np.unique(rolled[start:start + n - words + 1]))
    return sets, digests


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (documents by bands) from ``bands * rows`` minima of multiplied and shifted n-gram hashes."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    lengths = np.array([len(sets[i]) for i in full])
    starts = np.cumsum(lengths) - lengths
    seeds = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((len(full), bands), dtype=np.uint64)
    work = np.empty_like(flat)
    for band in range(bands):
        for row in range(rows):
            k = band * rows + row
            np.multiply(flat ^ seeds[2 * k], seeds[2 * k + 1] | np.uint64(1), out=work)
            work ^= work >> np.uint64(32)
            low = np.minimum.reduceat(work, starts)
            keys[:, band] = mixed(keys[:, band] + low + np.uint64(k + 1))
        keys[:, band] += np.uint64(band)
    out[full] = keys
    return out


def links_in_block(sets: list[np.ndarray], groups: np.ndarray, threshold: float, left: int | None = None):
    """Pairs (i, j), i < j, of one block whose sets are at least ``threshold`` alike, found over shared n-grams only.

    ``groups``: only documents of one group are compared. ``left``: the first so many documents are only compared with
    the rest. Counts of common n-grams come from dense products over those n-grams that two documents share, a slab of
    n-grams at a time.
    """
    found_i, found_j = [], []
    order = np.argsort(groups, kind="stable")
    edges = np.flatnonzero(np.diff(groups[order])) + 1
    for members in np.split(order, edges):
        m = len(members)
        if m < 2:
            continue
        sizes = np.array([len(sets[i]) for i in members])
        flat = np.concatenate([sets[i] for i in members])
        owner = np.repeat(np.arange(m), sizes)
        values, slot, counts = np.unique(flat, return_inverse=True, return_counts=True)
        shared = counts[slot] > 1
        number = np.cumsum(counts > 1) - 1
        slot, owner = number[slot[shared]], owner[shared]
        width = int((counts > 1).sum())
        common = np.zeros((m, m), dtype=np.float32)
        slab = max(1, 4_000_000 // m)
        by_slot = np.argsort(slot, kind="stable")
        slot, owner = slot[by_slot], owner[by_slot]
        for begin in range(0, width, slab):
            a, b = np.searchsorted(slot, (begin, begin + slab))
            dense = np.zeros((m, min(slab, width - begin)), dtype=np.float32)
            dense[owner[a:b], slot[a:b] - begin] = 1
            common += dense @ dense.T
        union = sizes[:, None] + sizes[None, :] - common
        alike = np.triu(common >= threshold * union - 1e-6, 1)
        if left is not None:
            first = members < left
            alike &= first[:, None] != first[None, :]
        i, j = np.nonzero(alike)
        found_i.append(members[i])
        found_j.append(members[j])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index each of ``n`` nodes is connected to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                    threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES,
                    tag: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, kept, row_tag.

    Two texts are linked if the Jaccard similarity of their sets of ``words``-word n-grams is at least ``threshold``;
    texts with the same words are copies and linked. ``class_id`` is the smallest doc_id connected through links,
    ``n_links`` the number of other rows at the threshold, copies included, and exactly one row of each class, one with
    the smallest doc_id, is ``kept``.

    ``tag`` names a unique row number that ``docs``, a written table, already has; without it the texts are written.
    Copies are taken together first, so a hot text is one representative. Its bands (``choose_bands``) are shuffled by
    their hashes; buckets are never expanded into pairs: representatives connected through buckets form candidate
    groups, each representative's whole text goes once to its group, and a group with more rows or n-grams than a block
    holds is cut into blocks that are compared two by two. Every pair that shares a band is compared exactly.

    Texts without words (null, empty, blank) are copies of each other. Null ids are the largest ids of their class. An
    empty table gives no rows. Only pairs that miss every band can be lost: one in 1 / (1 - recall) at the threshold.
    """
    bands, rows = choose_bands(threshold, recall, hashes)
    named = docs.select(F.col(tag) if tag else F.monotonically_increasing_id().alias("row_tag"),
                        F.col(id_column).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    source = named.withColumnRenamed(tag, "row_tag") if tag else cut(named)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in text_batches(texts, 2_000_000):
                sets, digests = grams_of(texts[start:stop], words)
                keys = band_keys(sets, bands, rows).view(np.int64)
                own = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_pydict({
                    "row_tag": own.column("row_tag"), "doc_id": own.column("doc_id"), "digest": pa.array(digests),
                    "n_grams": pa.array([len(s) for s in sets], pa.int64()),
                    "bands": pa.array([k.tolist() if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64()))})

    base = cut(source.mapInArrow(run, "row_tag long, doc_id long, digest binary, n_grams long, bands array<long>"))
    copies = cut(base.groupBy("digest").agg(F.min("row_tag").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_tag")).alias("low")))
    reps = copies.select("rep", "copies", "low")
    # Only a representative's own row goes on; its bands are thin.
    thin = cut(base.select(F.col("row_tag").alias("rep"), "n_grams", "bands").join(copies.select("rep", "copies"), "rep"))
    hubs = thin.select("rep", F.posexplode("bands").alias("band", "key")).select(
        F.col("rep").alias("node"), F.xxhash64("band", "key").alias("hub"))
    shared = hubs.groupBy("hub").count().filter("count > 1").select("hub")
    members = cut(hubs.join(shared, "hub"))
    groups = connected(members).withColumnRenamed("node", "rep").withColumnRenamed("label", "candidate")
    weighed = cut(groups.join(thin.select("rep", "copies", "n_grams"), "rep"))
    totals = weighed.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams_in"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("grams_in") / BLOCK_GRAMS)).cast("int")
    small = (F.sum("grams_in")).alias("all")
    sized = cut(totals.select("candidate", "n", "grams_in", blocks.alias("blocks")))
    together = sized.filter("blocks = 1").agg(small).first()[0] or 0
    shelves = max(1, -(-int(together) // (BLOCK_GRAMS // 4)))
    dealt = weighed.join(sized.select("candidate", "blocks"), "candidate").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = dealt.withColumn("other", other).select(
        "rep", "copies", "candidate", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("candidate"), F.lit(shelves))).otherwise(-1).alias("shelf"),
        F.when(F.col("blocks") == 1, F.lit(0).cast("long")).otherwise(F.col("candidate")).alias("large"))
    # Never a broadcast, however few the tasks are: they grow with the documents.
    sent = source.select(F.col("row_tag").alias("rep"), "text").join(cut(tasks).hint("merge"), "rep")

    def compare(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["block", "rep"], kind="stable").reset_index(drop=True)
        a, b = key[2], key[3]
        left = int((pdf["block"] == a).sum()) if a != b else None
        sets, _ = grams_of(pdf["text"].tolist(), words)
        i, j = links_in_block(sets, pdf["candidate"].to_numpy(), threshold, left)
        copies_ = pdf["copies"].to_numpy()
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, i, copies_[j])
        np.add.at(links, j, copies_[i])
        reps_ = pdf["rep"].to_numpy()
        return pd.DataFrame({"rep": reps_, "links": links, "root": reps_[_roots(len(pdf), i, j)]})

    compared = cut(sent.groupBy("large", "shelf", "a", "b").applyInPandas(compare, "rep long, links long, root long"))
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = compared.filter("rep <> root").select("rep", "root")
    edges = cut(joined.select(F.col("rep").alias("node"), F.col("root").alias("hub")).unionByName(
        joined.select(F.col("root").alias("node"), F.col("root").alias("hub"))))
    classes = connected(edges).withColumnRenamed("node", "rep").withColumnRenamed("label", "class_rep")
    labelled = reps.join(classes, "rep", "left").join(links, "rep", "left").withColumn(
        "class_rep", F.coalesce("class_rep", "rep"))
    lowest = labelled.groupBy("class_rep").agg(F.min("low").alias("lowest"))
    result = cut(labelled.join(lowest, "class_rep").select(
        "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "lowest"))
    by_digest = result.join(copies.select("rep", "digest"), "rep")
    return base.select("row_tag", "doc_id", "digest").join(by_digest, "digest").select(
        "doc_id", F.col("lowest.doc_id").alias("class_id"), "n_links",
        (F.col("lowest.row_tag") == F.col("row_tag")).alias("kept"), "row_tag")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near duplicates; all columns stay."""
    tag = free_name(docs, "row_tag")
    rows = cut(docs.withColumn(tag, F.monotonically_increasing_id()))
    kept = near_duplicates(rows, id_column, text_column, tag=tag, **options).filter("kept").select(
        F.col("row_tag").alias(tag))
    return rows.join(kept.hint("merge"), tag, "left_semi").select(*docs.columns)
