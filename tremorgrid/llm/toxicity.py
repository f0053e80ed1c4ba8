"""Toxicity by compression distance: which of two zstandard dictionaries compresses a window of text better."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorgrid.llm.common import free_name
from tremorgrid.session import cut

#: Bound on the labelled rows of each class that are trained on: those with the smallest hashes of their ids.
SAMPLE_ROWS = 4000
WINDOW_WORDS = 8
SHARED_BYTES, OWN_BYTES = 20_000, 8_000
LEVEL = 3
#: A word belongs to the toxic dictionary if its share of toxic texts is so many times its share of ordinary ones ...
RATIO = 20.0
#: ... and the likelihood-ratio statistic of the two shares is at least this.
EVIDENCE = 25.0
#: Shares of a word and bytes of a window from which a saving is counted; calibration weighs the counts.
WORD_SAVINGS, WINDOW_SAVINGS = (0.35, 0.5, 0.65), (2, 4, 6)
FEATURES = 1 + 2 * (len(WORD_SAVINGS) + len(WINDOW_SAVINGS)) + 2
WORDS_KEPT = 200_000
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id as text is divisible by five: such labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Two dictionaries that differ only in their last part, a neutral context, and the calibrated weights.

    Both begin with the same ordinary text, so text that neither knows costs the same in both and the difference of
    two compressed lengths is what the toxic or the further ordinary words save.
    """

    ordinary: bytes
    toxic: bytes
    context: bytes
    weights: tuple[float, ...] | None = None

    def _tools(self):
        import zstandard

        if "_compressors" not in self.__dict__:
            made = []
            for content in (self.ordinary, self.toxic):
                trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                trained.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=trained, write_content_size=False, write_dict_id=False))
            self._compressors, self._words = made, {}
        return self._compressors

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def saving(self, window: bytes) -> int:
        """Bytes by which the toxic dictionary is better on ``window``; the compressor never looks for matches in the
        last bytes of its input, hence the context behind it."""
        ordinary, toxic = self._tools()
        padded = b" " + window + b" " + self.context
        return len(ordinary.compress(padded)) - len(toxic.compress(padded))

    def word_saving(self, word: str) -> float:
        """Share of one word that the toxic dictionary saves, measured in the neutral context."""
        known = self._words.get(word)
        if known is None:
            if len(self._words) > WORDS_KEPT:
                self._words.clear()
            data = word.encode()
            known = self._words[word] = self.saving(self.context + b" " + data) / (len(data) + 2)
        return known

    def features(self, text: str) -> list[float]:
        """Savings of every word and of every window, windows overlapping by half.

        Largest word saving; for each of ``WORD_SAVINGS`` and ``WINDOW_SAVINGS`` the logarithm of the number of hits
        and the hits per word; largest and mean saving of the windows.
        """
        self._tools()
        words = _WORD.findall(text.lower())
        half = WINDOW_WORDS // 2
        of_words = np.array([self.word_saving(word) for word in words])
        of_windows = np.array([self.saving(" ".join(words[start:start + WINDOW_WORDS]).encode())
                               for start in range(0, max(len(words) - half, min(len(words), 1)), half)], dtype=float)
        out = [max(of_words.max(initial=0.0), 0.0)]
        for savings, levels in ((of_words, WORD_SAVINGS), (of_windows, WINDOW_SAVINGS)):
            for level in levels:
                hits = int((savings >= level).sum())
                out += [float(np.log1p(hits)), 10 * hits / (len(words) + 20)]
        out += [of_windows.max(initial=0.0) / WINDOW_WORDS, of_windows.mean() / WINDOW_WORDS if len(words) else 0.0]
        return [float(v) for v in out]

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrated(features: np.ndarray, toxic: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Weights of a ridge logistic regression by Newton steps: the thresholds on the compression features."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        w = w - np.linalg.solve(curve, x.T @ (p - toxic) + penalty @ w)
    return tuple(float(v) for v in w)


def _filled(words: list[str], size: int) -> bytes:
    """The words, the first ones last (where matches are cheapest), cut or repeated to ``size`` bytes."""
    data = (" ".join(["", *reversed(words), ""])).encode()
    if not words:
        return b" " * size
    while len(data) < size:
        data = data + data
    return data[-size:]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the dictionaries and thresholds on labelled rows that are not held out.

    At most ``sample_rows`` texts of each class are used (equal texts count once), chosen by the hash of their ids;
    their whole texts are read on the executors, and only the dictionaries' words and the features of each sampled row
    come to the driver. The intercept is corrected from the sample's ratio of classes to that of all learnable labels, so
    a score of 0.5 means the same whether the bound bites or not. Rows with null labels, ids or texts teach nothing. If a class has no rows the scores are 0.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    thin = texts.select("doc_id", F.xxhash64(F.lower("text")).alias("same"))
    known = cut(thin.join(marks.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))), "doc_id")
                .groupBy("same", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct())
    learnable = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for kind in (0, 1):
        own = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = own if chosen is None else chosen.unionByName(own)
    chosen = F.broadcast(cut(chosen.select("doc_id", "toxic")))  # at most twice ``sample_rows`` ids
    sample = cut(texts.join(chosen, "doc_id").dropDuplicates(["doc_id", "toxic"]))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Model(b" " * 64, b" " * 64, b" ")
    n0, n1 = float(totals[0]), float(totals[1])
    each = F.explode(F.array_distinct(F.split(F.lower("text"), F.lit("(?U)\\W+"))))
    counts = cut(sample.select(each.alias("word"), "toxic").filter("word <> ''").groupBy("word").agg(
        F.sum("toxic").cast("double").alias("c1"), F.sum(1 - F.col("toxic")).cast("double").alias("c0")))

    def part(c, n):
        share = (F.col("c1") + F.col("c0")) / (n0 + n1)
        hit = F.when(c > 0, c * F.log(c / (n * share))).otherwise(0.0)
        return hit + F.when(c < n, (n - c) * F.log((n - c) / (n * (1 - share)))).otherwise(0.0)

    evidence = 2 * (part(F.col("c1"), F.lit(n1)) + part(F.col("c0"), F.lit(n0)))
    marked = (counts.filter(F.col("c1") / n1 > RATIO * F.col("c0") / n0).withColumn("evidence", evidence)
              .filter(F.col("evidence") >= EVIDENCE))
    top = lambda df, order, n: [r["word"] for r in df.orderBy(F.col(order).desc(), "word").limit(n).select("word").collect()]
    toxic = top(marked, "evidence", OWN_BYTES // 4)
    plain = top(counts.join(marked.select("word"), "word", "left_anti"), "c0", (SHARED_BYTES + OWN_BYTES) // 3)
    shared, rest = plain[:SHARED_BYTES // 6], plain[SHARED_BYTES // 6:] or plain
    base = _filled(shared, SHARED_BYTES)
    model = Model(base + _filled(rest, OWN_BYTES), base + _filled(toxic, OWN_BYTES) if toxic else base + _filled(
        rest, OWN_BYTES), " ".join(shared[:9]).encode())
    rows = sample.select("toxic", _features(model)("text").alias("f")).collect()
    weights = calibrated(np.array([r["f"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float))
    model.weights = (weights[0] + float(np.log(learnable[1] / learnable[0] * n0 / n1)), *weights[1:])
    return model


def _features(model: Model):
    @F.pandas_udf("array<double>")
    def features(texts):
        return texts.map(lambda t: model.features(t or ""))

    return features


def score_column(model: Model, text: Column | str) -> Column:
    """Score of a text, 0 to 1, higher: more likely toxic. Null counts as empty."""
    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        rows = [model.features(t or "") for t in texts]
        return pd.Series(model.scores(np.array(rows, dtype=float).reshape(-1, FEATURES)))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; whole texts are read, in windows of eight words that overlap by half.

    Every window and every word is compressed with both dictionaries, which are lists of words learned from the labels.
    Empty and null texts have the score of a text without hits. Ids, nulls and repeated rows included, pass through;
    labels, lang and source are no inputs. An empty table gives no rows.
    """
    model = train(docs, labels, sample_rows)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model, "text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None,
               sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; all columns stay as they are."""
    model = train(docs if training_docs is None else training_docs, labels, sample_rows)
    name = free_name(docs, "toxic_score")
    return docs.withColumn(name, score_column(model, "text")).filter(F.col(name) < 0.5).drop(name)
