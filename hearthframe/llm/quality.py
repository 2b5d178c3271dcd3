"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_texts

FIT_ROWS = 20_000  # labelled rows that a fit sees, about: those of least hash
FEATURES, RIDGE, SEED, CALIBRATE_EVERY = 384, 1e-3, 7, 4
NO_LABELS = 0.5  # the score where there is nothing to learn from

#: Classes of bytes: 0 others of ASCII, 1 white space, 2 a-z, 3 A-Z, 4 digits, 5 marks of sentences, 6 beyond ASCII.
KIND = np.zeros(256, np.uint8)
KIND[list(b"\t\n\v\f\r ")] = 1
KIND[ord("a") : ord("z") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("0") : ord("9") + 1] = 2, 3, 4
KIND[list(b".,;:?'\"-()")], KIND[128:] = 5, 6
NAMES = (
    "log_bytes", "log_words", "word_length", "odd_share", "space_share", "upper_of_letters", "digit_share", "mark_share", "wide_share",
    "distinct_words", "distinct_pairs", "distinct_growth", "same_as_before", "most_frequent", "odd_ends", "distinct_lines", "log_line_words",
)


def statistics(text: str | None) -> list[float]:
    """Statistics of one text, in the order of NAMES; a null text counts as an empty one."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    kinds = sum((np.bincount(KIND[data[at : at + (1 << 20)]], minlength=7) for at in range(0, len(data), 1 << 20)), np.zeros(7, np.int64))
    words, lines = (text or "").split(), (text or "").split("\n")
    n, size = max(len(words), 1), max(len(data), 1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    distinct, letters, seen = max(len(counts), 1), max(int(kinds[2] + kinds[3]), 1), max(size - int(kinds[1]), 1)
    return [
        np.log1p(len(data)), np.log1p(len(words)), min(seen / n, 40.0), np.sqrt(kinds[0] / seen), kinds[1] / size, kinds[3] / letters, np.sqrt(kinds[4] / seen), np.sqrt(kinds[5] / seen), kinds[6] / size,
        distinct / n, len(set(zip(words, words[1:]))) / max(n - 1, 1), np.log1p(distinct) / np.log1p(n), sum(a == b for a, b in zip(words, words[1:])) / n, max(counts.values(), default=0) / n,
        sum(k for w, k in counts.items() if w[-1].isascii() and KIND[ord(w[-1])] == 0) / n, len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)),
    ]


def table_of(texts: Iterator[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(NAMES))


@dataclass(frozen=True)
class Model:
    """mean and scale of the statistics, waves (statistics x FEATURES) and phases, ridge weights (the last for 1), calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    chances: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(wx + b) has the Gaussian kernel as its mean product over random w and b."""
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.waves + self.phases), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def chance(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.bounds, self.chances), 0, 1)


def held_out(doc_id: Column) -> Column:
    """A third of the ids, of which nothing is learned. A null id counts as an empty one and has no label."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _least(n: int, limit: int, *by: Column) -> Column:
    """About limit of n rows, by hash; all if they are no more."""
    return F.lit(n <= limit) | (F.pmod(F.xxhash64(*by, F.lit(SEED)), F.lit(1 << 32)) < int((1 << 32) * limit / max(n, 1)))


def labelled_statistics(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(stats, label, apart) of at most about `limit` labelled rows that are not held out; ids with labels of both kinds teach nothing.

    Ids are sampled before texts are read, and rows after that, as an id may stand on many rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    known = checkpoint(known.where(_least(known.count(), limit, F.col("doc_id"))))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # about `limit` rows
    rows = rows.where(_least(rows.count(), limit, F.col("doc_id"), F.col("text")))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(CALIBRATE_EVERY)) == 0
    rows = rows.select("text", F.col("label").cast("double").alias("label"), apart.alias("apart"))
    compute = lambda texts: {"stats": pa.array(table_of(texts).tolist(), pa.list_(pa.float64()))}
    return checkpoint(map_texts(rows, "text", "stats array<double>", compute, keep=False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model | None:
    """A model of labels (doc_id, label 0 or 1) from the texts of docs (doc_id, text); None if no row has a label to learn from.

    Partitions of the sample sum their own normal equations, and Spark adds the sums row by row of the matrix. A quarter of the sample
    is left out of these and calibrates the scores.
    """
    rows = labelled_statistics(docs, labels, limit)
    shape = rows.select(*[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(len(NAMES)) for k, f in (("m", F.mean), ("s", F.stddev_pop))], F.count("*").alias("n")).first()
    if not shape.n:
        return None
    mean, scale = (np.array([shape[f"{k}{i}"] for i in range(len(NAMES))]) for k in "ms")
    scale = np.where(scale > 1e-9, scale, 1.0)
    draw = np.random.default_rng(SEED)
    width = np.sqrt(len(NAMES)) / 2  # of the Gaussian kernel, over statistics of unit variance
    waves, phases = draw.normal(size=(len(NAMES), FEATURES)) / width, draw.uniform(0, 2 * np.pi, FEATURES)
    blank = Model(mean, scale, waves, phases, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = blank.features(np.array(batch.column("stats").to_pylist(), float).reshape(-1, len(NAMES)))
            total += z.T @ np.column_stack([z, batch.column("label").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "sums"])

    taught = rows.where("not apart").select("stats", "label").mapInArrow(equations, "i int, sums array<double>")
    added = F.aggregate(F.array_sort(F.collect_list("sums")), F.array_repeat(F.lit(0.0), FEATURES + 2), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    whole = np.array([x.sums for x in taught.groupBy("i").agg(added.alias("sums")).orderBy("i").collect()])
    fitted = np.linalg.solve(whole[:, :-1] + RIDGE * np.eye(FEATURES + 1) * max(whole[-1, -2], 1.0) / FEATURES, whole[:, -1])
    model = Model(mean, scale, waves, phases, fitted, np.zeros(1), np.zeros(1))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array(batch.column("stats").to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(stats)), batch.column("label")], names=["features", "label"])

    scored = rows.select("stats", "label", "apart")
    scored = scored.where("apart") if not scored.where("apart").isEmpty() else scored
    steps = IsotonicRegression().fit(checkpoint(scored.select("stats", "label").mapInArrow(raw, "features double, label double")))
    return Model(mean, scale, waves, phases, fitted, steps.boundaries.toArray(), steps.predictions.toArray())


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (text, any others) with score, the calibrated chance of label 1 between 0 and 1; only the text decides.

    Null texts count as empty ones, repeated texts score alike, a column named score is replaced. Without a model all rows score 0.5.
    """
    if model is None:
        return docs.withColumn("score", F.lit(NO_LABELS))
    return map_texts(docs, "text", "score double", lambda texts: {"score": pa.array(model.chance(table_of(texts)))})
