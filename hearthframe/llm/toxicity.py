"""Toxicity: cumulative-link ordinal regression over sparse text features.

Grades 0..K share one weight vector; ordered thresholds separate them: P(grade <= k) = sigmoid(threshold_k - w.x).
Features are the distinct words of a text and their beginnings of some lengths. Those are kept that are commoner in
texts of a higher grade by a likelihood ratio beyond chance among as many candidates. Counting them is distributed; only
the bounded sample is fitted on the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_texts

#: Most labelled rows that the fit sees (those of least hash), fewest sampled documents with a feature.
SAMPLE_ROWS, LEAST_DOCS = 20_000, 3
#: Texts whose chance of a grade above 0 reaches this are rejected; of held-out labelled texts nine tenths of the toxic ones do.
REJECT = 0.2
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
COUNTS_AT_ONCE = 100_000


def features(text: str | None) -> set[str]:
    """The text's distinct words, lower-case, and with a star their beginnings of 4 to 6 letters."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*[{w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES])


@dataclass
class OrdinalModel:
    """weights by feature, thresholds of the grades 1..K; grades that the sample lacks have an infinite threshold."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1..K."""
        z = sum(self.weights[f] for f in features(text) if f in self.weights)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds - z))


def fit_thresholds(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, l2: float = 0.1, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the penalised likelihood; deterministic."""
    present = [k for k in range(1, n_grades + 1) if (grades >= k).any()]
    theta = np.full(n_grades, np.inf)
    if not present or (grades > 0).all():
        return np.zeros(n_features), theta if not present else np.where(np.isin(np.arange(1, n_grades + 1), present), -3.0, np.inf)
    index = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # thresholds as a first value and positive gaps, so that they stay in order
    level = np.searchsorted(np.array(present), grades, side="right")  # 0..m
    m = len(present)
    p = np.array([(level < j + 1).mean() for j in range(m)]).clip(1e-4, 1 - 1e-4)
    first = np.log(p / (1 - p))
    x = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, gaps = x[:n_features], np.exp(x[n_features + 1 :])
        th = x[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(owner, w[index], minlength=len(rows))
        upper = np.concatenate([th, [np.inf]])[level] - s
        lower = np.concatenate([[-np.inf], th])[level] - s
        fu, fl = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
        fu, fl = np.where(np.isinf(upper), 1.0, fu), np.where(np.isinf(lower), 0.0, fl)
        prob = np.maximum(fu - fl, 1e-12)
        du, dl = fu * (1 - fu) / prob, fl * (1 - fl) / prob
        gs = du - dl  # of the negative log likelihood by the score s
        gth = np.array([-(du[level == j].sum() - dl[level == j + 1].sum()) for j in range(m)])
        grad = np.concatenate([np.bincount(index, gs[owner], minlength=n_features) + l2 * w, [gth.sum()], gaps * np.cumsum(gth[::-1])[::-1][1:]])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        x = x - 0.1 * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    th = x[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_features + 1 :]))])
    theta[[k - 1 for k in present]] = th
    theta[: present[0] - 1] = th[0]
    for k in range(n_grades - 2, -1, -1):  # a grade that the sample lacks between two others takes the one above
        theta[k] = min(theta[k], theta[k + 1])
    return x[:n_features], theta


def fit(docs: DataFrame, labels: DataFrame, n_grades: int, sample_rows: int = SAMPLE_ROWS, l2: float = 0.1) -> OrdinalModel:
    """docs: (doc_id, text); labels: (doc_id, grade 0..n_grades). Rows without an id, text or grade take no part.

    At most sample_rows labelled documents, those whose ids hash least, are used, of an id that stands on several rows the text of least
    hash, of an id with several grades the highest. No labels: a model that rejects nothing.
    """
    graded = labels.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    picked = checkpoint(graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "doc_id")  # sample_rows at most
    base = checkpoint(texts.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([g for _, g in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["feature", "grade", "n"])

        for batch in batches:
            for grade, text in zip(batch.column("grade").to_pylist(), batch.column("text"), strict=True):
                seen.update([(f, grade) for f in features(text.as_py())])
                if len(seen) > COUNTS_AT_ONCE:
                    yield told()
                    seen.clear()
        if seen:
            yield told()

    counts = base.mapInArrow(counted, "feature string, grade int, n long")
    total, hits = base.count(), base.where("grade > 0").count()
    a, b = F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)), F.sum("n")
    told = counts.groupBy("feature").agg(a.alias("a"), b.alias("b")).where((F.col("b") >= LEAST_DOCS) & (F.col("a") > F.col("b") * F.lit(hits / max(total, 1))))
    odds = lambda x, share: F.when(x > 0, x * F.log(x / (F.col("b") * F.lit(share)))).otherwise(0.0)
    best = []
    if 0 < hits < total:
        ratio = 2 * (odds(F.col("a"), hits / total) + odds(F.col("b") - F.col("a"), 1 - hits / total))
        told = checkpoint(told.withColumn("ratio", ratio))
        top = told.where(F.col("ratio") >= 2 * math.log(told.count() + 1)).select("feature")
        best = sorted(r.feature for r in top.collect())  # bounded by what sample_rows hold
    place = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(best)})

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.array(sorted(place.value[f] for f in features(t.as_py()) if f in place.value), np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(at, pa.binary()), batch.column("doc_id")], names=["grade", "at", "doc_id"])

    found = sorted(base.mapInArrow(indexed, f"grade int, at binary, doc_id {dict(base.dtypes)['doc_id']}").collect(), key=lambda r: (r.doc_id, bytes(r.at))) if best else []  # bounded by sample_rows
    place.destroy()
    weights, thresholds = fit_thresholds([np.frombuffer(bytes(r.at), np.int32) for r in found], np.array([r.grade for r in found], int), len(best), n_grades, l2)
    return OrdinalModel({f: float(w) for f, w in zip(best, weights, strict=True) if abs(w) > 1e-4}, thresholds)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs with p_toxic, the chance of any grade above 0, and severity, the expected grade. Null text: as empty.

    Columns of docs with these names are replaced, all others pass through as they are. No rows: none.
    """

    def run(texts: Iterator[str | None]) -> dict[str, pa.Array]:
        p = np.array([model.at_least(t) for t in texts]).reshape(-1, len(model.thresholds))
        return {"p_toxic": pa.array(p[:, 0], pa.float64()), "severity": pa.array(p.sum(axis=1), pa.float64())}

    return map_texts(docs, text_col, "p_toxic double, severity double", run)
