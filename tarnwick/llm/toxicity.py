"""Severity of toxicity by cumulative-link ordinal regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import as_bytes, columns_of, fresh, table, written

#: Labelled rows to learn from at most.
SAMPLE = 20_000
#: Besides whole words, the first so many characters of a word are features: languages that inflect share stems.
PREFIXES = (3, 4, 5, 6, 7)
#: Features kept at most, and what a feature's log-likelihood ratio must exceed the log of their number by.
FEATURES, EVIDENCE = 5_000, 0.0
#: Steps of gradient descent, their length, and the pull of all weights towards zero at each.
STEPS, RATE, SHRINK = 600, 0.5, 1e-5
#: A text is rejected if its expected severity is at least this.
REJECT = 0.5

WORD = re.compile(r"\w+")


def features_of(word: str) -> list[str]:
    """The word, and its prefixes marked as such."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def words_of(text: bytes) -> set[str]:
    """Distinct words of a text, lower-cased."""
    return set(WORD.findall(text.decode().lower()))


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and texts of a higher grade than 0, that hold each feature."""
    n: Counter = Counter()
    high: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array([high[x] for x in n], pa.int64())], names=["feature", "n", "high"])

    for data in batches:
        for g, text in zip(data.column(0).to_pylist(), as_bytes(data.column(1)), strict=True):
            found = {f for w in words_of(text) for f in features_of(w)}
            n.update(found)
            if g:
                high.update(found)
            if len(n) > 500_000:
                yield out()
                n.clear()
                high.clear()
    yield out()


class Known(dict):
    """Words to the numbers of their known features."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
        return value

    def of(self, text: bytes) -> set[int]:
        return set(chain.from_iterable(map(self.__getitem__, words_of(text))))


class OrdinalModel:
    """P(severity > j) = sigmoid(w.x - cut_j) with one w for all cuts, and cuts in ascending order."""

    def __init__(self, weights: dict[str, float], cuts: list[float]):
        self.weights, self.cuts = weights, cuts
        self.known = Known({f: i for i, f in enumerate(weights)})
        self.values = list(weights.values())

    def severity(self, text: bytes) -> tuple[float, list[float]]:
        """Expected severity, and the probability of each grade."""
        z = sum(self.values[i] for i in sorted(self.known.of(text)))
        above = [1.0 / (1.0 + math.exp(min(500.0, max(-500.0, c - z)))) for c in self.cuts]
        edges = [1.0, *above, 0.0]
        return sum(above), [a - b for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fit(grades: np.ndarray, docs: list[list[int]], names: list[str], *, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> OrdinalModel:
    """Fits shared weights and cuts to graded feature sets by gradient descent (AdaGrad with soft thresholding).

    The loss is the mean over the texts of the sum of all thresholds' logistic losses: each threshold counts alike.
    """
    top = int(grades.max(initial=0))
    if not len(grades) or top == 0:
        return OrdinalModel({}, [20.0] * max(1, top))
    col = np.array([f for d in docs for f in d], dtype=np.int64)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    above = np.stack([(grades > j).astype(np.float64) for j in range(top)])
    rates = np.clip(above.mean(axis=1), 1e-4, 1 - 1e-4)
    cuts = -np.log(rates / (1 - rates))
    w = np.zeros(len(names))
    w_sum, cut_sum = np.full(len(names), 1e-8), np.full(top, 1e-8)
    for _ in range(steps):
        z = np.bincount(row, weights=w[col], minlength=len(grades))
        p = 1.0 / (1.0 + np.exp(np.clip(cuts[:, None] - z[None, :], -30, 30)))
        error = (p - above) / len(grades)
        g = np.bincount(col, weights=error.sum(axis=0)[row], minlength=len(names))
        gc = -error.sum(axis=1)
        w_sum += g * g
        cut_sum += gc * gc
        step = rate / np.sqrt(w_sum)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0.0)
        cuts = np.sort(cuts - rate / np.sqrt(cut_sum) * gc)
    return OrdinalModel({names[i]: float(w[i]) for i in np.flatnonzero(w)}, [float(c) for c in cuts])


def by_dose(toxic: list[int], found: list[list[int]], evidence: set[int]) -> list[int]:
    """Grades 0 (not toxic), 1 and 2: a toxic text is of grade 2 if it holds more toxic words than the median toxic text."""
    doses = [sum(f in evidence for f in x) for x in found]
    middle = median([d for d, t in zip(doses, toxic, strict=True) if t] or [0])
    return [int(t) + int(t > 0 and d > middle) for d, t in zip(doses, toxic, strict=True)]


def train(docs: DataFrame, labels: DataFrame, *, grade=None, sample: int = SAMPLE, features: int = FEATURES, evidence: float = EVIDENCE) -> OrdinalModel:
    """The model of at most ``sample`` labelled rows, those whose ids hash lowest.

    ``grade`` is a column of labels with grades from 0 on. Without it a text is toxic or not by the column toxic (0 or
    1, other values teach nothing), and toxic texts have grade 1 or 2 by how many distinct words they hold that speak
    for toxicity.

    Rows without a text, an id or a grade teach nothing; of repeated labels of an id the highest grade counts; equal
    texts count once, with their highest grade. Features are the words and prefixes whose spread over the grades is
    least like chance. Without graded rows, or with one grade only, the model rejects nothing.
    """
    own = F.when(F.col("toxic").isin(0, 1), F.col("toxic").cast("int")) if grade is None else grade.cast("int")
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    graded = graded.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    picked = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = written(texts.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("grade").alias("grade")).select("grade", "text"), "graded")
    total, high = held.agg(F.count("*"), F.count(F.when(F.col("grade") > 0, 1))).first()
    if not total or high in (0, total):
        return OrdinalModel({}, [20.0])
    share = F.lit(high / total)

    def part(k, n, p):
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)

    counts = held.mapInArrow(feature_counts, "feature string, n long, high long").groupBy("feature").agg(F.sum("n").cast("double").alias("n"), F.sum("high").cast("double").alias("high"))
    counts = written(counts.withColumn("gain", part(F.col("high"), F.col("n"), share) + part(F.col("n") - F.col("high"), F.col("n"), 1 - share)), "features")
    least = math.log(max(1, counts.count())) + evidence
    chosen = counts.where(F.col("gain") >= least).orderBy(F.desc("gain"), "feature").limit(features).select("feature", (F.col("high") > F.col("n") * share).alias("speaks")).collect()
    names = [r["feature"] for r in chosen]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Known({f: i for i, f in enumerate(names)})
        for data in batches:
            found = [sorted(memo.of(x)) for x in as_bytes(data.column(1))]
            yield pa.RecordBatch.from_arrays([data.column(0), pa.array(found, pa.list_(pa.int32()))], names=["grade", "found"])

    rows = sorted((r[0], list(r[1])) for r in held.mapInArrow(known, "grade int, found array<int>").collect())
    grades, found = [r[0] for r in rows], [r[1] for r in rows]
    if grade is None:
        grades = by_dose(grades, found, {i for i, r in enumerate(chosen) if r["speaks"] and not r["feature"].endswith("*")})
    return fit(np.array(grades, dtype=np.int64), found, names)


def score(docs: DataFrame, model: OrdinalModel, *, severity: str = "severity", probabilities: str = "grade_probabilities") -> DataFrame:
    """docs with the expected grade and the probability of each; a null text has no features.

    All rows and columns stay, but for columns that have the names of the new ones.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (severity.lower(), probabilities.lower())])
    at = [c.lower() for c in docs.columns].index("text")
    plain = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns_of(docs))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            found = [model.severity(x) for x in as_bytes(data.column(at).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*data.columns, pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.list_(pa.float64()))], names=[*data.schema.names, "severity", "probabilities"])

    schema = StructType([*plain.schema.fields, StructField("severity", DoubleType()), StructField("probabilities", ArrayType(DoubleType()))])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, severity, probabilities)


def toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """docs with severity, grade_probabilities and ``rejected`` (severity of at least ``reject``).

    Repeated rows, null ids and null or empty texts stay and are graded like any other; an empty table gives no rows.
    """
    return score(docs, train(docs, labels, sample=sample)).withColumn("rejected", F.col("severity") >= reject)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not rejected, with the columns they came with.

    Null and empty texts, null ids and repeated rows stay unless rejected; an empty table gives no rows; without labels
    that differ all stay.
    """
    severity = fresh(docs, "severity")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), severity=severity, probabilities=fresh(docs, "grade_probabilities"))
    return scored.where(F.col(severity) < REJECT).select(*columns_of(docs))
