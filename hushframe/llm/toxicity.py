"""Toxicity: a logistic classifier over words, regularised by counterfactuals.

Each labelled text that names an identity group also gets a twin in which the group's
terms are swapped for others of their kind.  The fit penalises any change of the score
between the two, so that naming a group is not in itself taken for toxicity.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import query, table, word_bytes

# Neutral terms for groups of people; terms of one line are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "refugees"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
)


@dataclass(frozen=True)
class Settings:
    """``max_rows``: labelled rows the weights are fitted on, a sample by hash; word counts cover all labelled rows.

    ``least_share``: of the toxic rows a word must stand in, so that the words of one
    copied text with a doubtful label do not count as telling.
    """

    max_rows: int = 20_000
    max_words: int = 2_000
    least_documents: int = 5
    least_share: float = 0.003
    least_chi2: float = 20.0
    ridge: float = 1e-5
    counterfactual: float = 1.0
    rounds: int = 300
    step: float = 0.1


@dataclass(frozen=True)
class Model:
    """Weights of words that are in a text or not."""

    weights: dict[str, float]
    bias: float

    def scorer(self):
        """The score of a text, as a function."""
        by_bytes = {word.encode(): weight for word, weight in self.weights.items()}

        def score(text: str | None) -> float:
            z = self.bias + math.fsum(by_bytes[word] for word in by_bytes.keys() & word_bytes((text or "").lower()))
            return sigmoid(z)

        return score


def sigmoid(z: float) -> float:
    """Between 0 and 1."""
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def distinct_words(text: str | None) -> set[str]:
    """The lower-case words of a whole text."""
    return {word.decode() for word in set(word_bytes((text or "").lower()))}


def word_counts(labelled: DataFrame) -> DataFrame:
    """``(word, n, toxic)``: texts that have the word, over all rows ``(text, label)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = distinct_words(text.as_py())
                n.update(words)
                if label.as_py():
                    toxic.update(words)
            words = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([n[w] for w in words], pa.int64()), pa.array([toxic[w] for w in words], pa.int64())],
                names=["word", "n", "toxic"],
            )

    counted = labelled.select("text", "label").mapInArrow(count, "word string, n long, toxic long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def telling_words(labelled: DataFrame, rows: int, toxic: int, settings: Settings) -> list[str]:
    """The words whose presence says most about the label, by a chi-squared test over all labelled rows."""
    share = toxic / rows
    expected = F.col("n") * share
    chi2 = (F.col("toxic") - expected) ** 2 / (expected * (1 - share) * (1 - F.col("n") / (rows + 1)))
    found = (
        word_counts(labelled)
        .filter((F.col("n") >= settings.least_documents) & (F.col("n") >= settings.least_share * toxic))
        .withColumn("chi2", chi2)
        .filter(F.col("chi2") >= settings.least_chi2)
        .orderBy(F.desc("chi2"), "word")
        .limit(settings.max_words)
        .collect()
    )
    return [row["word"] for row in found]


def swapped(words: set[str], identity_terms: Sequence[Sequence[str]], turn: int) -> set[str]:
    """The words with each identity term turned into another one of its line, ``turn`` deciding which."""
    turned = {}
    for line in identity_terms:
        for at, term in enumerate(line):
            turned[term] = line[(at + 1 + turn % (len(line) - 1)) % len(line)]
    return {turned.get(word, word) for word in words}


def feature_rows(labelled: DataFrame, words: Sequence[str], identity_terms: Sequence[Sequence[str]]) -> DataFrame:
    """``(label, features, twin)``: indexes of the words in a text, and in its counterfactual (null: no identity term)."""
    index = {word: at for at, word in enumerate(words)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here, twins = [], []
            for value in batch.column(0):
                text = value.as_py() or ""
                found = distinct_words(text)
                other = swapped(found, identity_terms, zlib.crc32(text.encode()))
                here.append(sorted(index[w] for w in found & index.keys()))
                twins.append(sorted(index[w] for w in other & index.keys()) if other != found else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(here, kind), pa.array(twins, kind)], names=["label", "features", "twin"]
            )

    return labelled.select("text", "label").mapInArrow(features, "label int, features array<int>, twin array<int>")


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, lists: Sequence[Sequence[int]], width: int):
        self.columns = np.array([c for row in lists for c in row], np.int64)
        self.rows = np.repeat(np.arange(len(lists)), [len(row) for row in lists])
        self.n, self.width = len(lists), width

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], self.n)

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, by_row[self.rows], self.width)


def fit_weights(
    labels: np.ndarray, rows: Sequence[Sequence[int]], twins: Sequence[Sequence[int] | None], width: int, settings: Settings
) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic regression, by gradient steps with adaptive sizes.

    The penalty is the mean squared change of the linear score from a text to its
    counterfactual, times ``settings.counterfactual``.
    """
    own = Rows(rows, width)
    paired = [at for at, twin in enumerate(twins) if twin is not None]
    here, there = Rows([rows[at] for at in paired], width), Rows([twins[at] for at in paired], width)
    theta, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    theta[-1] = math.log(share / (1 - share))
    for turn in range(1, settings.rounds + 1):
        z = own.times(theta[:-1]) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / own.n
        slope = np.append(own.gradient(error) + settings.ridge * theta[:-1], error.sum())
        if paired:
            change = here.times(theta[:-1]) - there.times(theta[:-1])
            change *= 2 * settings.counterfactual / len(paired)
            slope[:-1] += here.gradient(change) - there.gradient(change)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= settings.step * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(labelled: DataFrame, identity_terms: Sequence[Sequence[str]] = IDENTITY_TERMS, settings: Settings | None = None) -> Model:
    """The classifier of rows ``(id, text, label)``; rows without a label are left out.

    Without labelled rows the score is 1/2 everywhere; with one class it is close to
    that class.  Only the sampled rows' word indexes come to the driver.
    """
    settings = settings or Settings()
    labelled = labelled.filter(F.col("label").isNotNull()).select(
        "id", "text", (F.col("label") > 0).cast("int").alias("label")
    )
    rows, toxic = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not rows:
        return Model({}, 0.0)
    words = telling_words(labelled, rows, toxic, settings) if 0 < toxic < rows else []
    words = sorted({*words, *(term for line in identity_terms for term in line)})
    sample = labelled
    if rows > settings.max_rows:
        # Rows of equal hash come or go together, so a repeated id cannot make the sample differ from run to run.
        part = settings.max_rows / rows
        sample = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    found = feature_rows(sample, words, identity_terms).collect()
    if not found:
        return Model({}, math.log((toxic + 1) / (rows - toxic + 1)))
    weights, bias = fit_weights(
        np.array([row["label"] for row in found], float),
        [row["features"] for row in found],
        [row["twin"] for row in found],
        len(words),
        settings,
    )
    return Model({word: float(w) for word, w in zip(words, weights, strict=True) if abs(w) > 1e-9}, bias)


def score_of(model: Model, text_col: str) -> Column:
    """The score of a whole text; a null one is empty.  The model goes with the task: at most ``max_words`` and the terms."""

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(model.scorer()).astype(float)

    return scored(F.col(text_col))


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (columns of these names are replaced)."""
    return df.withColumn("score", score_of(model, text_col)).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, unchanged."""
    return df.filter(score_of(model, text_col) < threshold)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label must not be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_on_tables(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on the documents that have a label and are not held out; of several labels of a document the largest counts."""
    # The labels grow with the documents, so they are never sent to every task, however few there are.
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("label"))
    )
    return fit(docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").withColumnRenamed("doc_id", "id"), settings=settings)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_on_tables(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", "predicted")
