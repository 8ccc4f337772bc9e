"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's chance is a logistic score of its hashed words and their beginnings; a document's is the noisy-or over its
sentences. The weights are trained from document labels alone, on at most `sample` labelled documents, and then show which sentences
offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 18
#: Labelled documents that the weights are trained on, at most; those with the smallest hashes of their ids.
SAMPLE = 12_000
#: Bytes of their bags that the driver takes at most, whatever the texts' lengths.
MOST_BYTES = 256 << 20
FOLDS = 5
SENTENCE = re.compile(rb"[.!?\n]+")
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_/\\"
PREFIXES = (4, 5, 6)
LONGEST_KEPT, KEPT = 64, 300_000


class Kept(dict):
    """Results of make for each word; bounded."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes):
        value = self.make(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEPT:
                self.clear()
            self[word] = value
        return value


def buckets(word: bytes) -> tuple[int, ...]:
    """Of the word without marks at its ends, and of its first characters: words of one stem share those."""
    text = word.strip(EDGES).decode("utf-8", "surrogatepass")
    parts = [text, *(f"{text[:k]}-" for k in PREFIXES if len(text) >= k)]
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 7) % BUCKETS for x in parts)


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence that has any, A-Z lower-cased."""
    if not text:
        return []
    return [w for s in SENTENCE.split(text.encode("utf-8", "surrogatepass").lower()) if (w := s.split())]


class Model:
    """weights: of words by bucket; bias: of a sentence; prior: of a document, whatever its sentences say."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float) -> None:
        self.weights, self.bias, self.prior = weights, bias, prior
        self.kept: Kept | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": None}

    def sentence_scores(self, text: str | None) -> np.ndarray:
        if self.kept is None:
            self.kept = Kept(lambda word: float(self.weights[list(buckets(word))].sum()))
        of = self.kept.__getitem__
        sums = np.array([sum(map(of, set(s))) for s in sentences(text)])
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -40, 40)))

    def score(self, text: str | None) -> float:
        return float(1 - (1 - self.prior) * np.exp(np.log1p(-np.minimum(self.sentence_scores(text), 1 - 1e-12)).sum()))


def bags(text: str | None, of: Kept) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each sentence's distinct words, and how many buckets each sentence has."""
    found = [[b for w in sorted(set(s)) for b in of[w]] for s in sentences(text)]
    return np.array([b for s in found for b in s], "i4"), np.array([len(s) for s in found], "i4")


def train(words: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, rounds: int = 12, rate: float = 0.8, penalty: float = 1e-4, batch: int = 32, seed: int = 1) -> Model:
    """Minimise the noisy-or log loss by adaptive gradient steps over batches of documents. No documents: all scores are
    small; labels of one kind only move the bias."""
    rng = np.random.default_rng(seed)
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    bias, bias_squares, prior = -5.0, 1.0, 0.002
    for _ in range(rounds if len(labels) else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            w = np.concatenate([words[i] for i in chosen])
            size = np.concatenate([sizes[i] for i in chosen])
            if not len(size):
                continue
            doc = np.repeat(np.arange(len(chosen)), [len(sizes[i]) for i in chosen])
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[w], np.cumsum(size) - size) + bias, -30, 30)))
            silent = (1 - prior) * np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(chosen)))
            # slope of the loss by a sentence's score: p in a clean document, -p * silent / (1 - silent) in a toxic one
            pull = np.where(labels[chosen] == 1, -silent / np.maximum(1 - silent, 1e-12), 1.0)
            slope = p * pull[doc]
            touched, back = np.unique(w, return_inverse=True)
            step = np.bincount(back, np.repeat(slope, size), len(touched)) + penalty * weights[touched]
            squares[touched] += step**2
            weights[touched] -= rate * step / np.sqrt(squares[touched])
            whole = float(slope.sum())
            bias_squares += whole * whole
            bias -= rate * whole / bias_squares**0.5
    return Model(weights.astype("f4"), bias, prior)


def labelled_bags(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, most_bytes: int = MOST_BYTES) -> tuple[list, list, np.ndarray]:
    """Bags of at most `sample` labelled documents outside the held-out fold, and of at most so many bytes together, one for
    each id, in a fixed order."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
        .where(F.col("_id").isNotNull() & F.col("_toxic").isNotNull() & (common.crc32_mod(F.col("_id"), folds) != 0))
        .groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    docs = common.documents_only(documents, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Kept(buckets)
        for batch in batches:
            found = [bags(t if isinstance(t, str) else None, of) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["_toxic"], "words": [w.tobytes() for w, _ in found], "sizes": [s.tobytes() for _, s in found]})

    made = docs.select("doc_id", "text", "_toxic").mapInPandas(hashed, "doc_id long, toxic int, words binary, sizes binary")
    # of documents that share an id, one: the driver gets a row for each id at most, and no more bytes than it may hold
    one = common.cut(made.groupBy("doc_id").agg(F.min(F.struct("words", "sizes", "toxic")).alias("of")).select("doc_id", "of.*"))
    width = F.octet_length("words") + F.octet_length("sizes")
    widths = one.select("doc_id", width.alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fits = [r["doc_id"] for r, total in zip(widths, np.cumsum([r["bytes"] for r in widths])) if total <= most_bytes]
    if len(fits) < len(widths):
        one = one.join(F.broadcast(one.sparkSession.createDataFrame([(i,) for i in fits], "doc_id long")), "doc_id", "left_semi")
    rows = one.collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["words"])))
    return [np.frombuffer(r["words"], "i4") for r in rows], [np.frombuffer(r["sizes"], "i4") for r in rows], np.array([r["toxic"] for r in rows], "i8")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    return train(*labelled_bags(documents, labels, sample, folds))


def scored(documents: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. A text without words has the prior as its score.

    Very long texts are scored whole. A score of 0.5 is predicted toxic. Repeated rows and null ids (held out like the
    empty text) are each scored; an empty table gives an empty result; extra columns are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": [model.score(t if isinstance(t, str) else None) for t in batch["text"]]})

    rows = common.documents_only(documents, "doc_id", "text").withColumn("held_out", common.crc32_mod(F.col("doc_id"), folds) == 0)
    return rows.mapInPandas(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def filter_documents(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, their columns unchanged."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(t if isinstance(t, str) else None) for t in batch], dtype="f8")

    return documents.where(score(F.col("text")) < threshold)


def offending_sentences(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, sentence (its number among those with words) and score, of sentences at the threshold or over."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, s) for d, t in zip(batch["doc_id"].array, batch["text"]) for i, s in enumerate(shared.value.sentence_scores(t if isinstance(t, str) else None)) if s >= threshold]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence", "score"])

    return common.documents_only(documents, "doc_id", "text").mapInPandas(locate, "doc_id long, sentence int, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.read_table(spark, sf_dir, "documents")
    return scored(documents, fit(documents, common.read_table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9_toxicity}
