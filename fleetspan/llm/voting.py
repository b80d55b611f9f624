"""Quality scores by similarity-weighted votes of labelled neighbours in a latent semantic space."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMS = 2048  # hashed terms
RANK = 48  # latent dimensions
MAX_LABELLED = 6_000  # labelled texts that are fitted and broadcast: 6,000 x 48 numbers
NEIGHBOURS = 25
_BLOCK = 256  # texts whose cosines are computed together
_WORD = re.compile(r"\w+|[^\w\s]+")


class _Slots(dict):
    """Column of each token; a shape token stands beside every word."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        slot = self[token] = 64 + zlib.crc32(token.encode("utf-8", "replace")) % (TERMS - 64)
        return slot


_SLOTS = _Slots()


def _ladder(x: float) -> int:
    return min(7, int(8 * x))


def term_weights(texts: list[str | None]) -> np.ndarray:
    """Damped counts of hashed tokens, and of a few terms that say how a text is built, one unit-length row per text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts):
        text = text or ""
        tokens = _WORD.findall(text)
        n = len(tokens)
        if not n:
            row[[7, *range(8, 64, 8)]] = 0.5  # the terms of a text without letters, words or lines
        else:
            slots = np.fromiter(map(_SLOTS.__getitem__, tokens), np.int64, n)
            row[:] = np.log1p(np.bincount(slots, minlength=TERMS))
            row /= np.linalg.norm(row)
            words = text.split()
            letters = sum(map(str.isalpha, words)) / max(1, len(words))
            lines = text.split("\n")
            upper = sum(w.isupper() for w in words) / max(1, len(words))
            distinct = len(set(words)) / max(1, len(words))
            follow = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
            again = 1 - len(set(lines)) / len(lines)
            marks = len(re.findall(r"[^\w\s,.;:'\"?!-]", text)) / len(text)
            stops = len(re.findall(r"[.!?]", text)) / max(1, len(words))
            for k, x in enumerate((1 - letters, upper, 1 - distinct, follow, again, min(1, 10 * marks), min(1, 4 * stops), min(1, np.log1p(len(words)) / 10))):
                row[8 * k + _ladder(x)] = 0.5
    return out


@dataclass
class Space:
    weight: np.ndarray  # inverse document frequency of each term
    axes: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # labelled texts, unit length
    labels: np.ndarray

    def place(self, terms: np.ndarray) -> np.ndarray:
        x = (terms * self.weight) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vote(self, terms: np.ndarray, neighbours: int) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors, by exact cosines."""
        near = self.place(terms.astype(np.float32)) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        at = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:] if k < near.shape[1] else np.tile(np.arange(k), (len(near), 1))
        w = np.maximum(np.take_along_axis(near, at, 1), 0.0) ** 8 + 1e-6
        return (w * self.labels[at]).sum(1) / w.sum(1)


def fit_space(terms: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Space:
    """Latent axes of the labelled texts: the leading eigenvectors of the weighted term products."""
    seen = (terms > 0).sum(0)
    weight = (np.log((1 + len(terms)) / (1 + seen)) + 0.2).astype(np.float32)
    x = terms * weight
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    space = Space(weight, vectors[:, ::-1][:, :rank].astype(np.float32).copy(), np.empty(0), labels.astype(np.float32))
    space.vectors = space.place(terms)
    return space


def vote_quality(customers: DataFrame, ratings: DataFrame, customer_id: str = "customer_id", address: str = "address", label: str = "is_good", max_labelled: int = MAX_LABELLED, neighbours: int = NEIGHBOURS, as_column: str = "quality_score") -> DataFrame:
    """Score every record's text from 0 to 1 by its nearest labelled texts.

    ``ratings`` gives ``label`` 0 or 1 for some ``customer_id`` (the project marks address errors that way); null labels
    are left out. At most ``max_labelled`` labelled records, the first by a hash of the id, are fitted and broadcast; all
    records are scored by exact blocked cosine products. Only the text enters a score: equal texts have equal scores, and
    null and empty texts get the score of a text without terms. Without any label the score is 0.5. All columns stay and
    ``as_column`` is added (replaced if it exists). Several labels of one id count once each.
    """
    spark = customers.sparkSession
    marked = ratings.select(F.col(customer_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    chosen = marked.join(customers.select(F.col(customer_id).alias("_id")).distinct(), "_id", "left_semi").orderBy(F.xxhash64(F.col("_id").cast("string")), "_y", "_id").limit(max_labelled)

    @F.pandas_udf("binary")
    def sparse(text: pd.Series) -> pd.Series:
        return pd.Series([t.astype(np.float16).tobytes() for k in range(0, len(text), _BLOCK) for t in term_weights(list(text.iloc[k : k + _BLOCK]))], dtype=object)

    texts = customers.select(F.col(customer_id).alias("_id"), F.col(address).alias("_t")).join(F.broadcast(chosen), "_id")  # max_labelled ids
    rows = texts.select("_id", "_y", sparse("_t").alias("x")).orderBy("_id", "_y", "x").limit(max_labelled).collect()
    if not rows:
        return customers.withColumn(as_column, F.lit(0.5))
    terms = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    held = spark.sparkContext.broadcast(fit_space(terms, np.array([r["_y"] for r in rows])))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = [held.value.vote(term_weights(list(text.iloc[k : k + _BLOCK])), neighbours) for k in range(0, len(text), _BLOCK)]
        return pd.Series(np.concatenate(out) if out else [], dtype="float64").clip(0.0, 1.0)

    return customers.withColumn(as_column, score(F.col(address)))
