"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams that occur in it (each counts once). Every n-gram has
a log-count ratio from the labelled texts; features are scaled by these ratios, and a logistic
regression on the scaled features gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, broadcast_if_small, crc_mod, cut, give_back, table
from .sampling import balanced

WORD = re.compile(r"[^\W_]+")
#: Runs of more characters are not remembered.
LONG = 60
#: Characters of a run whose n-grams are held at once.
WINDOW = 2_000


def windows(word: str, least: int = 3, most: int = 6) -> Iterator[set[str]]:
    """Character n-grams of a lower-cased word between its borders, window by window: together all of them."""
    w = f"<{word}>"
    for at in range(0, len(w), WINDOW):
        part = w[at : at + WINDOW + most - 1]
        yield {part[k : k + n] for n in range(least, most + 1) for k in range(len(part) - n + 1)}


def grams(word: str) -> set[str]:
    """All character n-grams of a lower-cased word between its borders."""
    return set().union(*windows(word))


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class ScaledLinear:
    """Weights by n-gram, already multiplied by their ratios, and the intercept."""

    def __init__(self, names: list[str], weights: np.ndarray, intercept: float):
        self.rows = {g: k for k, g in enumerate(names)}
        self.weights, self.intercept = weights, intercept

    @classmethod
    def fit(cls, texts: list[set[str]], labels: list[int], rate_of_ones: float, smooth: float = 1.0, surprise: float = 30.0, epochs: int = 8, seed: int = 11, rate: float = 0.3, decay: float = 1e-4) -> ScaledLinear:
        """AdaGrad on the logistic loss, each class carrying half of the weight.

        N-grams whose chi-squared statistic with the label is under ``surprise`` may owe their
        ratio to chance and are left out. ``rate_of_ones`` is the share of label 1 in all
        labelled rows: the intercept is moved from the balanced share to it.
        """
        names: dict[str, int] = {}
        number = lambda part: np.array([names.setdefault(g, len(names)) for g in sorted(part)], np.int64)
        of_word = Remembered(lambda w: number(grams(w)))
        numbers = lambda w: of_word[w] if len(w) <= LONG else np.unique(np.concatenate([number(part) for part in windows(w)]))
        docs = [np.unique(np.concatenate([numbers(w) for w in sorted(t)])) if t else np.empty(0, np.int64) for t in texts]
        y = np.array(labels, bool)
        count = [np.bincount(np.concatenate([np.empty(0, np.int64), *(d for d, one in zip(docs, y) if one == which)]), minlength=len(names)) for which in (True, False)]
        share = [(c + smooth) / (c + smooth).sum() for c in count]
        ratio = np.log(share[0] / share[1])
        # The length of the classes' texts is no sign of its own: ratios count from their middle.
        ratio -= np.average(ratio, weights=count[0] + count[1]) if len(ratio) else 0
        ones, zeros = max(1, int(y.sum())), max(1, int((~y).sum()))
        both, off = count[0] + count[1], count[0] * (zeros - count[1]) - count[1] * (ones - count[0])
        chi = (ones + zeros) * (off.astype(float) ** 2) / np.maximum(1.0, 1.0 * ones * zeros * both * (ones + zeros - both))
        kept = np.flatnonzero(chi >= surprise)
        place = np.full(len(names), -1)
        place[kept] = np.arange(len(kept))
        ratio = ratio[kept]
        docs = [p[p >= 0] for p in (place[d] for d in docs)]
        weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y)
        rng, w, sums, b = np.random.default_rng(seed), np.zeros(len(kept)), np.full(len(kept), 1e-6), 0.0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for batch in np.array_split(order, max(1, len(order) // 64)) if len(kept) else ():
                sizes = np.array([len(docs[i]) for i in batch])
                ids, owner = np.concatenate([docs[i] for i in batch]), np.repeat(np.arange(len(batch)), sizes)
                z = b + np.bincount(owner, w[ids] * ratio[ids], len(batch))
                slope = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
                grad = np.bincount(ids, slope[owner] * ratio[ids], len(kept)) + decay * w
                sums += grad * grad
                w -= rate * grad / np.sqrt(sums) * (np.abs(grad) > 0)
                b -= 0.05 * slope.sum()
        order = list(names)
        odds = np.log(max(rate_of_ones, 1e-6) / max(1 - rate_of_ones, 1e-6))
        return cls([order[k] for k in kept], w * ratio, float(b + odds))

    def known(self, word: str) -> np.ndarray:
        rows = self.rows
        return np.array([*{rows[g] for part in windows(word) for g in part if g in rows}], np.int64)


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From batches of (label, place, text): the distinct words of each whole text, sorted, in its place."""
    for batch in batches:
        found = pa.array([sorted(words(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["label", "place", "words"])


def fit_toxicity(labelled: DataFrame, texts: DataFrame, per_label: int = 1200) -> ScaledLinear | None:
    """Train on ``labelled(doc_id, label)`` with the texts of those ids; None without both labels.

    The sample is bounded: the whole texts of about ``per_label`` ids of each label, chosen by hash
    of the id, of which the driver gets the distinct words. Where an id has several labels, the
    largest counts; rows that repeat an id with other texts each count.
    """
    rows = labelled.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = rows.agg(F.avg("label")).first()[0]
    if total is None or total in (0.0, 1.0):
        return None
    sample = cut(balanced(rows, "label", per_label, 2 * per_label).select("doc_id", "label", "place"))
    found = texts.join(broadcast_if_small(sample), "doc_id").select("label", "place", "text")
    got = found.mapInArrow(_word_lists, "label int, place double, words array<string>").collect()
    got.sort(key=lambda r: (r["place"], r["words"]))
    return ScaledLinear.fit([set(r["words"]) for r in got], [r["label"] for r in got], total)


def score_toxicity(docs: DataFrame, model: ScaledLinear | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every whole text, by all n-grams of all its words.

    A null or empty text has no n-gram and scores as the intercept alone; without a model every
    score is 0. Null ids stay null, repeated rows give a row each, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known = Remembered(model.known, 100_000) if model else {}
        rows_of = lambda w: known[w] if len(w) <= LONG else model.known(w)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1).to_pylist() if model else ()):
                got = [k for w in words(text) if len(k := rows_of(w))]
                z = model.intercept + (model.weights[np.unique(np.concatenate(got))].sum() if got else 0.0)
                scores[i] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select("doc_id", F.col("toxic").cast("int").alias("label"))
    model = fit_toxicity(labels, docs.select("doc_id", "text"))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
