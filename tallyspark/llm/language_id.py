"""Language identification by a linear-chain conditional random field over words.

Every word gets features (affixes, character n-grams, membership in a learned lexicon); learned
transitions tie neighbours, so code-switched text is labelled span by span. Forward-backward
yields each word's posterior; a document takes the language of the largest mean posterior.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .bpe import Pieces
from .common import crc_mod, give_back, table
from .sampling import balanced

UNKNOWN = "und"
#: Words of the documents that one forward-backward pass holds.
AT_ONCE = 200_000
#: Letters of one position; a longer run of letters becomes several.
REACH = 40
#: Stands where a position's run goes on, before it or behind it; no letter.
ON = "-"


def forward_backward(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posteriors of all positions of many chains at once, and the summed expected transitions.

    ``emit`` has the chains' rows one after another; chains come longest first, so at each step
    those still running are a leading slice. Rows are scaled to sum 1 along the way.
    """
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        at = starts[: np.searchsorted(-lengths, -t, "left")] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ trans) * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(int(lengths[0]) - 2 if len(lengths) else -1, -1, -1):
        at = starts[: np.searchsorted(-lengths, -(t + 1), "left")] + t
        b = (emit[at + 1] * beta[at + 1]) @ trans.T
        beta[at] = b / b.sum(1, keepdims=True)
    if not pairs:
        alpha *= beta
        alpha /= alpha.sum(1, keepdims=True)
        return alpha, None
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    inner = np.ones(len(emit), bool)
    inner[starts + lengths - 1] = False
    at = np.flatnonzero(inner)
    joint = alpha[at][:, :, None] * trans[None] * (emit[at + 1] * beta[at + 1])[:, None, :]
    return post, (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def stretches(word: str) -> list[str]:
    """A run of letters as positions of at most REACH letters of its own, about equally long.

    Where the run goes on, a position holds the next two letters too, for the n-grams across the
    cut, and the sign ON; a position that continues a run starts with ON.
    """
    n = -(-len(word) // REACH)
    cuts = [len(word) * k // n for k in range(n + 1)]
    return [f"{ON if a else ''}{word[a:b]}{word[b : b + 2] + ON if b < len(word) else ''}" for a, b in itertools.pairwise(cuts)]


def positions(words: list[str]) -> list[str]:
    """The words in order, those over REACH letters as their stretches."""
    if max(map(len, words), default=0) <= REACH:
        return words
    return [p for w in words for p in ([w] if len(w) <= REACH else stretches(w))]


def affixes(word: str, lexicon) -> list[str]:
    """Feature names of a position: a lower-cased word, or a stretch of one with those of its own letters.

    Prefixes belong to a run's first stretch and suffixes to its last.
    """
    begins, ends = word[:1] != ON, word[-1:] != ON
    w = f"<{word.strip(ON)}>"
    out = [w[:2], w[:3], w[:4]] if begins else []
    out += [w[-2:], w[-3:], w[-4:], w[-5:]] if ends else []
    own = len(w) - 1 if ends else len(w) - 3
    out += [f"~{w[k : k + n]}" for n in (1, 2, 3) for k in range(1, min(own, len(w) - n))]
    if word in lexicon:
        out.append(f"={word}")
    return out


class WordField:
    """The trained field: feature weights and transitions for each label."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.rows: dict[str, int] = {}
        self.lexicon: frozenset[str] = frozenset()
        self.weights = np.zeros((1, len(labels)))
        self.moves = np.zeros((len(labels), len(labels)))

    def features(self, word: str) -> np.ndarray:
        rows = self.rows
        return np.array([rows[f] for f in affixes(word, self.lexicon) if f in rows], np.int64)

    @classmethod
    def fit(cls, spans: list[tuple[list[str], str]], epochs: int = 6, seed: int = 5, rate: float = 0.2, decay: float = 1e-5) -> WordField:
        """Maximum likelihood by AdaGrad on chains that string spans of different documents together."""
        field = cls(sorted({label for _, label in spans}))
        rng = np.random.default_rng(seed)
        words = Counter(w for span, _ in spans for w in span)
        field.lexicon = frozenset(w for w, n in words.items() if n >= 4)
        seen = Counter(f for w in words for f in affixes(w, field.lexicon))
        field.rows = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 2 or f[0] == "="))}
        k = len(field.labels)
        field.weights, sums = np.zeros((len(field.rows), k)), np.full((len(field.rows), k), 1e-6)
        move_sums = np.full((k, k), 1e-6)
        made = {w: field.features(w) for w in words}
        number = {label: i for i, label in enumerate(field.labels)}
        for _ in range(epochs):
            order = rng.permutation(len(spans))
            at = 0
            while at < len(order):
                batch, at = order[at : at + 240], at + 240
                cuts = np.flatnonzero(rng.random(len(batch)) < 0.4)
                joined = [c for c in np.split(batch, cuts) if len(c)]
                joined.sort(key=lambda c: -sum(len(spans[i][0]) for i in c))
                lengths = np.array([sum(len(spans[i][0]) for i in c) for c in joined])
                flat = [i for c in joined for i in c]
                gold = np.concatenate([np.full(len(spans[i][0]), number[spans[i][1]]) for i in flat])
                feats = [made[w] for i in flat for w in spans[i][0]]
                ids, sizes = np.concatenate(feats), np.array([len(f) for f in feats])
                word = np.repeat(np.arange(len(feats)), sizes)
                logits = np.stack([np.bincount(word, field.weights[ids, j], len(feats)) for j in range(k)], 1)
                emit = np.exp(logits - logits.max(1, keepdims=True)) + 1e-12
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                post, moved = forward_backward(emit, starts, lengths, np.exp(field.moves), True)
                post[np.arange(len(gold)), gold] -= 1
                grad = np.stack([np.bincount(ids, np.repeat(post[:, j], sizes), len(field.rows)) for j in range(k)], 1) / len(joined)
                grad += decay * field.weights
                sums += grad * grad
                field.weights -= rate * grad / np.sqrt(sums)
                inner = np.ones(len(gold), bool)
                inner[starts] = False
                here = np.flatnonzero(inner)
                real = np.bincount(gold[here - 1] * k + gold[here], minlength=k * k).reshape(k, k)
                grad = (moved - real) / len(joined) + 1e-3 * field.moves
                move_sums += grad * grad
                field.moves -= rate * grad / np.sqrt(move_sums)
        return field


class Labeller:
    """Posteriors of whole texts under a field."""

    def __init__(self, field: WordField):
        self.field = field
        self.find = Pieces("[{L}]+")
        self.trans = np.exp(field.moves)
        self.scores = np.zeros((1024, len(field.labels)))
        self.number: dict[str, int] = {}

    def words(self, text: str | None) -> list[str]:
        return positions(self.find(text.lower())) if text else []

    def emissions(self, words: list[str]) -> np.ndarray:
        try:
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in self.number]
            for k in range(0, len(new), 5_000):
                self.learn(new[k : k + 5_000])
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return self.scores[at]

    def learn(self, words: list[str]) -> None:
        """Score words that are not known yet, all at once."""
        rows, lexicon, have = self.field.rows, self.field.lexicon, len(self.number)
        found = [[k for f in affixes(w, lexicon) if (k := rows.get(f)) is not None] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        sums = np.zeros((len(words), len(self.field.labels)))
        if sizes.any():
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            sums[sizes > 0] = np.add.reduceat(self.field.weights[np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum()))], starts)
        while have + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[have : have + len(words)] = np.exp(sums - sums.max(1, keepdims=True)) + 1e-12
        self.number.update(zip(words, range(have, have + len(words))))

    def posteriors(self, texts: list[str | None]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """For each text with a letter: its place, words and their posteriors. Memory is bounded by AT_ONCE words or one text."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i in [*order, None]:
            if held and (i is None or size >= AT_ONCE):
                held.sort(key=lambda x: -len(x[1]))
                lengths = np.array([len(w) for _, w in held])
                if len(self.number) > 150_000:
                    self.number.clear()
                    self.scores = np.zeros((1024, len(self.field.labels)))
                emit = self.emissions([*itertools.chain.from_iterable(w for _, w in held)])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                post, _ = forward_backward(emit, starts, lengths, self.trans)
                for (j, w), s, n in zip(held, starts, lengths):
                    yield j, w, post[s : s + n]
                held, size = [], 0
            if i is not None and (w := self.words(texts[i])):
                held.append((i, w))
                size += len(w)


def _spans(span_words: int, spans: int):
    """From batches of (place, label, text): stretches of words drawn from each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        find = Pieces("[{L}]+")
        for batch in batches:
            drawn = []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = positions(find(text.lower()))
                rng = np.random.default_rng([3, int(place * (1 << 32))])
                starts = sorted({int(x) for x in rng.integers(0, max(1, len(words) - span_words + 1), spans)})
                drawn.append([words[s : s + span_words] for s in starts if words])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(drawn, pa.list_(pa.list_(pa.string())))], ["place", "label", "spans"])

    return run


def fit_language_field(labelled: DataFrame, per_label: int = 300, span_words: int = 18, spans: int = 14, most_rows: int = 6_000) -> WordField | None:
    """Train on ``labelled(doc_id, text, label)``; None if no row has a label and a letter.

    The sample is bounded: about ``per_label`` rows of each label, or fewer where ``most_rows``
    would not hold so many of every label, and ``spans`` stretches of ``span_words`` words from
    anywhere in the whole text of each. Every label has a row, however many there are. Tasks draw
    the stretches, so whole texts never meet in the driver.
    """
    rows = balanced(labelled.where("text is not null and label is not null"), "label", per_label, most_rows)
    got = rows.select("place", "label", "text").mapInArrow(_spans(span_words, spans), "place double, label string, spans array<array<string>>").collect()
    out = [(span, r["label"]) for r in sorted(got, key=lambda r: (r["label"], r["place"], r["spans"])) for span in r["spans"]]
    return WordField.fit(out) if out else None


def _labelled(field: WordField | None, word_labels: bool):
    """From batches of (text, anything): predictions beside both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        labeller = Labeller(field) if field else None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pred, score, each = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[]] * len(texts)
            for i, _, post in labeller.posteriors(texts) if labeller else ():
                mean = post.mean(0)
                best = int(np.argmax(np.round(mean, 12)))
                pred[i], score[i] = field.labels[best], min(1.0, float(mean[best]))
                if word_labels:
                    each[i] = [field.labels[j] for j in post.argmax(1)]
            made = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)}
            if word_labels:
                made["word_labels"] = pa.array(each, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])

    return run


def identify_along(rows: DataFrame, field: WordField | None, word_labels: bool = False) -> DataFrame:
    """``rows(text, rest)`` with the prediction of each text beside it."""
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), *([StructField("word_labels", ArrayType(StringType()))] if word_labels else [])]
    rows = rows.select("text", "rest")
    return rows.mapInArrow(_labelled(field, word_labels), StructType([*rows.schema.fields, *new]))


def identify(docs: DataFrame, field: WordField | None, word_labels: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text, with ``word_labels`` the label of each word too.

    ``score`` is the mean posterior of the predicted language over the words; of equal means the
    alphabetically first language wins. A run of over REACH letters, as in scripts without spaces,
    counts as several words, which together hold all its letters. A text that is null or has no letter gets ``und`` and
    score 0, and so does every text if nothing could be learned. Null ids stay null; repeated rows
    give a row each; other columns are not read.
    """
    rows = docs.select(docs[text_col].alias("text"), docs[id_col].cast("long").alias("rest"))
    return identify_along(rows, field, word_labels).select(F.col("rest").alias("doc_id"), "lang_pred", "score", *(["word_labels"] if word_labels else []))


def trained_on(docs: DataFrame) -> WordField | None:
    """The field learned from all folds but the held-out one."""
    return fit_language_field(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", F.col("lang").alias("label")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, trained_on(docs)).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
