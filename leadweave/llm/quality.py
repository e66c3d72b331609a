"""Quality rules: fixed counts, and a calibrated logistic regression over hashed n-grams against a fixed threshold.

A text's logit is a bias and, for each kind of n-gram (one to three characters, one and two words), the mean weight of
its n-grams, whose hashes are the places of the weights. The weights are fitted in numpy on a bounded sample of
labelled texts; a fold that they haven't seen turns logits into probabilities (Platt's scaling, each class weighted by
its share of all labels).
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.periodic import space_words
from leadweave.llm.sampling import labelled_sample
from leadweave.llm.words import BYTE_VALUE, GAMMA, chunks, mix64, run_hashes, runs, text_bytes

#: Texts and bytes of text of each class that the classifier is fitted on and calibrated with, at most.
TRAIN_DOCUMENTS, TRAIN_BYTES = 2000, 8 << 20
#: Of the crc32 of ids modulo FOLDS, the remainder whose labelled rows calibrate; the others train.
FOLDS, CALIBRATES = 5, 4
#: A text that is of good quality with a lower probability is dropped.
LEAST_PROBABILITY = 0.3
#: Fewer words, or a larger share (in percent) of words in repeated windows, fail a text.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Bits of a weight's place; lengths of n-grams of characters and of words.
PLACE_BITS, CHARACTERS, WORDS = 20, (1, 2, 3), (1, 2)
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.3, 1e-5
#: Characters that are worked on at once.
SLICE = 1 << 20

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[9:14] = _SPACE[32] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _windows(hashes: np.ndarray, first: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive symbols within a row, and each row's first."""
    if n == 1:
        return mix64(hashes + np.uint64(salt)), first
    made = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], made) + np.repeat(first[:-1], made)
    out = np.full(len(at), salt, dtype=np.uint64)
    for k in range(n):
        out = out * GAMMA + hashes[at + k]
    return mix64(out), begin


def rule_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null has none."""
    raw, offsets = text_bytes(texts)
    words, first = space_words(texts)
    inside = ~_SPACE[raw]
    lines, ends, of_row = runs(raw != 10, offsets)
    some = np.concatenate([[0], np.cumsum(inside)])
    with_word = some[ends] > some[lines]
    row = np.repeat(np.arange(len(texts)), np.diff(of_row))[with_word]
    hashes = run_hashes(BYTE_VALUE[raw], lines[with_word], ends[with_word])
    keys, at = np.unique(hashes ^ mix64(row.astype(np.uint64) + GAMMA), return_index=True)
    dup = np.bincount(row, minlength=len(texts)) - np.bincount(row[at], minlength=len(texts))
    windows, begin = _windows(words, first, WINDOW, 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    _, index, times = np.unique(windows ^ mix64(owner.astype(np.uint64) + GAMMA), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[index] > 1)
    at = again - begin[owner[again]] + first[owner[again]]
    repeated = np.zeros(len(words), dtype=bool)
    for k in range(WINDOW):
        repeated[at + k] = True
    return {
        "n_words": np.diff(first),
        "word_chars": _sums(inside & ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOLS[raw], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": _sums(repeated, first),
    }


def _groups(texts: pa.Array):
    """For each kind of n-gram and slice of the texts: the places of the weights and each row's first in the slice."""
    every = pc.fill_null(texts, "").to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in every])]).astype(np.int64)
    codes = np.frombuffer("".join(every).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    words, first = space_words(texts)
    for kind, (symbols, edges, lengths) in enumerate(((codes, offsets, CHARACTERS), (words, first, WORDS))):
        for n in lengths:
            for at in range(0, max(len(symbols), 1), SLICE):
                part = symbols[at : at + SLICE + n - 1].astype(np.uint64)
                cut = np.clip(edges - at, 0, len(part))
                hashes, begin = _windows(part, cut, n, 16 * kind + n)
                yield 8 * kind + n, (hashes >> np.uint64(64 - PLACE_BITS)).astype(np.int64), begin


@dataclass
class Classifier:
    """Weights, bias, and the scale and shift that make a probability of a logit."""

    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for kind, places, begin in _groups(texts):
            total = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=np.float64)])
            sums[kind] = sums.get(kind, 0.0) + total[begin[1:]] - total[begin[:-1]]
            counts[kind] = counts.get(kind, 0) + np.diff(begin)
        return self.bias + sum((sums[k] / np.maximum(counts[k], 1) for k in sums), np.zeros(len(texts)))

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """The probability that a text is of good quality; one without n-grams has that of the bias."""
        return _sigmoid(self.scale * self.logits(texts) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, places and values of the texts' mean n-gram counts."""
    offsets, places, values = [0], [], []
    for chunk in chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])])):
        n = chunk.num_rows
        keys, weight = [], []
        counts: dict[int, np.ndarray] = {}
        parts = []
        for kind, place, begin in _groups(chunk.column("text")):
            row = np.repeat(np.arange(n), np.diff(begin))
            key, times = np.unique((row << PLACE_BITS) + place, return_counts=True)
            counts[kind] = counts.get(kind, np.zeros(n)) + np.diff(begin)
            parts.append((kind, key, times))
        for kind, key, times in parts:
            keys.append(key)
            weight.append(times / counts[kind][key >> PLACE_BITS])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        values.append(np.bincount(at, weights=np.concatenate(weight), minlength=len(key)).astype(np.float32))
        places.append((key & ((1 << PLACE_BITS) - 1)).astype(np.int32))
        offsets += (offsets[-1] + np.searchsorted(key >> PLACE_BITS, np.arange(1, n + 1))).tolist()
    return np.array(offsets), np.concatenate(places), np.concatenate(values)


def fit(texts: list[str], labels: np.ndarray, seed: int = 11) -> Classifier:
    """Fit weights and bias to texts and 0/1 labels, both classes with equal weight."""
    model = Classifier(np.zeros(1 << PLACE_BITS, dtype=np.float32))
    if not len(texts):
        return model
    offsets, places, values = _features(texts)
    rng, square, square_bias = np.random.default_rng(seed), np.full(1 << PLACE_BITS, 1e-8), 1e-8
    share = np.bincount(labels.astype(int), minlength=2)
    importance = (len(labels) / 2 / np.maximum(share, 1))[labels.astype(int)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            many = offsets[rows + 1] - offsets[rows]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offsets[rows], many)
            of, place, value = np.repeat(np.arange(len(rows)), many), places[at], values[at]
            logit = model.bias + np.bincount(of, weights=model.weights[place] * value, minlength=len(rows))
            wrong = (_sigmoid(logit) - labels[rows]) * importance[rows] / len(rows)
            used, where = np.unique(place, return_inverse=True)
            slope = np.bincount(where, weights=wrong[of] * value) + DECAY * model.weights[used]
            square[used] += slope**2
            model.weights[used] -= (RATE * slope / np.sqrt(square[used])).astype(np.float32)
            square_bias += wrong.sum() ** 2
            model.bias -= RATE * wrong.sum() / np.sqrt(square_bias)
    return model


def calibrate(model: Classifier, texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Classifier:
    """The classifier with the scale and shift that make its probabilities likeliest on weighted rows it hasn't seen.

    Labels are drawn in a little, as Platt does, so that separable rows don't make the scale endless.
    """
    if not len(texts) or len(set(labels.tolist())) < 2:
        return model
    logits = np.concatenate([model.logits(c.column("text")) for c in chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]))])
    count = np.bincount(labels.astype(int), minlength=2)
    target = np.where(labels > 0, (count[1] + 1) / (count[1] + 2), 1 / (count[0] + 2))
    x, theta = np.stack([logits, np.ones(len(logits))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps
        p = _sigmoid(x @ theta)
        slope = x.T @ (weights * (p - target))
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return Classifier(model.weights, model.bias, *theta.tolist()) if theta[0] > 0 else model


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCUMENTS, class_bytes: int = TRAIN_BYTES) -> Classifier:
    """Fit and calibrate on a sample of at most per_class texts and class_bytes bytes of each class.

    labels: doc_id, quality. An id with several labels is of poor quality if one of them says so; null ids and labels
    teach nothing. Without labels of both classes every text has the probability 1/2 or that of the only class.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    rows = labelled_sample(docs, known, per_class, class_bytes)
    texts, y = rows.column("text").to_pylist(), rows.column("label").to_numpy().astype(np.float64)
    fold = np.array([crc32(str(i).encode()) % FOLDS for i in rows.column("doc_id").to_pylist()], dtype=int)
    unseen = fold == CALIBRATES
    pick = lambda which: [t for t, w in zip(texts, which.tolist(), strict=True) if w]
    taken = np.bincount(y.astype(int), minlength=2)
    weights = np.array([share.get(k, 0) / max(taken[k], 1) for k in (0, 1)])[y.astype(int)]
    model = fit(pick(~unseen), y[~unseen])
    return calibrate(model, pick(unseen), y[unseen], weights[unseen])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_quality(docs: DataFrame, model: Classifier, least: float = LEAST_PROBABILITY) -> DataFrame:
    """doc_id, the counts of the rules, base_failed, probability, kept: one row for each row of `docs`.

    base_failed: fewer than 50 words, or more than half of them in three-word windows that the text holds twice.
    kept: not failed, and of good quality with a probability of at least `least`.

    Whole texts of any length are read. A null, empty or blank text has no words and so fails. Words, lines and windows
    are compared by 64-bit hashes. Rows of equal text score alike, repeated rows stay; only doc_id and text are
    read, whatever other columns are called. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for batch in chunks(batches):
            texts = batch.column("text")
            n = rule_counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n[c].astype(np.int64)) for c in COUNTS), pa.array(shared.value.probabilities(texts))], names=["doc_id", *COUNTS, "probability"])

    found = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY) -> DataFrame:
    """doc_id, probability of the documents that pass the rules and the classifier fitted on `labels`."""
    return score_quality(docs, train(docs, labels), least).filter("kept").select("doc_id", "probability")


def op11_quality(spark, sf_dir: str) -> DataFrame:
    """The rules' counts and the verdict on every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_quality(docs, train(docs, labels))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "probability")
