"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to its character n-grams:
to the longest length, from five down to one, at which any of its n-grams is known, and scores their mean.
Words are runs of letters, lower-cased; n-grams include the word's edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.words import GAMMA, chunks, mix64, run_hashes, runs

UNKNOWN = "und"
#: Documents of each language that are drawn for training, by a threshold on the hash of their ids.
TRAIN_DOCUMENTS = 3000
#: Count that a word or n-gram needs to be known. All that have it are kept: the sample bounds how many there are.
LEAST_COUNT = 3
LONGEST = 5
#: Words beyond which more text makes a score no surer.
ENOUGH_WORDS = 20
#: A text whose score is lower is rejected as of no one language.
LEAST_SCORE = 0.5

_letters = np.frombuffer(bytes(chr(c).isalpha() for c in range(1 << 16)), dtype=np.uint8).astype(bool)


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts end to end, and the rows' offsets in them."""
    lower = [t.lower() for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lower])]).astype(np.int64)
    return np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offsets


def _is_letter(codes: np.ndarray) -> np.ndarray:
    inside = _letters[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        kinds, of = np.unique(codes[high], return_inverse=True)
        inside[high] = np.array([chr(c).isalpha() for c in kinds.tolist()])[of]
    return inside


class _Text:
    """The words of a batch: their different forms, and which form stands where in which row."""

    def __init__(self, texts: pa.Array):
        codes, offsets = _symbols(pc.fill_null(texts, ""))
        starts, ends, self.first = runs(_is_letter(codes), offsets)
        values = mix64(codes.astype(np.uint64) + GAMMA)
        hashes = run_hashes(values, starts, ends)
        self.keys, at, self.form = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends, self.codes = starts[at], ends[at], codes

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the given forms with an edge at either side, and the form of each."""
        length = self.ends[which] - self.starts[which] + 2
        total = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(total[-1]) - np.repeat(total[:-1], length)
        edge = (at == 0) | (at == np.repeat(length, length) - 1)
        place = np.repeat(self.starts[which], length) + at - 1
        symbols = np.where(edge, np.uint64(32), self.codes[np.where(edge, 0, place)].astype(np.uint64))
        made = np.maximum(length - n + 1, 0)
        of = np.repeat(np.arange(len(which)), made)
        begin = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(total[:-1], made)
        hashes = np.full(len(begin), n, dtype=np.uint64)
        for k in range(n):
            hashes = hashes * np.uint64(0xD1342543DE82EF95) + symbols[begin + k] + np.uint64(1)
        return mix64(hashes), of


def training_rows(docs: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> DataFrame:
    """text, lang of rows to learn from: those with a language whose crc32 of doc_id mod 4 isn't 2, thinned by id hash.

    Null ids, texts and languages teach nothing; each row of an id is a row to learn from, whatever language it says.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    counts = known.groupBy("lang").count().collect()  # a row for each language
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, per_language / r["count"])).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    return known.filter(draw < share).select("text", "lang")


def _counted(batches):
    """lang, n (0: word), key, count of a task's rows."""
    for batch in chunks(batches):
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            text = _Text(batch.column("text").filter(pc.equal(langs, lang)))
            times = np.bincount(text.form, minlength=len(text.keys))
            parts = [(0, text.keys, times)]
            for n in range(1, LONGEST + 1):
                hashes, of = text.grams(np.arange(len(text.keys)), n)
                keys, at = np.unique(hashes, return_inverse=True)
                parts.append((n, keys, np.bincount(at, weights=times[of], minlength=len(keys)).astype(np.int64)))
            for n, keys, count in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n), pa.int32()), pa.array(keys.view(np.int64)), pa.array(count, pa.int64())],
                    names=["lang", "n", "key", "count"],
                )


class Model:
    """Languages, sorted keys of each length and their log probabilities by language."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    def find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and the scores of those that are."""
        known, scores = self.tables[n]
        if not len(known):
            return np.zeros(len(keys), dtype=bool), scores
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, scores[at[hit]]

    def word_scores(self, text: _Text) -> np.ndarray:
        """(forms, languages); zeros where nothing is known."""
        out = np.zeros((len(text.keys), len(self.langs)))
        hit, scores = self.find(0, text.keys)
        out[hit] = scores
        left = np.flatnonzero(~hit)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            hashes, of = text.grams(left, n)
            hit, scores = self.find(n, hashes)
            count = np.bincount(of[hit], minlength=len(left))
            sums = np.stack([np.bincount(of[hit], weights=scores[:, j], minlength=len(left)) for j in range(len(self.langs))], axis=1)
            got = count > 0
            out[left[got]] = sums[got] / count[got, None]
            left = left[~got]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (the languages' share of a text of at most ENOUGH_WORDS words) of each text."""
        text, n = _Text(texts), len(texts)
        many = np.diff(text.first)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        rows = np.repeat(np.arange(n), many)
        words = self.word_scores(text)
        sums = np.stack([np.bincount(rows, weights=words[text.form, j], minlength=n) for j in range(len(self.langs))], axis=1)
        mean = sums / np.maximum(many, 1)[:, None] * np.minimum(many, ENOUGH_WORDS)[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [self.langs[b] if m else UNKNOWN for b, m in zip(best, many, strict=True)], np.where(many > 0, share.max(axis=1), 0.0)


def train(docs: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> Model:
    """Learn from the rows of training_rows; counts are summed by Spark, all keys of LEAST_COUNT make the model."""
    counts = training_rows(docs, per_language).mapInArrow(_counted, "lang string, n int, key long, count long").groupBy("n", "key", "lang").agg(F.sum("count").alias("count"))
    by_key = counts.groupBy("n", "key").agg(F.sum("count").alias("total"), F.collect_list(F.struct("lang", "count")).alias("of")).filter(F.col("total") >= LEAST_COUNT)
    kept = by_key.select("n", "key", F.inline("of")).toArrow()
    langs = sorted(pc.unique(kept.column("lang")).to_pylist())
    code = pc.index_in(kept.column("lang"), pa.array(langs, pa.string())).to_numpy()
    length, every, times = (kept.column(c).to_numpy() for c in ("n", "key", "count"))
    tables = {}
    for n in range(LONGEST + 1):
        part = length == n
        keys, at = np.unique(every[part].view(np.uint64), return_inverse=True)
        count = np.full((len(keys), len(langs)), 0.5)
        np.add.at(count, (at, code[part]), times[part])
        logs = np.log(count / np.maximum(count.sum(axis=0, keepdims=True), 1.0))
        tables[n] = (keys, (logs - np.logaddexp.reduce(logs, axis=1, keepdims=True) if len(keys) else logs).astype(np.float32))
    return Model(langs, tables)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` in a struct `row`, lang_pred and score.

    Whole texts of any length are scored, and nothing but their text is used, so that rows of equal text score alike.
    Of languages with equal scores the first by name is taken. Null texts and texts without a letter are `und` with
    score 0, and so is every text if nothing could be learned. Repeated rows stay, other columns may have any names.
    An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in chunks(batches):
            langs, scores = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(scores)], names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, all columns as they were, that are of one known language: not `und`, score at least `least`.

    Null, empty and letterless texts go, and all texts if no row says its language; texts of any length are read whole.
    Repeated rows fare alike and stay, an empty table gives an empty one.
    """
    found = identify(docs, train(docs))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False))  # a null id is none of them
    return found.select("row.doc_id", held.alias("held_out"), "lang_pred", "score")
