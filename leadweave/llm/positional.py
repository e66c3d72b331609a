r"""Benchmark decontamination with a distributed positional inverted index.

The training tokens are indexed in segments, as search engines do: a segment is an inverted index of some hundred
documents, a sorted list of terms and for each term its posting list, the sorted places of the segment's token
stream at which it stands. Segments are rows of a written table, so the index is partitioned by documents and a
phrase is looked up in each segment by itself. There the phrase's posting lists are intersected, each moved by the
term's offset in the phrase, from the list that is shortest in the segment to the longest. A phrase occurs where all
lists agree. Only hits are shuffled, and documents are never gathered by term, so a term that is in all of them is
no hot key.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z, known by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.words import chunks, split_words
from leadweave.storage import materialise, small_or_merge

WINDOW = 10
#: Text bytes of a segment's documents (a longer document is a segment of its own).
SEGMENT_BYTES = 1 << 18
#: Documents, and segments (some 300 kB each), of a batch that goes to Python at once.
BATCH_DOCUMENTS, BATCH_SEGMENTS = 1000, 8
#: Most phrases (100 bytes each) that are looked up in one pass over the index; more take more passes.
PASS_PHRASES = 100_000
#: Most names of windows, or contaminated documents, that are broadcast at once (some 300 bytes each).
BROADCAST_ROWS = 100_000
#: Splits of the index that make a task where only its documents are read: splits are dealt by the bytes of all columns,
#: of which those are a few hundredths.
NARROW_SPLITS = 8
#: Possible starts that are worked on at once.
STARTS = 1 << 18

#: A segment: its documents with the place of their first token, its terms, and the lengths and entries of their posting
#: lists; these three as bytes, which the JVM passes on as they are.
SEGMENT = "doc_id array<{id}>, text_hash array<long>, first array<int>, terms binary, lengths binary, places binary"
#: Bytes of the index that a writer or reader holds at once, some ten segments (a longer one is held alone).
HELD_BYTES = 1 << 22


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: the hashed words of each item, in order; extra columns are left out."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches):
        for batch in chunks(batches):
            words = split_words(batch.column("text"))
            terms = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(words.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), terms], names=["item_id", "terms"])

    return items.select("item_id", "text").mapInArrow(split, f"item_id {kind}, terms array<long>")


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _bytes(values: np.ndarray) -> pa.Array:
    """One row: the numbers in as few bytes each as hold the largest."""
    narrow = next(t for t in ("<u2", "<u4", "<u8") if int(values.max(initial=0)) <= np.iinfo(t).max)
    return pa.array([values.astype(narrow).tobytes()], pa.binary())


def _numbers(column: pa.Array, row: int, n: int) -> np.ndarray:
    """The n numbers that _bytes has put there."""
    data = column[row].as_buffer()
    return np.frombuffer(data, dtype=f"<u{data.size // n}" if n else "<u8")


def positional_index(docs: DataFrame) -> DataFrame:
    """The written index of all words of `docs` (doc_id, text): a row for each segment, as SEGMENT says."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def post(batches):
        for batch in chunks(batches, size=SEGMENT_BYTES):
            words = split_words(batch.column("text"))
            order = np.argsort(words.hashes, kind="stable")  # places of a list stay in order
            terms = words.hashes[order]
            new = np.ones(len(terms), dtype=bool)
            new[1:] = terms[1:] != terms[:-1]
            begin = np.flatnonzero(new)
            columns = [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(words.first, pa.int32()),
            ]
            lists = [pa.array([terms[begin].astype("<u8").tobytes()], pa.binary()), _bytes(np.diff(np.append(begin, len(terms)))), _bytes(order)]
            yield pa.RecordBatch.from_arrays([*map(_one_list, columns), *lists], names=["doc_id", "text_hash", "first", "terms", "lengths", "places"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return materialise(rows.mapInArrow(post, SEGMENT.format(id=kind)), "postings", BATCH_DOCUMENTS, HELD_BYTES)


def indexed_documents(index: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words of every document of the index."""
    docs = F.transform("doc_id", lambda d, i: F.struct(d.alias("doc_id"), F.get("text_hash", i).alias("text_hash"), (F.get("first", i + 1) - F.get("first", i)).cast("long").alias("n_words")))
    rows, splits = index.select(F.explode(docs).alias("d")).select("d.*"), index.select("first").rdd.getNumPartitions()
    return rows.coalesce(max(splits // NARROW_SPLITS, index.sparkSession.sparkContext.defaultParallelism))


class Phrases:
    """Phrases of at most `width` terms as arrays, to be looked up in segments."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.phrase = table.column("phrase").to_numpy()
        lists = table.column("terms").combine_chunks()
        flat = lists.flatten().to_numpy().view(np.uint64)
        self.n = np.diff(lists.offsets.to_numpy())
        self.vocabulary, at = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(self.n)), self.n)
        self.terms = np.full((len(self.n), int(self.n.max(initial=1))), -1, dtype=np.int64)
        self.terms[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)] = at


class Segment:
    """One row of the index."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.ids = batch.column("doc_id").slice(row, 1).flatten()
        self.text_hash, self.first = (batch.column(c).slice(row, 1).flatten().to_numpy() for c in ("text_hash", "first"))
        self.terms = np.frombuffer(batch.column("terms")[row].as_buffer(), dtype="<u8")
        self.list_at = np.concatenate([[0], np.cumsum(_numbers(batch.column("lengths"), row, len(self.terms)), dtype=np.int64)])
        self.places = _numbers(batch.column("places"), row, int(self.list_at[-1])).astype(np.int64)
        #: list number and place in one number, which grows along the lists
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.list_at)) * (len(self.places) + 1) + self.places

    def candidates(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrases whose terms all have a list here, and the number of each term's list (-1 beyond a phrase's end)."""
        if not len(self.terms) or not len(phrases.n):
            return np.zeros(0, np.int64), np.zeros((0, 1), np.int64)
        at = np.minimum(np.searchsorted(self.terms, phrases.vocabulary), len(self.terms) - 1)
        lists = np.append(np.where(self.terms[at] == phrases.vocabulary, at, -1), -2)[phrases.terms]
        which = np.flatnonzero((lists != -1).all(axis=1))
        return which, np.maximum(lists[which], -1)

    def holds(self, lists: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each place is in its list."""
        asked = lists * (len(self.places) + 1) + places
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return self.keys[at] == asked

    def starts(self, lists: np.ndarray):
        """Slices of: row of `lists`, the place of the shortest list's term, its offset; and the other terms by length of list."""
        size = np.where(lists >= 0, np.diff(self.list_at)[lists], np.iinfo(np.int64).max)
        order = np.argsort(size, axis=1, kind="stable")
        rows = np.arange(len(lists))
        lead = lists[rows, order[:, 0]]
        many = size[rows, order[:, 0]]
        part = np.cumsum(many) // STARTS
        for k in np.unique(part):
            some = np.flatnonzero(part == k)
            row = np.repeat(some, many[some])
            step = np.arange(len(row)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
            yield row, self.places[self.list_at[lead[row]] + step], order

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def phrase_hits(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, document and start in the document of each occurrence."""
        which, lists = self.candidates(phrases)
        out = [(np.zeros(0, np.int64),) * 3]
        if len(which):
            for row, place, order in self.starts(lists):
                start = place - order[row, 0]
                keep = start >= 0
                row, start = row[keep], start[keep]
                for k in range(1, order.shape[1]):
                    term = order[row, k]
                    of = lists[row, term]
                    keep = (of < 0) | self.holds(of, start + term)
                    row, start = row[keep], start[keep]
                doc = self.documents(start)
                keep = start + phrases.n[which[row]] <= self.first[doc + 1]
                row, start, doc = row[keep], start[keep], doc[keep]
                out.append((which[row], doc, start - self.first[doc]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def near_hits(self, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, document and place of each leading term near which all other terms stand."""
        which, lists = self.candidates(phrases)
        out = [(np.zeros(0, np.int64),) * 3]
        if len(which):
            for row, place, order in self.starts(lists):
                lead = order[row, 0]
                doc = self.documents(place)
                for k in range(1, order.shape[1]):
                    term = order[row, k]
                    of, due = lists[row, term], place - lead + term
                    low = np.maximum(due - slop, self.first[doc])
                    high = np.minimum(due + slop, self.first[doc + 1] - 1)
                    base = np.maximum(of, 0) * (len(self.places) + 1)
                    found = np.searchsorted(self.keys, base + high, side="right") > np.searchsorted(self.keys, base + low)
                    keep = (of < 0) | (found & (low <= high))
                    row, place, lead, doc = row[keep], place[keep], lead[keep], doc[keep]
                out.append((which[row], doc, place - self.first[doc]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _looked_up(index: DataFrame, phrases: DataFrame, search, place: str) -> DataFrame:
    """doc_id, text_hash, phrase, n and the place for all that `search` finds of phrases in the index's segments."""
    spark, kind = index.sparkSession, index.schema["doc_id"].dataType.elementType.simpleString()
    phrases = materialise(phrases.filter(F.size("terms") > 0).select("phrase", "terms"), "phrases")
    passes = max(1, -(-phrases.count() // PASS_PHRASES))
    found = []
    for k in range(passes):
        shared = spark.sparkContext.broadcast(Phrases(phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(passes)) == k).toArrow()))

        def look(batches, shared=shared):
            asked = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = Segment(batch, i)
                    phrase, doc, at = search(segment, asked)
                    yield pa.RecordBatch.from_arrays(
                        [segment.ids.take(pa.array(doc)), pa.array(segment.text_hash[doc]), pa.array(asked.phrase[phrase]), pa.array(at, pa.int32()), pa.array(asked.n[phrase], pa.int32())], names=["doc_id", "text_hash", "phrase", place, "n"]
                    )

        found.append(index.mapInArrow(look, f"doc_id {kind}, text_hash long, phrase long, {place} int, n int"))
    return reduce(DataFrame.unionByName, found)


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, text_hash, phrase, start, n: each place at which a phrase (phrase long, terms array<long>) occurs.

    Rows that share id and text each give their matches.
    """
    return _looked_up(index, phrases, lambda segment, asked: segment.phrase_hits(asked), "start")


def proximity_matches(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """doc_id, text_hash, phrase, at, n: places of a phrase's rarest term near which all its other terms stand.

    Rarest is the term that stands least often in the document's segment. Near is at most `slop` words from where the
    phrase would have it, within the document.
    """
    return _looked_up(index, phrases, lambda segment, asked: segment.near_hits(asked, slop), "at")


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, phrase, terms: all windows of `width` words; an item of fewer, but not none, is one window."""
    n = F.size("terms")
    at = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    windows = F.transform(at, lambda i: F.slice("terms", i, F.least(n, F.lit(width))))
    rows = items.filter(n > 0).select("item_id", F.explode(windows).alias("terms"))
    return rows.withColumn("phrase", F.xxhash64("terms"))


def _same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def _covered(docs: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index; item_id, phrase, terms of all windows; doc_id, text_hash, n_hit, phrases of the documents that are hit."""
    index, terms = positional_index(docs), materialise(item_terms(items), "items")
    windows = materialise(item_windows(terms, width), "windows")
    hits = phrase_matches(index, windows.groupBy("phrase").agg(F.first("terms").alias("terms")))

    def step(state, x):
        fresh = F.greatest(x["end"] - F.greatest(x["start"], state["upto"]), F.lit(0))
        return F.struct(F.greatest(state["upto"], x["end"]).alias("upto"), (state["n"] + fresh).alias("n"))

    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    covered = hits.groupBy("doc_id", "text_hash").agg(spans.alias("spans"), F.collect_set("phrase").alias("phrases"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), step, lambda s: s["n"]).cast("long")
    return index, windows, materialise(covered.select("doc_id", "text_hash", n_hit.alias("n_hit"), "phrases"), "covered", BATCH_SEGMENTS)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, item_ids (sorted as strings): one row for each row of `docs`.

    Words inside any occurrence of an item's window are hit. Null or empty texts have no words; rows that share
    an id are told apart by their text, copies of id and text give equal rows; a null doc_id is an id like any other;
    an item of null id hits words but isn't listed, repeated items count once. A text of any length is indexed whole,
    one longer than SEGMENT_BYTES in a segment of its own. Only doc_id, item_id and text are read, whatever other
    columns are called. Empty tables give no hits, or no rows.
    """
    index, windows, covered = _covered(docs, items, width)
    names = small_or_merge(materialise(windows.select("phrase", F.col("item_id").cast("string").alias("item")).distinct(), "names"), BROADCAST_ROWS)
    listed = covered.select("doc_id", "text_hash", F.explode("phrases").alias("phrase")).join(names, "phrase")
    listed = listed.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    both = covered.alias("a").join(listed.hint("merge").alias("b"), _same_document("a", "b")).select("a.doc_id", "a.text_hash", "a.n_hit", "b.item_ids")
    both = materialise(both, "contaminated")
    rows = indexed_documents(index)
    rows = rows.alias("a").join(small_or_merge(both, BROADCAST_ROWS).alias("b"), _same_document("a", "b"), "left")
    return rows.select("a.*", F.coalesce("b.n_hit", F.lit(0)).alias("n_hit"), F.coalesce("b.item_ids", F.array().cast("array<string>")).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents, all columns as they were, without those in which a window of an item occurs.

    Null and empty texts stay, null and empty items occur nowhere. Texts of any length are searched whole; equal texts
    of an id fare alike, whichever of its rows they stand in. An empty table gives an empty one.
    """
    found = small_or_merge(_covered(docs, items, width)[2].select("doc_id", "text_hash"), BROADCAST_ROWS)
    rows = docs.alias("a").join(found.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.text") == F.col("b.text_hash")), "left_anti")
    return rows.select("a.*")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and the items."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items)
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0
), win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bw
), dw AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM dw
), hit AS (SELECT doc_id, item_id, i, n FROM dg JOIN win USING (n, gram)
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
