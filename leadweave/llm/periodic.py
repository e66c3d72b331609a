"""Periodic runs of words by recursive frequency splitting and lag scans.

A run repeats a stretch of `period` words at least four times, so each of its words occurs four times in it. A word
that occurs less often in a segment stands in no run of that segment and splits it. The parts are counted for
themselves, so that words which were frequent enough in the whole become too rare in a part and split that again,
until nothing changes. Of a segment that falls apart only the smaller parts are counted anew and what they hold is
taken off the largest one's counts, so that all rounds together take time in proportion to n log n.

Surviving segments are scanned by lags. Lags from 2**k to 2**(k+1) - 1 are tried together: a run of such a period
holds a whole block of 2**k words that begins at a multiple of 2**k and recurs one period later, and blocks are compared
by hashes of all stretches of 2**k words, which are mixed from those of half the length. What recurs is extended
to both sides by halving steps.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.words import BYTE_VALUE, GAMMA, chunks, mix64, run_hashes, runs, text_bytes

#: A run has at least LEAST words and REPEATS periods.
LEAST, REPEATS = 6, 4
#: Rows of an Arrow batch of the query.
BATCH_DOCUMENTS = 1000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[9:14] = _SPACE[32] = True


def space_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of each text, and each row's first; null has none."""
    raw, offsets = text_bytes(texts)
    starts, ends, first = runs(~_SPACE[raw], offsets)
    return run_hashes(BYTE_VALUE[raw], starts, ends), first


def _spread(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1 .. of many[i] numbers each, end to end."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)


def surviving(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments in which every word occurs REPEATS times, of LEAST words or more.

    words: the rows' words end to end, first: each row's first.
    """
    n = len(words)
    _, word = np.unique(words, return_inverse=True)
    by_word = np.argsort(word, kind="stable")
    sorted_at = word[by_word] * np.int64(n + 1) + by_word  # places by word, then position
    low, high = first[:-1].astype(np.int64), first[1:].astype(np.int64)
    done_low, done_high = [], []
    # a word of a segment is a pair; pair[i] is that of place i, count those of all pairs
    pair, count = np.zeros(n, dtype=np.int64), np.zeros(0, dtype=np.int64)
    fresh_low, fresh_high = low[high - low >= LEAST], high[high - low >= LEAST]
    old_low, old_high, doubtful = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(fresh_low) or len(old_low):
        # the fresh segments are counted, the old ones look up their words that have become rare
        many = fresh_high - fresh_low
        at = _spread(fresh_low, many)
        keys, index, times = np.unique(np.repeat(np.arange(len(many)), many) * np.int64(n) + word[at], return_inverse=True, return_counts=True)
        pair[at] = index + len(count)
        count = np.concatenate([count, times])
        cut = at[times[index] < REPEATS]
        seg_low, seg_high = np.concatenate([fresh_low, old_low]), np.concatenate([fresh_high, old_high])
        order = np.argsort(seg_low)
        seg_low, seg_high = seg_low[order], seg_high[order]
        if len(doubtful):  # (segment's start, word) of pairs that may now be rare
            of = np.searchsorted(seg_low, doubtful[:, 0])
            begin = np.searchsorted(sorted_at, doubtful[:, 1] * np.int64(n + 1) + seg_low[of])
            end = np.searchsorted(sorted_at, doubtful[:, 1] * np.int64(n + 1) + seg_high[of])
            cut = np.concatenate([cut, by_word[_spread(begin, end - begin)]])
        cut = np.sort(cut)
        of = np.searchsorted(seg_low, cut, side="right") - 1
        cuts = np.bincount(of, minlength=len(seg_low))
        done_low.append(seg_low[cuts == 0])
        done_high.append(seg_high[cuts == 0])
        # parts between the cuts; a segment's largest part keeps its pairs
        split = np.flatnonzero(cuts)
        part_low = np.sort(np.concatenate([seg_low[split], cut + 1]))
        part_high = np.sort(np.concatenate([seg_high[split], cut]))
        owner = np.repeat(split, cuts[split] + 1)
        size = part_high - part_low
        order = np.lexsort((-size, owner))
        largest = np.zeros(len(size), dtype=bool)
        largest[order[np.append(True, np.diff(owner[order]) > 0)] if len(order) else order] = True
        long = size >= LEAST
        keep = largest & long
        old_low, old_high = part_low[keep], part_high[keep]
        fresh_low, fresh_high = part_low[~largest & long], part_high[~largest & long]
        # what the largest part has lost
        lost_parts = ~largest & (keep[np.flatnonzero(largest)][np.searchsorted(split, owner)] if len(owner) else largest)
        alive = np.zeros(len(seg_low), dtype=bool)
        alive[owner[keep]] = True
        lost = np.concatenate([_spread(part_low[lost_parts], size[lost_parts]), cut[alive[of]]])
        start_of = np.zeros(len(seg_low), dtype=np.int64)
        start_of[owner[keep]] = old_low
        segment = start_of[np.searchsorted(seg_low, lost, side="right") - 1]
        gone, where, times = np.unique(pair[lost], return_index=True, return_counts=True)
        count[gone] -= times
        rare = (count[gone] < REPEATS) & (count[gone] > 0)
        doubtful = np.stack([segment[where[rare]], word[lost[where[rare]]]], axis=1)
        # old segments that lost nothing to doubt about are done
        open_ = np.isin(old_low, doubtful[:, 0])
        done_low.append(old_low[~open_])
        done_high.append(old_high[~open_])
        old_low, old_high = old_low[open_], old_high[open_]
    low, high = np.concatenate(done_low) if done_low else np.zeros(0, np.int64), np.concatenate(done_high) if done_high else np.zeros(0, np.int64)
    order = np.argsort(low)
    return low[order], high[order]


def _levels(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each k: hashes of all stretches of 2**k words, of the lags that segments of up to `longest` words can have."""
    out = [mix64(words + GAMMA)]
    while REPEATS << len(out) <= longest:
        half = out[-1]
        width = 1 << (len(out) - 1)
        out.append(mix64(half[:-width] + mix64(half[width:]) * GAMMA))
    return out


def scan(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs within the segments, by start, then period."""
    size = high - low
    at = _spread(low, size)  # the segments' words end to end
    w, base = words[at], np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    names = _levels(w, int(size.max(initial=0)))
    found = []
    for k, name in enumerate(names):
        block = 1 << k
        if (REPEATS << k) > len(w):
            break
        rows = len(name) // block - 1
        if rows < 1:
            break
        # row i: the block at i * 2**k against those that begin one to two blocks later
        hit = name[: rows * block : block, None] == name[block : block + rows * block].reshape(rows, block)
        i, j = np.nonzero(hit)
        x, q = i * block, j + block
        s = np.searchsorted(base, x, side="right") - 1
        inside = (x + q + block <= base[s + 1]) & (size[s] >= np.maximum(LEAST, REPEATS * q))
        hit[i[~inside], j[~inside]] = False
        inside[i > 0] &= ~hit[i[i > 0] - 1, j[i > 0]]  # the next row of a stretch tells nothing new
        found.append((x[inside], q[inside], s[inside]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    x, q, s = (np.concatenate([f[i] for f in found]) for i in range(3))
    left, right = x.copy(), x + q  # words of [left, right - q) equal those a lag on
    for k in range(len(names) - 1, -1, -1):
        step, name = 1 << k, names[k]
        while True:  # at most some eight times on the first level, once or twice below
            go = np.flatnonzero((right + step <= base[s + 1]) & (right - q + step <= len(name)) & (right + step <= len(w)))
            go = go[name[right[go] - q[go]] == name[right[go]]]
            if not len(go):
                break
            right[go] += step
        while True:
            go = np.flatnonzero(left - step >= base[s])
            go = go[name[left[go] - step] == name[left[go] - step + q[go]]]
            if not len(go):
                break
            left[go] -= step
    long = right - left >= np.maximum(LEAST, REPEATS * q)
    left, right, q = left[long], right[long], q[long]
    # a multiple of a run's period gives the same stretch, so the smallest lag is its period
    order = np.lexsort((q, right, left))
    left, right, q = left[order], right[order], q[order]
    new = np.append(True, (np.diff(left) > 0) | (np.diff(right) > 0)) if len(left) else np.zeros(0, bool)
    left, right, q = left[new], right[new], q[new]
    order = np.lexsort((q, left))
    left, right, q = left[order], right[order], q[order]
    return at[left] if len(left) else left, at[left] + (right - left) if len(left) else right, q


def periodic_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start within the row, length and period of all runs, by row, start, period."""
    start, end, period = scan(words, *surviving(words, first))
    row = np.searchsorted(first, start, side="right") - 1
    return row, start - first[row], end - start, period


RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _found(batches):
    for batch in chunks(batches):
        texts = batch.column("text")
        words, first = space_words(texts)
        row, start, length, period = periodic_runs(words, first)
        # each word after the first period of a run goes
        step = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(step, first[row] + start + period, 1)
        np.add.at(step, first[row] + start + length, -1)
        keep = np.cumsum(step[:-1]) == 0
        collapsed = []
        for i, text in enumerate(texts.to_pylist()):
            own = (text or "").encode().split()
            mine = keep[first[i] : first[i + 1]]
            collapsed.append((b" ".join(own) if mine.all() else b" ".join(compress(own, mine.tolist()))).decode())
        offsets = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
        listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(offsets, listed), pa.array(collapsed, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, collapsed: one row for each row of `docs`.

    runs: start (word number from 0), length and period of every stretch of words `[^\\x20\\x09-\\x0D]+` with smallest
    period `period` and length at least 6 and four periods that no neighbouring word extends, by start, then period.
    collapsed: the text's words, joined by one space, without those that a run holds after its first period.

    Whole texts of any length are searched, in time of about n log n. A null, empty or blank text has no words, no runs
    and an empty `collapsed`. Words are compared by 64-bit hashes. Rows of equal id are rows of their own; only doc_id
    and text are read, whatever other columns are called. An empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, {RUNS}")


def plant_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: of documents whose crc32(doc_id) is divisible by 10, the words from a certain one on repeat.

    With g = floor(crc32 / 10) and n words, word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id, and a text without words, changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    listed = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("w"))
    some = listed.selectExpr("doc_id", "text", "w", "h div 10 AS g", "size(w) AS n")
    some = some.selectExpr("doc_id", "text", "w", "g", "n", "if(n > 0, g % n, 0) AS a").selectExpr("*", "1 + (n - a) div (3 + g % 8) AS p")
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p AS int) + 1))), ' ')")
    return some.select("doc_id", F.when(F.col("w").isNotNull() & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, after some have been made to repeat."""
    docs = plant_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = find_runs(docs).select("doc_id", "runs", "collapsed")
    best = F.expr("array_sort(runs, (x, y) -> case when x.length * y.period > y.length * x.period then -1 when x.length * y.period < y.length * x.period then 1 when x.start < y.start then -1 when x.start > y.start then 1 else cast(x.period - y.period as int) end)[0]")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
