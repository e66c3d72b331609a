"""Hard negatives by Kronecker-packed integer products.

Vectors are integers. The same component of several candidates, made non-negative by a bias, is laid side by side in
the fields of one wide integer, and an anchor's component is multiplied with all of them at once. The sum over the
components holds each candidate's product in its own field, as a field is as wide as the largest sum. Taking out the
biases leaves exact inner products.

Anchors and candidates meet in the cells of a grid of blocks, so that a task holds one block of either and the best of
each block are all that is shuffled after. A first pass, over the rows of an anchor's label alone, finds its
positives; a second one, over all rows, the negatives in each positive's range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadweave.storage import materialise, small_or_merge

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Anchors and candidates of a block, and scores that a task holds at once.
ANCHORS, CANDIDATES, SCORES = 1024, 8192, 1 << 20
#: Bits of a wide integer that numpy multiplies, and fields of one that Python does.
WORD, PYTHON_FIELDS = 64, 16
#: Sums that are worked on at once, so that they stay in a core's cache.
SUMS = 1 << 15
#: Most groups whose numbers of blocks are broadcast.
BROADCAST_GROUPS = 100_000
_MOST = (1 << 63) - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of a double matrix: 64-bit integers, or Python's where those don't hold them."""
    x = np.floor(SCALE * x.astype(np.float64))
    if not np.isfinite(x).all():
        return np.array([[int(math.floor(v)) for v in r] for r in x.tolist()], dtype=object)
    return x.astype(np.int64) if not x.size or np.abs(x).max() < 2**62 else np.vectorize(int, otypes=[object])(x)


class Packed:
    """Candidates whose components stand side by side in wide integers, for anchors of given least and greatest component."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.n, self.dimension = rows.shape
        if not rows.size:
            return
        self.low, self.bias = low, int(rows.min())
        largest = self.dimension * (int(rows.max()) - self.bias) * (high - low)
        self.width = max(largest.bit_length(), 1)
        self.fields = WORD // self.width
        self.native = self.fields > 1
        self.fields = self.fields if self.native else PYTHON_FIELDS
        self.kind = np.uint64 if self.native else object
        above = rows.astype(object) - self.bias if not self.native else rows - self.bias
        above = np.vstack([above, np.zeros((-self.n % self.fields, self.dimension), dtype=above.dtype)]).astype(self.kind)
        above = above.reshape(-1, self.fields, self.dimension)
        wide = sum(above[:, f] << self.kind(self.width * f) if self.native else above[:, f] * (1 << self.width * f) for f in range(self.fields))
        self.wide = np.ascontiguousarray(wide.T)
        self.of_row = rows.sum(axis=1) * low if self.native else rows.astype(object).sum(axis=1) * low

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, candidates) of inner products; what 64 bits don't hold is the nearest that they do."""
        if not self.dimension or not self.n or not len(anchors):
            return np.zeros((len(anchors), self.n), dtype=np.int64)
        above = (anchors - self.low if self.native else anchors.astype(object) - self.low).astype(self.kind)
        wide = self.wide.shape[1]
        sums = np.zeros((len(anchors), wide), dtype=self.kind)
        step = max(1, SUMS // wide)
        for at in range(0, len(anchors), step):
            some, part = sums[at : at + step], above[at : at + step]
            for j in range(self.dimension):  # one product for all fields of a wide integer
                some += part[:, j : j + 1] * self.wide[j]
        out = np.empty((len(anchors), wide, self.fields), dtype=np.int64 if self.native else object)
        for f in range(self.fields):
            if self.native:
                out[:, :, f] = ((sums >> np.uint64(self.width * f)) & np.uint64((1 << self.width) - 1)).astype(np.int64)
            else:
                out[:, :, f] = (sums // (1 << self.width * f)) % (1 << self.width)
        out = out.reshape(len(anchors), -1)[:, : self.n]
        # sum (V + bias)(A + low) = sum VA + bias * sum A + low * sum (V + bias)
        out = out + self.of_row + (above.sum(axis=1).astype(out.dtype) * self.bias)[:, None]
        return out if self.native else np.clip(out, -_MOST, _MOST).astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if len(flat) else np.zeros((table.num_rows, 0))


def _scored(anchors: pa.Table, rows: pa.Table):
    """The candidates by vec_id, nulls last, and for slices of the anchors: their numbers and all scores."""
    rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
    a, x = integers(_matrix(anchors)), integers(_matrix(rows))
    packed = Packed(x, int(a.min()) if a.size else 0, int(a.max()) if a.size else 0)
    step = max(1, SCORES // max(len(x), 1))

    def each():
        for at in range(0, len(a), step):
            yield np.arange(at, min(at + step, len(a))), packed.products(a[at : at + step])

    return rows, each()


def _first(row: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of hits by row and, in it, by vec_id: the places of each row's `most` highest scores, ties by vec_id."""
    order = np.lexsort((-score, row))
    new = np.append(True, np.diff(row[order]) > 0) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    return order[rank < most]


def _best_positives(most: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            rows, slices = _scored(anchors, rows)
            uid, own = rows.column("uid").to_numpy(), anchors.column("uid").to_numpy()
            for at, score in slices:
                other = uid[None, :] != own[at][:, None]
                score = np.where(other, score, -_MOST - 1)
                least = np.partition(score, max(score.shape[1] - most, 0), axis=1)[:, max(score.shape[1] - most, 0)]
                i, j = np.nonzero((score >= least[:, None]) & other)
                keep = _first(i, score[i, j], most)
                out.append((at[i[keep]], j[keep], score[i[keep], j[keep]]))
        i, j, score = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
        return pa.table({"anchor": anchors.column("uid").take(pa.array(i)), "id": rows.column("vec_id").take(pa.array(j)), "uid": rows.column("uid").take(pa.array(j)), "score": pa.array(score)})

    return find


def _best_negatives(most: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            rows, slices = _scored(anchors, rows)
            label, own = (t.column("label").combine_chunks().dictionary_encode() for t in (rows, anchors))
            code = {v: k for k, v in enumerate(label.dictionary.to_pylist())}
            mine = np.array([code.get(v, -1) for v in own.dictionary.to_pylist()])[own.indices.to_numpy()]
            label = label.indices.to_numpy()
            scores = anchors.column("positive_scores").to_pylist()
            ranks = max(len(s) for s in scores)
            # 80 p <= 100 s <= 100 p holds for integers from p - floor(p / 5) to p
            high = np.array([s + [-1] * (ranks - len(s)) for s in scores], dtype=np.int64)
            low = high - high // 5
            low[high < 0] = 0  # an empty range
            for at, score in slices:
                within = (score >= low[at].min(axis=1)[:, None]) & (score <= high[at].max(axis=1)[:, None])
                i, j = np.nonzero(within & (label[None, :] != mine[at][:, None]))
                got = score[i, j]
                for p in range(ranks):
                    hit = np.flatnonzero((got >= low[at[i], p]) & (got <= high[at[i], p]))
                    keep = hit[_first(i[hit], got[hit], most)]
                    out.append((at[i[keep]], np.full(len(keep), p), j[keep], got[keep]))
        i, p, j, score = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(4))
        return pa.table({"anchor": anchors.column("uid").take(pa.array(i)), "place": pa.array(p.astype(np.int32)), "id": rows.column("vec_id").take(pa.array(j)), "score": pa.array(score)})

    return find


def _grid(anchors: DataFrame, rows: DataFrame, by: list[str]):
    """Anchors and rows of each group `by`, dealt into blocks, so that each block of one meets each of the other."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("anchor").alias("m")).filter("m > 0")
    sizes = sizes.select(*by, F.ceil(F.col("n") / CANDIDATES).cast("int").alias("parts"), F.ceil(F.col("m") / ANCHORS).cast("int").alias("blocks"))
    sizes = small_or_merge(materialise(sizes, "grid"), BROADCAST_GROUPS)
    deal = lambda n, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(sizes, by).withColumn("block", deal("blocks", 1)).withColumn("part", every("parts")).drop("parts", "blocks")
    right = rows.join(sizes, by).withColumn("part", deal("parts", 2)).withColumn("block", every("blocks")).drop("parts", "blocks")
    cell = [*by, "block", "part"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell))


def _top(found: DataFrame, by: list[str], most: int, *ties: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), *ties)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of each anchor and positive.

    vectors: vec_id, embedding, label; is_anchor marks the anchors (default: vec_id divisible by 100). A score is the
    inner product of components floor(256 * x); higher scores come first, ties by vec_id, nulls last. An anchor's
    positives are the first rows of its label, itself left out; a positive's negatives are the first rows of other
    labels whose scores lie from 80% to 100% of the positive's. A positive without negatives gives no row.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do vectors of another
    length than the anchor's. Repeated rows are rows of their own, each anchor, positive and negative in its own
    right, so that equal results repeat. A null vec_id is no anchor by default. Scores that 64 bits don't hold are
    the nearest that they do. Other columns are not read, whatever their names. An empty table gives an empty one.
    """
    e = F.col("embedding")
    good = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("label").isNotNull() & e.isNotNull() & good)
    rows = materialise(rows.withColumn("dimension", F.size("embedding")).withColumn("uid", F.monotonically_increasing_id()), "labelled-vectors")
    anchors = materialise(rows.filter("anchor").drop("anchor"), "all-anchors")
    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    near = _grid(anchors, rows, ["dimension", "label"]).applyInArrow(_best_positives(positives), f"anchor long, id {id_kind}, uid long, score long")
    near = _top(near, ["anchor"], positives, "uid")
    of = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # `positives` rows at most
    of = materialise(of, "positives")
    anchors = anchors.join(of.select(F.col("anchor").alias("uid"), F.col("positives.score").alias("positive_scores")).hint("merge"), "uid")
    anchors = materialise(anchors, "anchors")
    found = _grid(anchors, rows, ["dimension"]).applyInArrow(_best_negatives(negatives), f"anchor long, place int, id {id_kind}, score long")
    found = _top(found, ["anchor", "place"], negatives)
    named = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")).join(of.hint("merge"), "anchor")
    p = F.get("positives", F.col("place"))
    return found.hint("merge").join(named, "anchor").select(
        "anchor_id", p["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), p["score"].alias("positive_score"), F.col("score").alias("negative_score")
    )


def op13_hardneg(spark, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor; where vec_id is divisible by 7, the label moves on by one first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE p.k <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
