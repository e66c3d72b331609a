"""Near-duplicate embeddings by collision-counting projections.

Vectors are projected on many random lines. On each line they are sorted, and a pair collides if one lies in the
window centred on the other; a pair of the wanted cosine collides in a known share of the lines, so a pair whose count
of collisions reaches the number that such pairs miss once in ten thousand times is verified by its cosine in double
precision.

An unrelated pair collides in a third of all windows, so single windows cannot keep pairs apart: counting every
collision would touch every pair. Vectors are therefore sorted and counted inside blocks, which are made of further
projections: a block holds the vectors that lie on the same side of zero on each of some lines. The number of
lines to a block grows with the logarithm of the table, and blocks are drawn again until a pair of the wanted
cosine misses all of them once in ten thousand times. A pair is counted in the first block that it shares.

Only ids, block keys and rounded projections are shuffled to count; vectors follow for those with a pair that passes.
"""

from __future__ import annotations

from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.bagminhash import attach
from leadweave.operators.components import connected_components
from leadweave.storage import materialise, small_or_merge

COSINE = 0.95
#: The share of pairs at the threshold that blocks, and counts, may each miss.
MISS = 1e-4
#: Lines on which collisions are counted; half a window in standard deviations of the wanted pairs' differences.
LINES, HALF_WINDOW = 32, 2.0
#: Vectors that a block is meant to hold, keys of one task's group, and members of a part of a large group.
BLOCK, GROUP_BITS, PART = 16, 6, 2048
#: Steps of a half window to which projections are rounded.
STEPS = 16
#: Projections made at once; pairs whose collisions are counted at once, and whose cosines are taken at once.
PROJECTED, COUNTED, VERIFIED = 1 << 22, 1 << 20, 1 << 14
#: Most large blocks whose numbers of parts are broadcast.
BROADCAST_BLOCKS = 100_000


def block_shape(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Lines to a block, and how many times blocks are drawn, for n vectors."""
    bits = int(min(max(round(log2(max(n, 1) / BLOCK)), GROUP_BITS), 30))
    same = (1 - acos(cosine) / pi) ** bits
    return bits, ceil(log(MISS) / log(1 - same))


def least_count(lines: int = LINES) -> int:
    """The most collisions that a pair at the threshold reaches but for MISS of the cases."""
    p, tail = erf(HALF_WINDOW / sqrt(2)), 0.0
    for k in range(lines + 1):
        tail += comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail > MISS:
            return k
    return 0


def _dense(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and double matrix of a list column, for each length; no null or empty rows may be in it."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    starts = column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)].astype(np.float64)))
    return out


def _lines(dimension: int, count: int, stream: int) -> np.ndarray:
    return np.random.default_rng([dimension, stream]).standard_normal((dimension, count))


def _projector(bits: int, tables: int, cosine: float):
    step = HALF_WINDOW * sqrt(2 * (1 - cosine)) / STEPS
    most = max(1, PROJECTED // (bits * tables))

    def project(batches):
        for batch in batches:
            for rows, x in _dense(batch.column("embedding")):
                keys, marks = [], []
                for at in range(0, len(x), most):
                    unit = x[at : at + most] / np.linalg.norm(x[at : at + most], axis=1, keepdims=True)
                    sides = (unit @ _lines(x.shape[1], bits * tables, 1) > 0).reshape(len(unit), tables, bits)
                    keys.append((sides * (1 << np.arange(bits))).sum(axis=2).astype(np.int32))
                    marks.append(np.clip(np.round(unit @ _lines(x.shape[1], LINES, 2) / step), -127, 127).astype(np.int8))
                keys, marks = np.concatenate(keys), np.concatenate(marks)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vector").take(pa.array(rows)),
                        pa.array([x.shape[1]] * len(rows), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(keys.ravel())),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    names=["vector", "dimension", "keys", "marks"],
                )

    return project


def _cells(key: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Left and right by block, the blocks' numbers, and a cell of one array for each pair of a block.

    The pair of left i and right j has cell base[i] + place[j].
    """
    left, right = left[np.argsort(key[left], kind="stable")], right[np.argsort(key[right], kind="stable")]
    blocks = np.unique(key[right])
    of_left, of_right = np.searchsorted(blocks, key[left]), np.searchsorted(blocks, key[right])
    known = blocks[np.minimum(of_left, len(blocks) - 1)] == key[left]
    left, of_left = left[known], of_left[known]
    many_left, many_right = np.bincount(of_left, minlength=len(blocks)), np.bincount(of_right, minlength=len(blocks))
    first = np.concatenate([[0], np.cumsum(many_left * many_right)])
    row = np.arange(len(left)) - np.repeat(np.cumsum(many_left) - many_left, many_left)
    base = first[of_left] + row * many_right[of_left]
    place = np.arange(len(right)) - np.repeat(np.cumsum(many_right) - many_right, many_right)
    return left, right, of_left.astype(np.int64), of_right.astype(np.int64), base, place, int(first[-1])


def _windows(key: np.ndarray, marks: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a of left, b of right) of one block whose windows collide on `least` lines or more.

    On each line the right side is sorted by block and projection, and each of the left is looked up with its window.
    Where left and right are the same, each pair is counted once, from its lower end on the line.
    """
    both = left is right
    left, right, of_left, of_right, base, place, cells = _cells(key, left, right)
    count, span = np.zeros(cells, dtype=np.uint8), np.int64(1) << 16
    for line in range(LINES):
        at = of_right * span + marks[right, line]
        order = np.argsort(at, kind="stable")
        at = at[order]
        if both:
            low, high = np.arange(1, len(at) + 1), np.searchsorted(at, at + STEPS + 1, side="right")
        else:
            centre = of_left * span + marks[left, line]
            low, high = np.searchsorted(at, centre - STEPS - 1), np.searchsorted(at, centre + STEPS + 1, side="right")
        many = high - low
        upto = np.cumsum(many)
        for part in np.split(np.arange(len(many)), np.flatnonzero(np.diff(upto // COUNTED)) + 1):
            n = many[part]
            i = np.repeat(part, n)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - low[part], n)]
            if both:
                i = order[i]
                i, j = np.minimum(i, j), np.maximum(i, j)
            count[base[i] + place[j]] += 1
    hits = np.flatnonzero(count >= least)
    i = np.searchsorted(base, hits, side="right") - 1
    j = np.searchsorted(of_right, of_left[i]) + hits - base[i]
    return left[i], right[j]


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows on either side of a group's pairs: all of them, or two parts of a large block."""
    part, lo, hi = table.column("part").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    if lo == hi:
        rows = np.arange(len(part))
        return rows, rows
    return np.flatnonzero(part == lo), np.flatnonzero(part == hi)


def _marks(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("marks").to_pylist()), dtype=np.int8).reshape(table.num_rows, LINES).astype(np.int64)


def _finder(least: int):
    """Of a group: the vectors that have a pair of enough collisions."""

    def find(table: pa.Table) -> pa.Table:
        seen = np.zeros(table.num_rows, dtype=bool)
        a, b = _windows(table.column("key").to_numpy(), _marks(table), *_sides(table), least)
        seen[a] = seen[b] = True
        return table.select([c for c in table.column_names if c not in ("marks", "key")]).filter(pa.array(seen))

    return find


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each node over the links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linker(cosine: float, least: int):
    """Of a group: the vectors with links, how many, and the smallest row of the group that they reach."""

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        draw = table.column("draw")[0].as_py()
        copies, vectors = (table.column(c).to_numpy() for c in ("copies", "vector"))
        ((_, x),) = _dense(table.column("embedding").combine_chunks())
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        a, b = _windows(keys[:, draw], _marks(table), *_sides(table), least)
        for before in range(draw):  # pairs that share an earlier block are counted there
            new = keys[a, before] != keys[b, before]
            a, b = a[new], b[new]
        near = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", unit[a[k : k + VERIFIED]], unit[b[k : k + VERIFIED]]) >= cosine for k in range(0, len(a), VERIFIED))])
        a, b = a[near], b[near]
        links = np.bincount(a, weights=copies[b], minlength=len(x)) + np.bincount(b, weights=copies[a], minlength=len(x))
        root = _forest(len(x), a, b)
        rows = np.flatnonzero(links)
        return pa.table({"vector": vectors[rows], "links": links[rows].astype(np.int64), "root": vectors[root[rows]]})

    return link


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of `vectors` (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors are one node, known by a 64-bit hash, and link with each other. Repeated
    vec_ids are vectors of their own; a null vec_id is never smallest. Vectors may be of any length; columns other
    than these two are not read, whatever their names. An empty table gives an empty one.
    """
    e = F.col("embedding")
    square = F.aggregate(e, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(e.isNotNull() & finite & (square > 0) & (square < float("inf")), F.lit(False))
    rows = materialise(vectors.select("vec_id", F.when(good, F.xxhash64(e)).alias("vector"), F.when(good, e).alias("embedding")), "vectors")
    nodes = rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    nodes = materialise(nodes, "nodes")
    bits, tables = block_shape(nodes.count(), cosine)
    made = nodes.mapInArrow(_projector(bits, tables, cosine), "vector long, dimension int, keys array<int>, marks binary")
    made = materialise(made, "projected")
    spread = made.select("vector", "dimension", "marks", F.posexplode("keys").alias("draw", "key")).withColumn("block", F.shiftright("key", GROUP_BITS))
    # a large group is dealt into parts, and each pair of parts is a group
    block = ["draw", "dimension", "block"]
    sizes = spread.groupBy(*block).agg(F.count("*").alias("size")).filter(F.col("size") > PART)
    sizes = materialise(sizes.select(*block, F.ceil(F.col("size") / PART).cast("int").alias("parts")), "sizes")
    if sizes.isEmpty():
        parted = spread.withColumn("part", F.lit(0)).withColumn("other", F.lit(0))
    else:
        parted = spread.join(small_or_merge(sizes, BROADCAST_BLOCKS), block, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        parted = parted.withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int"))
        parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = [*block, "lo", "hi"]
    parted = parted.select("vector", "marks", "key", "part", *block, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    least = least_count()
    some = parted.groupBy(*group).applyInArrow(_finder(least), "vector long, part int, draw int, dimension int, block int, lo int, hi int")
    some = materialise(some, "with-pairs").join(made.select("vector", "keys", "marks").hint("merge"), "vector").join(nodes.hint("merge"), "vector")
    found = some.groupBy(*group).applyInArrow(_linker(cosine, least), "vector long, links long, root long")
    found = materialise(found, "vector-links")
    labels = connected_components(found, "vector", "root")
    counts = found.groupBy("vector").agg(F.sum("links").alias("links"))
    of = nodes.select("vector", "copies", "least").join(counts.hint("merge"), "vector", "left").join(labels.withColumnRenamed("node", "vector").hint("merge"), "vector", "left")
    of = of.select("vector", "copies", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vector").alias("part"))
    # the head of each component is found among vectors, then given to their rows
    of = materialise(of, "parts")
    heads = materialise(of.groupBy("part").agg(F.min("least").alias("head"), F.count("*").alias("size")), "component-heads")
    of = materialise(attach(of, heads, "part", "size").drop("least", "part"), "vector-heads")
    rows = attach(rows.select("vec_id", "vector"), of, "vector", "copies")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("head"))
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_projections(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate links and group of every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
