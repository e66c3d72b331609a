"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

A document is a bag of shingles with counts. Each shingle has a Poisson process on (time, weight level), the
same in every document; a point counts for a document if its level lies below the shingle's count there, and it
is dealt to one register. A register keeps its earliest point, so two documents agree on a register with the
probability of their weighted Jaccard similarity. Levels are discretised at whole counts and form a hierarchy of
blocks [0,1), [1,2), [2,4), [4,8) ...: a block is one process of its whole rate, and a block that a count covers
only in part is thinned by each point's level. Points later than a bound, by which all registers are filled
almost surely, are not made; documents with an empty register are done again with a later bound.

Registers are banded. Documents of a band bucket are compared with its head, the member that has the most company
in all its buckets. Where that leaves a bucket in several components, what stands outside the largest is paired with
the members of the others, but for pairs that cannot be similar. That is told from what a document lacks and adds
against the head, by counts alone: for bags x, y and head h, the sum of minimum counts of x and y is
|x & h| + |y & h| - |h| + |lack(x) & lack(y)| + |add(x) & add(y)|, and bitmaps of hashed shingles bound the last two
from above. Every similarity that counts is exact: sum of minimum counts over sum of maximum counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.words import GAMMA, chunks, mix64, shingle_hashes, split_words
from leadweave.operators.components import connected_components
from leadweave.storage import materialise, small_or_merge

SHINGLE = 5
#: Similarity as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
#: At similarity 0.8 a pair shares no band with a chance of 3e-6.
BANDS, ROWS = 42, 6
#: Registers of which the four low bits must agree for a comparison: 5.7 standard deviations below the mean at 0.8.
LEAST_AGREE = 170
#: Bits of the maps of what a document lacks and adds against a head: 512, by the leading bits of a shingle's hash.
CELL_BITS = 9
#: Documents whose registers are filled together, and of a batch that goes to Python at once.
GROUP, BATCH_DOCUMENTS = 256, 1000
#: Members of a bucket that each of the others is held against in one task.
SLICE = 1000
#: Most buckets, or texts to compare, of which ids (16 bytes a row) are broadcast.
BROADCAST_IDS = 200_000
#: Keys of more rows than HOT_ROWS and than all rows over HOT_KEYS are joined by broadcast; there are fewer than HOT_KEYS.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def _points(seed, draw):
    """Bits of the given draws (1, 2, ...) of each process."""
    return mix64(seed + draw * GAMMA)


def _times(bits):
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _elements(hashes: np.ndarray, rows: np.ndarray):
    """row, seed, count, block of every process that touches a shingle: block 0 for each, more where counts are."""
    order = np.argsort(hashes ^ mix64(rows.astype(np.uint64)), kind="stable")
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    h, r = h[at], r[at]
    parts = [(r, h, count, np.zeros(len(h), dtype=np.int64))]
    block, left = 1, np.flatnonzero(count >= 2)
    while len(left):
        parts.append((r[left], mix64(h[left] + np.uint64(block)), count[left], np.full(len(left), block)))
        block += 1
        left = left[count[left] > 1 << (block - 1)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signatures(hashes: np.ndarray, first: np.ndarray, registers: int, patience: float = 4.0) -> np.ndarray:
    """(documents, registers) of 64-bit point ids; a document without shingles has zeros."""
    n, m = len(first) - 1, registers
    weight = np.diff(first).astype(np.float64)
    best, ids = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    if not len(hashes):
        return ids.reshape(n, m)
    row, seed, count, block = _elements(hashes, np.repeat(np.arange(n), np.diff(first)))
    rate = np.where(block > 0, 2.0 ** (block - 1), 1.0)
    bound = np.zeros(n)
    np.divide(m * (np.log(m) + patience), weight, out=bound, where=weight > 0)

    def put(e, bits, time):
        deal = mix64(bits ^ GAMMA)
        level = (deal & np.uint64(0xFFFFFFFF)).astype(np.int64)
        width = np.where(block[e] > 0, np.int64(1) << np.maximum(block[e] - 1, 0), 0)
        inside = (block[e] == 0) | (width + (level & np.maximum(width - 1, 0)) < count[e])
        slot = row[e] * m + ((deal >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        slot, bits, time = slot[inside], bits[inside], time[inside]
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        ids[slot[won]] = bits[won]

    # the first draw rules out almost all shingles of long documents
    bits = _points(seed, np.uint64(1))
    time = _times(bits) / rate
    e = np.flatnonzero(time <= bound[row])
    put(e, bits[e], time[e])
    time, drawn = time[e], 1
    drawn = np.ones(len(e), dtype=np.int64)
    while len(e):
        due = rate[e] * (bound[row[e]] - time)
        more = np.where(due < 0.5, 1, np.ceil(due + 3 * np.sqrt(due))).astype(np.int64)
        at = np.repeat(np.arange(len(e)), more)
        step = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
        bits = _points(seed[e[at]], (drawn[at] + 1 + step).astype(np.uint64))
        gaps = np.cumsum(_times(bits) / rate[e[at]])
        last = np.cumsum(more) - 1
        base = np.concatenate([[0.0], gaps[last[:-1]]])
        when = gaps - base[at] + time[at]
        ok = when <= bound[row[e[at]]]
        put(e[at[ok]], bits[ok], when[ok])
        time, drawn = when[last], drawn + more
        go = time <= bound[row[e]]
        e, time, drawn = e[go], time[go], drawn[go]
    ids = ids.reshape(n, m)
    unfilled = np.flatnonzero(np.isinf(best.reshape(n, m)).any(axis=1) & (weight > 0))
    if len(unfilled):
        keep = np.concatenate([hashes[first[i] : first[i + 1]] for i in unfilled])
        ids[unfilled] = signatures(keep, np.concatenate([[0], np.cumsum(weight[unfilled].astype(np.int64))]), m, patience * 2)
    return ids


def band_keys(ids: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) of 64-bit keys of the bands' registers."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GAMMA, (len(ids), bands)).copy()
    for k in range(rows):
        keys = mix64(keys + ids[:, k : bands * rows : rows])
    return keys


def _banded(batches):
    for batch in chunks(batches):
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            hashes, first = shingle_hashes(split_words(part.column("text")), SHINGLE)
            ids = signatures(hashes, first, BANDS * ROWS)
            keys = band_keys(ids).view(np.int64)
            low = np.zeros((len(ids), -(-ids.shape[1] // 16) * 16), dtype=np.uint64)
            low[:, : ids.shape[1]] = ids & np.uint64(15)
            low = np.bitwise_or.reduce(low.reshape(len(ids), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * low.shape[1], pa.int32()), pa.array(low.view(np.int64).ravel()))
            n = np.diff(first)
            offsets = pa.array(np.arange(len(n) + 1) * BANDS, pa.int32())
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()), mask=pa.array(n == 0))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), pa.array(n, pa.int64()), bands, sketch], names=["doc_id", "text_id", "n", "bands", "sketch"])


def _over(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """Of two sorted bags: by how much a's counts exceed b's in sum, and the bitmap of the shingles that do."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    more = a[1] - np.where(b[0][at] == a[0], b[1][at], 0)
    cell = a[0][more > 0] >> np.uint64(64 - CELL_BITS)
    bits = np.zeros(1 << (CELL_BITS - 6), dtype=np.uint64)
    np.bitwise_or.at(bits, (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return int(more[more > 0].sum()), bits


#: Sums of minimum and maximum counts of a and b, and bitmaps of what a lacks and adds against b.
COMPARED = "a long, b long, same long, total long, lacks array<long>, adds array<long>"


def _compared(batches):
    """The pairs (a, b) as COMPARED says."""

    def bags(texts):
        hashes, first = shingle_hashes(split_words(texts), SHINGLE)
        return [np.unique(hashes[first[i] : first[i + 1]], return_counts=True) for i in range(len(first) - 1)]

    def lists(maps):
        flat = pa.array(np.array(maps).view(np.int64).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1) * (1 << (CELL_BITS - 6)), pa.int32()), flat)

    for batch in chunks(batches, "text_a"):
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            codes = part.column("b").dictionary_encode()  # one text is compared with many
            where = np.unique(codes.indices.to_numpy(), return_index=True)[1]
            right = bags(part.column("text_b").take(pa.array(where)))
            same, total, lacks, adds = [], [], [], []
            for x, k in zip(bags(part.column("text_a")), codes.indices.to_pylist(), strict=True):
                added, bits = _over(x, right[k])
                adds.append(bits)
                lacks.append(_over(right[k], x)[1])
                same.append(int(x[1].sum()) - added)
                total.append(int(right[k][1].sum()) + added)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(same, pa.int64()), pa.array(total, pa.int64()), lists(lacks), lists(adds)], names=["a", "b", "same", "total", "lacks", "adds"])


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """What COMPARED says of the written pairs (a, b: text ids), written."""
    asked = materialise(pairs.select(F.col("a").alias("asked")).unionByName(pairs.select(F.col("b").alias("asked"))).distinct(), "asked")
    held = texts.join(small_or_merge(asked, BROADCAST_IDS), F.col("text_id") == F.col("asked"), "left_semi")
    held = materialise(held.groupBy("text_id").agg(F.first("text").alias("text")), "asked-texts")
    both = pairs.join(held.select(F.col("text_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = both.join(held.select(F.col("text_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(_compared, COMPARED), "compared", BATCH_DOCUMENTS)


def _links(compared: DataFrame) -> DataFrame:
    return compared.filter(SIMILAR[1] * F.col("same") >= SIMILAR[0] * F.col("total")).select("a", "b")


def _differing(a: str, b: str) -> Column:
    """Registers whose four low bits differ, of two sketches of sixteen registers to a number."""
    total = F.lit(0)
    for k in range(-(-BANDS * ROWS // 16)):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def _common_bits(a: str, b: str) -> Column:
    """Bits set in both of two bitmaps."""
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseAND(F.get(b, F.lit(k)))) for k in range(1 << (CELL_BITS - 6))), F.lit(0))


def _may_be_similar() -> Column:
    """Whether x and y, both compared with one head, can reach the similarity, by a bound that no link exceeds.

    Cells that a bitmap's shingles share add at most the smaller of both documents' surplus of counts over bits.
    """
    both = F.col("x.same") + F.col("y.same") - F.col("x.n_head")
    for way in ("lacks", "adds"):
        both = both + _common_bits(f"x.{way}", f"y.{way}") + F.least(f"x.{way}_more", f"y.{way}_more")
    return (SIMILAR[0] + SIMILAR[1]) * both >= SIMILAR[0] * (F.col("x.n") + F.col("y.n"))


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their part, the bucket's main one and its slices, written."""
    placed = members.join(labels.hint("merge"), F.col("text_id") == F.col("node"), "left")
    placed = placed.withColumn("part", F.coalesce("component", "text_id")).drop("node", "component")
    parts = placed.groupBy("band", "part").agg(F.count("*").alias("size"))
    several = parts.groupBy("band").agg(F.max(F.struct("size", "part")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("members")).filter("parts > 1")
    several = materialise(several.select("band", F.col("most.part").alias("main"), F.ceil(F.col("members") / SLICE).cast("int").alias("slices")), "open-buckets")
    return materialise(placed.join(small_or_merge(several, BROADCAST_IDS), "band"), "open-members")


def attach(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """The rows with the other columns of `table`, which has one row a key and counts the rows of each key in `size`.

    Both are written tables. Keys of very many rows are broadcast and their rows, as those of null keys, dealt out
    at random, so that no task holds all rows of one key.
    """
    bound = max(HOT_ROWS, (table.agg(F.sum(size)).first()[0] or 0) // HOT_KEYS)
    names = [c for c in table.columns if c not in (key, size)]
    hot = table.filter(F.col(size) > bound).select(F.col(key).alias("hot_key"), F.struct(*names).alias("hot"))
    cold = table.filter(F.col(size) <= bound).select(F.col(key).alias("cold_key"), F.struct(*names).alias("cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    plain = F.col("hot_key").isNull() & F.col(key).isNotNull()
    marked = marked.withColumn("dealt", F.when(plain, F.col(key)).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    both = marked.join(cold.hint("merge"), F.col("dealt") == F.col("cold_key"), "left")
    value = F.when(plain, F.col("cold")).otherwise(F.col("hot"))
    return both.select(*rows.columns, *[value[n].alias(n) for n in names])


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, n_shingles, part, head: the component of each row and its smallest row, null without words.

    head is (no_id, doc_id, text_id): the smallest id, nulls last, and the smallest text of that id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id"))
    made = materialise(texts.mapInArrow(_banded, f"doc_id {kind}, text_id long, n long, bands array<long>, sketch array<long>"), "bands", BATCH_DOCUMENTS)
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id")
    kept = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]
    nodes = materialise(made.filter("n > 0").groupBy("text_id").agg(*kept, F.min(least).alias("least"), F.count("*").alias("copies")), "nodes")
    rows = materialise(nodes.select("text_id", "n", F.explode("bands").alias("band")), "band-rows")
    full = materialise(rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = materialise(rows.join(small_or_merge(full, BROADCAST_IDS), "band"), "in-buckets")
    company = members.groupBy("text_id").agg(F.sum("size").alias("company"))
    members = materialise(members.drop("size").join(company.hint("merge"), "text_id"), "members")
    heads = members.groupBy("band").agg(F.max(F.struct("company", "text_id")).alias("head")).select("band", F.col("head.text_id").alias("head"))
    members = materialise(members.drop("company").join(small_or_merge(materialise(heads, "heads"), BROADCAST_IDS), "band"), "members")
    pairs = materialise(members.filter("text_id <> head").select(F.col("text_id").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    first = _compare(pairs, texts)
    links = _links(first)
    labels = connected_components(links, "a", "b")
    # pairs of different components that no bucket has ruled out
    known = first.select(F.col("a").alias("text_id"), F.col("b").alias("head"), "same", "total", "lacks", "adds")
    left = _open_members(members, labels).join(known.hint("merge"), ["text_id", "head"])
    surplus = [(F.col("total") - F.col("n") - _common_bits("lacks", "lacks")).alias("lacks_more"), (F.col("n") - F.col("same") - _common_bits("adds", "adds")).alias("adds_more"), (F.col("same") + F.col("total") - F.col("n")).alias("n_head")]
    left = materialise(left.join(nodes.select("text_id", "sketch").hint("merge"), "text_id").select("*", *surplus), "measured")
    # a large bucket is dealt into slices, and what stands outside its main part is held against each
    x = left.filter("part <> main").withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).alias("x")
    y = left.withColumn("slice", F.pmod(F.xxhash64("text_id"), F.col("slices")).cast("int")).alias("y")
    apart = (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("y.main")) | (F.col("x.text_id") < F.col("y.text_id")))
    near = SIMILAR[1] * F.least("x.n", "y.n") >= SIMILAR[0] * F.greatest("x.n", "y.n")
    cross = x.hint("merge").join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.slice") == F.col("y.slice")) & apart & near & _may_be_similar() & (_differing("x.sketch", "y.sketch") <= BANDS * ROWS - LEAST_AGREE))
    cross = materialise(cross.select(F.greatest("x.text_id", "y.text_id").alias("a"), F.least("x.text_id", "y.text_id").alias("b")).distinct(), "cross-pairs")
    if not cross.isEmpty():
        # what is joined so far stands for its links
        joined = labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = connected_components(joined.unionByName(_links(_compare(cross, texts))), "a", "b")

    # the head of each component is found among texts, then given to their rows
    of_text = nodes.select("text_id", "copies", "least").join(labels.hint("merge"), F.col("text_id") == F.col("node"), "left")
    of_text = materialise(of_text.select("text_id", "copies", "least", F.coalesce("component", "text_id").alias("part")), "parts")
    heads = materialise(of_text.groupBy("part").agg(F.min("least").alias("head"), F.count("*").alias("size")), "component-heads")
    of_text = materialise(attach(of_text, heads, "part", "size").select(F.col("text_id").alias("node"), "copies", "part", "head"), "text-heads")
    rows = made.select("doc_id", "text_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("text_id")).alias("node"))
    return attach(rows, of_text, "node", "copies").drop("node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, n_shingles, component_id, kept: one row for each row of `docs`.

    component_id is the smallest doc_id of the documents reachable by similarities of 0.8 or more; equal texts
    are one node, known by a 64-bit hash. kept marks the rows whose doc_id that is. A text of one to four words
    has one shingle of all its words; texts of any length are read whole. A null, empty or word-less text is like
    none, not even its copies, and is kept. Copies of id and text give equal rows. A null doc_id is never smallest, and kept only if its component has no other id. Only doc_id and text
    are read. An empty table gives an empty one.
    """
    found = _grouped(docs).withColumn("component_id", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")))
    return found.select("doc_id", "text_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they were, one of each group of near duplicates.

    Of a group stays one row with its smallest doc_id (nulls last) and, of several texts under that id, the smallest
    text_id. Groups are told apart by their texts, so repeated and null ids join none. Rows without words all stay.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_id") == F.col("head.text_id"))
    found = _grouped(docs).filter("part IS NOT NULL").groupBy("doc_id", "text_id").agg(F.first(stays).alias("stays"), F.count("*").alias("rows"))
    found = materialise(found.filter("NOT stays OR rows > 1"), "near-duplicates")
    again = found.filter("stays").select("doc_id", "text_id")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.text") == F.col("b.text_id"))
    rows = docs.alias("a").join(small_or_merge(found.select("doc_id", "text_id"), BROADCAST_IDS).alias("b"), same, "left_anti").select("a.*")
    if again.isEmpty():
        return rows
    # of rows that repeat both id and text of the one that stays, any will do
    copies = docs.alias("a").join(small_or_merge(again, BROADCAST_IDS).alias("b"), same, "left_semi")
    copies = copies.select(F.struct("a.*").alias("row"), "a.doc_id", F.xxhash64("a.text").alias("text_id")).dropDuplicates(["doc_id", "text_id"])
    return rows.unionByName(copies.select("row.*"))


def op1_bagminhash(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "component_id", "kept", "n_shingles")
