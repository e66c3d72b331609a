"""Mixing sources to target weights by hash-threshold histograms.

Every document has a uniform 60-bit hash of its id. A source's budget in words is met by taking all of its
documents a whole number of times, and once more those whose hash lies below a threshold. The threshold comes
from histograms of words by hash prefix: the first over all documents, each further one only over the bucket
in which the budget ends. Thresholds of larger budgets contain those of smaller ones, and no document is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadweave.storage import materialise, small_or_merge

#: Bits of the hash prefix on each level; the last level holds the whole hash.
LEVELS = (10, 22, 60)
#: Most sources whose thresholds are broadcast (a row is a name and a few numbers).
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text; a null id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of every document; other columns are left out, whatever their names."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), ratio: float = 1.0, most: int = 3) -> DataFrame:
    """source, source_size, target: words by weight, none above `most` times its source.

    Sources in code-point order, null last, take the weights in turn. What a capped source leaves goes to the
    others by weight: the common level is the largest of those at which the sources capped so far leave off.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    upto = W.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) * ratio - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, repeats, below: take a document `repeats` times, once more if h < below.

    `sizes` is a written table. The last bucket holds documents of one hash; it is taken if that comes nearer
    to the target.
    """
    spare = F.col("target") - F.col("repeats") * F.col("source_size")
    plan = targets.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("spare", spare)
    found, rows, before = plan.select("source", "spare", F.lit(0.0).alias("base")), sizes, None
    for bits in LEVELS:
        prefix = F.shiftright("h", LEVELS[-1] - bits)
        hist = rows.groupBy("source", prefix.alias("bucket")).agg(F.sum("size").alias("words"))
        run = W.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(run)).join(found.select(F.col("source").alias("s"), "spare", "base"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        hist = hist.withColumn("upto", F.col("upto") + F.col("base")).filter(F.col("upto") > F.col("spare"))
        edge = hist.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "spare")).alias("e"))
        edge = edge.select("source", "e.bucket", F.col("e.spare").alias("spare"), "e.upto", (F.col("e.upto") - F.col("e.words")).alias("base"))
        found = materialise(edge, "mix-edge")
        if bits != LEVELS[-1]:
            edges = small_or_merge(found.select(F.col("source").alias("s"), "bucket"), BROADCAST_SOURCES)
            rows = materialise(rows.join(edges, F.col("source").eqNullSafe(F.col("s")) & (prefix == F.col("bucket"))).select("source", "size", "h"), "mix-bucket")
    nearer = (F.col("upto") - F.col("spare")) < (F.col("spare") - F.col("base"))
    cut = found.select(F.col("source").alias("s"), (F.col("bucket") + nearer.cast("long")).alias("below"))
    # a source whose budget ends in no bucket has no words left to split
    return plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "repeats", F.coalesce("below", F.lit(0)).alias("below"))


def mix(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows (with source, size and h) and: source_size, target, copies, taken. No row is dropped."""
    cuts = small_or_merge(cuts.select(F.col("source").alias("cut_source"), "source_size", "target", "repeats", "below"), BROADCAST_SOURCES)
    out = rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    copies = F.col("repeats") + ((F.col("h") < F.col("below")) & (F.col("repeats") * F.col("source_size") < F.col("target"))).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("cut_source", "repeats", "below")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), ratio: float = 1.0, most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of `docs`.

    Null text and text of white space have size 0 and are taken as often as their hash says, at no cost. A null
    source is a source of its own, a null id hashes as empty text; rows of the same id are taken alike. An empty
    table gives an empty one. Texts of any length are counted whole. Only doc_id, source and text are read.
    """
    sizes = materialise(sized(docs), "mix-sizes")
    cuts = materialise(thresholds(sizes, materialise(source_targets(sizes, weights, ratio, most), "mix-targets")), "mix-cuts")
    return mix(sizes, cuts).drop("h")


def take_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), ratio: float = 1.0, most: int = 3) -> DataFrame:
    """The documents that the mix takes, all columns as they were, and: mix_size, mix_copies (1 to `most`).

    Where `docs` has columns of these names, in any case, the new ones get underscores until they differ. Null texts,
    texts of any length, repeated rows and an empty table are taken as mix_sources says.
    """
    have = {c.lower() for c in docs.columns}
    size, copies = (next(n for k in range(len(have) + 1) if (n := name + "_" * k) not in have) for name in ("mix_size", "mix_copies"))
    sizes = materialise(sized(docs), "mix-sizes")
    cuts = materialise(thresholds(sizes, materialise(source_targets(sizes, weights, ratio, most), "mix-targets")), "mix-cuts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))
    return mix(rows, cuts).filter("copies > 0").select("row.*", F.col("size").alias(size), F.col("copies").alias(copies))


def op9_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), w AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
         [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s
), l AS (SELECT *, (sum(source_size) OVER ()
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM l)) AS target FROM l
), p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t
), g AS (SELECT source, h, sum(size) AS words FROM sizes GROUP BY source, h
), c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g
), e AS (SELECT c.source, min({'h': c.h, 'upto': c.upto, 'words': c.words, 'spare': target - repeats * source_size}) AS e
         FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE c.upto > target - repeats * source_size GROUP BY c.source
), b AS (SELECT source, e.h + CASE WHEN e.upto - e.spare < e.spare - (e.upto - e.words) THEN 1 ELSE 0 END AS below FROM e)
SELECT doc_id, size, source_size, target, (repeats + CASE WHEN h < coalesce(below, 0) THEN 1 ELSE 0 END) * size AS taken,
       CAST(repeats + CASE WHEN h < coalesce(below, 0) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM sizes JOIN p ON sizes.source IS NOT DISTINCT FROM p.source LEFT JOIN b ON sizes.source IS NOT DISTINCT FROM b.source
"""
