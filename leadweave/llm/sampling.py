"""A bounded sample of labelled texts, to fit a classifier on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.storage import materialise


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, text_bytes: int) -> pa.Table:
    """doc_id, text, label: at most `rows` texts of each label and `text_bytes` bytes of text of each label.

    labels: doc_id, label (an integer); one row an id. Ids are drawn by their hash, then the texts of these ids by
    the hash of id and text, so that one id with very many texts takes no more than the rest; equal texts of an id are
    one; an id without a text takes a place all the same. Texts are taken in that order while they fit in the bytes; a longer one is passed over. Null ids, labels
    and texts are left out. The rows come by id, then text, so that reruns agree.
    """
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    first = lambda df, *key: df.orderBy(F.xxhash64(*key), *key).limit(rows)
    kinds = sorted(r["label"] for r in labels.select("label").distinct().collect())  # classes are few
    picked = None
    for k in kinds:
        some = first(labels.filter(F.col("label") == k).select("doc_id", "label"), "doc_id")
        picked = some if picked is None else picked.unionByName(some)
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": pa.array([], pa.int64())})
    if picked is None:
        return empty
    picked = materialise(picked, "labelled-ids")  # rows * classes at most
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id").withColumn("text_id", F.xxhash64("text"))
    known = materialise(texts.groupBy("doc_id", "text_id", "label").agg(F.max(F.octet_length("text")).alias("bytes")), "labelled-texts")
    take = []
    for k in kinds:
        left = text_bytes
        for r in first(known.filter(F.col("label") == k), "doc_id", "text_id").collect():  # at most `rows`, without texts
            if r["bytes"] <= left:
                left -= r["bytes"]
                take.append((r["doc_id"], r["text_id"]))
    if not take:
        return empty
    wanted = docs.sparkSession.createDataFrame(take, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_id long")
    found = texts.join(F.broadcast(wanted), ["doc_id", "text_id"]).groupBy("doc_id", "text_id", "label").agg(F.first("text").alias("text"))
    return found.select("doc_id", "text", "label").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
