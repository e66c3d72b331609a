"""Rules against plain Python, and the classifier's accuracy and calibration on rows that it hasn't seen."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leadweave.llm import quality, sampling


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


TEXTS = [None, "", " \n \t", "a b c a b c d", "x\ny\nx\n\n \n \nx \n", "é| ü# <>&%$*", "a a a a", "same line\nsame line\nsame line", "\U0001f600\U0001f600 b", "a b c\n" * 30, "one " * 60, "x " * 20000 + "y"]


def random_texts(rng, n):
    return [" ".join(rng.choice(["a", "b", "é", "c|", "\n", "d\ne", "f#"]) for _ in range(rng.randrange(90))) for _ in range(n)]


def test_rule_counts():
    texts = TEXTS + random_texts(random.Random(1), 300)
    got = quality.rule_counts(pa.array(texts))
    assert list(zip(*(got[c].tolist() for c in quality.COUNTS))) == [counts(t) for t in texts]
    assert {k: len(v) for k, v in quality.rule_counts(pa.array([], pa.string())).items()} == dict.fromkeys(quality.COUNTS, 0)


def test_slices_of_long_texts_score_alike(monkeypatch):
    model = quality.Classifier(np.random.default_rng(2).standard_normal(1 << quality.PLACE_BITS).astype(np.float32), 0.5)
    texts = pa.array(TEXTS + random_texts(random.Random(2), 20))
    whole = model.logits(texts)
    monkeypatch.setattr(quality, "SLICE", 7)
    assert np.allclose(model.logits(texts), whole, atol=1e-5)


def corpus(rng, n):
    """Texts and labels: poor ones are shouted or full of symbols."""
    out = []
    for i in range(n):
        w = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(60, 150))]
        good = int(rng.random() < 0.8)
        if not good:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [x + rng.choice(["###", "$$$"]) for x in w]
        out.append((" ".join(w), good if rng.random() > 0.02 else 1 - good))
    return out


def test_held_out_accuracy_and_calibration(spark):
    rng = random.Random(4)
    rows = corpus(rng, 1500)
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows) if i < 1000], "doc_id long, quality int")
    model = quality.train(d, labels)
    p = model.probabilities(pa.array([t for t, _ in rows[1000:]]))
    y = np.array([g for _, g in rows[1000:]])
    assert ((p >= 0.5) == y).mean() > 0.95
    assert abs(p.mean() - y.mean()) < 0.05 and ((p - y) ** 2).mean() < 0.05
    again = quality.train(d.orderBy(F.rand(1)), labels)
    assert np.array_equal(again.weights, model.weights) and (again.scale, again.shift) == (model.scale, model.shift)


def test_query_and_odd_tables(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id " * 40), (3, "again " * 3), (3, "again " * 3)]
    d = spark.createDataFrame([(i, t, 0.5, "k") for i, t in rows], "doc_id long, text string, probability double, kept string")
    labels = "doc_id long, quality int, toxic int"
    d.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (5, 1, 0), (7, 1, 0), (99, 0, 1)], labels).write.parquet(f"{tmp_path}/a/labels.parquet")
    got = quality.op11_quality(spark, f"{tmp_path}/a").collect()
    want = collections.Counter((i, *counts(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= quality.LEAST_PROBABILITY) and 0 <= r.probability <= 1
    for name, docs, known in (("b", [], []), ("c", [(1, "some text")], []), ("d", [], [(1, 1, 0)])):
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(known, labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert quality.op11_quality(spark, f"{tmp_path}/{name}").count() == len(docs)


def test_sample_is_bounded_in_rows_and_bytes(spark):
    """One id on most rows takes no more than its share, and long texts are bounded."""
    d = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(3000).filter("id = 7 OR id >= 2500").select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    rows = sampling.labelled_sample(d, labels, 50, 1 << 20)
    assert 50 < rows.num_rows <= 100 and rows.num_rows == len(set(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text")))))
    assert sampling.labelled_sample(d.orderBy(F.rand(3)), labels, 50, 1 << 20).equals(rows)
    few = sampling.labelled_sample(d, labels, 50, 200)
    assert all(sum(len(t) for t, g in zip(few.column("text").to_pylist(), few.column("label").to_pylist()) if g == k) <= 200 for k in (0, 1)) and few.num_rows
    assert sampling.labelled_sample(d.limit(0), labels, 50, 200).num_rows == 0 and sampling.labelled_sample(d, labels.limit(0), 50, 200).num_rows == 0
