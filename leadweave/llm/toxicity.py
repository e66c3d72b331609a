"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input is an embedding of the word, if training saw it often enough, and the mean embedding of its
character 3- and 4-grams, edges included. A text is read in overlapping windows of words; both directions' states
are pooled by attention, and a text's score is that of its highest window. Training learns from a bounded sample
of labelled documents: of a toxic document, from the window that looks most toxic so far; of others, from windows
drawn at random and those that look most toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.sampling import labelled_sample
from leadweave.llm.words import BYTE_VALUE, GAMMA, _LOWER, _WORD, chunks, mix64, run_hashes, runs, text_bytes

#: Labelled documents of each class that are drawn for training, by a threshold on the hash of their ids.
TRAIN_DOCUMENTS = 1200
#: Bytes of text of each class that the network is fitted on at most.
TRAIN_BYTES = 8 << 20
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, CHAR_BUCKETS = 10, 10, 10, 1 << 13
#: Training documents that a word of the vocabulary occurs in at least.
LEAST_DOCUMENTS = 3
EPOCHS, ROUNDS, BATCH, RATE = 5, 3, 256, 5e-3
#: Steps of each round at least, so that few documents are learnt, too.
LEAST_STEPS = 100
#: Windows that are run at once.
SLICE = 2048
TOXIC = 0.7


class _Forms:
    """The different words of a batch with their character n-grams, and which stands where."""

    def __init__(self, texts: pa.Array):
        raw, offsets = text_bytes(texts)
        starts, ends, self.first = runs(_WORD[raw], offsets)
        raw = _LOWER[raw]
        hashes = run_hashes(BYTE_VALUE[raw], starts, ends)
        self.keys, at, self.form = np.unique(hashes, return_index=True, return_inverse=True)
        length = ends[at] - starts[at] + 2
        total = np.concatenate([[0], np.cumsum(length)])
        place = np.arange(total[-1]) - np.repeat(total[:-1], length)
        edge = (place == 0) | (place == np.repeat(length, length) - 1)
        symbols = np.where(edge, 32, raw[np.where(edge, 0, np.repeat(starts[at], length) + place - 1)] if len(raw) else 32).astype(np.uint64)
        grams, owners = [], []
        for n in (3, 4):
            made = np.maximum(length - n + 1, 0)
            begin = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(total[:-1], made)
            code = np.full(len(begin), n, dtype=np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + symbols[begin + k]
            grams.append((mix64(code * GAMMA) % np.uint64(CHAR_BUCKETS)).astype(np.int64))
            owners.append(np.repeat(np.arange(len(length)), made))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.grams, self.owner = np.concatenate(grams)[order], owner[order]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows, WINDOW) of forms, -1 beyond the text's end, and the row of each window; none for a row without words."""
        many = np.diff(self.first)
        made = np.where(many > 0, np.maximum(-(-(many - WINDOW) // STRIDE), 0) + 1, 0)
        row = np.repeat(np.arange(len(many)), made)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made)) * STRIDE
        at = start[:, None] + np.arange(WINDOW)
        inside = at < many[row][:, None]
        forms = self.form[np.where(inside, self.first[:-1][row][:, None] + at, 0)] if len(self.form) else np.zeros(at.shape, dtype=np.int64)
        return np.where(inside, forms, -1), row


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and the two passes. Inputs are word inputs (n, WORD_DIM + CHAR_DIM) and windows of their numbers."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary  # sorted hashes; the embedding's last row is for unknown words
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "words": np.zeros((len(vocabulary) + 1, WORD_DIM), np.float32),
            "chars": (rng.standard_normal((CHAR_BUCKETS, CHAR_DIM)) * 0.1).astype(np.float32),
            "pool": draw(2 * h, h), "query": draw(h), "out": draw(2 * h), "bias": np.full(1, -1.0, np.float32),
        }
        for side in "fb":
            self.p |= {f"W{side}": draw(d, 3 * h), f"U{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}

    def word_rows(self, keys: np.ndarray) -> np.ndarray:
        """The embedding's row of each word hash."""
        last = len(self.vocabulary)
        if not last:
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, keys), last - 1)
        return np.where(self.vocabulary[at] == keys, at, last)

    def inputs(self, words: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The inputs of words, given their embedding rows and n-grams sorted by owner."""
        first = np.searchsorted(owner, np.arange(len(words)))
        count = np.diff(np.append(first, len(owner)))
        sums = np.zeros((len(words), CHAR_DIM), np.float32)
        has = np.flatnonzero(count)
        if len(has):
            sums[has] = np.add.reduceat(self.p["chars"][grams], first[has], axis=0) / count[has, None]
        return np.concatenate([self.p["words"][words], sums], axis=1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (WINDOW, n, HIDDEN) of one direction over projected inputs (WINDOW, n, 3 * HIDDEN)."""
        h, u = HIDDEN, self.p[f"U{side}"]
        states = np.zeros((WINDOW, x.shape[1], h), x.dtype)
        s = np.zeros_like(states[0])
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            g = s @ u
            zr = _sigmoid(x[t, :, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * g[:, 2 * h :])
            new = n + z * (s - n)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, s, z, r, n, g[:, 2 * h :], m))
            s = np.where(m, new, s)
            states[t] = s
        return states

    def forward(self, inputs: np.ndarray, windows: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of the windows."""
        ids, mask = np.maximum(windows.T, 0), windows.T >= 0
        sides = []
        for side in "fb":
            projected = inputs @ self.p[f"W{side}"] + self.p[f"c{side}"]
            keep = [] if trace is not None else None
            sides.append(self._run(side, projected[ids], mask, keep))
            if trace is not None:
                trace[side] = keep
        states = np.concatenate(sides, axis=2)
        a = np.tanh(states @ self.p["pool"])
        e = np.where(mask, a @ self.p["query"], -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        if trace is not None:
            trace.update(ids=ids, mask=mask, states=states, a=a, w=w, pooled=pooled)
        return pooled @ self.p["out"] + self.p["bias"]

    def gradients(self, inputs: np.ndarray, windows: np.ndarray, labels: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean cross entropy, by parameter, and by input."""
        trace: dict = {}
        logits = self.forward(inputs, windows, trace)
        h, grad = HIDDEN, {}
        d = ((_sigmoid(logits) - labels) / len(labels)).astype(logits.dtype)
        states, a, w, mask = trace["states"], trace["a"], trace["w"], trace["mask"]
        grad["bias"], grad["out"] = d.sum(keepdims=True), trace["pooled"].T @ d
        dpool = d[:, None] * self.p["out"]
        dstates = w[:, :, None] * dpool
        dw = np.einsum("tnh,nh->tn", states, dpool)
        de = np.where(mask, w * (dw - (w * dw).sum(axis=0)), 0).astype(states.dtype)
        grad["query"] = np.einsum("tn,tnh->h", de, a)
        da = de[:, :, None] * self.p["query"] * (1 - a * a)
        grad["pool"] = np.einsum("tni,tnj->ij", states, da)
        dstates = dstates + da @ self.p["pool"].T
        dinputs = np.zeros_like(inputs)
        for k, side in enumerate("fb"):
            u, dx, du, ds = self.p[f"U{side}"], np.zeros((*mask.shape, 3 * h), states.dtype), np.zeros((h, 3 * h), states.dtype), 0.0
            for t, s, z, r, n, gn, m in reversed(trace[side]):
                ds = ds + dstates[t, :, k * h : (k + 1) * h]
                dnew = np.where(m, ds, 0)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (s - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                du += s.T @ dg
                ds = np.where(m, dnew * z, ds) + dg @ u.T
            flat = np.zeros((len(inputs), 3 * h), states.dtype)
            np.add.at(flat, trace["ids"].ravel(), dx.reshape(-1, 3 * h))
            grad[f"U{side}"], grad[f"c{side}"] = du, dx.sum(axis=(0, 1))
            grad[f"W{side}"] = inputs.T @ flat
            dinputs += flat @ self.p[f"W{side}"].T
        return grad, dinputs

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text; a text without words scores as an empty window."""
        forms = _Forms(texts)
        out = np.full(len(texts), float(_sigmoid(self.p["bias"][0])))
        windows, row = forms.windows()
        if len(row):
            inputs = self.inputs(self.word_rows(forms.keys), forms.grams, forms.owner)
            logits = np.concatenate([self.forward(inputs, windows[i : i + SLICE]) for i in range(0, len(row), SLICE)])
            rows, at = np.unique(row, return_index=True)
            out[rows] = _sigmoid(np.maximum.reduceat(logits, at).astype(np.float64))
        return out


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    """Train on whole texts and their 0/1 labels."""
    rng = np.random.default_rng(seed)
    parts = []
    for chunk in chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(labels)], names=["text", "label"])])):
        forms = _Forms(chunk.column("text"))
        windows, row = forms.windows()
        parts.append((forms, windows, row, chunk.column("label").to_numpy()))
    # document counts of words, by class
    hashes, docs = [], []
    for forms, _, _, label in parts:
        owner = np.repeat(np.arange(len(label)), np.diff(forms.first))
        pair = np.unique(np.stack([forms.form, owner], axis=1), axis=0)
        hashes.append(forms.keys[pair[:, 0]])
        docs.append(label[pair[:, 1]])
    all_keys, at = np.unique(np.concatenate(hashes), return_inverse=True)
    toxic = np.bincount(at, weights=np.concatenate(docs), minlength=len(all_keys))
    count = np.bincount(at, minlength=len(all_keys))
    often = np.flatnonzero(count >= LEAST_DOCUMENTS)
    net = Network(all_keys[often])
    odds = np.append(np.log((toxic[often] + 0.5) / max(labels.sum(), 1)) - np.log((count[often] - toxic[often] + 0.5) / max((1 - labels).sum(), 1)), 0.0)
    net.p["words"][:, 0] = np.clip(odds, -2, 6) / 3
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0
    for turn in range(ROUNDS):
        chosen = []
        for k, (forms, windows, row, label) in enumerate(parts):
            if not len(row):
                continue
            if turn:
                inputs = net.inputs(net.word_rows(forms.keys), forms.grams, forms.owner)
                look = np.concatenate([net.forward(inputs, windows[i : i + SLICE]) for i in range(0, len(row), SLICE)])
            else:
                seen = odds[net.word_rows(forms.keys)]
                look = np.where(windows >= 0, seen[np.maximum(windows, 0)], -9).max(axis=1)
            order = np.lexsort((-look, row))
            top = order[np.append(True, np.diff(row[order]) > 0)]
            any_ = rng.permutation(len(row))
            any_ = any_[np.unique(row[any_], return_index=True)[1]]
            chosen += [(k, w, float(label[row[w]])) for w in top.tolist()] + [(k, w, 0.0) for w in any_.tolist() if label[row[w]] == 0]
        if not chosen:
            continue
        batch = min(BATCH, max(16, len(chosen) // 12))
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * batch // len(chosen)))):
            order = rng.permutation(len(chosen))
            for i in range(0, len(order), batch):
                steps += 1
                _step(net, parts, [chosen[j] for j in order[i : i + batch]], moments, steps, rng)
    return net


def _step(net: Network, parts: list, batch: list, moments: dict, steps: int, rng) -> None:
    """One Adam step over windows (part, window, label)."""
    words, grams, owner, windows, base = [], [], [], [], 0
    for k in sorted({b[0] for b in batch}):
        forms, all_windows = parts[k][:2]
        own = np.array([b[1] for b in batch if b[0] == k])
        some = all_windows[own]
        used, at = np.unique(some[some >= 0], return_inverse=True)
        local = np.full(some.shape, -1)
        local[some >= 0] = at + base
        first, last = np.searchsorted(forms.owner, used), np.searchsorted(forms.owner, used, side="right")
        many = last - first
        take = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        grams.append(forms.grams[take])
        owner.append(np.repeat(np.arange(len(used)) + base, many))
        words.append(net.word_rows(forms.keys[used]))
        windows.append(local)
        base += len(used)
    labels = np.concatenate([[b[2] for b in batch if b[0] == k] for k in sorted({b[0] for b in batch})])
    words, grams, owner, windows = (np.concatenate(x) for x in (words, grams, owner, windows))
    words = np.where(rng.random(len(words)) < 0.4, len(net.vocabulary), words)  # so that characters must tell, too
    grad, dinputs = net.gradients(net.inputs(words, grams, owner), windows, labels)
    count = np.bincount(owner, minlength=len(words))
    grad["words"], grad["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
    np.add.at(grad["words"], words, dinputs[:, :WORD_DIM])
    np.add.at(grad["chars"], grams, (dinputs[:, WORD_DIM:] / np.maximum(count, 1)[:, None])[owner])
    grad["words"][-1] = 0
    for k, g in grad.items():
        m, v = moments[k]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        net.p[k] -= (RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCUMENTS, class_bytes: int = TRAIN_BYTES) -> pa.Table:
    """doc_id, text, label of labelled rows whose crc32 of doc_id mod 3 isn't 1: at most per_class and class_bytes of each class.

    An id with several labels is toxic if one of them says so; null ids and labels teach nothing. Different texts of an
    id are rows to learn from, but take no more places than others (see labelled_sample).
    """
    known = labels.filter(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    return labelled_sample(docs, known, per_class, class_bytes)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCUMENTS, class_bytes: int = TRAIN_BYTES) -> Network:
    """Fit on training_rows, which come in the order of their ids, so that reruns agree."""
    rows = training_rows(docs, labels, per_class, class_bytes)
    if not rows.num_rows:
        return Network(np.zeros(0, np.uint64))
    return fit(rows.column("text").to_pylist(), rows.column("label").to_numpy().astype(np.float64))


def score_texts(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score: one row for each row of `docs`; whole texts of any length, nothing but the text is used.

    Null, empty and word-less texts get the score of an empty window. Without labelled rows the network stays as
    drawn. Rows of equal text score alike. Only doc_id and text are read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_texts(docs, train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))  # a null id is none of them
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
