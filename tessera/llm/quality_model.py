"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network with calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import held_out, training_sample
from tessera.llm.wordhash import mix, text_buffer, words
from tessera.runtime import python_workers, slices

_U = np.uint64
#: Word buckets, vector length, and neighbours on each side that make a word's context.
BUCKETS, WIDTH, NEAR = 4096, 48, 2


def _shape_table() -> np.ndarray:
    """Bytes as written-form classes: capitals, small letters, digits and non-ASCII letters stand for one each, signs for themselves."""
    t = np.arange(1, 257, dtype=np.uint16)
    t[65:91], t[97:123], t[48:58], t[128:] = 65, 97, 48, 97
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(1, 257, dtype=np.uint16)
    t[65:91] += 32
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, word, first): for each word the bucket of its written form and of the word itself.

    The form has a word's last signs, the kind of its first letters, and whether the
    word is the one before or stands among the last few, as repetition is part of how a
    text is written.  The word's bucket is the hash of the lower-cased word.
    """
    data, offsets = text_buffer(column)
    start, end, low, first = words(data, offsets, _lower_table())
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    shape = _shape_table()
    text_of = np.repeat(np.arange(len(column)), np.diff(first))
    begin, size = start, end - start
    form = _U(0)
    for k in (0, 1):
        form = form * _U(257) + shape[data[np.minimum(begin + k, end - 1)]].astype(_U)
    for k in (1, 2, 3):
        form = form * _U(257) + shape[data[np.maximum(end - k, begin)]].astype(_U)
    again = np.zeros(len(low), np.int64)
    for k in range(1, 9):
        same = np.zeros(len(low), bool)
        same[k:] = (low[k:] == low[:-k]) & (text_of[k:] == text_of[:-k])
        again = np.where((again == 0) & same, 1 if k == 1 else 2, again)
    form = mix(form * _U(4) + again.astype(_U) + _U(1 << 60) + (np.minimum(size, 24) // 8).astype(_U) * _U(1 << 56))
    half = _U(BUCKETS // 2)
    return (form % half).astype(np.int64), (low % half + half).astype(np.int64), first


def _index_vectors(seed: int = 11, nonzero: int = 6) -> np.ndarray:
    """A sparse ternary index vector for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, WIDTH))
    for row in out:
        at = rng.choice(WIDTH, nonzero, replace=False)
        row[at] = rng.choice([-1.0, 1.0], nonzero)
    return out


def _contexts(batches):
    """Partial sums of context vectors, one row for each task: each word gets the index vectors of its neighbours and of its own form."""
    index = _index_vectors()
    sums = np.zeros((BUCKETS, WIDTH))
    for batch in slices(batches):
        form, word, first = word_buckets(batch.column("text"))
        text_of = np.repeat(np.arange(len(batch)), np.diff(first))
        pairs = [form * BUCKETS + word, word * BUCKETS + form]
        for k in range(1, NEAR + 1):
            same = text_of[k:] == text_of[:-k]
            for a, b in ((form, form), (word, form), (form, word)):
                pairs += [(a[k:] * BUCKETS + b[:-k])[same], (a[:-k] * BUCKETS + b[k:])[same]]
        both, n = np.unique(np.concatenate(pairs), return_counts=True)
        np.add.at(sums, both // BUCKETS, n[:, None] * index[both % BUCKETS])
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Unit context vectors plus the bucket's own index vector; the driver adds up BUCKETS * WIDTH numbers for each of the sample's few tasks."""
    sums = np.zeros((BUCKETS, WIDTH))
    for row in sample.coalesce(8).mapInArrow(_contexts, "sums binary").toLocalIterator():
        sums += np.frombuffer(row["sums"]).reshape(BUCKETS, WIDTH)
    sums -= sums.sum(axis=0) * (np.abs(sums).sum(axis=1, keepdims=True) / max(1e-9, np.abs(sums).sum()))
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    own = _index_vectors()
    return np.hstack([np.where(norm > 0, sums / np.maximum(norm, 1e-9), 0.0), own / np.linalg.norm(own, axis=1, keepdims=True)])


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A vector for each text: mean of its words' vectors, the same with square-root shares (so rare forms show), and its length."""
    form, word, first = word_buckets(column)
    out = np.zeros((len(column), 2 * vectors.shape[1] + 1))
    half = BUCKETS // 2
    for i in range(len(column)):
        a, z = first[i], first[i + 1]
        if z > a:
            f = np.bincount(form[a:z], minlength=half) / (z - a)
            w = np.bincount(word[a:z] - half, minlength=half) / (z - a)
            share = np.concatenate([f, w])
            at = np.flatnonzero(share)
            v = vectors[at]
            out[i, : v.shape[1]] = share[at] @ v
            root = np.where(at < half, np.sqrt(share[at]), 0.0)
            out[i, v.shape[1] : -1] = root @ v
            out[i, -1] = np.log1p(z - a)
    return out


def _pooled(model):
    def run(batches):
        vectors = model.value
        for batch in slices(batches):
            x = pool(batch.column("text"), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    return run


class Network:
    """Two layers (tanh, sigmoid) in numpy, trained by Adam; probabilities are calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, epochs: int = 120, seed: int = 1):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5)
        check, train = order[:cut], order[cut:]
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        t = 0
        for _ in range(epochs):
            rng.shuffle(train)
            for lo in range(0, len(train), 128):
                b = train[lo : lo + 128]
                h = np.tanh(x[b] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[b]) * weight[b] / len(b)
                back = np.outer(d, p[2]) * (1 - h**2)
                grads = [x[b].T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        z = self._logit(x[check])
        losses = {}
        for temperature in np.exp(np.linspace(-1.5, 2.5, 41)):
            q = np.clip(1 / (1 + np.exp(-np.clip(z / temperature, -30, 30))), 1e-6, 1 - 1e-6)
            losses[temperature] = -(weight[check] * np.where(y[check] == 1, np.log(q), np.log(1 - q))).mean()
        self.temperature = float(min(losses, key=losses.get))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(model):
    def run(batches):
        vectors, network, prior = model.value
        for batch in slices(batches):
            x = pool(batch.column("text"), vectors)
            s = network.probability(x) if network is not None else np.full(len(batch), 0.5)
            s = np.where(x[:, -1] > 0, s, prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(s, 6))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, positives: int = 3000, negatives: int = 3000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), learnt from labels (doc_id, quality).

    Word vectors, network and temperature are fitted on at most `positives` +
    `negatives` labelled rows whose crc32 mod 4 isn't 2, weighed to the share of
    positives among all such rows.  Scoring is one narrow pass over whole texts:
    bucket counts times the BUCKETS-row vector table, then the network.  Null or
    empty texts get the share of positives (0.5 without labels); so does every text
    if only one class has labels.
    """
    spark = docs.sparkSession
    python_workers(spark)
    sample, share = training_sample(docs, labels, "quality", 4, 2, positives, negatives)
    vectors = word_vectors(sample)
    rows = sample.mapInArrow(_pooled(spark.sparkContext.broadcast(vectors)), "y int, x array<double>").toPandas()  # positives + negatives rows at most
    y = rows["y"].to_numpy(dtype=float)
    network = None
    if len(set(y.tolist())) == 2:
        weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
        order = np.lexsort(np.array(rows["x"].tolist()).T[:3])
        network = Network(np.array(rows["x"].tolist())[order], y[order], weight[order])
    else:
        share = 0.5
    model = spark.sparkContext.broadcast((vectors, network, share))
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    scored = source.mapInArrow(_score(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
