"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

A token is a run of letters and digits or a run of other signs. Every vocabulary entry (tokens are hashed to BUCKETS
entries) has a sparse ternary index vector. The word vector of an entry is the sum of the index vectors of its neighbours
over all documents, centred and set to unit length, plus its own index vector. Word shapes and a mark for a word that
repeats the one before it are entries too. A document is the mean of its entries' vectors; a network with one hidden layer
gives a logit, which a temperature fitted on a part of the sample turns into a probability.

The classifier is fitted on a bounded sample: at most SAMPLE labelled documents, those least by a hash of doc_id, of the rows
outside the held-out fold (crc32 of doc_id as text, modulo 5, is 0). Word vectors need no label and are made from every row. Label, language, source and doc_id are no inputs. Sums
of index vectors are whole numbers, so the model does not depend on the order of tasks. The model (BUCKETS x DIM floats)
has a fixed size. Scoring is a pass over the rows without a shuffle.

Defined results: null and empty texts have no token and get the score of the zero vector; a doc_id with several labels
takes the majority (a tie is good); labels that are null or have no doc_id are left out, and rows without doc_id count as held out; without any label every score is 0.5; rows that repeat get
equal rows; an empty table gives an empty result; an input column named ``score`` is replaced. Texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read, settle

BUCKETS, DIM, ONES, REACH = 1 << 14, 32, 6, 2
SAMPLE = 6_000
FAN = 8
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4
CUT = 0.3
SHAPES = 9
REPEAT = BUCKETS + SHAPES
ENTRIES = REPEAT + 1

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


def shape(token: bytes) -> int:
    if token.isalnum() or any(b >= 0x80 for b in token):
        if token.isdigit():
            return 0
        if token.isupper():
            return 1 if len(token) == 1 else 2
        if token[:1].isupper():
            return 3
        return 4 if any(48 <= b < 58 for b in token) else 5
    if len(token) == 1:
        return 6
    return 7 if len(set(token)) == 1 else 8


class Entries(dict):
    """token -> entry and shape, made when first seen; emptied when it has grown large."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = x = zlib.crc32(token) % BUCKETS | shape(token) << 20
        return x

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall(text.encode("utf-8", "surrogatepass")) if text else []
        both = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return both & 0xFFFFF, both >> 20


def index_vectors(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((ENTRIES, DIM), dtype=np.int32)
    at = rng.permuted(np.tile(np.arange(DIM), (ENTRIES, 1)), axis=1)[:, :ONES]
    np.put_along_axis(out, at, np.where(np.arange(ONES) % 2, 1, -1)[None, :].repeat(ENTRIES, 0), axis=1)
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sums of the neighbours' index vectors over this task's texts."""
    # entry BUCKETS has no vector: it parts the texts
    index, entries = np.concatenate([index_vectors()[:BUCKETS], np.zeros((1, DIM))]).astype(np.int8), Entries()
    total, gap = np.zeros((BUCKETS + 1, DIM), dtype=np.int64), np.full(REACH, BUCKETS, dtype=np.uint16)
    held, size = [gap], 0

    def add() -> None:
        e = np.concatenate(held)
        own = index[e]
        near = np.zeros(own.shape, dtype=np.int8)
        for k in range(1, REACH + 1):
            near[:-k] += own[k:]
            near[k:] += own[:-k]
        order = np.argsort(e, kind="stable")
        word = e[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total[word[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)

    for batch in batches:
        for text in batch.column("text").to_pylist():
            e, _ = entries.of(text)
            held += [e.astype(np.uint16), gap]
            size += len(e)
            if size > 1 << 18:
                add()
                held, size = [gap], 0
    add()
    yield pa.RecordBatch.from_arrays([pa.array([total[:BUCKETS].tobytes()], pa.binary())], ["sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sum of this task's rows of sums."""
    total = np.zeros(BUCKETS * DIM, dtype=np.int64)
    for batch in batches:
        for x in batch.column("sums"):
            total += np.frombuffer(x.as_buffer(), dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def contexts(texts: DataFrame) -> np.ndarray:
    """The sums over all rows of texts(text). Tasks' sums (BUCKETS x DIM numbers each) are added in up to FAN tasks before the driver adds those."""
    parts = settle(texts.mapInArrow(_contexts, "sums binary"), "sums").coalesce(FAN).mapInArrow(_added, "sums binary")
    total = np.zeros((BUCKETS, DIM), dtype=np.int64)
    for r in parts.toLocalIterator():
        total += np.frombuffer(r["sums"], dtype=np.int64).reshape(BUCKETS, DIM)
    return total


def word_vectors(sums: np.ndarray) -> np.ndarray:
    index = index_vectors().astype(np.float64)
    c = sums.astype(np.float64)
    size = np.linalg.norm(c, axis=1, keepdims=True)
    c = np.divide(c, size, out=np.zeros_like(c), where=size > 0)
    c[size[:, 0] > 0] -= c[size[:, 0] > 0].mean(axis=0) if (size > 0).any() else 0
    index /= np.sqrt(ONES)
    index[:BUCKETS] += c
    return index.astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, entries: Entries) -> np.ndarray:
    e, s = entries.of(text)
    if not len(e):
        return np.zeros(DIM, dtype=np.float32)
    again = int((e[1:] == e[:-1]).sum())
    total = vectors[e].sum(axis=0) + np.bincount(s, minlength=SHAPES).astype(np.float32) @ vectors[BUCKETS:REPEAT] + again * vectors[REPEAT]
    return (total / len(e)).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sums go along the rows of weights one by one, so that a row's score does not depend on the rows beside it."""
        hidden = np.tanh(np.add.reduce(((x - self.mean) / self.scale)[:, :, None] * self.w1, axis=1) + self.b1)
        logit = np.add.reduce((hidden * self.w2).T, axis=0) + self.b2
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -40, 40)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 3) -> Model:
    """Adam on the cross-entropy of four fifths of the rows; the temperature is fitted on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) * 4 // 5)
    fit, rest = order[:cut], order[cut:] if len(x) > cut else order
    m = Model(vectors, x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6, rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - m.mean) / m.scale
    p = [m.w1, m.b1, m.w2, np.array(m.b2)]
    a, b, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
            back = d[:, None] * p[2][None, :] * (1 - h * h)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], d.sum()]
            t += 1
            for i, g in enumerate(grads):
                a[i] = 0.9 * a[i] + 0.1 * g
                b[i] = 0.999 * b[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (a[i] / (1 - 0.9**t)) / (np.sqrt(b[i] / (1 - 0.999**t)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3])
    logit = m.logit(x[rest])
    heats = np.geomspace(0.25, 8, 41)
    loss = [np.mean(np.logaddexp(0, -np.where(y[rest] > 0, logit, -logit) / h)) for h in heats]
    m.temperature = float(heats[int(np.argmin(loss))])
    return m


def held_out(key) -> F.Column:
    """Whether a row is kept from training; a null key, which no label has, is."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model | None:
    # of texts with one doc_id the least by its hash is learnt from, so that the model does not depend on the order of rows
    votes = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    # at most ``sample`` rows, so they may be broadcast
    chosen = settle(votes.orderBy(F.xxhash64(key), key).limit(sample), "chosen")
    rows = settle(docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key).groupBy(key, "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")), "sample")
    vectors = word_vectors(contexts(docs.select(F.col(text).alias("text"))))

    def pool(batches):
        entries = Entries()
        for b in batches:
            x = [pooled(t, vectors, entries).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("y"), pa.array(x, pa.binary())], ["k", "y", "x"])

    got = sorted((r["k"], r["y"], r["x"]) for r in rows.mapInArrow(pool, f"k {dict(rows.dtypes)[key]}, y int, x binary").collect())
    if not got:
        return None
    return train(vectors, np.stack([np.frombuffer(x, dtype=np.float32) for _, _, x in got]).astype(np.float64), np.array([y for _, y, _ in got], dtype=np.float64))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its ``score``, 0 to 1."""
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    docs = docs.drop("score")

    def run(batches):
        entries = Entries()
        for b in batches:
            texts = b.column(text).to_pylist()
            s = [np.zeros(0)]
            for at in range(0, len(texts), 512):
                s.append(model.score(np.stack([pooled(t, model.vectors, entries) for t in texts[at : at + 512]]).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(s), pa.float64())], [*b.schema.names, "score"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", score double")


def op4_quality_classifier(spark, sf_dir):
    """All documents scored by a model of the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
