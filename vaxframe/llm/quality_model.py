"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

1. Every token has a fixed sparse random index vector; the vector of a token is the sum of the index vectors
   of its neighbours over all documents. Tokens share BUCKETS hash buckets, so the table has a fixed size.
   A word gives its lower-case letters, its marks, and its shape as tokens of their own, and a word that
   repeats the one before gives a repeat token.
2. A document is the weighted mean and spread of its tokens' unit vectors; frequent tokens weigh less.
3. A network with one hidden layer learns labels from at most SAMPLE_ROWS labelled documents (the smallest
   by hash of their id), outside the held-out fifth; a fifth of those sets the temperature.

Defined results: null and empty texts have the zero vector and get its score; labels of null or of both
values for one document count by their larger value, null quality is no label; without labels every score is
0.5; a null doc_id is not held out. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaxframe.llm import blocks
from vaxframe.llm import words as w

BUCKETS, DIMS, NONZERO, REACH = 1 << 15, 32, 4, 2
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
SEED = 20_240_229
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 256, 0.003
POOL_BYTES, POOL_TOKENS = 1 << 20, 1 << 16

LETTERS = re.compile(r"[^\W_]+")
MARKS = re.compile(r"[\W_]+")
SAME = xxhash.xxh3_64_intdigest(b"\x00same") % BUCKETS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector's nonzero entries."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def _bucket(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % BUCKETS


@lru_cache(maxsize=1 << 16)
def _tokens_of(word: str) -> list[int]:
    plain = word.isalnum()
    letters = word if plain else "".join(LETTERS.findall(word))
    out = [_bucket(letters.lower())] if letters else []
    marks = "" if plain else "".join(MARKS.findall(word))
    if marks:
        out.append(_bucket("\x00marks" + marks))
    if len(letters) > 1 and letters == letters.upper() and letters != letters.lower():
        out.append(_bucket("\x00upper"))
    return out or [SAME]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token buckets of all documents of a chunk, and where each document's begin."""
    flat, bounds = w.flat_words(texts, w.SPACES)
    if not len(flat):
        return np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    spelled = [_tokens_of(x) for x in coded.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in spelled])
    every = np.array([t for x in spelled for t in x], np.int64)
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[bounds[:-1][bounds[:-1] < len(codes)]] = False
    count = sizes[codes] + same
    ends = np.cumsum(count)
    out = np.full(int(ends[-1]), SAME, np.int64)
    out[w.ragged(ends - count, sizes[codes])] = every[w.ragged((np.cumsum(sizes) - sizes)[codes], sizes[codes])]
    return out, np.concatenate([[0], ends])[bounds]


def _context_rows(batches):
    """The task's share of the context vectors and token counts."""
    places, signs = index_vectors()
    sums, counts = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64)
    for batch in w.chunks(batches):
        found, bounds = tokens(batch.column("text"))
        counts += np.bincount(found, minlength=BUCKETS)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for reach in range(1, REACH + 1):
            near = np.flatnonzero(owner[reach:] == owner[:-reach])
            a, b = found[near], found[near + reach]
            for k in range(NONZERO):
                sums += np.bincount(a * DIMS + places[b, k], signs[b, k], BUCKETS * DIMS)
                sums += np.bincount(b * DIMS + places[a, k], signs[a, k], BUCKETS * DIMS)
    yield from blocks.to_rows(np.concatenate([np.rint(sums).astype(np.int64), counts]), BUCKETS).to_batches(max_chunksize=8)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Weighted unit vectors of all buckets (BUCKETS x DIMS, 4 MB) from all documents."""
    total = blocks.total(docs.select("text").mapInArrow(_context_rows, "block long, counts binary"), BUCKETS * (DIMS + 1))
    vectors, counts = total[: BUCKETS * DIMS].reshape(BUCKETS, DIMS).astype(np.float64), total[BUCKETS * DIMS :]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)
    weight = 1e-2 / (1e-2 + counts / max(1, counts.sum()))
    return (vectors * weight[:, None]).astype(np.float32)


def pool(vectors: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Mean and spread of the token vectors of each document."""
    found, bounds = tokens(texts)
    sums, squares = np.zeros((len(bounds) - 1, DIMS)), np.zeros((len(bounds) - 1, DIMS))
    for doc, begin in enumerate(bounds[:-1]):
        for at in range(begin, bounds[doc + 1], POOL_TOKENS):
            part = vectors[found[at : min(at + POOL_TOKENS, bounds[doc + 1])]].astype(np.float64)
            sums[doc] += part.sum(0)
            squares[doc] += np.einsum("ij,ij->j", part, part)
    n = np.maximum(np.diff(bounds), 1)[:, None]
    mean = sums / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0))], axis=1)


class Network:
    """Two layers, trained with Adam on shuffled batches; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        check = rng.random(len(x)) < 0.2
        check &= len(x) >= 50
        self.mean, self.scale = x[~check].mean(0), x[~check].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        self.parts = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        learn, moments = np.flatnonzero(~check), [[np.zeros_like(p), np.zeros_like(p)] for p in self.parts]
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(learn)
            for at in range(0, len(learn), BATCH):
                rows, step = learn[at : at + BATCH], step + 1
                hidden = np.tanh(z[rows] @ self.parts[0] + self.parts[1])
                error = (_sigmoid(hidden @ self.parts[2] + self.parts[3]) - y[rows]) / len(rows)
                back = np.outer(error, self.parts[2]) * (1 - hidden * hidden)
                slopes = [z[rows].T @ back + 1e-4 * self.parts[0], back.sum(0), hidden.T @ error + 1e-4 * self.parts[2], np.array([error.sum()])]
                for part, (m, v), slope in zip(self.parts, moments, slopes, strict=True):
                    m += 0.1 * (slope - m)
                    v += 0.001 * (slope * slope - v)
                    part -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if check.any():
            logits, truth = self.logits(x[check]), y[check]
            grid = np.exp(np.linspace(np.log(0.3), np.log(5), 60))
            losses = [-np.mean(np.log(np.clip(np.where(truth == 1, _sigmoid(logits / t), 1 - _sigmoid(logits / t)), 1e-12, 1))) for t in grid]
            self.temperature = float(grid[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.parts[0] + self.parts[1])
        return hidden @ self.parts[2] + self.parts[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """The network, from a bounded sample of labelled documents; None without labels."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in w.chunks(batches, max_bytes=POOL_BYTES):
            pooled = pool(shared.value, batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in pooled], pa.binary()), "y": batch.column("y").cast(pa.int64())})

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y").mapInArrow(run, "x binary, y long").orderBy("x", "y").limit(2 * sample_rows).collect()
    if not rows:
        return None
    return Network(np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64), np.array([r.y for r in rows], np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, train(docs, labels, vectors, label)))

    def run(batches):
        table, network = shared.value
        for batch in w.chunks(batches, max_bytes=POOL_BYTES):
            pooled = pool(table, batch.column("text"))
            score = network.score(pooled) if network else np.full(len(pooled), 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": pc.fill_null(batch.column("held_out"), False), "score": pa.array(score)})

    scored = docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
