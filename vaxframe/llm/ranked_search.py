"""Ranked lexical search over hashed max-sketches.

Index: a stored row per document with its text and a sketch. Every distinct term falls into one of the sketch's
coordinates by hash, and a coordinate keeps the largest impact that falls into it. Within one document an impact
grows with the term's count, so the largest count is kept (255: that or more) and is turned into an impact once
the corpus's totals are known. The sketch has SLOTS coordinates a distinct term, so long texts have wide ones. Each
task also writes the document counts of its terms, which a search sums for the terms that it asks for.

Search, in bounded blocks of items: one batched lookup of all terms of a block in a document's sketch gives an
upper bound of its score for every item (a coordinate is at least the impact of each term in it).

1. Each item's documents with the highest bounds are scored exactly; their TOP-th score is the item's floor.
2. Documents whose bound reaches the floor are scored from their texts, highest bounds first, and the floor of the
   task rises until the next bound is below it.

What is left out has a bound below TOP exact scores, so the answer is exact. Terms are held as 64-bit fingerprints.

Defined results: null and empty texts have no terms and are never found; repeated rows each count; among equal scores
the smaller doc_id comes first, a null doc_id last; an item without terms, or whose terms no document holds, has no
rows; items of equal id are ranked apart; empty tables give no rows. Columns other than doc_id, item_id and text are
unused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaxframe.llm import words as w
from vaxframe.sources.scratch import stage

TOP = 10
#: Coordinates of a sketch for each distinct term (rounded up to a power of two).
SLOTS = 4
#: Text bytes and items of a block of the queries; text bytes that a task indexes at a time.
BLOCK_BYTES, BLOCK_ITEMS, CHUNK_BYTES = 1 << 18, 1024, 1 << 20
#: Distinct terms that a task counts before it writes their counts.
COUNTED_TERMS = 1 << 19
#: Cells of a lookup table that a task holds at a time, and documents of an item that it scores before it looks at the floor again.
CELLS, STEP = 1 << 20, 32
#: A term's share of the score, before its weight, is below this.
LARGEST = 1_000_000
#: Partial lists of an item are cut within lanes first.
LANES = 64

INDEX = "uid long, doc_id long, n_terms long, text string, sketch binary, term long, docs long"
FOUND = "item int, uid long, doc_id long, score long"


class Counts:
    """The distinct terms of a chunk's documents with their counts, ordered by document and term."""

    def __init__(self, texts: pa.Array):
        flat, bounds = w.flat_words(texts, w.ALNUM_LOWER)
        coded = flat.dictionary_encode()
        self.terms = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.length = np.diff(bounds)
        self.base = max(1, len(self.terms))
        owner = np.repeat(np.arange(len(self.length)), self.length)
        self.keys, self.tf = np.unique(owner * self.base + coded.indices.to_numpy(), return_counts=True)
        self.owner, self.code = self.keys // self.base, self.keys % self.base

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """All sketches one after another, and where each document's begins."""
        distinct = np.bincount(self.owner, minlength=len(self.length))
        width = np.where(distinct > 0, 1 << np.ceil(np.log2(np.maximum(SLOTS * distinct, 1))).astype(np.int64), 0)
        ends = np.concatenate([[0], np.cumsum(width)])
        place = ends[:-1][self.owner] + (self.terms[self.code] & (width[self.owner] - 1).astype(np.uint64)).astype(np.int64)
        order = np.argsort(self.tf, kind="stable")
        out = np.zeros(int(ends[-1]), np.uint8)
        out[place[order]] = np.minimum(self.tf[order], 255)  # the largest of a coordinate is written last
        return out, ends

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms in this chunk, -1 for others."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        order = np.argsort(self.terms)
        at = order[np.minimum(np.searchsorted(self.terms, terms, sorter=order), len(order) - 1)]
        return np.where(self.terms[at] == terms, at, -1)


def _index_rows(batches):
    task = TaskContext.get()
    uid, pending, size = (task.partitionId() if task else 0) << 33, [], 0

    def counted():
        every = np.concatenate([t for t, _ in pending])
        distinct, back = np.unique(every, return_inverse=True)
        docs = np.bincount(back, np.concatenate([n for _, n in pending])).astype(np.int64)
        none = [pa.nulls(len(distinct), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
        table = pa.table([*none, pa.array(distinct.view(np.int64)), pa.array(docs)], names=["uid", "doc_id", "n_terms", "text", "sketch", "term", "docs"])
        yield from table.to_batches(max_chunksize=100_000)

    for batch in w.chunks(batches, max_bytes=CHUNK_BYTES):
        counts = Counts(batch.column("text"))
        cells, ends = counts.sketches()
        n = batch.num_rows
        sketch = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(cells)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(uid, uid + n)), batch.column("doc_id").cast(pa.int64()), pa.array(counts.length.astype(np.int64)), batch.column("text").cast(pa.string()),
             sketch.cast(pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            names=["uid", "doc_id", "n_terms", "text", "sketch", "term", "docs"])
        uid += n
        pending.append((counts.terms, np.bincount(counts.code, minlength=len(counts.terms))))
        size += len(counts.terms)
        if size > COUNTED_TERMS:
            yield from counted()
            pending, size = [], 0
    if size:
        yield from counted()


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of (doc_id, text): a row per document, and rows of (term, docs) that sum to the terms' document counts."""
    return stage(docs.select("doc_id", "text").mapInArrow(_index_rows, INDEX), "search-index")


class Block:
    """A block of items: their distinct terms, the terms' weights, and each item's run of term numbers."""

    def __init__(self, texts: list[str | None]):
        counts = Counts(pa.array(texts, pa.large_string()))
        self.terms, self.item, self.of = counts.terms, counts.owner, counts.code
        self.starts = np.searchsorted(self.item, np.arange(len(texts) + 1))
        self.weights = np.zeros(len(self.terms), np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, docs: dict[int, int], n_docs: int, n_terms: int) -> None:
        """Takes the corpus's totals and the document counts of the terms, by fingerprint."""
        held = [docs.get(t, 0) for t in self.terms.view(np.int64).tolist()]
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in held], np.int64)
        self.n_docs, self.n_terms = n_docs, n_terms

    def slowness(self, length: np.ndarray) -> np.ndarray:
        """How much a document of that many terms damps its counts."""
        return 10 + (90 * length.astype(np.int64) * self.n_docs) // self.n_terms

    def summed(self, shares: np.ndarray) -> np.ndarray:
        """Sums over each item's terms of (documents, terms) weighted shares."""
        full = np.flatnonzero(np.diff(self.starts))
        out = np.zeros((len(shares), len(self.starts) - 1), np.int64)
        if len(full):
            out[:, full] = np.add.reduceat(shares[:, self.of], self.starts[full], axis=1)
        return out

    def bounds(self, cells: np.ndarray, begin: np.ndarray, width: np.ndarray, slow: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of some documents (with terms) for all items."""
        look = cells[begin[:, None] + (self.terms[None, :] & (width - 1).astype(np.uint64)[:, None]).astype(np.int64)]
        row, col = np.nonzero(look)
        tf = look[row, col].astype(np.int64)
        shares = np.zeros(look.shape, np.int64)
        shares[row, col] = self.weights[col] * np.where(tf == 255, LARGEST, share(tf, slow[row]))
        return self.summed(shares)

    def scores(self, counts: Counts, doc: np.ndarray, item: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a document of the chunk and an item."""
        runs = self.starts[item + 1] - self.starts[item]
        term = self.of[w.ragged(self.starts[item], runs)]
        pair = np.repeat(np.arange(len(doc)), runs)
        key = doc[pair] * counts.base + numbers[term]
        at = np.minimum(np.searchsorted(counts.keys, key), len(counts.keys) - 1)
        held = (numbers[term] >= 0) & (counts.keys[at] == key)
        pair, term, at = pair[held], term[held], at[held]
        out = np.zeros(len(doc), np.int64)
        np.add.at(out, pair, self.weights[term] * share(counts.tf[at], self.slowness(counts.length)[doc[pair]]))
        return out


def share(tf: np.ndarray, slow: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * slow)


def _slabs(batches, block: Block):
    """(batch, its rows with terms, their bounds) in parts of at most CELLS lookups."""
    step = max(1, CELLS // max(1, len(block.of)))
    for batch in batches:
        length = batch.column("n_terms").to_numpy()
        sketch = batch.column("sketch").cast(pa.large_binary())
        ends = np.frombuffer(sketch.buffers()[1], np.int64)[sketch.offset : sketch.offset + batch.num_rows + 1]
        cells = np.frombuffer(sketch.buffers()[2], np.uint8) if sketch.buffers()[2] else np.empty(0, np.uint8)
        rows = np.flatnonzero(length > 0)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield batch, part, block.bounds(cells, ends[part], np.diff(ends)[part], block.slowness(length[part]))


class Best:
    """The TOP rows of each item so far, and the score that a further row must reach."""

    def __init__(self, floors: np.ndarray):
        self.floors = np.maximum(floors, 1)
        self.rows: list[list[tuple]] = [[] for _ in floors]

    def add(self, item: int, rows: list[tuple]) -> None:
        """rows: (-score, doc_id is null, doc_id or 0, uid)."""
        if rows := [x for x in rows if -x[0] >= self.floors[item]]:
            self.rows[item] = sorted(self.rows[item] + rows)[:TOP]
            if len(self.rows[item]) == TOP:
                self.floors[item] = max(self.floors[item], -self.rows[item][-1][0])

    def batches(self):
        rows = [(item, uid, None if none else doc, -score) for item, found in enumerate(self.rows) for score, none, doc, uid in found]
        item, uid, doc, score = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), *(pa.array(x, pa.int64()) for x in (uid, doc, score))], names=["item", "uid", "doc_id", "score"])


def _highest_bounds(shared):
    """Of each item, the TOP documents of the task with the highest bounds (as score)."""

    def run(batches):
        block = shared.value
        best = Best(np.zeros(len(block.starts) - 1, np.int64))
        for batch, rows, bounds in _slabs(batches, block):
            uid = batch.column("uid").to_numpy()[rows]
            doc, item = np.nonzero(bounds >= best.floors)
            order = np.lexsort((-bounds[doc, item], item))
            doc, item = doc[order], item[order]
            first = np.searchsorted(item, np.arange(len(best.rows) + 1))
            for i in np.flatnonzero(np.diff(first)):
                top = doc[first[i] : min(first[i] + TOP, first[i + 1])]
                best.add(i, [(-b, 0, u, u) for b, u in zip(bounds[top, i].tolist(), uid[top].tolist(), strict=True)])
        yield from best.batches()

    return run


def _exact_scores(shared, floors: np.ndarray):
    """Of each item, the TOP documents of the task with scores at or above its floor, scored from the highest bound down."""

    def run(batches):
        block = shared.value
        best = Best(floors)
        for batch, rows, bounds in _slabs(batches, block):
            doc, item = np.nonzero(bounds >= best.floors)
            if not len(doc):
                continue
            used, local = np.unique(doc, return_inverse=True)
            counts = Counts(batch.column("text").take(pa.array(rows[used])))
            numbers = counts.numbers(block.terms)
            ids = batch.column("doc_id").take(pa.array(rows[used])).to_pylist()
            uids = batch.column("uid").to_numpy()[rows[used]].tolist()
            bound = bounds[doc, item]
            order = np.lexsort((-bound, item))
            local, item, bound = local[order], item[order], bound[order]
            turn = (np.arange(len(item)) - np.searchsorted(item, item)) // STEP
            for step in range(int(turn.max()) + 1):
                now = np.flatnonzero((turn == step) & (bound >= best.floors[item]))
                if not len(now):
                    break
                scores = block.scores(counts, local[now], item[now], numbers)
                first = np.searchsorted(item[now], np.arange(len(best.rows) + 1))
                for i in np.flatnonzero(np.diff(first)):
                    own = slice(first[i], first[i + 1])
                    best.add(i, [(-s, ids[d] is None, ids[d] or 0, uids[d]) for s, d in zip(scores[own].tolist(), local[now][own].tolist(), strict=True)])
        yield from best.batches()

    return run


def _top(rows: DataFrame) -> DataFrame:
    """The TOP rows of each item with their rank: first within lanes, so that no task sorts what all tasks found for one item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("uid")]
    lanes = rows.withColumn("lane", F.pmod("uid", F.lit(LANES)))
    part = lanes.withColumn("place", F.row_number().over(Window.partitionBy("item", "lane").orderBy(*order))).where(F.col("place") <= TOP)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= TOP).drop("lane", "place")


def _blocks(index: DataFrame, items: DataFrame):
    """(item ids, block) of all items with text, in blocks of about BLOCK_BYTES and BLOCK_ITEMS."""
    spark, docs = index.sparkSession, index.where("uid is not null")
    n_docs, n_terms = docs.agg(F.count_if(F.col("n_terms") > 0), F.sum("n_terms")).first()
    given = items.selectExpr("item_id", "text").where("text <> ''")
    size, count = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(-(-size // BLOCK_BYTES), -(-count // BLOCK_ITEMS)) if n_terms else 0
    for number in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()  # about BLOCK_BYTES
        block = Block([r.text for r in rows])
        terms = spark.createDataFrame(pa.table({"term": block.terms.view(np.int64)}))
        held = index.where("term is not null").join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("docs").alias("docs"))
        block.weigh({r.term: r.docs for r in held.collect()}, n_docs, n_terms)  # at most the block's terms
        yield [r.item_id for r in rows], block


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents with a score above 0 for each item."""
    spark, index = docs.sparkSession, build_index(docs)
    stored, parts = index.where("uid is not null"), []
    for ids, block in _blocks(index, items):
        shared, n = spark.sparkContext.broadcast(block), len(ids)
        likely = _top(stored.select("uid", "n_terms", "sketch").mapInArrow(_highest_bounds(shared), "item int, uid long, doc_id long, score long"))
        uids = stage(likely.select("uid").distinct(), "likely")  # at most TOP rows an item of the block
        columns = ("uid", "doc_id", "n_terms", "text", "sketch")
        first = stored.select(*columns).join(F.broadcast(uids), "uid", "left_semi").mapInArrow(_exact_scores(shared, np.zeros(n, np.int64)), FOUND)
        floors = np.zeros(n, np.int64)
        for r in _top(first).where(F.col("rank") == TOP).collect():
            floors[r.item] = r.score
        names = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _top(stored.select(*columns).mapInArrow(_exact_scores(shared, floors), FOUND))
        parts.append(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not parts:
        return items.selectExpr("item_id", "cast(0 as int) as rank", "0L as doc_id", "0L as score").where("false")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
