"""Benchmark decontamination with a positional inverted index of the training documents.

The index is a table of segments, each a bounded chunk of documents: its terms, and for each term the sorted
places (over the segment) at which it stands. The benchmark's word windows are looked up segment by segment:
the rarest term's places, shifted by its offset in the window, are the candidate starts, which are then
intersected with the shifted places of the other terms from rare to common.

The benchmark is taken in blocks of bounded size, so what is broadcast does not grow with it; a larger
benchmark means more passes over the index. Nothing is shuffled but one narrow row per document and block.

Defined results: null and empty texts have no words; an item with fewer words than a window is one window, an
item without words matches nothing; equal items and repeated rows each count; item ids may repeat and are
counted once; the words of an item without an id are hit, but it is not counted or named. Columns other than doc_id, item_id and text are unused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaxframe.llm import words as w
from vaxframe.sources.scratch import stage

WINDOW_WORDS = 10
#: Text bytes of a segment (or one document), and of a block of the benchmark.
SEGMENT_BYTES, BLOCK_BYTES = 256 << 10, 4 << 20
#: Segments of a row group: a reader holds a row group's columns at a time.
GROUP_ROWS = 16
#: Candidate starts that a task holds at a time.
CANDIDATES = 250_000

INDEX = "segment long, doc_ids array<long>, bounds binary, terms array<string>, offsets binary, places binary"


def _segments(batches):
    task, n = TaskContext.get(), 0
    base = (task.partitionId() if task else 0) << 32
    for batch in w.chunks(batches, max_bytes=SEGMENT_BYTES):
        flat, bounds = w.flat_words(batch.column("text"), w.ALNUM_LOWER)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        places = np.argsort(codes, kind="stable").astype(np.int32)
        offsets = np.searchsorted(codes[places], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array([base + n], pa.int64()), "doc_ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "bounds": pa.array([bounds.tobytes()], pa.binary()), "terms": pa.array([coded.dictionary.cast(pa.string())], pa.list_(pa.string())),
            "offsets": pa.array([offsets.tobytes()], pa.binary()), "places": pa.array([places.tobytes()], pa.binary())})
        n += 1


def positional_index(docs: DataFrame) -> DataFrame:
    """The stored index of (doc_id, text)."""
    rows = docs.select("doc_id", "text").mapInArrow(_segments, INDEX)
    return stage(rows, "index", {"parquet.block.row.count.limit": GROUP_ROWS})


class Windows:
    """The windows of a block of items: word numbers (-1: past the end of a short item), items, and words."""

    def __init__(self, item_ids: list, texts: list, width: int):
        flat, bounds = w.flat_words(pa.array(texts, pa.large_string()), w.ALNUM_LOWER)
        coded = flat.dictionary_encode()
        codes = np.append(coded.indices.to_numpy().astype(np.int64), -1)
        starts, items = w.starts_inside(bounds, width)
        grid = [codes[starts[:, None] + np.arange(width)]] if len(starts) else [np.empty((0, width), np.int64)]
        owners = [items]
        for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < width)):
            row = np.full((1, width), -1)
            row[0, : bounds[i + 1] - bounds[i]] = codes[bounds[i] : bounds[i + 1]]
            grid.append(row)
            owners.append([i])
        self.words, self.terms = np.concatenate(grid), pa.array(coded.dictionary, pa.string()) if len(flat) else pa.array([], pa.string())
        self.items = np.array([None if i is None else str(i) for i in item_ids], object)[np.concatenate(owners).astype(int)] if item_ids else np.empty(0, object)
        self.lengths = (self.words >= 0).sum(1)
        self.order = np.argsort(self.words < 0, axis=1, kind="stable")

    def by_rarity(self, counts: np.ndarray) -> None:
        """Order the offsets of each window from its rarest term on."""
        weight = np.where(self.words >= 0, counts[self.words], np.iinfo(np.int64).max)
        self.order = np.argsort(weight, axis=1, kind="stable")


class Segment:
    """One row of the index."""

    def __init__(self, row: dict, vocabulary: pa.Array):
        self.bounds = np.frombuffer(row["bounds"].as_buffer(), np.int64)
        offsets = np.frombuffer(row["offsets"].as_buffer(), np.int32)
        self.local = pc.fill_null(pc.index_in(vocabulary, row["terms"].values), -1).to_numpy().astype(np.int64)
        self.offsets, self.counts = offsets[:-1].astype(np.int64), np.diff(offsets)
        self.places = np.frombuffer(row["places"].as_buffer(), np.int32).astype(np.int64)
        self.size = len(self.places) + 1
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.size + self.places

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        wanted = term * self.size + place
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted) & (place >= 0) & (place < self.size - 1)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, place, side="right") - 1

    def candidates(self, windows: Windows):
        """(window, start) in bounded parts: windows with all terms, at every place of their rarest."""
        local = np.where(windows.words >= 0, self.local[windows.words] if len(self.local) else -1, 0)
        alive = np.flatnonzero((local >= 0).all(1))
        first = windows.order[alive, 0]
        term = local[alive, first]
        count = self.counts[term] if len(self.counts) else np.zeros(len(alive), np.int64)
        upto = np.cumsum(count)
        at = 0
        while at < len(alive):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
            part = slice(at, end)
            rows = w.ragged(self.offsets[term[part]], count[part])
            yield local, np.repeat(alive[part], count[part]), self.places[rows] - np.repeat(first[part], count[part])
            at = end

    def phrases(self, windows: Windows):
        """(window, start) of all exact occurrences inside one document."""
        found = []
        for local, window, start in self.candidates(windows):
            last = start + windows.lengths[window] - 1
            keep = (start >= 0) & (last < self.size - 1)
            keep[keep] = self.document(start[keep]) == self.document(last[keep])
            window, start = window[keep], start[keep]
            for k in range(1, windows.words.shape[1]):
                offset = windows.order[window, k]
                fits = (offset >= windows.lengths[window]) | self.holds(local[window, offset], start + offset)
                window, start = window[fits], start[fits]
            found.append((window, start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))

    def near(self, windows: Windows, slop: int):
        """(window, document): all words of the window, in any order, within its length plus ``slop`` words."""
        found = set()
        for local, window, start in self.candidates(windows):
            anchor = start + windows.order[window, 0]
            span = windows.lengths[window] + slop
            begin, end = self.bounds[self.document(anchor)], self.bounds[self.document(anchor) + 1]
            for shift in range(int(span.max(initial=0))):
                low = np.maximum(anchor - shift, begin)
                high = np.minimum(anchor - shift + span, end)
                fits = (shift < span) & (anchor - shift >= begin - slop)
                for k in range(1, windows.words.shape[1]):
                    offset = windows.order[window, k]
                    key = local[window, offset] * self.size
                    at = np.searchsorted(self.keys, key + low)
                    fits &= (offset >= windows.lengths[window]) | (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] < key + high)
                found.update(zip(window[fits].tolist(), self.document(anchor[fits]).tolist(), strict=True))
        return found


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}
    w.give_back()


def _term_counts(shared):
    def run(batches):
        terms = shared.value.terms
        total = np.zeros(len(terms), np.int64)
        for row in _rows(batches):
            segment = pc.index_in(terms, row["terms"].values)
            known = segment.is_valid().to_numpy(zero_copy_only=False)
            total[known] += np.diff(np.frombuffer(row["offsets"].as_buffer(), np.int32))[segment.drop_null().to_numpy()]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    return run


def _found_rows(shared):
    def run(batches):
        windows = shared.value
        for row in _rows(batches):
            segment = Segment(row, windows.terms)
            n_docs = len(segment.bounds) - 1
            window, start = segment.phrases(windows)
            change = np.zeros(segment.size, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + windows.lengths[window], -1)
            hits = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            owner = segment.document(hits)
            ends = np.searchsorted(owner, np.arange(n_docs + 1))
            items: list[set] = [set() for _ in range(n_docs)]
            for doc, item in zip(segment.document(start).tolist(), windows.items[window].tolist(), strict=True):
                if item is not None:
                    items[doc].add(item)
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([row["segment"].as_py()] * n_docs, pa.int64()), "number": pa.array(np.arange(n_docs), pa.int32()),
                "doc_id": row["doc_ids"].values, "n_words": pa.array(np.diff(segment.bounds), pa.int64()),
                "hits": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hits - segment.bounds[owner], pa.int32())),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))})

    return run


def _near_rows(shared, slop: int):
    def run(batches):
        windows = shared.value
        for row in _rows(batches):
            pairs = sorted({(doc, windows.items[k]) for k, doc in Segment(row, windows.terms).near(windows, slop) if windows.items[k] is not None})
            ids = row["doc_ids"].as_py()
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[d] for d, _ in pairs], pa.int64()), "item_id": pa.array([i for _, i in pairs], pa.string())})

    return run


def _blocks(index: DataFrame, benchmark: DataFrame, width: int):
    """Broadcast windows of each bounded block of the benchmark, with their terms' counts in the index known."""
    spark = index.sparkSession
    items = benchmark.selectExpr("item_id", "coalesce(text, '') as text").where("text <> ''")
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BLOCK_BYTES)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        windows = Windows([r.item_id for r in rows], [r.text for r in rows], width)
        counts = np.zeros(len(windows.terms) + 1, np.int64)
        for term, n in index.select("terms", "offsets").mapInArrow(_term_counts(spark.sparkContext.broadcast(windows)), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
            counts[term] = n
        windows.by_rarity(counts)
        yield spark.sparkContext.broadcast(windows)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, hits, items) of every document: the places of its hit words, and the items found in it."""
    index = positional_index(docs)
    parts = [index.mapInArrow(_found_rows(shared), "segment long, number int, doc_id long, n_words long, hits array<int>, items array<string>")
             for shared in _blocks(index, benchmark, width)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("segment", "number").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).drop("segment", "number")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, slop: int = 5) -> DataFrame:
    """(doc_id, item_id as string): documents where all words of a window stand within its length plus ``slop`` words."""
    index = positional_index(docs)
    rows = None
    for shared in _blocks(index, benchmark, width):
        part = index.mapInArrow(_near_rows(shared, slop), "doc_id long, item_id string")
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct()


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
