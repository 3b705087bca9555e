"""Removal of word spans that repeat elsewhere.

Two ways to say what "elsewhere" is:

* ``remove_reference_spans``: a stated reference table. Its texts are cut to shards of bounded size, each
  shard becomes a suffix automaton, the automata are broadcast one after another, and the documents stream
  past them: the matching statistic of a word is the length of the longest reference passage that ends there.
* ``remove_repeats``: the corpus is its own reference. Streaming all documents past automata of all documents
  costs the square of the corpus, so candidate windows come from content-chosen anchors and window
  fingerprints; no automaton takes part.

Defined results: a null or empty text has no words and keeps "". A document shorter than the threshold loses
nothing. Rows alike in id and text are separate documents, so each repeats the other. Every window is judged
on the input. Columns other than doc_id and text are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaxframe.llm import words as w
from vaxframe.llm.keys import maybe_in, row_key
from vaxframe.sources.scratch import stage

MIN_WORDS = 35
#: Words of the k-gram that anchors a window; any value below the window width gives the same results.
ANCHOR_WORDS = 8
#: A reference shard holds at most so many words.
SHARD_WORDS = 20_000

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class SuffixAutomaton:
    """Suffix automaton over word fingerprints; ``cut`` separates passages and matches nothing."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def cut(self) -> None:
        self.last = 0

    def add(self, word: int) -> None:
        """Append a word to the current passage (generalised construction: a known passage adds no state)."""
        nxt, link, length, last = self.next, self.link, self.length, self.last
        known = nxt[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            self.last = known
            return
        if known is not None:
            self.last = self._clone(last, known, word)
            return
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = state
            at = link[at]
        if at >= 0:
            target = nxt[at][word]
            link[state] = target if length[target] == length[at] + 1 else self._clone(at, target, word)
        self.last = state

    def _clone(self, at: int, target: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[target]))
        link.append(link[target])
        length.append(length[at] + 1)
        link[target] = twin
        while at >= 0 and nxt[at].get(word) == target:
            nxt[at][word] = twin
            at = link[at]
        return twin

    def statistics(self, hashes) -> list[int]:
        """For each word, the length of the longest passage part that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for word in hashes:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            step = nxt[state].get(word)
            if step is None:
                size = 0
            else:
                state, size = step, size + 1
            out.append(size)
        return out


def automata(passages, shard_words: int = SHARD_WORDS) -> list[SuffixAutomaton]:
    """One automaton per shard of whole passages; a passage longer than a shard has one for itself."""
    out, room = [], 0
    for passage in passages:
        if not out or room < len(passage):
            out.append(SuffixAutomaton())
            room = shard_words
        out[-1].cut()
        for word in passage:
            out[-1].add(int(word))
        room -= len(passage)
    return out


def matched_ends(shards: list[SuffixAutomaton], hashes: np.ndarray, min_words: int) -> np.ndarray:
    """Start positions of the ``min_words`` windows that some shard holds."""
    if not shards or len(hashes) < min_words:
        return np.empty(0, np.int64)
    listed = hashes.tolist()
    best = np.zeros(len(listed), np.int64)
    for shard in shards:
        known = shard.next[0]
        if any(x in known for x in listed[min_words - 1 :: min_words]):  # a match of min_words covers one of these
            best = np.maximum(best, shard.statistics(listed))
    return np.flatnonzero(best >= min_words) - min_words + 1


def covered(n_words: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of words inside any of the spans [start, end)."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def _emit(ids, flat, bounds, removed: np.ndarray):
    """Result rows of one chunk from the mask of removed words."""
    before = np.concatenate([[0], np.cumsum(~removed)])
    kept = w.joined(flat.filter(pa.array(~removed)), before[bounds])
    n_words = np.diff(bounds)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(before[bounds]), pa.int64()),
         pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


# ---- the stated reference -------------------------------------------------------------------


def remove_reference_spans(docs: DataFrame, reference: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text) without the maximal spans of at least ``min_words`` words that occur in a reference text.

    The reference is streamed to the driver in shards (``toLocalIterator``) and each shard's automaton is
    built where it is used; one pass over the documents holds the automata of one shard only. A reference
    of many shards means as many passes, which suits stated sets, not a corpus against itself.
    """
    spark = docs.sparkSession
    current = docs.select("doc_id", "text", F.lit(None).cast("array<int>").alias("hit"))
    for passages in _reference_shards(reference, shard_words):
        shared = spark.sparkContext.broadcast(passages)

        def mark(batches, shared=shared):
            shards = automata([w.word_hashes(pa.array(p, pa.large_string())).tolist() for p in shared.value], 1 << 62)
            for batch in w.chunks(batches):
                flat, bounds = w.flat_words(batch.column("text"), w.SPACES)
                hashes, hits = w.word_hashes(flat), []
                for i, old in enumerate(batch.column("hit").to_pylist()):
                    found = matched_ends(shards, hashes[bounds[i] : bounds[i + 1]], min_words)
                    hits.append(sorted({*(old or []), *found.tolist()}))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hits, pa.list_(pa.int32()))], names=["doc_id", "text", "hit"])

        current = current.mapInArrow(mark, "doc_id long, text string, hit array<int>")

    def cut(batches):
        for batch in w.chunks(batches):
            flat, bounds = w.flat_words(batch.column("text"), w.SPACES)
            removed = np.zeros(len(flat), bool)
            for i, starts in enumerate(batch.column("hit").to_pylist()):
                if starts:
                    at = np.array(starts)
                    removed[bounds[i] : bounds[i + 1]] = covered(bounds[i + 1] - bounds[i], at, at + min_words)
            before = np.concatenate([[0], np.cumsum(~removed)])
            kept = [x.decode() for x in w.joined(flat.filter(pa.array(~removed)), before[bounds])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return current.mapInArrow(cut, "doc_id long, text string")


def _reference_shards(reference: DataFrame, shard_words: int):
    shard, room = [], shard_words
    for row in reference.select("text").where("text is not null").toLocalIterator():
        words = w.flat_words(pa.array([row.text]), w.SPACES)[0].to_pylist()
        if shard and room < len(words):
            yield shard
            shard, room = [], shard_words
        shard.append(words)
        room -= len(words)
    if shard:
        yield shard


# ---- the corpus as its own reference ------------------------------------------------------------


def _window_anchors(hashes: np.ndarray, starts: np.ndarray, min_words: int, anchor_words: int) -> np.ndarray:
    """For each window, the position of its smallest k-gram fingerprint (the first of equals): equal windows choose equally."""
    grams = w.gram_hashes(hashes, anchor_words)
    best = np.arange(len(grams))
    span = 1
    need = min_words - anchor_words + 1
    while span < need:  # doubling: the best of `step` more places each time
        step = min(span, need - span)
        n = len(best) - step
        a, b = best[:n], best[step : step + n]
        best = np.where(grams[b] < grams[a], b, a)
        span += step
    return best[starts], grams


def _anchor_rows(min_words: int, anchor_words: int):
    def run(batches):
        for batch in w.chunks(batches):
            flat, bounds = w.flat_words(batch.column("text"), w.SPACES)
            starts, docs = w.starts_inside(bounds, min_words)
            if not len(starts):
                continue
            at, grams = _window_anchors(w.word_hashes(flat), starts, min_words, anchor_words)
            first = np.concatenate([[True], (at[1:] != at[:-1]) | (docs[1:] != docs[:-1])])
            at, docs = at[first], docs[first]
            keys = batch.column("key").to_numpy()[docs]
            table = pa.table({"anchor": grams[at].view(np.int64), "key": keys}).group_by(["anchor", "key"]).aggregate([([], "count_all")])
            yield from table.select(["anchor", "key", "count_all"]).rename_columns(["anchor", "key", "n"]).to_batches()

    return run


def _window_rows(min_words: int, anchor_words: int):
    """Windows with a repeated anchor. A fingerprint met twice in this task is known to repeat and is sent once,
    as a note for the other tasks; its places need no lookup. So no fingerprint has more rows than there are tasks."""

    def run(batches):
        held: dict[str, list] = {"h": [], "key": [], "s": []}
        size = 0
        for batch in w.chunks(batches):
            flat, bounds = w.flat_words(batch.column("text"), w.SPACES)
            starts, docs = w.starts_inside(bounds, min_words)
            if not len(starts):
                continue
            hashes = w.word_hashes(flat)
            at, grams = _window_anchors(hashes, starts, min_words, anchor_words)
            lists = batch.column("anchors")
            lengths = np.diff(lists.offsets.to_numpy())
            wanted = w.mix(lists.flatten().to_numpy().view(np.uint64)) ^ np.repeat(w.mix(np.arange(len(lengths), dtype=np.uint64)), lengths)
            found = np.isin(w.mix(grams[at]) ^ w.mix(docs.astype(np.uint64)), wanted)
            shown = batch.column("copied").to_numpy(zero_copy_only=False)[docs]
            prints = w.gram_hashes(hashes, min_words)[starts]
            if shown.any():
                yield from _notes(np.unique(prints[shown]))
            found &= ~shown
            if found.any():
                held["h"].append(prints[found])
                held["key"].append(batch.column("key").to_numpy()[docs[found]])
                held["s"].append((starts - bounds[:-1][docs])[found])
                size += int(found.sum())
            if size > 1_000_000:
                yield from _resolve(held)
                held, size = {"h": [], "key": [], "s": []}, 0
        if size:
            yield from _resolve(held)

    return run


def _notes(prints: np.ndarray):
    """Rows that tell the other tasks that these fingerprints repeat."""
    none = pa.array(np.full(len(prints), -1), pa.int32())
    table = pa.table({"h": prints.view(np.int64), "key": np.zeros(len(prints), np.int64), "lo": none, "hi": none, "n": np.full(len(prints), 2)})
    yield from table.to_batches(max_chunksize=200_000)


def _resolve(held):
    h, key, s = (np.concatenate(held[k]) for k in ("h", "key", "s"))
    distinct, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    rows = [(h[~twice].view(np.int64), key[~twice], s[~twice], s[~twice] + 1, np.ones((~twice).sum(), np.int64))]
    yield from _notes(distinct[counts > 1])
    k, p = key[twice], s[twice]
    if len(k):  # runs of consecutive places
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)])
        lo, last = p[new], np.concatenate([np.flatnonzero(new)[1:] - 1, [len(p) - 1]])
        own = w.mix(k[new].view(np.uint64) ^ w.mix(lo.astype(np.uint64) + np.uint64(1 << 40))).view(np.int64)
        rows.append((own, k[new], lo, p[last] + 1, np.full(len(lo), 2)))
    h, key, lo, hi, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    table = pa.table({"h": h, "key": key, "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32()), "n": pa.array(n, pa.int64())})
    yield from table.to_batches(max_chunksize=200_000)


def repeated_starts(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """(key, spans): for each row key the runs [lo, hi) of window starts whose word sequence starts elsewhere too.

    1. Every window's anchor is counted over the corpus: an anchor met once proves its windows unique.
    2. Documents with repeated anchors (found by key, behind a bounded filter, so that other texts are not
       shuffled) give their candidate windows' fingerprints.
    3. Fingerprints that occur twice are repeats. Each task has settled what it saw twice itself, so the rows
       of one fingerprint are at most as many as the tasks, however often a passage occurs.

    A text that another row has too repeats throughout (hi -1: to its end); one row of each such group shows
    its fingerprints to the other documents.
    """
    keyed = docs.select(row_key().alias("key"), "text")
    anchors = stage(keyed.mapInArrow(_anchor_rows(min_words, anchor_words), "anchor long, key long, n long"), "anchors")
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    marks = keyed.select("key", F.xxhash64("text").alias("t"))
    groups = marks.groupBy("t").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1").drop("n")
    copies = stage(marks.join(groups, "t").groupBy("key").agg(F.max(F.expr("key = first")).alias("copied")), "copies")
    wanted = stage(
        maybe_in(anchors, "anchor", repeated).join(repeated, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
        .join(copies, "key", "left").where("coalesce(copied, true)").withColumn("copied", F.expr("copied is not null")), "wanted")
    candidates = maybe_in(keyed, "key", wanted.select("key")).join(wanted, "key")
    windows = candidates.mapInArrow(_window_rows(min_words, anchor_words), "h long, key long, lo int, hi int, n long")
    total = F.sum("n").over(Window.partitionBy("h")).alias("total")
    found = windows.select("key", "lo", "hi", total).where("total > 1 and lo >= 0").groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return found.unionByName(copies.select("key", F.expr("array(named_struct('lo', 0, 'hi', -1))").alias("spans")))


def _cut_rows(min_words: int):
    def run(batches):
        for batch in w.chunks(batches):
            flat, bounds = w.flat_words(batch.column("text"), w.SPACES)
            removed = np.zeros(len(flat), bool)
            spans = batch.column("spans")
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                runs = spans[i].values
                lo, hi = (runs.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi"))
                n = int(bounds[i + 1] - bounds[i])
                hi = np.where(hi < 0, max(n - min_words + 1, 0), hi)
                removed[bounds[i] : bounds[i + 1]] = covered(n, lo[lo < hi], hi[lo < hi] - 1 + min_words)
            yield _emit(batch.column("doc_id"), flat, bounds, removed)

    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of what is kept."""
    spans = stage(repeated_starts(docs, min_words, anchor_words), "repeats")
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    joined = keyed.join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_rows(min_words), RESULT)
